"""Vectors of one label that point the same way: a flat graph built in overlapping shards, searched by range, audited and verified.

1. Equal vectors of a label are one node. Nodes of a label are dealt to shards by
   the nearest of pivots drawn from them, and to the next nearest ones too; shards
   that are too large are split again.
2. Each shard builds a graph: a node's candidates are its nearest nodes and some
   at random, thinned by robust pruning. A node's lists from all its shards are
   united.
3. Each node is searched for in all its shards: from the shard's medoid (and from
   itself) greedily along the graph, then outwards from every node in range or nearly so. Where a
   node in range is at home in another shard, the search goes on there, from it.
4. Cosines that count are computed in double precision from whole vectors.
5. Some nodes, chosen by hash, are compared with all vectors. Where the search
   found less than the recall asked for, everything is repeated with more shards
   for each node and longer lists; if that doesn't help, it is an error.

Links are counted where the other node is at home, so each counts once, and go on
only as a spanning forest of each task, so no table holds all pairs.

Vectors that are null, empty or zero or hold null or non-finite components, and
those without a label or id, link with nothing; without an id they have no
component either and are kept. Vectors of different lengths don't link. Rows that repeat count each; rows
of one id are in one component. An empty table gives an empty table. Columns
beside vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, pick, prepare

#: Nodes of a shard, about; it is split beyond twice as many. Pivots a shard is split by at once, at most.
SHARD, PIVOTS = 256, 256
#: Candidates of a node: nearest and random ones; what distances may be longer by to be pruned.
NEAREST, RANDOM, ALPHA = 40, 16, 1.2
#: Queries searched together, pairs whose cosines are computed at once, and queries of a task.
TOGETHER, PAIRS, TASK = 256, 1 << 17, 8192
#: Nodes of an audit (queries against all vectors), and rows of classes that are broadcast at most.
AUDITED, SMALL = 512, 1 << 16
#: Nodes beyond the range that are looked at on the way: up to so many times the angle.
SLACK = 1.25


def nodes(vectors: DataFrame) -> DataFrame:
    """(id, sig, label, v, copies): equal vectors of a label that can link at all, by their smallest id. id and sig name a node."""
    own = usable(vectors)
    return own.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).select("id", F.xxhash64("label", "v").alias("sig"), "label", "v", "copies")


def _rows(vectors: DataFrame) -> DataFrame:
    own = pick(vectors, vec_id="vec_id", label="label", v="embedding")
    return own.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("v").alias("v"))


def usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return _rows(vectors).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of doubles, scaled by powers of two to about 1 (no cosine changes), and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    a = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    a = np.ldexp(a, -np.frexp(np.abs(a).max(1, initial=0))[1][:, None]) if a.size else a
    return a, np.sqrt(np.einsum("ij,ij->i", a, a))


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


# shards


def _split(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and salt, pivots first: each other row once for each of its nearest pivots."""
    at, pivots, names = None, None, None
    for batch in batches:
        place = list(zip(batch.column("shard").to_pylist(), batch.column("salt").to_pylist()))
        kind = batch.column("kind").to_numpy()
        k = 0
        while k < len(place):
            end = k
            while end < len(place) and place[end] == place[k] and kind[end] == kind[k]:
                end += 1
            part = batch.slice(k, end - k)
            v, size = matrix(part.column("v"))
            v = v / size[:, None]
            ids = part.column("sig").to_numpy()
            if kind[k] == 0:
                again = at == place[k]
                pivots, names = (np.concatenate([pivots, v]), np.concatenate([names, ids])) if again else (v, ids)
                at = place[k]
            elif at != place[k]:
                yield part.select(OUT)  # no pivot was drawn: they stay together until the next try
            else:
                # equal distances are broken by hash, so that vectors of one direction are spread
                close = v @ pivots.T + (((ids[:, None] ^ names[None, :]) * np.int64(0x9E3779B97F4A7C1) >> 40) & 1023) * 1e-13
                home = part.column("home").to_numpy(zero_copy_only=False)
                order = np.argsort(-close, 1, kind="stable")[:, :overlap]
                row, rank = np.nonzero((np.arange(order.shape[1]) == 0) | home[:, None])
                taken = part.take(pa.array(row)).select(OUT)
                shard = [f"{place[k][0]}/{p}" for p in names[order[row, rank]].tolist()]
                yield taken.set_column(0, "shard", pa.array(shard, pa.string())).set_column(1, "home", pa.array(home[row] & (rank == 0)))
            k = end


OUT = ["shard", "home", "id", "sig", "label", "v", "copies"]


def shards(found: DataFrame, scratch: Scratch, overlap: int, size: int = SHARD) -> DataFrame:
    """(shard, home, id, sig, label, v, copies): nodes in the shards of their nearest pivots; home in the nearest one."""
    now = found.select(F.concat_ws(":", "label", F.size("v").cast("string")).alias("shard"), F.lit(True).alias("home"), "id", "sig", "label", "v", "copies")
    done = None
    schema = now.schema
    for level in range(40):
        counts = scratch.store(now.groupBy("shard").agg(F.count("*").alias("n")), f"sizes{level}")
        large = counts.where(F.col("n") > 2 * size)
        some = large.limit(1).count()
        small = now.join(large, "shard", "left_anti") if some else now
        done = small.select(OUT) if done is None else done.unionByName(small.select(OUT))
        if not some:
            return done
        salts = F.ceil(F.col("n") / (8 * TASK)).cast("int")
        mine = now.join(large, "shard").withColumn("salts", salts)
        drawn = F.pmod(F.xxhash64("sig", F.lit(level)), F.lit(1 << 40)) < F.least(F.lit(PIVOTS), F.ceil(overlap * F.col("n") / size)) / F.col("n") * (1 << 40)
        kinds = [mine.where(drawn).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("kind", F.lit(0)), mine.withColumn("salt", F.pmod("sig", "salts").cast("int")).withColumn("kind", F.lit(1))]
        both = kinds[0].unionByName(kinds[1]).select(*OUT, "salt", "kind")
        dealt = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        now = scratch.store(dealt.mapInArrow(lambda b: _split(b, overlap), schema), f"level{level}")
    raise ValueError("shards didn't get smaller")


# graph


def pruned(v: np.ndarray, degree: int, seed: int = 0) -> np.ndarray:
    """Rows of neighbours (-1 where there are fewer) of unit vectors, by robust pruning, with the way back added."""
    n = len(v)
    if n < 2:
        return np.full((n, 1), -1)
    rng = np.random.default_rng(seed)
    near = min(NEAREST, n - 1)
    out = []
    for k in range(0, n, TOGETHER):
        own = np.arange(k, min(n, k + TOGETHER))
        s = v[own] @ v.T
        s[np.arange(len(own)), own] = -2
        cand = np.concatenate([np.argpartition(-s, near - 1, 1)[:, :near], rng.integers(0, n, (len(own), RANDOM))], 1)
        out.append(_thinned(v, own, cand, degree))
    forward = np.concatenate(out)
    # the way back: sources of each node, nearest first, thinned with its own list
    a, b = np.repeat(np.arange(n), degree), forward.ravel()
    a, b = a[b >= 0], b[b >= 0]
    close = np.einsum("ij,ij->i", v[a], v[b])
    order = np.lexsort((-close, b))
    a, b = a[order], b[order]
    rank = np.arange(len(b)) - np.searchsorted(b, b)
    keep = rank < degree
    back = np.full((n, degree), -1)
    back[b[keep], rank[keep]] = a[keep]
    lists = np.concatenate([_thinned(v, np.arange(k, min(n, k + TOGETHER)), np.concatenate([forward, back], 1)[k : k + TOGETHER], degree) for k in range(0, n, TOGETHER)])
    return _reachable(v, _both_ways(lists, 3))


def _both_ways(lists: np.ndarray, first: int) -> np.ndarray:
    """With the way back of each node's first edges, which pruning may have taken: else some nodes of a dense place have no way in."""
    n = len(lists)
    b, a = lists[:, :first].ravel(), np.repeat(np.arange(n), min(first, lists.shape[1]))
    a, b = a[b >= 0], b[b >= 0]
    new = ~(lists[b] == a[:, None]).any(1)
    a, b = a[new], b[new]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    rank = np.arange(len(b)) - np.searchsorted(b, b)
    more = np.full((n, rank.max(initial=-1) + 1), -1)
    more[b, rank] = a
    return np.concatenate([lists, more], 1)


def _thinned(v: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
    """Of candidates, nearest first, those that no one taken before is much nearer to."""
    d = 1 - np.einsum("rcd,rd->rc", v[cand], v[own])
    d[(cand < 0) | (cand == own[:, None])] = np.inf
    order = np.argsort(d, 1)
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    again = np.zeros(cand.shape, bool)
    by = np.argsort(cand, 1, kind="stable")
    sorted_ = np.take_along_axis(cand, by, 1)
    np.put_along_axis(again, by[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
    alive = np.isfinite(d) & ~again
    between = 1 - np.einsum("rcd,red->rce", v[cand], v[cand])
    rows, out = np.arange(len(own)), np.full((len(own), degree), -1)
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = cand[rows, first][some]
        alive &= ~(ALPHA * ALPHA * between[rows, first] <= d) | ~some[:, None]
        alive[rows, first] = False
    return out


def _medoid(v: np.ndarray) -> int:
    return int((v @ v.mean(0)).argmax())


def _reachable(v: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """With one more column, by which what can't be reached from the medoid is tied to the nearest reached node."""
    n, spare = len(lists), np.full((len(lists), 1), -1)
    lists = np.concatenate([lists, spare], 1)
    seen = np.zeros(n, bool)
    front = np.array([_medoid(v)])
    seen[front] = True
    while True:
        while len(front):
            nxt = np.unique(lists[front])
            nxt = nxt[nxt >= 0]
            front = nxt[~seen[nxt]]
            seen[front] = True
        left = np.flatnonzero(~seen)
        if not len(left):
            return lists
        free = np.flatnonzero(seen & (lists[:, -1] < 0))
        if not len(free):
            lists = np.concatenate([lists, spare], 1)
            free = np.flatnonzero(seen)
        s = v[free] @ v[left[:TOGETHER]].T
        i, j = np.unravel_index(s.argmax(), s.shape)
        lists[free[i], -1] = left[j]
        front = left[j : j + 1]
        seen[front] = True


# search


def search(v: np.ndarray, size: np.ndarray, lists: np.ndarray, q: np.ndarray, q_size: np.ndarray, starts: list[list[int]], threshold: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, nodes) whose cosine reaches the threshold, for some queries at a time.

    Greedy: the best `beam` nodes met so far, four of them expanded at a time. Then
    all nodes in range, and up to SLACK times its angle, are expanded until none is left.
    """
    n, entry = len(v), _medoid(v / size[:, None])
    loose = math.cos(min(math.pi, SLACK * math.acos(max(-1.0, min(1.0, threshold)))))
    loose = min(loose, threshold)

    def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a))
        for k in range(0, len(a), PAIRS):
            i, j = a[k : k + PAIRS], b[k : k + PAIRS]
            out[k : k + PAIRS] = np.einsum("ij,ij->i", q[i], v[j]) / (q_size[i] * size[j])
        return out

    for k in range(0, len(q), TOGETHER):
        own = np.arange(k, min(len(q), k + TOGETHER))
        m = len(own)
        seen = np.zeros((m, n), bool)
        first = [(r, s) for r, x in enumerate(own) for s in {entry, *starts[x]}]
        r, s = np.array([x[0] for x in first]), np.array([x[1] for x in first])
        seen[r, s] = True
        c = cosine(own[r], s)
        met = [(r, s, c)]
        # lists of the best nodes: number, cosine, expanded
        best, close, gone = np.zeros((m, beam), int), np.full((m, beam), -np.inf), np.ones((m, beam), bool)
        wide = np.full((m, max(beam, int(np.bincount(r, minlength=m).max()))), -np.inf)
        number = np.zeros(wide.shape, int)
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        wide[r, rank], number[r, rank] = c, s
        order = np.argsort(-wide, 1)[:, :beam]
        best, close = np.take_along_axis(number, order, 1), np.take_along_axis(wide, order, 1)
        gone = ~np.isfinite(close)
        while True:
            open_ = np.where(gone, -np.inf, close)
            pick_ = np.argpartition(-open_, 3, 1)[:, :4]
            row, col = np.nonzero(np.isfinite(np.take_along_axis(open_, pick_, 1)))
            if not len(row):
                break
            at = pick_[row, col]
            gone[row, at] = True
            r = np.repeat(row, lists.shape[1])
            s = lists[best[row, at]].ravel()
            r, s = _fresh(r[s >= 0], s[s >= 0], seen)
            if not len(r):
                continue
            c = cosine(own[r], s)
            met.append((r, s, c))
            order = np.argsort(r, kind="stable")
            r, s, c = r[order], s[order], c[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            more = np.full((m, rank.max() + 1), -np.inf)
            which = np.zeros(more.shape, int)
            more[r, rank], which[r, rank] = c, s
            close, best, gone = np.concatenate([close, more], 1), np.concatenate([best, which], 1), np.concatenate([gone, ~np.isfinite(more)], 1)
            order = np.argpartition(-close, beam - 1, 1)[:, :beam]
            close, best, gone = (np.take_along_axis(x, order, 1) for x in (close, best, gone))
        r, s, c = (np.concatenate([x[i] for x in met]) for i in range(3))
        found = [(r[c >= threshold], s[c >= threshold])]
        front_r, front_s = r[c >= loose], s[c >= loose]
        while len(front_r):
            step = max(1, PAIRS // lists.shape[1])
            nr, ns = [], []
            for at in range(0, len(front_r), step):
                x = lists[front_s[at : at + step]].ravel()
                y = np.repeat(front_r[at : at + step], lists.shape[1])
                y, x = _fresh(y[x >= 0], x[x >= 0], seen)
                c = cosine(own[y], x)
                found.append((y[c >= threshold], x[c >= threshold]))
                nr.append(y[c >= loose])
                ns.append(x[c >= loose])
            front_r, front_s = np.concatenate(nr), np.concatenate(ns)
        yield own[np.concatenate([x[0] for x in found])], np.concatenate([x[1] for x in found])


def _fresh(r: np.ndarray, s: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs not seen yet, once each; they are seen from now on."""
    new = ~seen[r, s]
    r, s = r[new], s[new]
    key = np.unique(r * seen.shape[1] + s)
    r, s = key // seen.shape[1], key % seen.shape[1]
    seen[r, s] = True
    return r, s


def _roots(n: int, links: list[tuple[np.ndarray, np.ndarray]], root: np.ndarray | None = None) -> np.ndarray:
    """The smallest number that each of n can reach."""
    root = np.arange(n) if root is None else root
    for a, b in links:
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root != (up := root[root])).any():
                root = up
    return root


FOUND = "kind int, id bigint, sig bigint, n bigint, other bigint, shard string, entries array<bigint>"
BUILT = "shard string, home boolean, id bigint, sig bigint, near array<bigint>"


def _build(part: pa.Table, degree: int) -> pa.Table:
    order = np.lexsort((_longs(part.column("sig")), _longs(part.column("id"))))
    part = part.take(pa.array(order))
    v, size = matrix(part.column("v"))
    lists = pruned(v / size[:, None], degree)
    sig = _longs(part.column("sig"))
    near = [sig[x[x >= 0]].tolist() for x in lists]
    return pa.table([*(part.column(c) for c in ("shard", "home", "id", "sig")), pa.array(near, pa.list_(pa.int64()))], names=["shard", "home", "id", "sig", "near"])


def _searched(members: pa.Table, queries: pa.Table | None, threshold: float, beam: int) -> pa.Table:
    """Rows of FOUND of one shard: 0 links of a node (n), 1 two ids of one component (id, other), 2 where a node must be searched for too (shard, entries)."""
    order = np.lexsort((_longs(members.column("sig")), _longs(members.column("id"))))
    members = members.take(pa.array(order))
    v, size = matrix(members.column("v"))
    ids, sig, copies = (_longs(members.column(c)) for c in ("id", "sig", "copies"))
    by = np.argsort(sig, kind="stable")
    near = members.column("near").combine_chunks()
    near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
    flat, count = near.flatten().to_numpy().astype(np.int64), np.diff(near.offsets.to_numpy())
    at = np.minimum(np.searchsorted(sig[by], flat), len(sig) - 1)
    here = sig[by][at] == flat  # neighbours in other shards are met there
    row = np.repeat(np.arange(len(count)), count)[here]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    lists = np.full((len(ids), max(1, int(rank.max(initial=0)) + 1)), -1)
    lists[row, rank] = by[at[here]]
    shard = members.column("shard")[0].as_py()
    home = np.array(members.column("home").to_pylist(), object)
    if queries is None:
        q, q_size, q_ids, q_sig = v, size, ids, sig
        visits, starts, place = [set(x) for x in members.column("shards").to_pylist()], [[k] for k in range(len(ids))], np.arange(len(ids))
    else:
        q, q_size = matrix(queries.column("v"))
        q_ids, q_sig = _longs(queries.column("id")), _longs(queries.column("sig"))
        visits = [set(x) for x in queries.column("visited").to_pylist()]
        number = dict(zip(sig.tolist(), range(len(sig))))
        starts = [[number[s] for s in x if s in number] for x in queries.column("entries").to_pylist()]
        place = len(ids) + np.arange(len(q_ids))
    names = np.concatenate([ids, q_ids]) if queries is not None else ids
    root, out = np.arange(len(names)), []
    others = home != shard
    for a, b in search(v, size, lists, q, q_size, starts, threshold, beam):
        other = (ids[b] != q_ids[a]) | (sig[b] != q_sig[a])
        a, b = a[other], b[other]
        root = _roots(len(names), [(place[a], b)], root)
        mine = ~others[b]
        n = np.zeros(len(q_ids), np.int64)
        np.add.at(n, a[mine], copies[b[mine]])
        out += [(0, int(q_ids[x]), int(q_sig[x]), int(n[x]), None, None, None) for x in np.flatnonzero(n)]
        go: dict[tuple[int, str], list[int]] = {}
        for x, y in zip(a[~mine].tolist(), b[~mine].tolist()):
            if home[y] not in visits[x]:
                go.setdefault((x, home[y]), []).append(int(sig[y]))
        out += [(2, int(q_ids[x]), int(q_sig[x]), None, None, to, entries[:8]) for (x, to), entries in go.items()]  # starts, from which all else is reached
    out += [(1, int(names[x]), None, None, int(names[root[x]]), None, None) for x in np.flatnonzero(root != np.arange(len(root)))]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
    return pa.table([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["kind", "id", "sig", "n", "other", "shard", "entries"])


def links(found: DataFrame, scratch: Scratch, threshold: float, overlap: int, degree: int, beam: int, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Of nodes: (id, sig, n), the linked rows of other nodes for each that has any, and (a, b), links that connect all ids that are connected."""
    dealt = scratch.store(shards(found, scratch, overlap, shard), "shards")
    built = scratch.store(dealt.groupBy("shard").applyInArrow(lambda t: _build(t, degree), BUILT), "built")
    # as many lists as a node has shards
    united = built.groupBy("id", "sig").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max(F.when(F.col("home"), F.col("shard"))).alias("home"), F.collect_set("shard").alias("shards"))
    graph = scratch.store(dealt.drop("home").join(united, ["id", "sig"]), "graph")
    scratch.drop("shards", "built")
    rounds = [scratch.store(graph.groupBy("shard").applyInArrow(lambda t: _searched(t, None, threshold, beam), FOUND), "search0")]
    visited = graph.select("id", "sig", "shard").distinct()
    while True:
        sent = rounds[-1].where("kind = 2").groupBy("id", "sig", "shard").agg(F.slice(F.array_distinct(F.flatten(F.collect_list("entries"))), 1, 64).alias("entries"))
        todo = scratch.store(sent.join(visited, ["id", "sig", "shard"], "left_anti"), f"todo{len(rounds)}")
        per = todo.groupBy("shard").agg(F.ceil(F.count("*") / TASK).cast("int").alias("blocks"))
        if not todo.limit(1).count():
            break
        visited = scratch.store(visited.unionByName(todo.select("id", "sig", "shard")), f"visited{len(rounds)}")
        been = visited.groupBy("id", "sig").agg(F.collect_set("shard").alias("visited"))
        asked = todo.join(been, ["id", "sig"]).join(found.select("id", "sig", "v"), ["id", "sig"]).join(per, "shard").withColumn("block", F.pmod(F.xxhash64("id", "sig"), F.col("blocks")).cast("int"))
        asked = scratch.store(asked, f"asked{len(rounds)}")
        ready = graph.join(per, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        one = lambda m, q: _searched(m, q, threshold, beam) if len(m) and len(q) else NONE
        rounds.append(scratch.store(ready.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(one, FOUND), f"search{len(rounds)}"))
    everything = rounds[0]
    for r in rounds[1:]:
        everything = everything.unionByName(r)
    n = everything.where("kind = 0").groupBy("id", "sig").agg(F.sum("n").alias("n"))
    return scratch.store(n, "links"), everything.where("kind = 1").select(F.col("id").alias("a"), F.col("other").alias("b"))


NONE = pa.table([pa.array([], kind) for kind in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))], names=["kind", "id", "sig", "n", "other", "shard", "entries"])


def audit(found: DataFrame, counted: DataFrame, threshold: float, queries: int = AUDITED) -> float:
    """The part of the links of `queries` nodes, chosen by hash and compared with all nodes, that `counted` holds; 1 if there are none."""
    some = found.orderBy(F.xxhash64("id", "sig"), "id", "sig").limit(queries).select("id", "sig", "label", "v").toArrow()  # a stated set of queries
    if not len(some):
        return 1.0
    rows = some.to_pylist()
    sets = {}
    for x in rows:
        sets.setdefault((x["label"], len(x["v"])), []).append(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {k: (matrix(pa.array([x["v"] for x in part])), np.array([x["id"] for x in part]), np.array([x["sig"] for x in part])) for k, part in sets.items()}
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), np.diff(batch.column("v").offsets.to_numpy()).tolist()))
            for key in set(keys) & set(ready):
                part = batch.take(pa.array([k for k, x in enumerate(keys) if x == key]))
                (q, q_size), ids, sigs = ready[key]
                v, size = matrix(part.column("v"))
                own, sig, copies = (part.column(c).to_numpy() for c in ("id", "sig", "copies"))
                near = np.einsum("ij,kj->ik", q, v) / (q_size[:, None] * size[None, :]) >= threshold
                near &= (ids[:, None] != own[None, :]) | (sigs[:, None] != sig[None, :])
                for i, n in enumerate((near * copies).sum(1).tolist()):
                    total[ids[i], sigs[i]] = total.get((ids[i], sigs[i]), 0) + n
        at = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([int(x[0]) for x in at], pa.int64()), pa.array([int(x[1]) for x in at], pa.int64()), pa.array([total[x] for x in at], pa.int64())], names=["id", "sig", "n"])

    true = found.select("id", "sig", "label", "v", "copies").mapInArrow(run, "id bigint, sig bigint, n bigint").groupBy("id", "sig").agg(F.sum("n").alias("n"))
    met = true.join(counted.withColumnRenamed("n", "got"), ["id", "sig"], "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("got", F.lit(0))))).first()
    return met[1] / met[0] if met[0] else 1.0


def near_vectors(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.98, overlap: int = 3, degree: int = 16, beam: int = 32, shard: int = SHARD) -> DataFrame:
    """A row for each vector: vec_id, n_links (other vectors of its label with a cosine of at least `threshold`), component_id (the smallest id that links lead to) and kept (it is its component's)."""
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "neighbours")
    found = scratch.store(nodes(vectors), "nodes")
    for _ in range(3):
        counted, edges = links(found, scratch, threshold, overlap, degree, beam, shard)
        reached = audit(found, counted, threshold)
        if reached >= recall:
            break
        overlap, degree, beam = overlap + 2, 2 * degree, 2 * beam
    if reached < min(recall, 0.9):
        raise ValueError(f"the search found only {reached:.3f} of the links audited")
    joined = scratch.store(components(edges, scratch), "components")
    # nodes with links or copies; what isn't among them has neither
    copied = found.where("copies > 1")
    part = counted.join(copied.select("id", "sig", F.col("copies")), ["id", "sig"], "full").select("id", "sig", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n"))
    result = part.join(joined.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select("id", "sig", "n", F.coalesce("component", "id").alias("component_id"))
    result = scratch.store(result, "result")
    scratch.keep("nodes", "result")
    rows = _rows(vectors).withColumn("sig", F.xxhash64("label", "v"))
    usable_ = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    classes = copied.select("id", "sig", "label", "v").join(result, ["id", "sig"]).select(F.col("label").alias("l"), F.col("v").alias("w"), F.col("id").alias("head"), "n", "component_id")
    if copied.limit(SMALL + 1).count() <= SMALL:
        classes = F.broadcast(classes)
    met = rows.join(classes, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")) & usable_, "left")
    twins = met.where("head is not null").select("vec_id", F.col("n").alias("n_links"), "component_id")
    alone = met.where("head is null").select("vec_id", "sig").join(result.withColumnsRenamed({"id": "i", "sig": "s"}), (F.col("vec_id") == F.col("i")) & (F.col("sig") == F.col("s")), "left")
    alone = alone.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return twins.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def near_vectors_sql(threshold: float = 0.93) -> str:
    """The same over a table `embeddings` in SQL, every pair of a label compared."""
    return f"""with recursive numbered as materialized (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
kept as materialized (
  select * from numbered
  where vec_id is not null and label is not null and len(v) > 0
    and list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(v, lambda x: x <> 0))),
linked as materialized (
  select a.r as ra, a.vec_id as a, b.vec_id as b from kept a join kept b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r
  where list_cosine_similarity(a.v, b.v) >= {threshold}),
reach as (
  select a, b from linked
  union
  select r.a, l.b from reach r join linked l on r.b = l.a),
low as (select a, min(b) as b from reach group by a)
select e.vec_id, count(l.ra) as n_links, least(e.vec_id, min(low.b)) as component_id, coalesce(e.vec_id <= min(low.b), true) as kept
from numbered e left join linked l on l.ra = e.r left join low on low.a = e.vec_id
group by e.r, e.vec_id"""
