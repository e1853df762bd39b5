"""Near-duplicate documents by a chosen-path set similarity join, confirmed on whole shingle sets.

After Christiani, Pagh and Sivertsen, "Scalable and robust set similarity join"
(2018). Each document is embedded as SIZE minwise tokens: small sets by SIZE hash
functions, large ones by the least member in each of SIZE parts of one hash's range
(Shrivastava 2017), those between by both, so that documents which may be linked
always share a kind. A node of a tree picks
coordinates by its own hash, one over the similarity on average; documents
that agree there go on to the same child. Small nodes are compared exhaustively,
large ones branch further. Coordinates at the root stand for TREES independent
trees.

The trees only say which documents may belong together: a spanning forest of
candidates. All links are then confirmed on full sets, within each connected set
of candidates, in a way that loses no link whatever the set's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, maybe_in, pick, prepare

#: Minwise tokens of a document; trees; levels below which large nodes are joined whole.
SIZE, TREES, LEVELS = 64, 8, 4
#: Documents in a node that are compared exhaustively.
NODE = 64
#: Documents of each large node and pairs of all of them, up to which a level compares them exhaustively too and is the last.
LAST_NODE, LAST_PAIRS = 4096, 1 << 26
#: Documents of a large node that one task holds against its pivots.
SPLIT = 4096
#: Documents and shingles of a set of candidates that one task confirms; rounds of pivots for larger ones.
SMALL_DOCS, SMALL_SHINGLES, ROUNDS = 256, 1 << 20, 3

#: Sets of up to LARGE members have the first kind of tokens; from `percent` of that on, the second.
LARGE = 256

SIGNATURES = "doc_id bigint, n bigint, f1 bigint, f2 bigint, roots0 array<int>, roots1 array<int>, sig0 binary, sig1 binary"


class _Hashes(dict):
    """The hash of each word, kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _Hashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20180)
_MUL = _SEEDS.integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _SEEDS.integers(0, 2**63, SIZE, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; words are runs without ASCII white space, A-Z lower-cased."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 300_000:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    take = min(words, len(h))
    n = len(h) - take + 1
    out = np.full(n, take, np.uint64)
    for k in range(take):
        out = out * _ODD + h[k : k + n]
    return np.unique(_mix(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of SIZE hash functions over a set, as 32 bits."""
    least = np.full(SIZE, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 8192):
        np.minimum(least, ((hashes[None, k : k + 8192] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


#: Pivots of a large node.
PIVOTS = 6


@dataclass(frozen=True)
class Limits:
    """What follows from the similarity that is looked for."""

    #: Coordinates taken at the root, for TREES trees; how many more than one a node takes, in percent.
    roots: int
    more: int
    #: Equal coordinates of SIZE that make a candidate, 5 deviations under the similarity; that let a document belong to a pivot whose other partners' partners it may be; that take it out of the node.
    alike: int
    near: int
    core: int

    @classmethod
    def of(cls, percent: int) -> "Limits":
        if not 0 < percent <= 100:
            raise ValueError("a similarity is over 0 and at most 100 percent")
        p = percent / 100
        q = max(2 * p - 1, 0.0)  # two links away at least
        under = lambda x, deviations: int(SIZE * x - deviations * (SIZE * x * (1 - x)) ** 0.5)
        return cls(min(SIZE, math.ceil(TREES / p)), min(100, round(100 / p) - 100), min(SIZE, max(1, under(p, 5) + 1)), max(1, under(q, 3.67)), max(1, under(p, 1.6)))

#: For a part without members, the parts it asks in turn.
_ASK = np.stack([np.random.default_rng(k).permutation(SIZE) for k in range(SIZE)])
_BOUNDS = np.arange(SIZE, dtype=np.uint64) << np.uint64(64 - SIZE.bit_length() + 1)


def parted_signature(hashes: np.ndarray) -> np.ndarray:
    """The least member of each of SIZE equal parts of the range, of sorted hashes; a part without any takes the first that it asks."""
    at = np.searchsorted(hashes, _BOUNDS)
    end = np.append(at[1:], len(hashes))
    least = _mix(hashes[np.minimum(at, len(hashes) - 1)])
    full = end > at
    if not full.all():
        for k in np.flatnonzero(~full).tolist():
            least[k] = least[next(j for j in _ASK[k].tolist() if full[j])]
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(x) -> int:
    return int(np.uint64(x).view(np.int64))


def _signatures(words: int, percent: int):
    count = Limits.of(percent).roots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, kinds = [], [], [], ([], [])
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                f1.append(_signed(s.sum(dtype=np.uint64)))
                f2.append(_signed(np.bitwise_xor.reduce(s * _ODD)) if len(s) else 0)
                kinds[0].append(signature(s) if 0 < len(s) <= LARGE else None)
                kinds[1].append(parted_signature(s) if 100 * len(s) >= percent * LARGE and len(s) else None)
            roots = [pa.array([None if x is None else x[:count] for x in k], pa.list_(pa.int32())) for k in kinds]
            sigs = [pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in k], pa.binary()) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), *roots, *sigs], names=["doc_id", "n", "f1", "f2", "roots0", "roots1", "sig0", "sig1"])

    return run


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by it."""
    carry = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if carry is None else pa.concat_tables([carry, t]).combine_chunks()
        keys = t.column(key).to_numpy()
        start = 0
        for cut in np.flatnonzero(keys[1:] != keys[:-1]) + 1:
            yield t.slice(start, cut - start)
            start = int(cut)
        carry = t.slice(start)
    if carry is not None and len(carry):
        yield carry


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _find(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIZE)


def _against_pivots(limits: Limits):
    """For each document of a large node the first pivot that it is near to, and whether it is at a pivot's core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _bytes(batch.column("sig"))
            pivots = batch.column("pivots").combine_chunks() if hasattr(batch.column("pivots"), "combine_chunks") else batch.column("pivots")
            counts = pivots.value_lengths().to_numpy()
            flat = pivots.flatten()
            ids, owner = flat.field("id").to_numpy(), np.repeat(np.arange(len(sig)), counts)
            alike = (_bytes(flat.field("sig")) == sig[owner]).sum(axis=1)
            near, core = np.full(len(sig), -1), np.zeros(len(sig), bool)
            for k in np.flatnonzero(alike >= limits.near)[::-1].tolist():
                near[owner[k]] = k
            np.logical_or.at(core, owner, alike >= limits.core)
            pivot = pa.array([None if k < 0 else int(ids[k]) for k in near.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "kind", "node", "sig")), pivot, pa.array(core)], names=["id", "kind", "node", "sig", "pivot", "core"])

    return run


def _compare_node(limits: Limits):
    """A spanning forest of the documents of each node that agree in limits.alike coordinates at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in sorted_groups(batches, "node"):
            ids = t.column("id").to_pylist()
            sig = _bytes(t.column("sig"))
            parent = list(range(len(ids)))
            for i in range(1, len(ids)):
                for j in np.flatnonzero((sig[:i] == sig[i]).sum(axis=1) >= limits.alike):
                    x, y = _find(parent, i), _find(parent, int(j))
                    if x != y:
                        parent[x] = y
                        a.append(ids[i])
                        b.append(ids[j])
            if len(a) > 5000:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)

    return run


def candidates(reps: DataFrame, scratch: Scratch, limits: Limits) -> DataFrame:
    """Edges (a, b) between documents (id, kind, roots, sig) that the trees bring together.

    A family of copies is never split by branching. So the documents of a large
    node are first held against a few of them, its pivots: each is joined to a
    pivot that it is near to. Those at a pivot's core then leave the node, for what
    may be linked to them is near to the pivot as well, and so is joined already.
    """
    nodes = reps.select("id", "kind", "sig", F.explode(F.array(*(F.xxhash64(F.lit(c), "kind", F.col("roots")[c]) for c in range(limits.roots)))).alias("node"))
    found, small = [], []
    for level in range(LEVELS):
        # only the ids of nodes meet at first; signatures follow where a node has two documents at least
        counts = scratch.store(nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("least")).where("size > 1"), f"counts{level}")
        big = F.when(F.col("size") > NODE, F.col("size"))
        several, most, pairs = counts.agg(F.count("*"), F.coalesce(F.max(big), F.lit(0)), F.coalesce(F.sum(big * big), F.lit(0))).first()
        last = most <= LAST_NODE and pairs <= LAST_PAIRS
        # a plain join of two shuffles: the adaptive planner can split a node that holds a large share of all rows
        met = scratch.store(maybe_in(nodes, "node", counts, several).join(counts.hint("merge"), "node"), f"met{level}")
        scratch.drop(f"counts{level}", *([f"nodes{level}"] if level else []))
        small.append((met if last else met.where(F.col("size") <= NODE)).select("node", "id", "sig"))
        if last:
            break
        large = met.where(F.col("size") > NODE)
        if level == LEVELS - 1:
            found.append(large.where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b")))
        else:
            chosen = large.groupBy("node", "size").agg(*(F.min_by(F.struct("id", "sig"), F.xxhash64(F.lit(j), "id")).alias(f"p{j}") for j in range(PIVOTS)))
            # a part of a node for each SPLIT documents: its pivots go to all parts
            parts = F.ceil(F.col("size") / SPLIT).cast("int")
            chosen = chosen.select("node", F.array_distinct(F.array(*(f"p{j}" for j in range(PIVOTS)))).alias("pivots"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
            held = large.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).join(chosen.hint("merge"), ["node", "part"])
            held = scratch.store(held.mapInArrow(_against_pivots(limits), "id bigint, kind int, node bigint, sig binary, pivot bigint, core boolean"), f"held{level}")
            found.append(scratch.store(held.where("pivot is not null and pivot != id").select(F.col("id").alias("a"), F.col("pivot").alias("b")), f"near{level}"))
            pick_one = [F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(SIZE)).cast("int") for k in (1, 2)]
            at = F.when(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(100)) < limits.more, F.array(*pick_one)).otherwise(F.array(pick_one[0]))
            rest = held.where("not core").select("id", "kind", "node", "sig", F.explode(at).alias("at")).select("id", "kind", "sig", F.xxhash64("node", "at", F.substring("sig", F.col("at") + 1, F.lit(1))).alias("node"))
            nodes = scratch.store(rest, f"nodes{level + 1}")
            scratch.drop(f"held{level}")
    # the small nodes of all levels are compared in one step
    small = reduce(DataFrame.union, small).repartition("node").sortWithinPartitions("node")
    found.append(scratch.store(small.mapInArrow(_compare_node(limits), "a bigint, b bigint"), "found"))
    return reduce(DataFrame.union, found)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), batch.column("parts")], names=["cluster", "id", "n", "hashes", "parts"])

    return run


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Members that two sorted sets have in common."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def _linked(inter: int, n: int, m: int, percent: int) -> bool:
    return 100 * inter >= percent * (n + m - inter)


def _confirm_small(percent: int, words: int = 0):
    """Links of small sets of candidates, whose rows carry hashes or, if `words` is given, texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of a small set of candidates, but for those that are connected already."""
        for t in sorted_groups(batches, "cluster"):
            ids = t.column("id").to_pylist()
            sets = [shingles(x, words) for x in t.column("text").to_pylist()] if words else [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
            order = sorted(range(len(ids)), key=lambda k: len(sets[k]))
            parent, a, b = list(range(len(ids))), [], []
            for p, i in enumerate(order):
                for j in order[p + 1 :]:
                    if 100 * len(sets[i]) < percent * len(sets[j]):
                        break
                    x, y = _find(parent, i), _find(parent, j)
                    if x != y and _linked(shared(sets[i], sets[j]), len(sets[i]), len(sets[j]), percent):
                        parent[x] = y
                        a.append(ids[i])
                        b.append(ids[j])
            yield _edges(a, b)

    return run


def _confirmed(small: DataFrame, percent: int, words: int = 0) -> DataFrame:
    return small.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_confirm_small(percent, words), "a bigint, b bigint")


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, id, other, n, m, inter) of pairs that carry both sets."""
    for batch in batches:
        inter = [shared(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("hashes").to_pylist(), batch.column("others").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("cluster", "id", "other", "n", "m")] + [pa.array(inter, pa.int64())], names=["cluster", "id", "other", "n", "m", "inter"])


OVERLAPS = "cluster bigint, id bigint, other bigint, n bigint, m bigint, inter bigint"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cluster, id_, n, comp, raw in zip(*(batch.column(c).to_pylist() for c in ("cluster", "id", "n", "comp", "hashes"))):
            yield pa.RecordBatch.from_arrays([pa.array([x] * n, pa.int64()) for x in (cluster, id_, n, comp)] + [pa.array(np.frombuffer(raw, np.int64))], names=["cluster", "id", "n", "comp", "token"])


def _confirm_by_prefix(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Overlaps of all pairs of a cluster that can reach `percent` and are not connected yet (of different comp).

    Such a pair shares one of the rarest shingles of each, n - ceil(percent * n /
    100) + 1 of them. Of a shingle's documents one comp holds the most; of a pair
    one at least isn't of that comp, so only these look for partners, and what is
    connected already is never paired. Both have a place for their last shared
    one of these: all that they share is what they share up to there, and at most
    what either has after it; and, as one's rarest end before the other's, at most
    what one has behind its rarest. Pairs that can't reach `percent` so are not measured.
    """
    tokens = sets.mapInArrow(_tokens, "cluster bigint, id bigint, n bigint, comp bigint, token bigint")
    df = scratch.store(tokens.groupBy("cluster", "token").agg(F.count("*").alias("df"), (F.min("comp") != F.max("comp")).alias("several")).where("df > 1"), "df")
    ranked = tokens.join(df, ["cluster", "token"], "left").selectExpr("cluster", "id", "n", "comp", "token", "several", "row_number() over (partition by cluster, id order by coalesce(df, 1), token) as place")
    prefix = scratch.store(ranked.where(F.expr(f"several and place <= n - ceil({percent} * n / 100) + 1")).select("cluster", "id", "n", "comp", "token", "place"), "prefix")
    most = prefix.groupBy("cluster", "token", "comp").agg(F.count("*").alias("k")).groupBy("cluster", "token").agg(F.max_by("comp", F.struct("k", "comp")).alias("most"))
    few = prefix.join(most, ["cluster", "token"]).where("comp != most")
    other = prefix.select("cluster", "token", F.col("id").alias("other"), F.col("n").alias("m"), F.col("comp").alias("its"), F.col("place").alias("its_place"))
    # a row for each shared token: if neither is of the comp with the most, the smaller id looks for the other
    met = few.join(other, ["cluster", "token"]).where(f"comp != its and (its = most or id < other) and 100 * least(n, m) >= {percent} * greatest(n, m)")
    pairs = met.selectExpr("cluster", "least(id, other) as id", "greatest(id, other) as other", "n + m as members", f"ceil({percent} * greatest(n, m) / 100) - 1 as behind", "if(id < other, n - place, m - its_place) as after", "if(id < other, m - its_place, n - place) as its_after")
    pairs = pairs.groupBy("cluster", "id", "other").agg(F.first("members").alias("members"), (F.count("*") + F.least(F.min("after"), F.min("its_after"), F.first("behind"))).alias("most"))
    pairs = pairs.where(f"100 * most >= {percent} * (members - most)").select("cluster", "id", "other")
    pairs = scratch.store(pairs, "pairs")
    scratch.drop("df", "prefix")
    both = pairs.join(sets.select("cluster", "id", "n", "hashes"), ["cluster", "id"]).join(sets.select("cluster", F.col("id").alias("other"), F.col("n").alias("m"), F.col("hashes").alias("others")), ["cluster", "other"])
    return both.mapInArrow(_overlap, OVERLAPS)


def _confirm_large(sets: DataFrame, percent: int, scratch: Scratch) -> list[DataFrame]:
    """Edges of large sets of candidates (cluster, id, n, hashes, parts).

    A round takes two pivots of each cluster and measures all its documents
    against them, which links the bulk of a family of copies. Jaccard distance is
    a metric: with the best pivot p, and u the least distance to p of those not
    linked to p, a document linked to p can only have a link to one of these if
    its own distance to p is at least u less the allowed distance. All others are
    settled. The next round's first pivot is the document most alike to the last
    best one: of a family of copies, one near its middle. What became small is
    compared in pairs; what stays large after ROUNDS goes to an exact join on rarest
    shingles, of documents that are not connected by then. A cluster's documents are dealt over
    its parts, and its pivots go to all of them.
    """
    edges: list[DataFrame] = []
    far = 1 - percent / 100
    link = F.expr(f"100 * inter >= {percent} * (n + m - inter)")
    for k in range(ROUNDS):
        near_best = F.max_by("id", F.struct("alike", F.xxhash64(F.lit(k), "id"))) if k else F.min_by("id", F.xxhash64(F.lit(-1), "id"))
        least = sets.groupBy("cluster", "parts").agg(near_best.alias("p0"), F.min_by("id", F.xxhash64(F.lit(k), "id")).alias("p1"))
        chosen = least.select("cluster", F.explode(F.array_distinct(F.array("p0", "p1"))).alias("id"))
        pivots = sets.join(chosen, ["cluster", "id"]).select("cluster", F.col("id").alias("other"), F.col("n").alias("m"), F.col("hashes").alias("others"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        dealt = sets.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        near = scratch.store(dealt.join(pivots.hint("merge"), ["cluster", "part"]).mapInArrow(_overlap, OVERLAPS), f"near{k}").withColumn("link", link)
        near = near.withColumn("d", F.expr("1 - inter / (n + m - inter)"))
        edges.append(near.where("link and id != other").select(F.col("id").alias("a"), F.col("other").alias("b")))
        best = near.groupBy("cluster", "other").agg(F.count_if("link").alias("links"), F.min(F.when(~F.col("link"), F.col("d"))).alias("u"))
        best = best.groupBy("cluster").agg(F.max_by(F.struct("other", "u"), F.struct("links", "other")).alias("best")).where("best.u is not null").select("cluster", "best.other", "best.u")
        left = near.join(best, ["cluster", "other"]).where(~F.col("link") | (F.col("d") >= F.col("u") - F.lit(far + 1e-9)))
        left = left.groupBy("cluster", "id").agg(F.max(F.when(F.col("id") != F.col("other"), 1 - F.col("d")).otherwise(0.0)).alias("alike"))
        left = scratch.store(sets.drop("alike").join(left, ["cluster", "id"]), f"left{k}")
        sizes = left.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
        fits = (F.col("docs") <= SMALL_DOCS) & (F.col("total") <= SMALL_SHINGLES) | (F.col("docs") <= 2)
        sizes = scratch.store(sizes.select("cluster", fits.alias("fits")), f"sizes{k}")
        rest = left.join(sizes, "cluster")
        scratch.drop(f"left{k - 1}" if k else "sets", *([f"sizes{k - 1}"] if k else []))
        small, large = sizes.agg(F.count_if("fits"), F.count_if(~F.col("fits"))).first()
        if small:
            edges.append(scratch.store(_confirmed(rest.where("fits").select("cluster", "id", "hashes"), percent), f"late{k}"))
        sets = rest.where("not fits").drop("fits")
        if not large:
            break
    else:
        known = components(reduce(DataFrame.unionByName, edges), scratch, "known").withColumnRenamed("component", "comp")
        apart = scratch.store(sets.join(known, "id", "left").select("cluster", "id", "n", "hashes", F.coalesce("comp", "id").alias("comp")), "apart")
        found = _confirm_by_prefix(apart, percent, scratch).where(link).select(F.col("id").alias("a"), F.col("other").alias("b"))
        edges.append(scratch.store(found, "last"))
    return edges


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connected components of documents whose shingle sets have a Jaccard similarity of `percent` / 100 or more.

    Returns a row for each row of `docs`: doc_id, n_shingles (distinct shingles of
    `words` words; a shorter text has one, its whole sequence), component_id (the
    smallest id that can be reached over links, itself included) and kept (doc_id
    = component_id). Texts with one set of shingles form a class, which takes part
    in the join once. Null, empty and blank texts have no shingles and no links.
    A row without an id can't be named: it is not linked, has a null component_id
    and is kept. Rows that repeat an id are one document with several texts.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "neardup")
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    marks = scratch.store(rows.mapInArrow(_signatures(words, percent), SIGNATURES), "marks")
    reps = scratch.store(marks.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("roots0", "roots1", "sig0", "sig1"))), "reps")
    both = F.array(*(F.struct(F.col(f"roots{k}").alias("roots"), F.col(f"sig{k}").alias("sig")) for k in (0, 1)))
    signed = reps.select("id", F.posexplode(both).alias("kind", "s")).where("s.sig is not null").select("id", "kind", "s.roots", "s.sig")
    spread = components(candidates(signed, scratch, Limits.of(percent)), scratch, "spread").withColumnRenamed("component", "cluster")
    spread = scratch.store(spread.join(reps.select("id", "n"), "id"), "spread")
    scratch.keep("marks", "reps", "spread")
    sizes = spread.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    fits = (F.col("docs") <= SMALL_DOCS) & (F.col("total") <= SMALL_SHINGLES)
    clusters = scratch.store(spread.drop("n").join(sizes.select("cluster", fits.alias("fits"), F.ceil(F.col("docs") / SPLIT).cast("int").alias("parts")), "cluster"), "clusters")
    several, large = clusters.agg(F.count("*"), F.count_if(~F.col("fits"))).first()
    # of the texts, only those of candidates are shuffled
    wanted = clusters.withColumnRenamed("id", "doc_id")
    texts = maybe_in(rows, "doc_id", wanted.select("doc_id"), several).join(wanted.hint("merge"), "doc_id").select("cluster", F.col("doc_id").alias("id"), "text", "fits", "parts")
    texts = scratch.store(texts, "texts")
    scratch.drop("spread", "clusters")
    edges = [scratch.store(_confirmed(texts.where("fits").select("cluster", "id", "text"), percent, words), "sure")]
    if large:
        sets = scratch.store(texts.where("not fits").mapInArrow(_sets(words), "cluster bigint, id bigint, n bigint, hashes binary, parts int"), "sets")
        edges += _confirm_large(sets, percent, scratch)
    scratch.drop("texts")
    # a class whose smallest ids repeat in others is joined with them by its rows' ids
    joined = components(reduce(DataFrame.unionByName, edges), scratch, "links")
    classes = reps.select("f1", "f2", "n", "id").join(joined, "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component_id"))
    classes = scratch.store(classes, "classes")
    scratch.keep("marks", "classes")
    known = marks.where("n > 0 and doc_id is not null").select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    bare = marks.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return known.union(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
