"""Aligned tokens, near vectors and centroid clusters against brute force and SQL."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from cellweave.llm import align, cluster, neighbours

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# aligned tokens


def byte_tokens(text):
    """(ids, bytes) of both vocabularies for a blank and the text, whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    table = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}
    a = [(i, bytes(table[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if (p := sp.id_to_piece(i))[:3] == "<0x" and len(p) == 6 else p.replace("▁", " ").encode()) for i in sp.encode(text)]
    return a, b


def brute_alignment(texts):
    """By sets of byte offsets, without labels."""
    found = {}
    for doc, text in texts:
        a, b = byte_tokens(text) if text else ([], [])
        own = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != own or b"".join(x for _, x in b) != own:
            found[doc] = None
            continue

        def groups(tokens, cuts):
            out, at = defaultdict(list), 0
            for i, x in tokens:
                out[min(c for c in cuts if c > at)].append(i)
                at += len(x)
            return out

        ends = [set(np.cumsum([len(x) for _, x in t]).tolist()) for t in (a, b)]
        cuts = sorted(ends[0] & ends[1])
        ga, gb = groups(a, cuts), groups(b, cuts)
        found[doc] = [(ga[c], gb[c]) for c in cuts]
    of = {d: Counter((p, q) for x, y in g or [] for p in x for q in y) for d, g in found.items()}
    df = Counter(p for c in of.values() for p in c)
    most = defaultdict(int)
    for (p, _), n in df.items():
        most[p] = max(most[p], n)
    out = []
    for d, g in found.items():
        if g is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        c = of[d]
        out.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if df[p] == most[p[0]]), sum(n * df[p] for p, n in c.items()), hashlib.sha256(line.encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = [None, "", " ", "a", "a  b", "\n", "Hello, world!\nDon't stop…", "x<s>y <|endoftext|> z", "日本語 テキスト é́", "▁a", "a\r\nb {\r", "t\tu\x1cv  w", "trail  ", "naïve café.\n\nOne\nTwo", "ab" * 300, "Hello, world!\nDon't stop…"]


@pytest.mark.parametrize("held", [1 << 18, 5])
def test_alignment_equals_brute_force(spark, held):
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()]
    texts = given + [(1000 + k, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], "doc_id bigint, text string, n_a string, pairs int")
    got = align.alignment(df, A, B, held_pairs=held)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got) == brute_alignment(texts)


def test_alignment_of_nothing_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id bigint, text string")
    got = align.alignment(df, A, B).collect()
    assert len(got) == 3 and {r.count_sum for r in got} == {6} and sum(r.doc_id is None for r in got) == 1
    assert align.alignment(df.where("false"), A, B).count() == 0
    groups = {r.doc_id: r.groups for r in align.token_groups(df.limit(2), A, B).collect()}
    assert [(g.start, g.stop) for g in groups[7]] == [(0, 2), (2, 4)]


def test_labels_of_bytes():
    assert align.label_string([b" ab", b"c", b"d"], [b" a", b"bc", b"d"]) == b"02133"
    assert align.spans(b"02133") == [(0, 4, 2, 2), (4, 5, 1, 1)]


def test_long_group_of_many_links():
    with_ = align.aligner(A, B)
    text = "x" * 4000 + " and so on"
    assert with_._segment(" " + text, with_.b.encode(text)).n_links == sum(s.n_links for s in with_.batch([text])[0])


def test_new_segments_are_encoded_together(monkeypatch):
    """Not one call of A for each; white space alone, marks of other scripts and special tokens stand between words."""
    texts = ["one two, zwölf\n\nthree###  ", " \n", "one tail \t", "<|endoftext|> 日本語 é́ fin."]
    with_ = align.Aligner(A, B)
    expected = [with_.whole(t) for t in texts]
    calls = []
    monkeypatch.setattr(with_, "_ids_a", lambda text, own=with_._ids_a: calls.append(text) or own(text))
    got = with_.batch(texts)
    assert [";".join(s.text for s in row) for row in got] == [s.text for s in expected]
    assert [tuple(sum(s[k] for s in row) for k in range(1, 5)) for row in got] == [s[1:5] for s in expected]
    assert all(t.isspace() for t in calls)


# near vectors

EMBEDDINGS = "vec_id bigint, embedding array<float>, label int, n int, id string"


def planted(seed, n, dims=16):
    """Directions at random, chains and dense clumps around some of them, copies, and rows that can't link."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dims) for _ in range(n)]
    for k in range(12):
        c = rng.normal(size=dims)
        out += [c + rng.normal(size=dims) * s for s in np.linspace(0.02, 0.45, 20)]
    c = rng.normal(size=dims)
    out += [c + rng.normal(size=dims) * 0.08 for _ in range(150)]
    out += [out[3]] * 40 + [out[3] * 2, out[4] * 1e18, out[4]]
    table = [(k, [float(x) for x in v], int(rng.integers(0, 2)) if k % 7 else 0, 1, "x") for k, v in enumerate(out)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dims, [1.0] * (dims - 1) + [None], [nan] * dims, [inf] * dims, [1.0, 2.0], [2.0, 4.0]]
    table += [(5000 + k, v, 1, 2, None) for k, v in enumerate(odd)]
    table += [(6000, [float(x) for x in out[5]], None, 1, None), (None, [float(x) for x in out[6]], 1, 1, None), (7, [float(x) for x in out[7]], 0, 1, None)]
    order = rng.permutation(len(table))
    return [table[k] for k in order]


def by_sql(table, schema, sql):
    import pandas as pd

    con = duckdb.connect()
    con.register("given", pd.DataFrame(table, columns=["vec_id", "embedding", "label"]))
    con.execute("create table embeddings as select vec_id::bigint as vec_id, embedding::float[] as embedding, label::int as label from given")
    return sorted((tuple(r) for r in con.execute(sql).fetchall()), key=str)


@pytest.mark.parametrize(("shard", "overlap"), [(1024, 3), (48, 3)])
def test_near_vectors_equal_all_pairs(spark, shard, overlap):
    table = planted(shard, 400)
    got = rows(neighbours.near_vectors(spark.createDataFrame(table, EMBEDDINGS), shard=shard, overlap=overlap))
    want = by_sql([(r[0], r[1], r[2]) for r in table], None, neighbours.near_vectors_sql())
    n_got, n_want = sum(r[1] for r in got), sum(r[1] for r in want)
    assert len(got) == len(want)
    if shard > len(table):
        assert got == want
    else:
        # split again and again, so that a few links between far shards may be missed, and none is too many
        assert 0.98 * n_want <= n_got <= n_want
        assert sum(a[0] == b[0] and a[2] == b[2] for a, b in zip(got, want)) >= 0.98 * len(want)


def test_near_vectors_of_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert neighbours.near_vectors(empty).collect() == []
    one = spark.createDataFrame([(9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (4, [1.0, 0.1], 1), (2, [1.0, 0.1], 2)], "vec_id bigint, embedding array<float>, label int")
    assert rows(neighbours.near_vectors(one)) == [(2, 0, 2, True), (4, 2, 4, True), (9, 2, 4, False), (9, 2, 4, False)]


def test_audit_sees_what_is_missed(spark):
    df = spark.createDataFrame([(k, [1.0, 0.01 * k], 1) for k in range(10)], "vec_id bigint, embedding array<float>, label int")
    found = neighbours.nodes(df)
    true = found.selectExpr("id", "sig", "9l as n")
    assert neighbours.audit(found, true, 0.93) == 1
    assert neighbours.audit(found, true.where("id >= 5"), 0.93) == 0.5


def test_graph_reaches_all():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=8) + 0.01 * rng.normal(size=(300, 8))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    lists = neighbours.pruned(v, 8)
    seen, front = {neighbours._medoid(v)}, [neighbours._medoid(v)]
    while front:
        front = [int(y) for x in front for y in lists[x] if y >= 0 and int(y) not in seen and not seen.add(int(y))]
    assert len(seen) == 600


# clusters


def brute_clusters(table, k, rounds, size, scale, salt):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in table if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=mark)[:k]]
    d = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    for r in range(rounds + 1):
        at = [min(range(len(c)), key=lambda j: (d(v, c[j]), j)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                own = [v for (_, v), x in zip(kept, at) if x == j]
                if own:
                    c[j] = [sum(x) // len(own) for x in zip(*own)]
    dist = [d(v, c[j]) for (_, v), j in zip(kept, at)]
    per = Counter()
    for j, x in zip(at, dist):
        per[j] += x
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((i, j, x, per[j], sum(dist), digest[j]) for (i, _), j, x in zip(kept, at, dist)), key=str)


@pytest.mark.parametrize("coarse", [False, True])
def test_clusters_equal_brute_force(spark, coarse):
    rng = np.random.default_rng(5)
    table = [(k, [float(x) for x in (rng.integers(-2, 3, 3) if coarse else rng.normal(size=3))]) for k in range(300)]  # coarse: many ties
    table += [(k, v) for k, v in enumerate([None, [], [1.0, 2.0], [1.0, None, 2.0], [float("nan")] * 3, [float("inf")] * 3, [0.5] * 3, [0.5] * 3])] + [(None, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in table], "vec_id bigint, embedding array<float>, cluster int, v string")
    table = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in table]
    got = rows(cluster.centroid_clusters(df, k=12, rounds=4, size=3, scale=16, salt="s"))
    assert got == brute_clusters(table, 12, 4, 3, 16, "s")


def test_clusters_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [-1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert rows(cluster.centroid_clusters(df, size=2)) == brute_clusters([(1, [1.0, 2.0]), (2, [-1.0, 0.0])], 40, 5, 2, 256, "2:")
    assert cluster.centroid_clusters(df, size=3).collect() == []
    with pytest.raises(Exception, match="too large"):
        cluster.centroid_clusters(df.selectExpr("vec_id", "transform(embedding, x -> x * 1e20) as embedding"), size=2).collect()


def test_bounds_skip_distances_and_keep_ties():
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (2000, 6))
    c = v[:20].copy()
    at, up, low = cluster.start(v, c)
    total = 0
    for _ in range(6):
        new = np.array([v[at == j].sum(0) // max(1, (at == j).sum()) if (at == j).any() else c[j] for j in range(20)])
        moved = np.nextafter(np.sqrt(((new - c) ** 2).sum(1)), np.inf)
        c = new
        at, up, low, worked = cluster.assign(v, at, up, low, c, moved)
        total += worked
        d = ((v[:, None, :] - c[None]) ** 2).sum(2)
        assert (at == d.argmin(1)).all() and (up.astype(float) ** 2 >= d[np.arange(2000), at] * (1 - 1e-9)).all() and (low.astype(float) ** 2 <= d * (1 + 1e-9)).all()
    assert total < 6 * 2000 * 20 / 2
    big = v * (1 << 21)
    assert (cluster.start(big, big[:20])[0] == ((big[:, None, :] - big[None, :20]) ** 2).sum(2).argmin(1)).all()


@pytest.mark.parametrize("name", ["op12_near_vectors", "op13_centroid_clusters"])
def test_given_tables_equal_sql(spark, name):
    from cellweave.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.select(names)) == sorted((tuple(r) for r in want.fetchall()), key=str)
