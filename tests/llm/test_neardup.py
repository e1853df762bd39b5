import random

import numpy as np
import pytest

from cellweave.llm import common, neardup
from cellweave.llm.common import Scratch, components
from cellweave.llm.neardup import near_duplicates


def brute(texts, words, percent):
    """Component and set size of each id, by comparing all pairs."""
    sets = {}
    for k, t in texts:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return {k: (len(sets[k]), root[k]) for k in sets}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed, sizes=((40, 3, 60), (30, 8, 120), (20, 2, 12))):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d", "A b\tC d", "a b c d e"]
    for n, edits, length in sizes:
        base = " ".join(f"v{rng.randrange(10**6)}" for _ in range(length))
        texts += family(rng, base, n, edits)
    line = " ".join(f"common{k}" for k in range(12))
    texts += [line + "\n" + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30))) for _ in range(120)]
    texts += [" ".join(f"r{rng.randrange(40)}" for _ in range(30)) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def run(spark, texts, **options):
    df = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, n long")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("words,percent", [(4, 80), (5, 80), (2, 60)])
def test_components_equal_brute_force(spark, words, percent):
    texts = corpus(words)
    assert run(spark, texts, words=words, percent=percent) == brute(texts, words, percent)


@pytest.mark.parametrize("rounds", [1, 6])
def test_large_sets_of_candidates_lose_no_link(spark, monkeypatch, rounds):
    """With small limits, families go through pivots, and with one round also through the join on rarest shingles."""
    for name, value in (("NODE", 4), ("SMALL_DOCS", 5), ("ROUNDS", rounds), ("LEVELS", 2)):
        monkeypatch.setattr(neardup, name, value)
    texts = corpus(9, ((60, 9, 60), (40, 12, 60)))
    assert run(spark, texts, words=4) == brute(texts, 4, 80)


def test_pairs_that_cannot_be_linked_are_not_measured(spark):
    """Variants of one set that share rare members, and near copies: all links are found, and few other pairs are held against each other."""
    rng = np.random.default_rng(5)
    picked = [np.where(rng.random(147) < 0.2, rng.integers(1, 5, 147), 0) for _ in range(60)]
    for x in picked[:20]:
        picked.append(np.where(rng.random(147) < 0.04, 9, x))
    sets = [np.unique(np.arange(147, dtype=np.uint64) * np.uint64(10) + x.astype(np.uint64)) for x in picked]
    rows = [(1, k, len(x), bytearray(x.tobytes()), k) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "cluster long, id long, n long, hashes binary, comp long")
    got = {(r.id, r.other): r.inter for r in neardup._confirm_by_prefix(df, 80, Scratch(spark, "test")).collect()}
    links = {(i, j) for i in range(80) for j in range(i + 1, 80) if neardup._linked(neardup.shared(sets[i], sets[j]), 147, 147, 80)}
    assert len(links) > 15 and links <= got.keys() and len(got) < 3 * len(links)
    assert all(neardup.shared(sets[i], sets[j]) == n for (i, j), n in got.items())


def test_rows_without_ids_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (7, 2, 3, False)]
    assert near_duplicates(df.where("false")).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}


def written(monkeypatch):
    """The names of the tables that are written from now on."""
    names, store = [], Scratch.store
    monkeypatch.setattr(Scratch, "store", lambda self, df, name: names.append(name) or store(self, df, name))
    return names


@pytest.mark.parametrize("most,tables", [(None, 2), (30, None)])
def test_few_links_end_in_one_task_and_many_by_stars(spark, monkeypatch, most, tables):
    if most:
        monkeypatch.setattr(common, "LAST_LINKS", most)
    names = written(monkeypatch)
    edges = [(k, (7 * k + 3) % 400) for k in range(300)] + [(k, k + 1) for k in range(1000, 1060)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(8), Scratch(spark, "test")).collect()}
    root = {k: k for e in edges for k in e}
    while any(root[a] != root[b] for a, b in edges):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert len(names) == tables if tables else "cc1" in names


@pytest.mark.parametrize("last", [0, neardup.LAST_PAIRS])
def test_few_pairs_of_large_nodes_end_the_levels(spark, monkeypatch, last):
    """A family of copies in one node goes through pivots and levels, or is compared as it is: the same components, with fewer tables."""
    monkeypatch.setattr(neardup, "LAST_PAIRS", last)
    names = written(monkeypatch)
    texts = corpus(3, ((150, 6, 60),))
    assert run(spark, texts, words=4) == brute(texts, 4, 80)
    assert len([n for n in names if n.startswith("found")]) == 1 and ("held0" in names) == (not last)
    assert len(names) <= (25 if last else 40)


def exact_components(texts, words, percent):
    """Component of each id by an exact join: two linked sets share one of the rarest of each, n - ceil(percent n / 100) + 1 of them."""
    import math
    from collections import Counter, defaultdict

    import numpy as np

    sets = {k: neardup.shingles(t, words) for k, t in texts}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def link(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    classes = {}
    for k in sorted(sets):
        if len(sets[k]) and classes.setdefault(sets[k].tobytes(), k) != k:
            link(classes[sets[k].tobytes()], k)
    df = Counter()
    for k in classes.values():
        df.update(sets[k].tolist())
    seen = defaultdict(list)
    for k in classes.values():
        s = sets[k]
        n = len(s)
        rare = sorted(s.tolist(), key=lambda t: (df[t], t))[: n - math.ceil(percent * n / 100) + 1]
        near = {j for t in rare if df[t] > 1 for j in seen[t]}
        for j in near:
            m = len(sets[j])
            if 100 * min(n, m) >= percent * max(n, m) and find(j) != find(k):
                inter = int(np.isin(s, sets[j], assume_unique=True).sum())
                if 100 * inter >= percent * (n + m - inter):
                    link(j, k)
        for t in rare:
            if df[t] > 1:
                seen[t].append(k)
    return {k: find(k) for k in sets}


def test_recall_on_the_given_tables(spark):
    """All documents of the largest given table against an exact join: at most one in a thousand may be in another component."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    expected = exact_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 4, 80)
    found = {r.doc_id: r.component_id for r in near_duplicates(docs, words=4).collect()}
    assert found.keys() == expected.keys()
    wrong = [k for k in found if found[k] != expected[k]]
    assert len(wrong) <= len(found) / 1000, wrong[:20]
