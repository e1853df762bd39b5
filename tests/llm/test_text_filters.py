import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from cellweave.llm import counts, decontaminate, substrings, toxicity
from cellweave.llm.common import Scratch
from cellweave.llm.queries import vocabulary

DATA, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def words(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n))


# substrings


def test_gear_hash_equals_its_sum_and_forgets():
    data = np.frombuffer(random.Random(1).randbytes(200), np.uint8)
    h = substrings.gear(data)
    for k in range(200):
        assert h[k] == sum(int(substrings._GEAR[data[k - j]]) << j for j in range(min(substrings.WINDOW, k + 1))) % 2**16
    moved = substrings.gear(np.concatenate([np.zeros(7, np.uint8), data]))
    assert (moved[7 + substrings.WINDOW :] == h[substrings.WINDOW :]).all()


def test_cuts_resist_insertions():
    rng = random.Random(2)
    text = words(rng, 400).encode()

    def chunks(raw):
        at = [*substrings.cuts(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
        return {raw[x:y] for x, y in zip(at, at[1:])}

    a, b = chunks(text), chunks(text[:700] + b" put in " + text[700:])
    assert len(a - b) <= 4 < len(a) / 4 and sum(map(len, a)) == len(text)


def test_repeated_passages_are_found_and_cut(spark):
    rng = random.Random(3)
    passages = [words(rng, 70) for _ in range(6)]
    clean = {k: words(rng, 120) for k in range(40)}
    held = {100 + k: words(rng, 30) + "\n" + passages[k % 6] + "\n" + words(rng, 25) + " end" for k in range(30)}
    docs = {**clean, **held, 200: None, 201: "", 202: " \n ", 203: "short", 204: "short"}
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in docs.items()] + [(100, held[100], 1, "s"), (None, held[101], 1, "s")], "doc_id long, text string, fp int, source string")
    rows = substrings.repeated_spans(df).collect()
    assert {r.doc_id for r in rows} == set(range(101, 130)) - {102, 103, 104, 105} or {r.doc_id for r in rows} >= set(range(106, 130))
    assert not {r.doc_id for r in rows} & (set(clean) | {100, 200, 201, 202, 203, 204})
    for r in rows:
        piece = docs[r.doc_id].encode()[r.start : r.start + r.size].decode()
        assert piece.split() and " ".join(piece.split()) in " ".join((held[101] if r.keeper is None else docs[r.keeper]).split())
        assert r.words == len(piece.split()) >= 16
    out = {r.doc_id: r for r in substrings.drop_repeats(df).collect()}
    assert out[100].text == held[100] and out[201].text == "" and out[200].text is None and out[202].text == " \n " and out[200].asDict().keys() == {"doc_id", "text", "fp", "source"}
    for k in clean:
        assert out[k].text == clean[k]
    for k in range(106, 130):
        assert len(out[k].text) < len(held[k]) - 200 and out[k].text.endswith(" end")
    assert substrings.drop_repeats(df.where("false")).collect() == []


def test_a_text_that_is_all_repeated_goes(spark):
    rng = random.Random(5)
    text = "é" + words(rng, 200)
    df = spark.createDataFrame([(1, text), (2, text), (3, words(rng, 9) + " " + text)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in substrings.drop_repeats(df).collect()}
    assert out[1] == text and 2 not in out and len(out[3]) < 150


def test_words_that_never_stood_together_stay(spark):
    rng = random.Random(6)
    phrases = [words(rng, 12) for _ in range(40)]
    docs = {k: words(rng, 20) + " " + p + " " + words(rng, 20) for k, p in enumerate(phrases)} | {100: " ".join(phrases), 101: words(rng, 30) + " Und" * 12 + " " + words(rng, 30), 102: words(rng, 20) + " Und" * 300}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = substrings.repeated_spans(df).collect()
    assert {(r.doc_id, r.keeper) for r in rows} <= {(102, 102)}, "a document's own earlier place counts, its overlap with itself doesn't"
    out = {r.doc_id: r.text for r in substrings.drop_repeats(df).collect()}
    assert all(out[k] == t for k, t in docs.items() if k != 102) and 36 <= len(out[102].split()) < 100


def test_passages_of_few_words_or_without_spaces_are_found(spark):
    rng = random.Random(8)
    docs, where = {}, {}
    for k in range(300):
        period = (1, 3, 5, 8)[k % 4] if k < 240 else 0
        line = words(rng, period) + " " if period else ""
        passage = " ".join((line * 60).split()[:60]) if period else "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(120))
        gap = " " if period else ""
        near = (lambda: words(rng, 40)) if period else (lambda: "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(90)))
        for d in (k, 1000 + k):
            docs[d] = near() + gap + passage + gap + near()
        where[1000 + k] = passage
    rows = substrings.repeated_spans(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).where("doc_id >= 1000 and keeper < 1000").collect()
    assert {r.doc_id: r.keeper for r in rows} == {1000 + k: k for k in range(300)}
    for r in rows:
        piece = docs[r.doc_id].encode()[r.start : r.start + r.size].decode().strip()
        assert piece in where[r.doc_id] and r.words == len(piece.split())
        assert len(piece.split()) >= 16 if r.doc_id < 1240 else len(piece) >= 120 - 2 * (substrings.EVERY - 1)


def test_planted_passages_at_the_query_s_own_words(spark):
    """Every passage of 16 words and a chunk at either end is found, whatever stands around it; its span is all of it but parts of those chunks."""
    from cellweave.llm.queries import LEAST_WORDS

    rng = random.Random(9)
    docs, where = {}, {}
    for k in range(400):
        n = LEAST_WORDS + 2 * substrings.EVERY - 1 + k % 4
        passage = words(rng, n)
        for d in (k, 1000 + k):
            docs[d] = " ".join(x for x in (words(rng, rng.randrange(40)), passage, words(rng, rng.randrange(40))) if x)
        where[1000 + k] = passage
    rows = substrings.repeated_spans(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), LEAST_WORDS).collect()
    assert {r.doc_id: r.keeper for r in rows} == {1000 + k: k for k in range(400)}
    for r in rows:
        piece = docs[r.doc_id].encode()[r.start : r.start + r.size].decode().strip()
        assert piece in where[r.doc_id] and r.words == len(piece.split()) >= len(where[r.doc_id].split()) - 2 * substrings.EVERY + 1


def test_spans_of_a_given_table_equal_brute_force(spark):
    """All words of spans stood in 16 words in an earlier place, and no passage of 39 that did is left without a span."""
    from cellweave.llm.queries import LEAST_WORDS

    df = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    spans = {}
    for r in substrings.repeated_spans(df, LEAST_WORDS).collect():
        spans.setdefault(r.doc_id, []).append(r)
    long, seen = LEAST_WORDS + 2 * substrings.EVERY - 1, {}
    for d, raw in sorted(docs.items()):
        w = raw.split()
        for n in (LEAST_WORDS, long):
            for k in range(len(w) - n + 1):
                seen.setdefault((n, hash(tuple(w[k : k + n]))), (d, k))
    found = missed = 0
    for d, raw in docs.items():
        w, bare = raw.split(), np.ones(0, bool)
        before = lambda n, k: seen[n, hash(tuple(w[k : k + n]))] < (d, k)  # noqa: B023, E731
        inside = np.zeros(len(w), bool)
        for r in spans.get(d, []):
            first = len(raw[: r.start].split())
            inside[first : first + r.words] = True
            assert raw[r.start : r.start + r.size].split() == w[first : first + r.words]
        again = np.zeros(len(w), bool)
        for k in range(len(w) - LEAST_WORDS + 1):
            again[k : k + LEAST_WORDS] |= before(LEAST_WORDS, k)
        assert not (inside & ~again).any(), d
        for k in range(len(w) - long + 1):
            if before(long, k) and (seen[long, hash(tuple(w[k : k + long]))][0] != d):
                found += 1
                missed += not inside[k : k + long].any()
    assert found > 1000 and not missed


# decontamination


def brute_force(docs, items, question, answer, n):
    out = set()
    for d, text in docs:
        seen = {m: decontaminate._grams(decontaminate.terms_of(text), m) for m in range(1, n + 1)}
        for i, item in items:
            shares = []
            for part in decontaminate.halves(item):
                g = decontaminate._grams(decontaminate.terms_of(part), n)
                shares.append(len(g & seen[len(next(iter(g)))]) / len(g) if g else 1.0)
            if shares[0] >= question and shares[1] >= answer:
                out.add((d, i))
    return out


def test_contaminated_documents_equal_brute_force(spark):
    import duckdb

    docs = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert got == brute_force(docs, items, 0.8, 0.8, 5) and len(got) > 10


def test_search_finds_every_item_over_the_threshold():
    rng = random.Random(7)
    items = [(k, words(rng, 3) + " " + " ".join(rng.choice("pqrstuv") for _ in range(rng.randint(1, 20))), "") for k in range(60)]
    index = decontaminate.Index.of(items, 5)
    for least in (0.05, 0.3, 0.6, 0.95):
        for _ in range(60):
            terms = {t for t in range(len(index.vocabulary)) if rng.random() < rng.choice([0.1, 0.5])}
            scores = Counter()
            for t in terms:
                for i, w in zip(*index.postings[t]):
                    scores[i] += w
            got = dict(index.search(terms, least))
            assert {i for i, s in scores.items() if s >= least + 1e-9} <= got.keys() <= {i for i, s in scores.items() if s >= least - 1e-9}
            assert all(abs(scores[i] - s) < 1e-9 for i, s in got.items())


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "what is the sum of two and two here? it is four of course"), (2, "short one"), (3, None), (4, ""), (None, "no id"), (5, "another item with some more words in it")], "item_id long, text string")
    filler = " ".join(f"f{k}" for k in range(500))
    docs = [(1, filler + " What is the SUM of two, and two here? It is four of course. " + filler, "a"), (1, "what is the sum of two and two here? it is four of course", "b"), (2, "what is the sum of two and two here? no idea", "c"), (3, None, "d"), (4, "", "e"), (None, "a short one", "f"), (5, filler, "g")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contaminated(df, items).collect()) == [(0, 2), (1, 1), (1, 1)]
    assert sorted(r.item_id for r in decontaminate.clean(df, items).collect()) == ["c", "d", "e", "f", "g"]
    assert decontaminate.contaminated(df, items.where("false")).collect() == decontaminate.contaminated(df.where("false"), items).collect() == []
    two = spark.createDataFrame([(1, "what is the sum of two and two here", "seven")], "item_id long, question string, answer string")
    assert decontaminate.contaminated(df, two).collect() == []


# token counts


def test_totals_follow_signed_changes_and_repeated_batches(spark):
    rollup = counts.Rollup(spark, Scratch(spark, "test").path("rollup"))
    make = lambda *rows: spark.createDataFrame(rows, counts.CHANGES)
    assert rollup.totals().collect() == []
    assert rollup.commit("1", make((1, "a", "en", "v", 1, 10), (2, "a", "en", "v", 1, 5), (3, "b", None, "v", 1, 7), (4, "a", "en", "v", None, 7)))
    assert not rollup.commit("1", make((9, "a", "en", "v", 1, 99)))
    assert rollup.commit("2", make((1, "a", "en", "v", -1, 10), (1, "b", "en", "v", 1, 11), (3, "b", None, "v", -1, 7)))
    assert rollup.commit("3", make()) and rollup.committed("3")
    assert sorted(tuple(r) for r in rollup.totals().collect()) == [("a", "en", "v", 1, 5), ("b", "en", "v", 1, 11)]
    with pytest.raises(ValueError):
        rollup.commit("../x", make())


def test_a_batch_that_broke_off_does_not_count(spark):
    rollup = counts.Rollup(spark, Scratch(spark, "test").path("rollup"))
    change = spark.createDataFrame([(1, "a", "en", "v", 1, 10)], counts.CHANGES)
    spark.createDataFrame([("a", "en", "v", 5, 5)], "source string, lang string, version string, documents long, tokens long").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{rollup.base}/deltas/batch=1")
    assert rollup.totals().collect() == [] and rollup.commit("1", change)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 1, 10)]


def test_corpus_totals_equal_brute_force(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(k, t, s, la) for k, (t, s, la) in enumerate([("some text", "a", "en"), ("more of it", "a", "en"), (None, "a", "en"), ("", "b", None), ("x", None, "de"), ("x", None, "de")])]
    expected = Counter()
    docs = Counter()
    for _, t, s, la in rows:
        expected[s, la] += len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids)
        docs[s, la] += 1
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lang string, tokens string")
    got = {(r.source, r.lang): (r.documents, r.tokens) for r in counts.count_corpus(df, path, "v").collect()}
    assert got == {k: (docs[k], expected[k]) for k in docs}
    assert counts.count_corpus(df.where("false"), path, "v").collect() == []


# toxicity


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [(r.score, r.toxic) for r in rows if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    pairs = [(a > b) + (a == b) / 2 for a, y in held for b, z in held if y == 1 and z == 0]
    assert sum(pairs) / len(pairs) > 0.9
    assert sum((s >= 0.5) == (y == 1) for s, y in held) / len(held) > 0.95


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(1)
    rows = [(k, words(rng, 20) + (" awful nasty" if k % 3 == 0 else ""), "x") for k in range(300)] + [(None, "awful nasty", "x"), (400, None, "x"), (401, "", "x"), (402, "awful nasty " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)] + [(None, 1), (7, None), (3, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[402].predicted == got[None].predicted == 1 and got[400].score == got[401].score < 0.5
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert {None, 400, 401} <= kept and 402 not in kept and sum(k % 3 == 0 for k in kept if k) < 10 < sum(k % 3 != 0 for k in kept if k)
    assert {r.score for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.toxicity(docs.where("false"), labels).collect() == []


def test_risk_and_gradient_equal_brute_force():
    """The non-negative risk by its definition, and its gradient by small steps, on both sides of zero."""
    rng = np.random.default_rng(2)
    is_pos = np.arange(12) < 4
    loss = lambda z, y: np.log1p(np.exp(-z * y))
    seen = set()
    for prior in (0.05, 0.3, 0.9):
        score = rng.normal(size=12) * 2
        toxic, clean, push = toxicity.nn_risk(score, is_pos, prior)
        of = lambda s: (prior * loss(s[is_pos], 1).mean(), loss(s[~is_pos], -1).mean() - prior * loss(s[is_pos], -1).mean())  # noqa: B023, E731
        assert np.allclose([toxic, clean], of(score))
        seen.add(clean >= 0)
        for k in range(12):
            step = np.eye(12)[k] * 1e-6
            up, down = of(score + step), of(score - step)
            slope = ((sum(up) - sum(down)) if clean >= 0 else -(up[1] - down[1])) / 2e-6
            assert abs(push[k] - slope) < 1e-6
    assert seen == {True, False}


def test_items_in_parts_and_bounds_in_stretches(spark, monkeypatch):
    """The same documents are found with an index for each few items, and with a table of bounds for each few cells."""
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"q{k}" for k in rng.integers(0, 3000, n))
    items = [(k, f"{words(14)}. {words(9)}.") for k in range(60)]
    docs = [(k, f"{words(200)} {items[k % 60][1]} {words(90)}" if k % 3 == 0 else words(150)) for k in range(90)]
    bench, rows = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, bench).collect())
    expected = found()
    assert {d for d, _ in expected} == {k for k in range(90) if k % 3 == 0} and set(expected) >= {(k, k % 60) for k in range(0, 90, 3)}
    monkeypatch.setattr(decontaminate, "BOUNDS", 40)
    assert found() == expected
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 2000)
    assert found() == expected
