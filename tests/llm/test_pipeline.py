"""Each stage of the pipeline on its own input, against plain Python."""

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from cellweave.llm.common import Scratch
from cellweave.llm.queries import ORACLE_SQL, QUERIES, vocabulary
from tests.llm.test_neardup import brute
from tests.llm.test_text_filters import brute_force

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs, out = Scratch(spark, "test"), spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, f in pipeline.STAGES:
        before, docs = docs, scratch.store(f(spark, docs, DATA), name)
        out[name] = (before.toPandas(), docs.toPandas())
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert list(before.columns) == list(after.columns) and 0 < len(after) <= len(before), name
        assert set(after.doc_id) <= set(before.doc_id)


def test_near_duplicates_equal_brute_force(stages):
    before, after = stages["near_duplicates"]
    roots = brute(list(zip(before.doc_id, before.text)), 5, 80)
    assert set(after.doc_id) == {k for k, (_, root) in roots.items() if k == root}


def test_decontamination_equals_brute_force(stages):
    before, after = stages["decontamination"]
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    bad = {d for d, _ in brute_force(list(zip(before.doc_id, before.text)), items, 0.8, 0.8, 5)}
    assert set(after.doc_id) == set(before.doc_id) - bad


def test_substrings_leave_no_long_repeats(stages):
    before, after = stages["substrings"]

    def passages(df):
        seen, found = {}, set()
        for k, t in sorted(zip(df.doc_id, df.text)):
            w = (t or "").split()
            for g in {tuple(w[i : i + 51]) for i in range(len(w) - 50)}:
                if g in seen:
                    found.add((seen[g], k))
                seen.setdefault(g, k)
        return found

    assert passages(before) and not passages(after)
    assert (after.n_chars == after.text.map(lambda t: len(t) if t else t)).all()


def test_packing_holds_every_id(stages):
    before, after = stages["packing"]
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert after.groupby("doc_id").length.sum().to_dict() == {k: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in zip(before.doc_id, before.text)}


def test_run_equals_its_stages(spark, stages):
    assert sorted(pipeline.run(spark, DATA).toPandas().doc_id) == sorted(stages["packing"][1].doc_id)


def test_queries_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 11)] and ORACLE_SQL.keys() <= QUERIES.keys()


def test_stages_with_gaps_repeats_clashing_names_and_nothing(spark, tmp_path):
    """Null ids and texts, repeated rows and columns named like the operators' own go through all stages; an empty table stays empty."""
    path = f"file://{tmp_path}"
    line = " ".join(f"word{k}" for k in range(60))
    rows = [(1, None, 5), (2, "", 5), (None, "no id " + line, 5), (3, "own words " + line, 5), (3, "own words " + line, 5), (4, "own words " + line, 5), (5, "other start " + line + " " + " ".join(f"own{k}" for k in range(70)), 5), (6, "一" * 3000, 5)]
    schema = "doc_id long, text string, n_chars long, n long, grp string, component_id long, cw_0 string, score double"
    docs = spark.createDataFrame([(*r, 1, "g", 2, "c", 0.5) for r in rows], schema)
    spark.createDataFrame([(3, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "What is asked here today. This is the one answer.")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for start in (docs, docs.where("false")):
        scratch, df = Scratch(spark, "test"), start
        for name, f in pipeline.STAGES[:-1]:
            df = scratch.store(f(spark, df, path), name)
            assert df.columns == docs.columns, name
        pieces = pipeline.STAGES[-1][1](spark, df, path).collect()
        kept = [(r.doc_id, r.text) for r in df.collect()]
        if not start.isEmpty():
            assert {1, 2, 3, 5, 6} <= {k for k, _ in kept} and 4 not in {k for k, _ in kept} and sum(k is None for k, _ in kept) <= 1
            assert sum(k == 3 for k, _ in kept) == 2, "repeated rows stay or go together"
            assert {p.doc_id for p in pieces} == {k for k, _ in kept}
        else:
            assert not kept and not pieces
