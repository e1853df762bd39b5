"""A training corpus from raw documents: five stages, each over all that the one before it kept.

No stage can be written in SQL whole; tests/llm/test_pipeline.py holds them against brute force.

In all stages a null text is an empty one, and an empty text is clean: it goes on
to the end, where it is a document of one id. Rows without an id can't be named
by another stage's finding, so filters by id keep them; the classifier judges them
by their text. Rows that repeat an id are judged together, and stay or go together,
but in the substring stage, which tells them apart by their text. An empty table
gives an empty table. Columns beside doc_id and text are carried along, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import decontaminate, neardup, packing, substrings, toxicity
from cellweave.llm.queries import LEAST_WORDS, table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; without toxic labels none."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates (five words, 0.8)."""
    gone = neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti")


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that stand in an earlier document; n_chars follows the text."""
    left = substrings.drop_repeats(docs, LEAST_WORDS)
    return left.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else left


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold items of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("substrings", drop_substrings), ("decontamination", drop_benchmark), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again, and deleted once the next is written."""
    from cellweave.llm.common import Scratch

    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
        scratch.keep(name)
    return STAGES[-1][1](spark, docs, sf_dir)
