"""The registered queries of the training-data operators: each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, cluster, counts, decontaminate, extract, media, neardup, neighbours, packing, reputation, substrings, tokenstore, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this machine; every node has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules that the page query is asked to apply.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


#: Words that must have stood together before: passages of 39 words and more are always found.
LEAST_WORDS = 16


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_corpus(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "byte_bpe_50k")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_features(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.token_spans(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge(table(spark, sf_dir, "pages"), RULES)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents"), LEAST_WORDS)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.centroid_clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5, size=64, scale=256, salt="2:")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_minhash, op3_token_counts, op4_html_text, op5_media, op6_decontamination, op7_toxicity, op8_token_store, op9_url_filter, op10_substrings, op11_token_alignment, op12_near_vectors, op13_centroid_clusters)
}

ORACLE_SQL: dict[str, str] = {
    "op9_url_filter": reputation.judge_sql(RULES),
    "op12_near_vectors": neighbours.near_vectors_sql(0.93),
    "op13_centroid_clusters": cluster.clusters_sql(k=40, rounds=5, size=64, scale=256, salt="2:"),
}
