"""Token counts kept up to date by signed changes, by source, language and tokenizer version."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pick, prepare
from .tokens import encoder

GROUP = ["source", "lang", "version"]
#: One change of a document: `sign` is 1 for what comes in and -1 for what goes; a revised count is one of each.
CHANGES = "doc_id bigint, source string, lang string, version string, sign int, tokens bigint"


class Rollup:
    """Totals of documents and tokens under `base`, a folder that driver and executors share.

    commit(batch, changes) writes what the batch adds to each total. It counts
    once its folder holds Spark's mark of success; a batch that is committed
    already is left alone, and one that broke off is written anew. So a batch can
    be sent any number of times. totals() adds up the committed batches. A batch
    has one writer at a time: two that commit the same name at once would write
    the same folder, so whoever sends batches takes turns on a name.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.base}/deltas/batch={batch}/_SUCCESS")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add `changes` (CHANGES) under this name; False if they were there already. Rows with a null sign or count change nothing."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError("a batch is named by letters, digits, - and _")
        if self.committed(batch):
            return False
        c = pick(changes, **{x: x for x in (*GROUP, "sign", "tokens")}).where("sign is not null and tokens is not null")
        delta = c.groupBy(*GROUP).agg(F.sum(F.col("sign").cast("bigint")).alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("bigint").alias("tokens"))
        delta.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/deltas/batch={batch}")  # as many rows as there are groups
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens) of the committed batches, without groups that are empty again."""
        schema = "source string, lang string, version string, documents bigint, tokens bigint"
        paths = self._batches()
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*GROUP).agg(F.sum("documents").cast("bigint").alias("documents"), F.sum("tokens").cast("bigint").alias("tokens")).where("documents != 0 or tokens != 0")

    def _batches(self) -> list[str]:
        top = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/deltas")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [x.getPath().toString() for x in fs.listStatus(top)]
        return sorted(x for x in found if self._exists(f"{x}/_SUCCESS"))


def _count(path: str, blank_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, blank_kept)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "source", "lang", "estimate")] + [pa.array([len(x) for x in ids_of.batch(texts)], pa.int64())], names=["doc_id", "source", "lang", "estimate", "tokens"])

    return run


def count_documents(docs: DataFrame, tokenizer_path: str, version: str, blank_kept: bool = True) -> DataFrame:
    """(doc_id, source, lang, estimate, tokens, version): ids of the whole text, and the guess of one id for four bytes.

    Null and empty texts have no ids. Null sources and languages are groups of
    their own. Repeated rows count each. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", source="source", lang="lang", text="text").selectExpr("cast(doc_id as bigint) doc_id", "cast(source as string) source", "cast(lang as string) lang", "cast(text as string) text")
    rows = rows.withColumn("estimate", F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4))
    counted = rows.mapInArrow(_count(tokenizer_path, blank_kept), "doc_id bigint, source string, lang string, estimate bigint, tokens bigint")
    return counted.withColumn("version", F.lit(version))


def inserts(counted: DataFrame, tokens: str = "tokens") -> DataFrame:
    """CHANGES that add each row with the count in column `tokens`; a row without a count changes nothing when committed."""
    return counted.select("doc_id", "source", "lang", "version", F.lit(1).alias("sign"), F.col(tokens).alias("tokens"))


def deletes(counted: DataFrame, tokens: str = "tokens") -> DataFrame:
    """CHANGES that take each row out again."""
    return inserts(counted, tokens).withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame, was: str = "tokens", now: str = "tokens") -> DataFrame:
    """The old counts out and the new ones in; source, language and version may differ too."""
    return deletes(before, was).unionByName(inserts(after, now))


def count_corpus(docs: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """Totals of a corpus that first arrives with guessed counts, which exact ones then replace; each batch is sent twice."""
    scratch = Scratch(docs.sparkSession, "counts")
    counted = scratch.store(count_documents(docs, tokenizer_path, version), "counted")
    rollup = Rollup(docs.sparkSession, scratch.path("rollup"))
    for _ in range(2):
        rollup.commit("arrival", inserts(counted, "estimate"))
        rollup.commit("exact", revisions(counted, counted, "estimate", "tokens"))
    return rollup.totals()
