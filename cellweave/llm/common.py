"""What the training-data operators share: input columns, scratch tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch. Texts may be long, so batches are kept short.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20
#: The most bits of a bitmap of keys (it is broadcast: 8 MiB), and bits for each key.
MOST_BITS, KEY_BITS = 1 << 26, 16
#: Spark's own setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches (settings of the session, which stay), and let Python workers import this package wherever the driver was started."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (top, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cellweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a reread and not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.names = spark, f"{shared_dir(spark)}/cellweave/{name}-{uuid.uuid4().hex}", []

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back. The shuffle files behind it are let go, for only the table is read from then on."""
        was = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, was)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no returned DataFrame reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names = [x for x in self.names if x != name]

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*(set(self.names) - set(names)))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only these columns, as new_name="column" pairs, found by exact name whatever else the table carries."""
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    missing = [c for c in columns.values() if c not in at]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{at[c]}").alias(new) for new, c in columns.items()))


def maybe_in(df: DataFrame, key: str, keys: DataFrame, count: int) -> DataFrame:
    """The rows of `df` whose bigint `key` may be among the `count` values of the first column of `keys`: all that are, and few others.

    A bitmap of hashed keys is broadcast, KEY_BITS bits for each key and MOST_BITS
    at most. With more keys than that can tell apart, all rows come back: the join
    that follows is the filter. Null keys go. Repeated rows stay.
    """
    if count * 4 > MOST_BITS:
        return df.where(F.col(key).isNotNull())
    bits = min(MOST_BITS, 1 << max(15, (KEY_BITS * count).bit_length()))
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = keys.select(spot(F.col(keys.columns[0])).alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("cw_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("cw_bits"))
    held = df.where(F.col(key).isNotNull()).withColumn("cw_spot", spot(F.col(key))).withColumn("cw_number", F.expr("bitmap_bucket_number(cw_spot)"))
    byte = "cast(conv(hex(substring(cw_bits, cast(bitmap_bit_position(cw_spot) div 8 as int) + 1, 1)), 16, 10) as int)"
    met = held.join(F.broadcast(marks), F.col("cw_number") == F.col("cw_bucket"))
    return met.where(f"getbit({byte}, cast(bitmap_bit_position(cw_spot) % 8 as int)) = 1").select(*df.columns)


#: Ids whose links one task holds at once; links that one task can end with, for they have no more ids than that.
MOST_IDS = 1 << 20
LAST_LINKS = MOST_IDS // 2


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a task as links from each id to the smallest that it reaches, MOST_IDS ids at a time."""
    parent: dict[int, int] = {}

    def find(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def stars() -> pa.RecordBatch:
        rows = [(k, find(k)) for k in parent]
        rows = [r for r in rows if r[0] != r[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > MOST_IDS:
            yield stars()
    yield stars()


def _with_roots(stars: DataFrame) -> DataFrame:
    """(id, component) of links from each id to its component's smallest, and of the smallest themselves."""
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of `edges` (a, b: bigint): a row (id, component) for each id that has an edge to another.

    component is the smallest id that can be reached. Alternates the two star
    contractions of Kiveris et al. (2014), so the number of rounds grows with
    the logarithm of the longest path; each task first shortens the paths within
    its own rows, which saves most rounds. Each round is written to the shared
    folder. Once no more than LAST_LINKS links are left, whatever their number was,
    a task holds them all and shortens all paths, which ends the rounds.
    Loops, nulls and repeated edges change nothing.
    """
    short = lambda df: df.select("a", "b").mapInArrow(_forest, "a bigint, b bigint")
    e = scratch.store(short(edges.where("a is not null and b is not null and a != b")), f"{name}0")
    k = 0
    while True:
        if e.limit(LAST_LINKS + 1).count() <= LAST_LINKS:
            last = scratch.store(short(e.coalesce(1)), f"{name}-last")
            scratch.drop(f"{name}{k}")
            return _with_roots(last)
        # large star: each neighbour above the centre goes to the smallest of the neighbourhood
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.store(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m")), f"{name}-low{k}")
        large = both.join(low, both.a == low.c).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        k += 1
        e1 = scratch.store(short(large), f"{name}{k}")
        # small star: each centre and its neighbours below go to the smallest of them
        low = scratch.store(e1.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m"), f"{name}-low{k}")
        down = e1.join(low, e1.a == low.c)
        small = down.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("c").alias("a"), F.col("m").alias("b")))
        k += 1
        e2 = scratch.store(short(small).distinct(), f"{name}{k}")
        # done once all ids hang on one that hangs on none: links go to smaller ids
        ends = e2.select(F.col("a").alias("id"), F.lit(1).alias("up")).union(e2.select(F.col("b").alias("id"), F.lit(0).alias("up")))
        done = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or ups = 1 and least = 0").isEmpty()
        scratch.drop(*(f"{name}{x}" for x in (k - 2, k - 1, f"-low{k - 2}", f"-low{k - 1}")))
        e = e2
        if done:
            return _with_roots(e)
