"""Runs of values: events over a threshold and dry spells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .statistics import binned, digitise


def runs(df: DataFrame, by: Sequence[str], flag: Column, order: Sequence[str]) -> DataFrame:
    """(by..., flag, run, length, total, mean, most) of each maximal run of rows with one flag; a null flag is false.

    Rows follow each other in the table's order: a missing row is no gap, a row
    with a missing value is one. All windows share the series' partitions.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    f = df.withColumn("flag", F.coalesce(flag, F.lit(False)))
    f = f.withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "flag").orderBy(*order)))
    return f.groupBy(*by, "flag", "run").agg(F.count("*").alias("length"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("most"))


def events(df: DataFrame, by: Sequence[str], least: float, measure: str, durations: Sequence[int], edges: Sequence[float], order: Sequence[str] = ("time",), keep: Sequence[str] | None = None) -> DataFrame:
    """How many events (runs of values of `least` or more) have each duration and fall in each bin of their total, mean or most: (keep..., duration, bin, n).

    Runs end where their series ends; `keep` names the keys that stay apart in the
    counts (all of them; none pools all series). Series without events have zeros.
    """
    keep, n = list(by if keep is None else keep), len(edges) - 1
    place = F.array_position(F.array(*(F.lit(int(d)) for d in durations)), F.col("length").cast("int")).cast("int") - 1
    at = F.when(F.col("flag") & (place >= 0), place * n + digitise(F.col(measure), edges, True))
    rows = runs(df, by, F.col("value") >= least, order).select(*keep, at.alias("bin"), F.col("length").alias("_v"))
    which = F.element_at(F.array(*(F.lit(int(d)).cast("bigint") for d in durations)), F.floor(F.col("bin") / n).cast("int") + 1)
    return binned(rows, keep, n * len(durations)).select(*keep, which.alias("duration"), (F.col("bin") % n).alias("bin"), F.col("n_bin").alias("n"))


def dry_spells(df: DataFrame, by: Sequence[str], over: float, edges: Sequence[float], order: Sequence[str] = ("time",), keep: Sequence[str] | None = None) -> DataFrame:
    """How many runs of values not over `over` (missing ones too) fall in each bin of their length, and the longest: (keep..., bin, n, longest).

    `keep` as in `events`. Series without a dry run have zeros.
    """
    keep = list(by if keep is None else keep)
    found = runs(df, by, ~F.coalesce(F.col("value") > over, F.lit(False)), order)
    dry = F.when(F.col("flag"), F.col("length"))
    rows = found.select(*keep, F.when(F.col("flag"), digitise(F.col("length"), edges, True)).alias("bin"), dry.alias("_v"))
    longest = F.coalesce(F.max("most"), F.lit(0)).alias("longest")
    return binned(rows, keep, len(edges) - 1, longest).select(*keep, "bin", F.col("n_bin").alias("n"), "longest")


def dry_lengths(df: DataFrame, by: Sequence[str], under: float, edges: Sequence[float], order: Sequence[str] = ("time",), keep: Sequence[str] | None = None) -> DataFrame:
    """How many runs of values under `under` fall in each bin of their length: what stands before the histogram of events."""
    keep = list(by if keep is None else keep)
    found = runs(df, by, F.col("value") < under, order)
    rows = found.select(*keep, F.when(F.col("flag"), digitise(F.col("length"), edges, True)).alias("bin"), F.when(F.col("flag"), F.col("length")).alias("_v"))
    return binned(rows, keep, len(edges) - 1).select(*keep, "bin", F.col("n_bin").alias("n"))
