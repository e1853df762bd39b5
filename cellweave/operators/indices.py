"""Indices of series, running means and filters, and measures of distributions.

As in `statistics`: null values are skipped (in running sums and filters they are
0), null keys are keys, repeated rows count each. Ranks of equal values follow
`tie`. Every window is one series'.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import large
from .statistics import histogram, pdf, percentiles, with_percentiles


def days_over(df: DataFrame, by: Sequence[str], over: float, share: bool = False) -> DataFrame:
    """Values over `over` (hot days, tropical nights over 293 K, heavy rain); share: of the values there are."""
    n = F.count_if(F.col("value") > over)
    return df.groupBy(*by).agg((n / F.nullif(F.count("value"), F.lit(0)) if share else n).alias("value"))


def total_from(df: DataFrame, by: Sequence[str], least: float) -> DataFrame:
    """The sum of values of `least` or more."""
    return df.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("value") >= least, F.col("value"))), F.lit(0.0)).alias("value"))


def days_over_own(df: DataFrame, by: Sequence[str], bounds: DataFrame, bound: str = "value") -> DataFrame:
    """Values over their series' own bound (by..., bound): hot days over a 75th, very hot ones over a 95th percentile. Null without a bound."""
    b = bounds.select(*(F.col(c).alias(f"_b{k}") for k, c in enumerate(by)), F.col(bound).alias("_q"))
    joined = df.join(b, reduce(Column.__and__, (F.col(f"_b{k}").eqNullSafe(F.col(c)) for k, c in enumerate(by))), "left")
    return joined.groupBy(*by).agg(F.when(F.max("_q").isNotNull(), F.count_if(F.col("value") > F.col("_q"))).alias("value"))


def total_from_percentile(df: DataFrame, by: Sequence[str], q: float, wet: float) -> DataFrame:
    """The sum of values that reach the percentile q of those of `wet` or more; null where none is wet."""
    return with_percentiles(df, by, [q], wet).groupBy(*by).agg(F.sum(F.when(F.col("value") >= F.col("_q")[0], F.col("value"))).alias("value"))


def intensity(df: DataFrame, by: Sequence[str], wet: float = 1.0) -> DataFrame:
    """The mean of values of `wet` or more."""
    return df.groupBy(*by).agg(F.avg(F.when(F.col("value") >= wet, F.col("value"))).alias("value"))


def running_mean(df: DataFrame, by: Sequence[str], n: int, order: Sequence[str] = ("time",), whole: bool = False) -> DataFrame:
    """The sum of n values around each divided by n, as if zeros stood beyond the ends; whole: only where n values stand."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n // 2), n - 1 - n // 2)
    out = df.withColumn("_n", F.count("*").over(w)).withColumn("mean", F.sum("value").over(w) / n)
    return (out.where(f"_n = {n}") if whole else out).drop("_n")


def heat_index(df: DataFrame, by: Sequence[str], over: float, order: Sequence[str] = ("time",)) -> DataFrame:
    """How many means of three values in a row, all there, are over `over`."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-2, 0)
    m = df.withColumn("_m", F.when(F.count("value").over(w) == 3, F.avg("value").over(w)))
    return m.groupBy(*by).agg(F.count_if(F.col("_m") > over).alias("value"))


def lanczos(window: int, cutoff: float, second: float | None = None, kind: str = "lowpass") -> list[float]:
    """Weights of an odd window; high pass is minus low pass, band pass the difference of two low passes."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    if kind == "highpass":
        return [-x for x in lanczos(window, cutoff)]
    if kind == "bandpass":
        if second is None:
            raise ValueError("a band has two ends")
        return [b - a for a, b in zip(lanczos(window, cutoff), lanczos(window, second))]
    half = window // 2
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    return [2 * cutoff * sinc(2 * cutoff * k) * sinc(k / (half + 1)) for k in range(-half, half + 1)]


def filtered(df: DataFrame, by: Sequence[str], weights: Sequence[float], order: Sequence[str] = ("time",), mode: str = "same") -> DataFrame:
    """The weighted sum around each value, zeros beyond the ends.

    mode: same; valid, only where no weight stands beyond; full, also the half
    windows before and after a series, in rows whose other columns are null but
    for the keys and _place (from 0). The window of values is one array for each
    row, so its cost is that of its length, whatever that is. Missing values are 0.
    """
    if mode not in ("same", "valid", "full"):
        raise ValueError(f"unknown mode {mode!r}")
    half, n = len(weights) // 2, len(weights)
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df
    if mode == "full":
        place = F.row_number().over(w) - 1 + half
        ends = df.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_place", F.explode(F.concat(F.sequence(F.lit(0), F.lit(half - 1)), F.sequence(F.col("_n").cast("int") + half, F.col("_n").cast("int") + 2 * half - 1)))) if half else None
        rows = df.withColumn("_place", place)
        rows = rows if ends is None else rows.unionByName(ends.drop("_n"), allowMissingColumns=True)
        w = Window.partitionBy(*by).orderBy("_place")
    around = F.collect_list(F.coalesce("value", F.lit(0.0))).over(w.rowsBetween(-half, half))
    i, size = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by))
    out = rows.withColumn("_a", around).withColumn("_i", i).withColumn("_n", size)
    if mode == "valid":
        out = out.where((F.col("_i") > half) & (F.col("_i") <= F.col("_n") - half))
    # at the start of a series the array lacks its first values; weights run from the last to the first
    lack = F.greatest(half - F.col("_i") + 1, F.lit(0))
    kernel = F.slice(F.array(*(F.lit(float(x)) for x in reversed(weights))), lack + 1, F.size("_a"))
    total = F.aggregate(F.zip_with("_a", kernel, lambda a, k: a * k), F.lit(0.0), lambda t, x: t + x)
    return out.withColumn("filtered", total).drop("_a", "_i", "_n")


def ranked_share(df: DataFrame, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Values from the largest down, with the share of the sum that those so far hold. Without keys the whole table is ranked, in ranges of values."""
    given = df.where("value is not null")
    order = [F.desc("value"), *(F.col(c) for c in tie)]
    if not by:
        found = large.running(given, by, order, {"_sum": F.col("value")})
        return found.select("place", "value", (F.col("_sum") / F.nullif(F.col("_sum_all"), F.lit(0.0))).alias("share"))
    w = Window.partitionBy(*by).orderBy(*order)
    rows = given.withColumn("place", F.row_number().over(w))
    so_far = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.nullif(F.sum("value").over(Window.partitionBy(*by)), F.lit(0.0))
    return rows.select(*by, "place", "value", so_far.alias("share"))


def exceedance(df: DataFrame, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Values from the smallest up, with the chance to exceed them: 1 down to 0 in even steps. Without keys the whole table is ranked, in ranges of values."""
    given = df.where("value is not null")
    if by:
        w = Window.partitionBy(*by).orderBy("value", *tie)
        rows = given.withColumn("place", F.row_number().over(w)).withColumn("size", F.count("*").over(Window.partitionBy(*by)))
    else:
        rows = large.running(given, by, [F.col("value"), *(F.col(c) for c in tie)])
    return rows.select(*by, "place", "value", F.when(F.col("size") > 1, 1 - (F.col("place") - 1) / (F.col("size") - 1)).otherwise(1.0).alias("chance"))


#: Percentiles of an exceedance curve: every one to 99, then finer ones (fixed values).
LEVELS = [float(k) for k in range(100)] + [99 + 0.1 * k for k in range(10)] + [99.9 + 0.01 * k for k in range(10)]


def exceedance_levels(df: DataFrame, by: Sequence[str], q: Sequence[float] = tuple(LEVELS), least: float | None = None) -> DataFrame:
    """(by..., pctl, value, chance): the values at percentiles and the chance to exceed them."""
    return percentiles(df, by, q, least).withColumn("chance", 1 - F.col("pctl") / 100)


def skill(model: DataFrame, reference: DataFrame, by: Sequence[str]) -> DataFrame:
    """The common part of two distributions (by..., bin, value): the sum of the lesser value of each bin."""
    r = reference.select(*by, "bin", F.col("value").alias("_r"))
    return model.join(r, [*by, "bin"]).groupBy(*by).agg(F.sum(F.least("value", "_r")).alias("value"))


def block_starts(sizes: DataFrame, by: Sequence[str], block: int, samples: int, seed: int) -> DataFrame:
    """(by..., sample, _b, _s, _n) of series with _n rows: where block _b of a sample begins, by a hash of (seed, keys, sample, block)."""
    draws = sizes.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block).cast("int"))))
    return draws.withColumn("_s", F.pmod(F.xxhash64(F.lit(seed), *by, "sample", "_b"), F.greatest(F.col("_n") - block + 1, F.lit(1))))


def block_bootstrap(df: DataFrame, by: Sequence[str], block: int, samples: int, order: Sequence[str] = ("time",), seed: int = 1, columns: Sequence[str] = ("value",)) -> DataFrame:
    """Resampled series (by..., sample, place, columns...): blocks of rows from random places, which hashes of (seed, series, sample, block) choose.

    All `columns` of a row stay together. A series shorter than a block is taken
    from its start, and its samples are no longer than it is.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.select(*(F.col(c).alias(f"_b{k}") for k, c in enumerate(by)), *columns, (F.row_number().over(w) - 1).alias("_row"))
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    draws = block_starts(sizes, by, block, samples, seed).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumn("place", F.col("_b") * block + F.col("_k")).where("place < _n")
    same = [F.col(f"_b{k}").eqNullSafe(F.col(c)) for k, c in enumerate(by)] + [F.col("_row") == F.col("_s") + F.col("_k")]
    # there are as many draws as rows in all samples, though they come from a row for each series: never one table for every task
    return draws.where("_s + _k < _n").hint("merge").join(rows, reduce(Column.__and__, same)).select(*by, "sample", "place", *columns)


def pdf_band(df: DataFrame, by: Sequence[str], edges: Sequence[float], least: float | None = None, density: bool = True, samples: int = 500, block: int = 1, level: float = 95, order: Sequence[str] = ("time",), seed: int = 1) -> DataFrame:
    """A distribution with a confidence band: (by..., bin, lo, hi, value, low, high).

    The band is that of block resamples of the values that reach `least`: the
    percentiles around `level` of each bin. density=False: counts.
    """
    rows = df.where("value is not null" if least is None else F.col("value") >= least)
    of = lambda t, keys: pdf(t, keys, edges) if density else histogram(t, keys, edges)
    spread = of(block_bootstrap(rows, by, block, samples, order, seed), [*by, "sample"])
    tail = (100 - level) / 200
    band = spread.groupBy(*by, "bin").agg(F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail))).alias("_p"))
    band = band.select(*(F.col(c).alias(f"_b{k}") for k, c in enumerate(by)), F.col("bin").alias("_bin"), F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))
    same = [F.col(f"_b{k}").eqNullSafe(F.col(c)) for k, c in enumerate(by)] + [F.col("_bin") == F.col("bin")]
    return of(rows, list(by)).join(band, reduce(Column.__and__, same)).select(*by, "bin", "lo", "hi", "value", "low", "high")
