"""Statistics along the time of each series: moments, cycles, percentiles, distributions.

Keys are named in `by`; none pools the whole table. Null values are skipped, and
what has no value at all is null, but for sums and counts, which are 0. Null keys
are keys. Repeated rows count each. Empty tables give empty tables, or with no
keys a row as of no values. Names of the results replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import large
from .series import SEASONS, method, resample, season, threshold


def moments(df: DataFrame, by: Sequence[str], how: str = "mean", freq: str | None = None, least: float | None = None) -> DataFrame:
    """One value for each series, or for each of its buckets."""
    df = df.withColumn("value", threshold(F.col("value"), least))
    return resample(df, by, freq, how) if freq else df.groupBy(*by).agg(method(how)(F.col("value")).alias("value"))


def _cycle(df: DataFrame, by: Sequence[str], key: Column, name: str, how: str, least: float | None) -> DataFrame:
    v = threshold(F.col("value"), least)
    return df.groupBy(*by, key.alias(name)).agg(method(how)(v).alias("value"), F.count(v).alias("n"))


def annual_cycle(df: DataFrame, by: Sequence[str], how: str = "mean", least: float | None = None) -> DataFrame:
    return _cycle(df, by, F.month("time"), "month", how, least)


def seasonal_cycle(df: DataFrame, by: Sequence[str], how: str = "mean", least: float | None = None) -> DataFrame:
    """All four seasons for each series, pooled over the years; without rows the value is null. One pass, one shuffle; null keys are keys."""
    v, of = threshold(F.col("value"), least), season(F.col("time"))
    parts = [F.struct(F.lit(s).alias("season"), F.when(F.count_if(of == s) > 0, method(how)(F.when(of == s, v))).cast("double").alias("value"), F.count(F.when(of == s, v)).alias("n")) for s in SEASONS]
    return df.groupBy(*by).agg(F.array(*parts).alias("_s")).select(*by, F.explode("_s").alias("_s")).select(*by, "_s.*")


def diurnal_cycle(df: DataFrame, by: Sequence[str], how: str = "mean", least: float | None = None) -> DataFrame:
    return _cycle(df, by, F.hour("time"), "hour", how, least)


def diurnal_frequency(df: DataFrame, by: Sequence[str], least: float) -> DataFrame:
    """How many values of each hour reach `least`, and how many distinct times the hour has in all series."""
    steps = df.groupBy(F.hour("time").alias("hour")).agg(F.count_distinct("time").alias("steps"))  # 24 rows at most
    found = df.groupBy(*by, F.hour("time").alias("hour")).agg(F.count_if(F.col("value") >= least).alias("n"))
    return found.join(F.broadcast(steps), "hour")


def harmonic(cycle: DataFrame, by: Sequence[str], k: int = 1, hours: int = 24) -> DataFrame:
    """Least squares m + c cos(2 pi k t / 24 - p) through (hour, value), t counting the hours present: (by..., amplitude, phase, level).

    Null where one of `hours` is missing. The three normal equations are solved in
    closed form from nine sums; c is not negative.
    """
    fits = _fits(cycle, by, (k,), hours)
    return fits.select(*by, *(F.col(f"f{k}.{c}").alias(c) for c in ("amplitude", "phase", "level")))


def _fits(cycle: DataFrame, by: Sequence[str], kinds: Sequence[int], hours: int) -> DataFrame:
    """A column f<k> (amplitude, phase, level) for each harmonic k."""
    t = F.row_number().over(Window.partitionBy(*by).orderBy("hour")) - 1  # 24 rows a series
    a = cycle.select(*by, F.col("value").alias("v"), t.alias("_t"))
    sums, fits = [F.expr("count(v)").alias("n"), F.expr("sum(v)").alias("sv")], []
    for k in kinds:
        x, y, v = F.cos(2 * math.pi * k / 24 * F.col("_t")), F.sin(2 * math.pi * k / 24 * F.col("_t")), F.col("v")
        terms = {"sx": x, "sy": y, "xx": x * x, "yy": y * y, "xy": x * y, "xv": x * v, "yv": y * v}
        sums += [F.sum(F.when(v.isNotNull(), e)).alias(f"{name}{k}") for name, e in terms.items()]
        c = {n: f"({n[1:]}{k} - s{n[1]}{k} * s{n[2]}{'' if n[2] == 'v' else k} / n)" for n in ("cxx", "cyy", "cxy", "cxv", "cyv")}
        det = f"nullif({c['cxx']} * {c['cyy']} - {c['cxy']} * {c['cxy']}, 0)"
        p, q = f"(({c['cxv']} * {c['cyy']} - {c['cyv']} * {c['cxy']}) / {det})", f"(({c['cyv']} * {c['cxx']} - {c['cxv']} * {c['cxy']}) / {det})"
        whole = lambda e: F.expr(f"case when n = {hours} then {e} end")
        fits.append(F.struct(whole(f"sqrt({p} * {p} + {q} * {q})").alias("amplitude"), whole(f"atan2({q}, {p})").alias("phase"), whole(f"sv / n - {p} * sx{k} / n - {q} * sy{k} / n").alias("level")).alias(f"f{k}"))
    return a.groupBy(*by).agg(*sums).select(*by, *fits)


def harmonic_cycle(cycle: DataFrame, by: Sequence[str], hours: int = 24, points: int = 200) -> DataFrame:
    """The first two harmonics of (hour, value), each fitted alone: (by..., c1, p1, c2, p2, curve).

    curve: `points` values from hour 0 to 23, of the second fit's level and both waves.
    """
    f = _fits(cycle, by, (1, 2), hours).select(*by, F.col("f1.amplitude").alias("c1"), F.col("f1.phase").alias("p1"), F.col("f2.amplitude").alias("c2"), F.col("f2.phase").alias("p2"), F.col("f2.level").alias("_m"))
    at = F.sequence(F.lit(0), F.lit(points - 1))
    wave = lambda i: F.col("_m") + F.col("c1") * F.cos(2 * math.pi / 24 * 23 / (points - 1) * i - F.col("p1")) + F.col("c2") * F.cos(4 * math.pi / 24 * 23 / (points - 1) * i - F.col("p2"))
    return f.select(*by, "c1", "p1", "c2", "p2", F.when(F.col("c2").isNotNull(), F.transform(at, wave)).alias("curve"))


def percentiles(df: DataFrame, by: Sequence[str], q: Sequence[float], least: float | None = None) -> DataFrame:
    """Exact, with linear interpolation: a row for each percentile. Without keys all values are one group, which no task holds."""
    if not by:
        found = large.quantiles(df.select(threshold(F.col("value"), least).alias("value")), by, [x / 100 for x in q], name="_p")
    else:
        found = df.groupBy(*by).agg(F.percentile(threshold(F.col("value"), least), F.array(*(F.lit(x / 100) for x in q))).alias("_p"))
    return found.select(*by, F.posexplode_outer("_p").alias("_i", "value")).select(*by, F.element_at(F.array(*(F.lit(float(x)) for x in q)), F.col("_i") + 1).alias("pctl"), "value")


def digitise(v: Column, edges: Sequence[float], closed: bool) -> Column:
    """The bin of a value, from 0, null outside; bins hold their lower edge, the last also its upper one if `closed`."""
    out, n = F.lit(None).cast("int"), len(edges) - 1

    def split(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v < edges[mid], split(lo, mid)).otherwise(split(mid, hi))

    inside = (v >= edges[0]) & ((v <= edges[-1]) if closed else (v < edges[-1]))
    return F.when(inside, split(0, n)).otherwise(out)


def binned(rows: DataFrame, by: Sequence[str], bins: int, *more: Column) -> DataFrame:
    """count and total of every bin of every series, empty ones too, of rows (by..., bin, _v): columns bin, n_bin, total.

    n: the series' values; n_in, total_in: of those in bins. `more`: further
    aggregates of a series' rows of (bin, n_bin, total, most). Rows are counted once;
    what follows works on a row for each bin that has members. Null keys are keys.
    """
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("n_rows"), F.count("_v").alias("n_bin"), F.sum("_v").cast("double").alias("total"), F.max("_v").alias("most"))
    inside = F.col("bin").isNotNull()
    entry = F.struct("bin", F.struct("n_bin", "total").alias("v"))
    one = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.when(inside, entry))).alias("_m"), F.sum("n_bin").alias("n"), F.coalesce(F.sum(F.when(inside, F.col("n_bin"))), F.lit(0)).alias("n_in"),
        F.coalesce(F.sum(F.when(inside, F.col("total"))), F.lit(0.0)).alias("total_in"), *more,
    )
    every = one.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("_e", F.try_element_at("_m", F.col("bin")))
    return every.withColumn("n_bin", F.coalesce("_e.n_bin", F.lit(0))).withColumn("total", F.coalesce("_e.total", F.lit(0.0))).drop("_m", "_e")


def _counts(df: DataFrame, by: Sequence[str], edges: Sequence[float], v: Column, closed: bool) -> DataFrame:
    rows = df.select(*by, v.alias("_v")).withColumn("bin", digitise(F.col("_v"), edges, closed))
    lo, hi = (F.element_at(F.array(*(F.lit(float(x)) for x in side)), F.col("bin") + 1) for side in (edges[:-1], edges[1:]))
    return binned(rows, by, len(edges) - 1).withColumn("lo", lo).withColumn("hi", hi)


def histogram(df: DataFrame, by: Sequence[str], edges: Sequence[float], least: float | None = None) -> DataFrame:
    """How many values each bin holds, the last one closed: (by..., bin, lo, hi, value)."""
    return _counts(df, by, edges, threshold(F.col("value"), least), True).select(*by, "bin", "lo", "hi", F.col("n_bin").cast("double").alias("value"))


def pdf(df: DataFrame, by: Sequence[str], edges: Sequence[float], least: float | None = None, normalised: bool = False, dry_under: float | None = None) -> DataFrame:
    """Density of each bin (the last one closed); normalised: its share of the sum of values (open).

    dry_under: a column dry with the number of the series' values under this,
    whatever `least` is. Null where the bins hold nothing; null values count nowhere.
    """
    v = threshold(F.col("value"), least)
    c = _counts(df, by, edges, v, not normalised)
    out = F.col("total") / F.nullif("total_in", F.lit(0.0)) if normalised else F.col("n_bin") / (F.nullif("n_in", F.lit(0)) * (F.col("hi") - F.col("lo")))
    found = c.select(*by, "bin", "lo", "hi", out.alias("value"))
    if dry_under is None:
        return found
    dry = dry_count(df, by, dry_under)
    if not by:
        return found.crossJoin(F.broadcast(dry.withColumnRenamed("n", "dry")))  # one row
    named = dry.select(*(F.col(c).alias(f"_b{k}") for k, c in enumerate(by)), F.col("n").alias("dry"))
    return found.join(named, reduce(Column.__and__, (F.col(f"_b{k}").eqNullSafe(F.col(c)) for k, c in enumerate(by)))).drop(*(f"_b{k}" for k in range(len(by))))


def dry_count(df: DataFrame, by: Sequence[str], under: float) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col("value") < under).alias("n"))


def auto_edges(df: DataFrame, bins: int = 20) -> list[float]:
    """`bins` edges from the least to the largest value of the whole field."""
    lo, hi = df.agg(F.min("value"), F.max("value")).first()
    if lo is None:
        raise ValueError("no values")
    return [lo + (hi - lo) * k / (bins - 1) for k in range(bins)]


def klingaman_edges(n: int) -> list[float]:
    return [0.0] + [0.005 * math.exp(math.sqrt(1.724 * k)) for k in range(n)]


def exponential_edges(n: int) -> list[float]:
    return [0.0] + [0.02 * math.exp(0.12 * k) for k in range(n)]


def asop(df: DataFrame, by: Sequence[str], edges: Sequence[float], least: float | None = None) -> DataFrame:
    """What each bin adds to the mean, and its share of all bins' sum."""
    c = _counts(df, by, edges, threshold(F.col("value"), least), False)
    return c.select(*by, "bin", "lo", "hi", (F.col("total") / F.nullif("n", F.lit(0))).alias("contrib"), (F.col("total") / F.nullif("total_in", F.lit(0.0))).alias("share"))


def with_percentiles(df: DataFrame, by: Sequence[str], q: Sequence[float], least: float | None = None, name: str = "_q") -> DataFrame:
    """Every row with an array of its series' percentiles; the whole table's (one row, broadcast) where there are no keys."""
    v, at = threshold(F.col("value"), least), F.array(*(F.lit(x / 100) for x in q))
    if by:
        return df.withColumn(name, F.percentile(v, at).over(Window.partitionBy(*by)))
    return df.crossJoin(F.broadcast(large.quantiles(df.select(v.alias("value")), [], [x / 100 for x in q], name=name)))  # one row


def survival_fraction(df: DataFrame, by: Sequence[str], q: Sequence[float]) -> DataFrame:
    """The share of the sum that values at or over each percentile hold: a row for each percentile. Null values count nowhere."""
    v = F.col("value")
    parts = [F.struct(F.lit(float(x)).alias("pctl"), (F.sum(F.when(v >= F.col("_q")[k], v)) / F.nullif(F.sum(v), F.lit(0.0))).alias("value")) for k, x in enumerate(q)]
    return with_percentiles(df, by, q).groupBy(*by).agg(F.array(*parts).alias("_p")).select(*by, F.explode("_p").alias("_p")).select(*by, "_p.*")


#: Statistics of a user: name to a function of a pandas frame of one series.
OWN: dict[str, Callable] = {}


def register(name: str, f: Callable) -> None:
    OWN[name] = f


def generic(df: DataFrame, by: Sequence[str], name: str, schema: str) -> DataFrame:
    """A registered function of each series, as pandas, in time order. A series is one task's; so there are keys, and no function of the whole table."""
    if not by:
        raise ValueError("a function of one's own takes one series at a time: name its keys")
    f = OWN[name]
    return df.groupBy(*by).applyInPandas(lambda part: f(part.sort_values("time")), schema)
