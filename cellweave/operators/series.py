"""Series: reading in, selecting, resampling, aligning.

Null is the only missing value; NaN becomes null on the way in. Selections drop
rows whose time is null. Null keys are keys of their own, also in joins, but for
`derive` and `forward_fill`, where series without a key meet nothing. Rows that
repeat a key and time are all used, or the last by `order` in `keep_last`; ties in
an order that the caller leaves open are taken as they come. Columns beside those
named are dropped or left alone. Empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.sources.scratch import store

from . import splines

SEASONS = ("DJF", "MAM", "JJA", "SON")


def clean(value: Column) -> Column:
    """As a double, NaN as null."""
    v = value.cast("double")
    return F.when(~F.isnan(v), v)


def series(df: DataFrame, by: Sequence[str], time: str, value: str, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Only (by..., time, value), the value cleaned, scaled and shifted."""
    return df.select(*by, F.col(time).alias("time"), (clean(F.col(value)) * scale + offset).alias("value"))


#: Reductions by name; all skip null.
METHODS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "max": F.max,
    "min": F.min,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "median": lambda v: F.percentile(v, F.lit(0.5)),
    "count": lambda v: F.count(v),
    "first": lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("time"))),
    "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("time"))),
}
#: Reductions that have a value, 0, where all are missing.
COUNTING = ("sum", "count")


def method(name: str) -> Callable[[Column], Column]:
    """A reduction of METHODS, or `percentile q`."""
    if m := re.fullmatch(r"percentile\s+(\d+(?:\.\d+)?)", name):
        return lambda v: F.percentile(v, F.lit(float(m[1]) / 100))
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}")
    return METHODS[name]


def threshold(v: Column, least: float | None) -> Column:
    """Values under `least` as missing; rows stay."""
    return v if least is None else F.when(v >= least, v)


def season(time: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEASONS)), (F.floor(F.month(time) % 12 / 3) + 1).cast("int"))


#: Seconds in units of a fixed length; units of the calendar, labelled at their start or (E) at their end.
FIXED = {"min": 60, "Min": 60, "T": 60, "H": 3600, "h": 3600, "hr": 3600, "D": 86400}
CALENDAR = {"MS": "month", "YS": "year", "QS-DEC": "quarter", "M": "month", "Y": "year", "Q": "quarter"}


def split_freq(freq: str) -> tuple[int, str]:
    """The number and the unit of a frequency such as 3H, D or QS-DEC."""
    m = re.fullmatch(r"(\d*)(\D+)", freq)
    if not m or m[2] not in FIXED and m[2] not in CALENDAR or m[2] in CALENDAR and m[1] not in ("", "1"):
        raise ValueError(f"unknown frequency {freq!r}")
    return int(m[1] or 1), m[2]


def step_seconds(freq: str) -> int:
    """A frequency's length, to compare it with a series' step: months have 30 days, quarters 90, years 365."""
    n, unit = split_freq(freq)
    return n * (FIXED.get(unit) or {"month": 30, "quarter": 90, "year": 365}[CALENDAR[unit]] * 86400)


def bucket(time: Column, freq: str, origin: str = "1970-01-01") -> Column:
    """The start of the bucket: n minutes, hours or days counted from `origin`, or a month, a year or a quarter (QS-DEC: from December on)."""
    n, unit = split_freq(freq)
    if unit == "QS-DEC":
        return F.add_months(F.date_trunc("quarter", F.add_months(time, 1)), -1).cast("timestamp_ntz")
    if unit in CALENDAR:
        return F.date_trunc(CALENDAR[unit], time).cast("timestamp_ntz")
    if n == 1 and unit == "D":
        return F.date_trunc("day", time).cast("timestamp_ntz")
    step, start = n * FIXED[unit], F.lit(origin).cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.floor(F.timestamp_diff("SECOND", start, time) / step) * step, start)


def bucket_label(start: Column, freq: str) -> Column:
    """What a bucket is called: its middle below a day, its last day for M, Q and Y, else its start."""
    n, unit = split_freq(freq)
    if unit in FIXED:
        step = n * FIXED[unit]
        return F.timestamp_add("SECOND", F.lit(round(step / 2)), start) if step < 86400 else start
    months = {"M": 0, "Q": 2, "Y": 11}.get(unit)
    return start if months is None else F.last_day(F.add_months(start, months)).cast("timestamp_ntz")


def first_step(df: DataFrame) -> int | None:
    """Seconds between the first two times of a series table; None with fewer than two. One small job."""
    two = [r.time for r in df.select("time").where("time is not null").distinct().orderBy("time").limit(2).collect()]
    return int((two[1] - two[0]).total_seconds()) if len(two) == 2 else None


def resample(df: DataFrame, by: Sequence[str], freq: str, how: str = "mean", label: str = "auto", origin: str = "1970-01-01", drop_missing: bool = True) -> DataFrame:
    """One value for each bucket of a series that has rows: (by..., time, value).

    Null values are skipped. A bucket without any value has the value null, or 0
    for sums and counts. Buckets in which no series of the table has a value go,
    as sums and counts never do; drop_missing=False keeps them and saves the
    look at other series. label: auto (`bucket_label`), start, or middle of
    buckets of a fixed length. Null keys are keys; rows without a time form a
    bucket without a time. An empty table stays empty.
    """
    start = bucket(F.col("time"), freq, origin)
    out = df.groupBy(*by, start.alias("time")).agg(method(how)(F.col("value")).cast("double").alias("value"))
    if drop_missing and how not in COUNTING:
        seen = out.where("value is not null").select(F.col("time").alias("_t")).distinct()
        # not a semi join: that would move below the aggregate, which then couldn't be used for both sides
        out = out.join(seen, out.time.eqNullSafe(seen._t)).drop("_t")
    n, unit = split_freq(freq)
    if label == "middle":
        if unit not in FIXED:
            raise ValueError("only buckets of a fixed length have a middle")
        return out.withColumn("time", F.timestamp_add("SECOND", F.lit(round(n * FIXED[unit] / 2)), F.col("time")))
    if label == "auto":
        return out.withColumn("time", bucket_label(F.col("time"), freq))
    if label != "start":
        raise ValueError(f"unknown label {label!r}")
    return out


def interpolate(df: DataFrame, by: Sequence[str], freq: str, kind: str = "linear") -> DataFrame:
    """Each series at every multiple of a fixed step between its first and last time: linear, nearest (of equals the earlier), zero (the last before), quadratic or cubic (`splines`, a series in a task).

    A time next to a missing value is missing; with splines all times of its
    series are. Times of a series are distinct (`keep_last`); rows without a time go.
    """
    if kind not in ("linear", "nearest", "zero", *splines.DEGREES):
        raise ValueError(f"unknown interpolation {kind!r}")
    n, unit = split_freq(freq)
    if unit not in FIXED:
        raise ValueError("steps have a fixed length")
    if kind in splines.DEGREES:
        return splines.interpolate(df, by, n * FIXED[unit], kind)
    step, start = n * FIXED[unit], F.lit("1970-01-01").cast("timestamp_ntz")
    w = Window.partitionBy(*by).orderBy("time")
    rows = df.where("time is not null").withColumn("_s", F.timestamp_diff("SECOND", start, F.col("time")))
    rows = rows.withColumn("_n", F.lead("_s").over(w)).withColumn("_v", F.lead("value").over(w))
    low, high = F.ceil(F.col("_s") / step).cast("bigint"), F.coalesce(F.ceil(F.col("_n") / step) - 1, F.floor(F.col("_s") / step)).cast("bigint")
    at = rows.withColumn("_k", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))).withColumn("_at", F.col("_k") * step)
    part = (F.col("_at") - F.col("_s")) / (F.col("_n") - F.col("_s"))
    between = {"linear": F.col("value") + (F.col("_v") - F.col("value")) * part, "nearest": F.when(part <= 0.5, F.col("value")).otherwise(F.col("_v")), "zero": F.col("value")}[kind]
    known = F.col("value").isNotNull() & F.col("_v").isNotNull()
    value = F.when(F.col("_at") == F.col("_s"), F.col("value")).when(known, between)
    return at.select(*by, F.timestamp_add("SECOND", F.col("_at"), start).alias("time"), value.alias("value"))


def resampled(df: DataFrame, by: Sequence[str], asked: Sequence) -> DataFrame:
    """As a configuration asks: [freq, method], [freq, "interpolate", kind], ["select hours", h] or ["select dates", times]; nothing where the step is that already."""
    if len(asked) not in (2, 3):
        raise ValueError("a resample resolution has two or three items")
    if asked[0] == "select hours":
        return select_hours(df, asked[1] if isinstance(asked[1], (list, tuple)) else [asked[1]])
    if asked[0] == "select dates":
        return select_dates(df, asked[1] if isinstance(asked[1], (list, tuple)) else [asked[1]])
    if first_step(df) == step_seconds(asked[0]):
        return df
    return interpolate(df, by, asked[0], asked[2]) if asked[1] == "interpolate" else resample(df, by, asked[0], asked[1])


def whole_hours(df: DataFrame) -> DataFrame:
    """Times to the minute; where they aren't whole hours in even steps, moved to whole hours at the middle of the step.

    All minutes of 30 or more go up to the hour, else down; then steps of 12, 6,
    3 and 1 hours move by 6, 3, 1 and 0. What to do is read from the table's
    distinct hours and minutes (at most 1440) and its first times, from its distinct times, which are written first: one pass.
    """
    minute = F.date_trunc("minute", F.timestamp_add("SECOND", F.lit(30), F.col("time"))).cast("timestamp_ntz")
    each = store(df.where("time is not null").select("time").distinct().select(minute.alias("time")).distinct(), "times")
    kinds = [(r.h, r.m) for r in each.select(F.hour("time").alias("h"), F.minute("time").alias("m")).distinct().collect()]
    times = [r.time for r in each.orderBy("time").limit(1500).collect()]
    df = df.withColumn("time", minute)
    delta = next((b.hour - a.hour for a, b in zip(times, times[1:]) if b.hour > a.hour), None)
    if delta is None or all(h % delta == 0 for h, _ in kinds) and not any(m for _, m in kinds):
        return df
    offsets = {12: 6, 6: 3, 3: 1, 1: 0}  # fixed values
    if delta not in offsets:
        raise ValueError(f"no rule for steps of {delta} hours")
    up = all(m >= 30 for _, m in kinds)
    hour = F.date_trunc("hour", F.timestamp_add("MINUTE", F.lit(59 if up else 0), F.col("time"))).cast("timestamp_ntz")
    return df.withColumn("time", F.timestamp_add("HOUR", F.lit(offsets[delta]), hour))


def select_years(df: DataFrame, first: int, last: int, months: Sequence[int] = tuple(range(1, 13))) -> DataFrame:
    """Rows of these years and months; the range of years is also a plain range of time, which prunes files."""
    return df.where((F.col("time") >= F.lit(f"{first:04d}-01-01").cast("timestamp_ntz")) & (F.col("time") < F.lit(f"{last + 1:04d}-01-01").cast("timestamp_ntz")) & F.month("time").isin(*months))


def select_interval(df: DataFrame, start: str, end: str) -> DataFrame:
    """From the start of month `start` to the end of month `end` (yyyy-mm)."""
    return df.where((F.col("time") >= F.lit(f"{start}-01").cast("timestamp_ntz")) & (F.col("time") < F.add_months(F.lit(f"{end}-01").cast("date"), 1).cast("timestamp_ntz")))


def select_hours(df: DataFrame, hours: Sequence[int]) -> DataFrame:
    return df.where(F.hour("time").isin(*hours))


def select_dates(df: DataFrame, times: Sequence[str]) -> DataFrame:
    """Rows at these times; a date alone is its midnight."""
    return df.where(F.col("time").isin(*(F.lit(t).cast("timestamp_ntz") for t in times)))


def keep_last(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with the same key and time the last in `order`."""
    w = Window.partitionBy(*by, "time").orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def deaccumulate(df: DataFrame, by: Sequence[str], order: Sequence[str] = ("time",), file: str | None = None, keep_file: bool = False) -> DataFrame:
    """Steps of a counter, at the middle of each step; the first row of a series goes. file: the column by whose values counters start anew (keep_file: it stays)."""
    w = Window.partitionBy(*by, *([file] if file else [])).orderBy(*order)
    before = df.withColumn("_v", F.lag("value").over(w)).withColumn("_t", F.lag("time").over(w)).where("_t is not null")
    half = F.timestamp_diff("SECOND", F.col("_t"), F.col("time")) / 2
    return before.select(*by, F.timestamp_add("SECOND", -F.floor(half).cast("int"), F.col("time")).alias("time"), (F.col("value") - F.col("_v")).alias("value"), *([file] if file and keep_file else []))


def forward_fill(fine: DataFrame, coarse: DataFrame, by: Sequence[str], name: str = "other") -> DataFrame:
    """`fine` with the value of `coarse` at the same time, or else the last one found before."""
    joined = fine.join(coarse.select(*by, "time", F.col("value").alias("_c")), [*by, "time"], "left")
    w = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.last("_c", ignorenulls=True).over(w)).drop("_c")


def derive(expression: str, by: Sequence[str], **inputs: DataFrame) -> DataFrame:
    """A SQL expression over series joined on key and time, each under its name."""
    out = None
    for name, df in inputs.items():
        one = df.select(*by, "time", F.col("value").alias(name))
        out = one if out is None else out.join(one, [*by, "time"])
    return out.select(*by, "time", clean(F.expr(expression)).alias("value"))


def condition_table(df: DataFrame, bounds: DataFrame, op: str, cell: str = "cell_id", value: str = "value") -> DataFrame:
    """Values that compare to their cell's bound (cell, value), else missing; cells without a bound are missing."""
    b = bounds.select(F.col(cell).alias("_cell"), F.col(value).alias("_q"))
    joined = df.join(b, df[cell].eqNullSafe(F.col("_cell")), "left")
    return joined.withColumn("value", F.when(OPERATORS[op](F.col("value"), F.col("_q")), F.col("value"))).drop("_cell", "_q")


#: Comparisons by name.
OPERATORS = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__, "=": Column.__eq__}


def condition(df: DataFrame, other: DataFrame, by: Sequence[str], op: str, bound: float | None = None, percentile: float | None = None, freq: str | None = None) -> DataFrame:
    """Values where `other` compares to `bound`, or to its own percentile in each series, else missing. freq: other is given per bucket."""
    if other is df and not freq:
        # one table: its own values tell, at once
        q = F.percentile("value", F.lit(percentile / 100)).over(Window.partitionBy(*by)) if percentile is not None else F.lit(bound)
        keep = F.max(OPERATORS[op](F.col("value"), F.col("_q"))).over(Window.partitionBy(*by, "time"))
        return df.withColumn("_q", q).withColumn("_keep", keep).select(*by, "time", F.when(F.col("_keep"), F.col("value")).alias("value"))
    key = bucket(F.col("time"), freq) if freq else F.col("time")
    o = other.select(*by, key.alias("_key"), F.col("value").alias("_o"))
    q = F.percentile("_o", F.lit(percentile / 100)).over(Window.partitionBy(*by)) if percentile is not None else F.lit(bound)
    o = o.withColumn("_q", q).groupBy(*by, "_key").agg(F.max(OPERATORS[op](F.col("_o"), F.col("_q"))).alias("_keep"))
    same = [F.col(f"_b{k}").eqNullSafe(F.col(c)) for k, c in enumerate(by)] + [F.col("_at").eqNullSafe(F.col("_key"))]
    o = o.select(*(F.col(c).alias(f"_b{k}") for k, c in enumerate(by)), F.col("_key").alias("_at"), "_keep")
    return df.withColumn("_key", key).join(o, reduce(Column.__and__, same), "left").select(*by, "time", F.when(F.col("_keep"), F.col("value")).alias("value"))
