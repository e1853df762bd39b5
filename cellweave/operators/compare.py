"""Comparing results: differences, regional means, trends, scores.

Only keys that both sides have are compared, and null keys meet nothing but in
`t_test`. A null on either side gives null, or is skipped where values are summed
or averaged. Keys are unique in results; repeated ones are compared each with each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import large


def difference(model: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = reference.select(*keys, F.col("value").alias("_r"))
    return model.join(r, list(keys)).select(*keys, (F.col("value") - F.col("_r")).alias("value"))


def regional_mean(df: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The plain mean of a region's cells for each key."""
    return df.join(cells, "cell_id").groupBy("region", *keys).agg(F.avg("value").alias("value"))


def trend(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """The straight line through the values over column x."""
    rows = df.where("value is not null")
    return rows.groupBy(*by).agg(F.regr_slope("value", x).alias("slope"), F.regr_intercept("value", x).alias("intercept"))


def share_index(model: DataFrame, reference: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sum over the bins of the absolute difference of their shares (of `statistics.asop`)."""
    r = reference.select(*by, "bin", F.col("share").alias("_r"))
    return model.join(r, [*by, "bin"]).groupBy(*by).agg(F.sum(F.abs(F.col("share") - F.col("_r"))).alias("value"))


def levels(df: DataFrame, n: int = 10) -> list[float]:
    """Evenly spaced contour levels between percentiles 2 and 98, to 99 where the values lean to the right."""
    r = large.quantiles(df, [], [0.02, 0.98, 0.99]).first()[0], df.agg(F.skewness("value")).first()[0]
    if r[0][0] is None:
        raise ValueError("no values")
    lo, hi = r[0][0], r[0][2] if (r[1] or 0) > 2 else r[0][1]
    return [lo + (hi - lo) * k / (n - 1) for k in range(n)]


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or tiny)
            c = (1 + k / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_tail(t: float, df: float) -> float:
    """The chance of a larger absolute t."""
    return _beta(df / (df + t * t), df / 2, 0.5)


def t_bound(alpha: float, df: float) -> float:
    """What t passes with the chance alpha on one side."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_tail(mid, df) / 2 > alpha else (lo, mid)
    return (lo + hi) / 2


def t_test(a: DataFrame, b: DataFrame, by: Sequence[str], alpha: float | None = None) -> DataFrame:
    """(by..., t, df) of the difference of two means, each with its own error; with `alpha` also bound, what t passes by chance on one side, and p, of both sides.

    Null where a sample has fewer than two values. The distribution's tail is
    worked out on the reduced rows, one for each series.
    """
    half = lambda x, n: x.groupBy(*by).agg(F.avg("value").alias(f"m{n}"), (F.var_samp("value") / F.count("value")).alias(f"e{n}"), F.count("value").alias(f"n{n}"))
    one, two = half(a, 1), half(b, 2)
    if by:
        two = two.toDF(*(f"_b{k}" for k in range(len(by))), "m2", "e2", "n2")
        both = one.join(two, reduce(Column.__and__, (F.col(f"_b{k}").eqNullSafe(F.col(c)) for k, c in enumerate(by))))
    else:
        both = one.crossJoin(two)  # a row each
    out = both.select(*by, ((F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(F.col("e1") + F.col("e2")), F.lit(0.0))).alias("t"), (F.col("n1") + F.col("n2") - 2).alias("df"))
    if alpha is None:
        return out

    @F.pandas_udf("bound double, p double")
    def tail(t: pd.Series, df: pd.Series) -> pd.DataFrame:
        bounds = {n: t_bound(alpha, n) if n > 0 else None for n in set(df)}
        return pd.DataFrame({"bound": [bounds[n] for n in df], "p": [None if pd.isna(x) or n <= 0 else t_tail(x, n) for x, n in zip(t, df)]})

    return out.withColumn("_r", tail("t", "df")).select(*by, "t", "df", "_r.bound", "_r.p")
