"""Interpolating splines of second and third degree, one series in a task.

The knots of a cubic spline are the given times but the second and the last but
one ("not a knot"); those of a quadratic one lie half way between the times, but
for the first and the last such place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.sources.scratch import reachable

DEGREES = {"quadratic": 2, "cubic": 3}


def knots(x: np.ndarray, degree: int) -> np.ndarray:
    inner = x[2:-2] if degree == 3 else ((x[1:] + x[:-1]) / 2)[1:-1]
    return np.r_[[x[0]] * (degree + 1), inner, [x[-1]] * (degree + 1)]


def basis(t: np.ndarray, degree: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the number of the first B-spline that isn't zero there, and the values of it and the `degree` next ones."""
    last = np.clip(np.searchsorted(t, at, "right") - 1, degree, len(t) - degree - 2)
    values = np.zeros((len(at), degree + 1))
    values[:, 0] = 1
    for d in range(1, degree + 1):
        # each one of degree d - 1 is shared between two of degree d
        kept = np.zeros(len(at))
        for j in range(d):
            left, right = t[last + j + 1 - d], t[last + j + 1]
            part = values[:, j] / (right - left)
            values[:, j] = kept + (right - at) * part
            kept = (at - left) * part
        values[:, d] = kept
    return last - degree, values


def coefficients(x: np.ndarray, y: np.ndarray, t: np.ndarray, degree: int) -> np.ndarray:
    """Of the B-splines whose sum goes through the points: a banded system, which needs no pivots."""
    n, k = len(x), degree
    first, values = basis(t, k, x)
    band, b = np.zeros((n + k, 3 * k + 1)), np.r_[y.astype(float), np.zeros(k)]
    np.put_along_axis(band[:n], (first - np.arange(n) + k)[:, None] + np.arange(k + 1), values, 1)
    for r in range(n):
        for j in range(1, k + 1):
            f = band[r + j, k - j] / band[r, k]
            if f:
                band[r + j, k - j : 2 * k + 1 - j] -= f * band[r, k : 2 * k + 1]
                b[r + j] -= f * b[r]
    for r in range(n - 1, -1, -1):
        b[r] = (b[r] - band[r, k + 1 : 2 * k + 1] @ b[r + 1 : r + k + 1]) / band[r, k]
    return b[:n]


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """The spline through points at ascending x, at other places between the first and the last."""
    t = knots(x, degree)
    c = coefficients(x, y, t, degree)
    first, values = basis(t, degree, at)
    return (values * c[first[:, None] + np.arange(degree + 1)]).sum(1)


def interpolate(df: DataFrame, by: Sequence[str], step: int, kind: str) -> DataFrame:
    """Each series (by..., time, value) at every multiple of `step` seconds between its first and last time.

    A spline depends on all values, so a series with a missing one is missing
    everywhere, and so is one with fewer points than its degree and one more.
    Times of a series are distinct; rows without a time go. Null keys are keys.
    """
    degree = DEGREES[kind]
    reachable(df.sparkSession)
    from pyspark.sql.types import StructType

    schema = StructType([df.schema[c] for c in by]).add("time", "timestamp_ntz").add("value", "double")

    def run(part: pa.Table) -> pa.Table:
        time = part.column("time").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
        value = part.column("value").to_numpy().astype(float)
        order = np.argsort(time)
        time, value = time[order], value[order]
        at = np.arange(-(-time[0] // (step * 1_000_000)), time[-1] // (step * 1_000_000) + 1) * step * 1_000_000
        scale = max(1, time[-1] - time[0])
        if len(time) > degree and not np.isnan(value).any():
            found = spline((time - time[0]) / scale, value, (at - time[0]) / scale, degree)
        else:
            found = np.full(len(at), np.nan)
        keys = [part.column(c).take(pa.array(np.zeros(len(at), np.int64))) for c in by]
        return pa.table([*keys, pa.array(at.astype("M8[us]"), pa.timestamp("us")), pa.array(found, mask=np.isnan(found))], names=[*by, "time", "value"])

    rows = df.where("time is not null").select(*by, F.col("time").cast("timestamp_ntz").alias("time"), F.col("value").cast("double").alias("value"))
    return rows.groupBy(*by).applyInArrow(run, schema)
