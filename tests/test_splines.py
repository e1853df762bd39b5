"""Splines against piecewise polynomials that are solved for from their conditions."""

import datetime as dt

import numpy as np
import pytest

from cellweave.operators import series, splines


def pieces(x, y, at, degree):
    """Coefficients of all pieces at once: values at the points, continuous derivatives below the degree at the breaks."""
    breaks = np.r_[x[0], x[2:-2], x[-1]] if degree == 3 else np.r_[x[0], ((x[1:] + x[:-1]) / 2)[1:-1], x[-1]]
    m, p = len(breaks) - 1, degree + 1
    rows, b = [], []
    where = lambda v: int(np.clip(np.searchsorted(breaks, v, "right") - 1, 0, m - 1))

    def row(k, v, order):
        out = np.zeros(m * p)
        for j in range(order, p):
            out[k * p + j] = np.prod(np.arange(j, j - order, -1)) * (v - breaks[k]) ** (j - order)
        return out

    for v, value in zip(x, y):
        rows.append(row(where(v), v, 0))
        b.append(value)
    for k in range(1, m):
        for order in range(degree):
            rows.append(row(k - 1, breaks[k], order) - row(k, breaks[k], order))
            b.append(0)
    c = np.linalg.solve(np.array(rows), np.array(b))
    return np.array([row(where(v), v, 0) @ c for v in at])


@pytest.mark.parametrize("degree", [2, 3])
@pytest.mark.parametrize("n", [4, 5, 6, 30])
def test_splines_equal_solved_pieces(degree, n):
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.uniform(0.2, 2, n)), rng.normal(size=n)
    at = np.r_[x, rng.uniform(x[0], x[-1], 50)]
    assert np.allclose(splines.spline(x, y, at, degree), pieces(x, y, at, degree), atol=1e-8)
    curve = np.polynomial.Polynomial(rng.normal(size=degree + 1))
    assert np.allclose(splines.spline(x, curve(x), at, degree), curve(at), atol=1e-7)


@pytest.mark.parametrize("kind", ["quadratic", "cubic"])
def test_series_are_interpolated(spark, kind):
    start = dt.datetime(2000, 1, 1, 0, 30)
    rows = [(c, start + dt.timedelta(hours=2 * k), float((k * (c or 7)) % 5) if (c, k) != (3, 4) else None) for c in (1, 2, 3, None) for k in range(9)] + [(4, start, 1.0), (1, None, 9.0)]
    got = {}
    for r in series.interpolate(spark.createDataFrame(rows, "cell int, time timestamp_ntz, value double"), ["cell"], "1H", kind).collect():
        got.setdefault(r.cell, {})[r.time] = r.value
    degree = splines.DEGREES[kind]
    at = [start + dt.timedelta(minutes=30 + 60 * k) for k in range(16)]
    for c in (1, 2, None):
        own = [v for d, _, v in rows[:36] if d == c]
        want = pieces(np.arange(9) * 2.0, np.array(own), np.arange(16) + 0.5, degree)
        assert sorted(got[c]) == at and np.allclose([got[c][t] for t in at], want, atol=1e-8)
    assert set(got[3].values()) == {None} and 4 not in got
    with pytest.raises(ValueError, match="unknown interpolation"):
        series.interpolate(spark.createDataFrame(rows, "cell int, time timestamp_ntz, value double"), ["cell"], "1H", "quintic")
