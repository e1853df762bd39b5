"""Nearest cells by tiles against all distances."""

import numpy as np
import pytest

from cellweave.operators import grid


@pytest.mark.parametrize("shape", ["regular", "line", "clumps", "one", "none"])
def test_nearest_equals_all_distances(spark, shape):
    rng = np.random.default_rng(1)
    if shape == "regular":
        cells = [(i * 100 + j, i, j, float(j), 40 + i / 2) for i in range(15) for j in range(20)]
    elif shape == "line":
        cells = [(j, 0, j, float(j), 45.0) for j in range(50)]
    elif shape == "clumps":  # most of the extent is empty
        places = np.concatenate([rng.normal(c, 0.05, (60, 2)) for c in ((-100, -50), (20, 30), (150, 60))])
        cells = [(k, k // 10, k % 10, float(a), float(b)) for k, (a, b) in enumerate(places)]
    else:
        cells = [(7, 0, 0, 3.0, 4.0)] if shape == "one" else []
    cells.append((999_999, 50, 50, None, 45.0))
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform([-180, -80], [180, 80], (60, 2)))]
    points += [(100 + k, c[3] + 0.5, c[4] + 0.25) for k, c in enumerate(cells[:40]) if c[3] is not None] + [(200, None, 1.0), (201, 10.5, 43.0)]
    got = {r.point: (r.cell_id, r.distance) for r in grid.nearest(spark.createDataFrame(points, "point int, lon double, lat double"), spark.createDataFrame(cells, "cell_id bigint, y int, x int, lon double, lat double")).collect()}
    real = [c for c in cells if c[3] is not None]
    want = {}
    for p, a, b in points:
        if a is not None and real:
            d, _, _, cell = min((float(np.sqrt((c[3] - a) * (c[3] - a) + (c[4] - b) * (c[4] - b))), c[1], c[2], c[0]) for c in real)
            want[p] = (cell, d)
    assert got == want
