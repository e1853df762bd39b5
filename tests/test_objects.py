import datetime as dt

import duckdb
import numpy as np
import pytest

from cellweave.operators import objects
from cellweave.plans.queries import QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_smoothing_equals_a_convolution_with_mirrored_borders(spark, sf):
    data = f"/root/testdata/{sf}"
    height, width = duckdb.sql(f"select max(s_suppkey // 10) + 1, max(s_suppkey % 10) + 1 from '{data}/supplier.parquet'").fetchall()[0]
    found = duckdb.sql(f"select date_trunc('month', l_shipdate)::timestamp, l_suppkey // 10, l_suppkey % 10, sum(l_quantity)::double from '{data}/lineitem.parquet' where day(l_shipdate) <= 15 and l_suppkey in (select s_suppkey from '{data}/supplier.parquet') group by all").fetchall()
    fields = {}
    for time, y, x, v in found:
        fields.setdefault(time, np.full((height, width), np.nan))[y, x] = v
    expected = {}
    for time, f in fields.items():
        p = np.pad(np.nan_to_num(f), 1, mode="symmetric")
        total = sum(p[j : j + height, i : i + width] for j in range(3) for i in range(3)) / 9
        expected |= {(time, y, x): total[y, x] for y, x in zip(*np.nonzero(~np.isnan(f)))}
    got = {(r.time, r.y, r.x): r.value for r in QUERIES["smooth_2d"](spark, data).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-5 for k, v in expected.items())


def flood(on):
    """Objects by flood fill, diagonal neighbours too, in order of their first cell."""
    names, k = np.zeros(on.shape, int), 0
    for y, x in zip(*np.nonzero(on)):
        if names[y, x]:
            continue
        k += 1
        open_ = [(y, x)]
        while open_:
            j, i = open_.pop()
            if 0 <= j < on.shape[0] and 0 <= i < on.shape[1] and on[j, i] and not names[j, i]:
                names[j, i] = k
                open_ += [(j + dy, i + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return names


def brute_sal(m, r, bounds):
    """Structure, amplitude and location by their definitions, on full fields."""
    sides = []
    for f, b in zip((m, r), bounds):
        names = flood(np.nan_to_num(f, nan=-1) > b)
        mass = lambda on, f=f: np.hypot(*(np.array(np.nonzero(on)) * f[on]).sum(axis=1)) / f[on].sum()
        whole = mass(names > 0)
        parts = [names == k for k in range(1, names.max() + 1)]
        total = [f[p].sum() for p in parts]
        volume = sum(t * t / f[p].max() for t, p in zip(total, parts)) / sum(total)
        scatter = sum(t * abs(mass(p) - whole) for t, p in zip(total, parts)) / sum(total)
        sides.append((volume, whole, scatter, np.nanmean(f)))
    a, b = sides
    far = np.hypot(*m.shape)
    return 2 * (a[0] - b[0]) / (a[0] + b[0]), 2 * (a[3] - b[3]) / (a[3] + b[3]), abs(a[1] - b[1]) / far, 2 * abs(a[2] - b[2]) / far


def table(spark, fields):
    rows = [(dt.datetime(2000, 1, 1 + t), y, x, None if np.isnan(v) else float(v)) for t, f in enumerate(fields) for (y, x), v in np.ndenumerate(f)]
    return spark.createDataFrame(rows, "time timestamp_ntz, y int, x int, value double")


@pytest.mark.parametrize("how,value", [("S", 0.8), ("F", 0.6), ("P", 70)])
def test_sal_equals_brute_force(spark, how, value):
    rng = np.random.default_rng(1)
    m, r = rng.random((3, 9, 12)), rng.random((3, 9, 12)) * 1.3
    r[2] = 0.1  # one time without objects, but where the bound is relative
    found = {x.time.day - 1: x for x in objects.sal(table(spark, m), table(spark, r), how, value).collect()}
    assert found.keys() == ({0, 1} if how == "S" else {0, 1, 2} if how == "F" else {0, 1})
    for t in (0, 1):
        bounds = [value if how == "S" else value * f.max() if how == "F" else np.percentile(f, value) for f in (m[t], r[t])]
        assert np.allclose([found[t].s, found[t].a, found[t].l1, found[t].l2], brute_sal(m[t], r[t], bounds)) and abs(found[t].l - found[t].l1 - found[t].l2) < 1e-12
    assert objects.sal(table(spark, m).where("false"), table(spark, r)).collect() == []


def test_size_limits_and_object_properties(spark):
    f = np.zeros((8, 10))
    f[1:3, 1:5], f[6, 8], f[5, 3], f[6, 4] = 2.0, 9.0, 3.0, 5.0
    f[2, 2] = 4.0
    sea = spark.createDataFrame([(y, x, x >= 4) for y in range(8) for x in range(10)], "y int, x int, sea boolean")
    rows = objects.sal_objects(table(spark, [f]), table(spark, [f]), "S", 1.0, sea=sea).where("side = 'model'").orderBy("label").collect()
    assert [(r.size, r.total, r.most, r.kind) for r in rows] == [(8, 18.0, 4.0, 2), (2, 8.0, 5.0, 2), (1, 9.0, 9.0, 0)]
    block, pair = rows[0], rows[1]
    assert (block.centre_y, block.centre_x, block.extent) == (1.5, 2.5, 1.0) and abs(block.ratio - 4 / (18 / 8)) < 1e-12
    assert abs(block.major_axis - 4 * np.sqrt(1.25)) < 1e-9 and abs(block.minor_axis - 4 * np.sqrt(0.25)) < 1e-9
    assert pair.extent == 0.5 and abs(pair.major_axis - 4 * np.sqrt(0.5)) < 1e-9 and abs(pair.minor_axis) < 1e-6
    only = objects.sal_objects(table(spark, [f]), table(spark, [f]), "S", 1.0, least=2, most=7).collect()
    assert {(r.side, r.size, r.kind) for r in only} == {("model", 2, None), ("reference", 2, None)}


def test_a_contour_of_one_cell_gives_no_location(spark):
    m = np.random.default_rng(1).random((1, 6, 7))
    m[0, 0, 0] = np.nan
    assert objects.farthest(np.isfinite(m[0])) == 0
    found = objects.sal(table(spark, m), table(spark, np.abs(m - 0.1)), "F", 0.5).collect()
    assert len(found) == 1 and found[0].l1 is None and found[0].l is None and found[0].s is not None


def test_longest_distance_of_valid_cells():
    valid = np.ones((6, 7), bool)
    assert objects.farthest(valid) == pytest.approx(np.hypot(6, 7)), "all valid: the diagonal"
    valid[:] = False
    valid[1:5, 2:6] = True
    # crossings are taken at the first cell of each pair: rows 0 to 4, columns 1 to 5
    points = [(y, 1) for y in range(1, 5)] + [(y, 5) for y in range(1, 5)] + [(0, x) for x in range(2, 6)] + [(4, x) for x in range(2, 6)]
    assert objects.farthest(valid) == pytest.approx(max(np.hypot(a[0] - b[0], a[1] - b[1]) for a in points for b in points))


@pytest.mark.parametrize("options", [{}, {"fill": 2.0}, {"wrap": True}, {"interpolate": True}, {"ignore_edges": True}, {"interpolate": True, "ignore_edges": True, "least_weight": 0.5}])
def test_fourier_convolution_equals_sums(spark, options):
    rng = np.random.default_rng(6)
    f, k = rng.random((9, 11)), rng.random((5, 3))
    f[2, 3] = f[0, 0] = np.nan
    expected = np.zeros(f.shape)
    for y in range(9):
        for x in range(11):
            total = weight = 0.0
            for j in range(5):
                for i in range(3):
                    yy, xx = y - (j - 2), x - (i - 1)
                    out = not (0 <= yy < 9 and 0 <= xx < 11)
                    v = f[yy % 9, xx % 11] if options.get("wrap") or not out else options.get("fill", 0.0)
                    known = not np.isnan(v)
                    total += k[j, i] * (v if known else 0.0)
                    if (known or not options.get("interpolate")) and not (out and options.get("ignore_edges") and not options.get("wrap")):
                        weight += k[j, i] / k.sum()
            divided = options.get("interpolate") or options.get("ignore_edges")
            expected[y, x] = total if not divided else np.nan if weight < options.get("least_weight", 0) else total / weight
    assert np.allclose(objects.convolved(f, k, **options), expected, equal_nan=True)
    found = {(r.y, r.x): r.value for r in objects.smooth_fft(table(spark, [f]), k, **options).collect()}
    assert all(found[p] is None if np.isnan(v) else abs(found[p] - v) < 1e-9 for p, v in np.ndenumerate(expected))
