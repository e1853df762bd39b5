"""Weights between grids with bent lines: linear fields, constants and totals, brute force by points, and a run from files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import curved, grid
from cellweave.plans import config
from cellweave.sources import files, netcdf

CELLS = "cell_id bigint, y int, x int, lon double, lat double"


def turn(lon, lat, pole_lon, pole_lat):
    """Rotated to true degrees, by rotating vectors."""
    a, b = np.radians(lon), np.radians(lat)
    v = np.array([np.cos(a) * np.cos(b), np.sin(a) * np.cos(b), np.sin(b)])
    t, p = math.radians(90 - pole_lat), math.radians(180 + pole_lon)
    v = np.array([[math.cos(t), 0, -math.sin(t)], [0, 1, 0], [math.sin(t), 0, math.cos(t)]]) @ v
    v = np.array([[math.cos(p), -math.sin(p), 0], [math.sin(p), math.cos(p), 0], [0, 0, 1]]) @ v
    return np.degrees(np.arctan2(v[1], v[0])), np.degrees(np.arcsin(np.clip(v[2], -1, 1)))


def rotated(spark, ny=9, nx=8, pole=(-170.0, 40.0), step=1.5, lon0=-5.0, lat0=-4.0):
    y, x = (a.ravel() for a in np.mgrid[0:ny, 0:nx])
    lon, lat = turn(lon0 + step * x, lat0 + step * y, *pole)
    rows = [(int(i * 100 + j), int(i), int(j), float(a), float(b)) for i, j, a, b in zip(y, x, lon, lat)]
    return spark.createDataFrame(rows, CELLS), rows


def regular(spark, lon, lat):
    rows = [(i * 1000 + j, i, j, float(a), float(b)) for i, b in enumerate(lat) for j, a in enumerate(lon)]
    return spark.createDataFrame(rows, CELLS), rows


def weights(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.target_cell, {})[r.source_cell] = r.w
    return out


@pytest.mark.parametrize("pole", [(-170.0, 40.0), (0.0, 30.0)])  # the second's longitudes pass the date line
def test_linear_fields_are_exact(spark, pole):
    source, rows = rotated(spark, pole=pole)
    y, x = np.random.default_rng(1).uniform(0, 1, (2, 200)) * [[8], [7]]
    lon, lat = turn(-5 + 1.5 * np.floor(x) + 1.5 * (x % 1), -4 + 1.5 * y, *pole)
    target = spark.createDataFrame([(k, 0, k, float(a), float(b)) for k, (a, b) in enumerate(zip(lon, lat))], CELLS)
    w = weights(curved.bilinear_weights(source, target))
    far = lambda a, b: (a - b + 180) % 360 - 180
    own = {r[0]: r for r in rows}
    assert len(w) > 170  # sides of quadrilaterals are straight in degrees and not on the sphere: border points can lie outside
    for k, of in w.items():
        assert abs(sum(of.values()) - 1) < 1e-9 and len(of) <= 4 and min(of.values()) > 0
        assert abs(sum(v * far(own[s][3], lon[k]) for s, v in of.items())) < 1e-7 and abs(sum(v * own[s][4] for s, v in of.items()) - lat[k]) < 1e-7


def test_centres_outside_have_no_weights_and_ties_one_quadrilateral(spark):
    source, rows = rotated(spark)
    inner = [r for r in rows if 0 < r[1] < 8 and 0 < r[2] < 7]
    target = spark.createDataFrame([(r[0], 0, k, r[3], r[4]) for k, r in enumerate(inner)] + [(-1, 0, 99, 100.0, -60.0), (-2, 0, 98, None, 50.0)], CELLS)
    w = weights(curved.bilinear_weights(source, target))
    assert set(w) == {r[0] for r in inner}
    assert all(abs(of[c] - 1) < 1e-6 for c, of in w.items())


def test_bilinear_equals_that_of_rectilinear_grids(spark):
    source, _ = regular(spark, range(0, 8), range(40, 50))
    target, _ = regular(spark, np.linspace(0.2, 6.7, 9), np.linspace(40.1, 48.8, 7))
    one, other = weights(grid.bilinear_weights(source, target)), weights(curved.bilinear_weights(source, target))
    assert set(one) == set(other)
    for t in one:
        assert {s: round(v, 9) for s, v in one[t].items()} == {s: round(v, 9) for s, v in other[t].items()}


def test_gaps_repeats_and_nothing(spark):
    source, rows = rotated(spark)
    gap = source.withColumn("lon", F.when(F.col("cell_id") != 303, F.col("lon")))
    target, _ = rotated(spark, ny=4, nx=4, step=1.0, lon0=-2.0, lat0=-1.0)
    w = weights(curved.bilinear_weights(gap, target))
    assert w and all(303 not in of for of in w.values())
    for method in (curved.bilinear_weights, curved.conservative_weights):
        assert method(source, target.where("false")).count() == 0


def points_in(ring, p):
    """Which points of the sphere lie left of all sides of a ring."""
    return np.all([p @ np.cross(ring[k], ring[(k + 1) % len(ring)]) >= 0 for k in range(len(ring))], 0)


def test_overlap_on_the_sphere_equals_counted_points():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(400_000, 3)) * [0.12, 0.12, 0] + [0, 0, 1]
    flat = p[:, :2].copy()
    p /= np.linalg.norm(p, axis=1)[:, None]
    density = np.exp(-(flat**2).sum(1) / (2 * 0.12**2)) / (2 * math.pi * 0.12**2) * (1 + (flat**2).sum(1)) ** 1.5  # points for each unit of area, over all points

    def ring(cx, cy, angle, size):
        a = angle + np.array([0.25, 0.75, 1.25, 1.75]) * math.pi
        r = np.stack([cx + size * np.cos(a), cy + size * np.sin(a), np.ones(4)], 1)
        return r / np.linalg.norm(r, axis=1)[:, None]

    a = np.stack([ring(*x) for x in [(0, 0, 0.1, 0.1), (0, 0, 0.3, 0.1), (0.05, 0.02, 0, 0.08), (0.3, 0.3, 0, 0.05), (0, 0, 0, 0.03)]])
    b = np.stack([ring(*x) for x in [(0, 0, 0.1, 0.1), (0.03, 0.02, 1.0, 0.1), (0, 0, 0.7, 0.1), (0, 0, 0, 0.1), (0, 0, 0.2, 0.15)]])
    got = curved.sphere_overlap(a, b)
    for k in range(5):
        both = points_in(a[k], p) & points_in(b[k], p)
        assert abs(got[k] - (1 / density[both]).sum() / len(p)) < 3e-4
    assert np.allclose(got, curved.sphere_overlap(a[:, ::-1], b)) and np.allclose(got, curved.sphere_overlap(b, a)) and np.allclose(got, curved.sphere_overlap(a, b[:, ::-1]))
    octant = np.array([[[1, 0, 0], [0, 1, 0], [0, 0, 1.0]]])
    assert math.isclose(curved.sphere_area(octant, np.array([3]))[0], math.pi / 2)


@pytest.mark.parametrize(("pole", "lon", "lat"), [((-170.0, 40.0), np.arange(-8, 37, 2.5), np.arange(30, 70, 2.0)), ((0.0, 30.0), np.arange(160, 204, 2.5), np.arange(40, 80, 2.0)), ((10.0, 3.0), np.arange(-180, 180, 10.0), np.arange(64.5, 90, 3.0))])
def test_constants_and_totals_are_kept(spark, pole, lon, lat):
    """The third grid holds a pole."""
    source, rows = rotated(spark, pole=pole)
    target, cells = regular(spark, lon, lat)
    w = curved.conservative_weights(source, target)
    own, area = ({r.cell_id: abs(curved.sphere_area(np.array(r.ring).reshape(1, -1, 3), np.array([4]))[0]) for r in curved.sphere_rings(g).collect()} for g in (source, target))
    assert len(own) == len(rows) and len(area) == len(cells)
    of = weights(w)
    value = {r[0]: 280 + r[1] - 0.3 * r[2] ** 2 for r in rows}
    whole = sum(own[s] * v for s, v in value.items())
    assert math.isclose(sum(area[t] * v * value[s] for t, x in of.items() for s, v in x.items()), whole, rel_tol=1e-7)
    back = {}
    for t, x in of.items():
        assert sum(x.values()) < 1 + 1e-7
        for s, v in x.items():
            back[s] = back.get(s, 0) + v * area[t]
    assert all(math.isclose(back[s], own[s], rel_tol=1e-6) for s in value)
    df = source.select("cell_id", F.lit(1).alias("time"), F.lit(7.5).alias("value"))
    got = {r.cell_id: r.value for r in grid.regrid(df, w, target).collect()}
    assert all(abs(v - 7.5) < 1e-9 for v in got.values() if v is not None) and {c for c, v in got.items() if v is not None} == set(of) and len(got) == len(cells)


def test_a_run_regrids_rotated_files(spark, tmp_path):
    """From NetCDF files with rotated or two-dimensional coordinates, by `analyse`."""
    source, _ = rotated(spark)
    target, _ = regular(spark, np.arange(6, 15, 1.0), np.arange(48, 54, 1.0))
    days = spark.range(0, 60).selectExpr("timestamp_ntz '2000-01-01 00:00:00' + make_dt_interval(int(id)) as time")
    linear = source.crossJoin(days).selectExpr("cell_id", "time", "lon + 2 * lat as value")
    netcdf.write_series(linear, source, str(tmp_path / "m1/day/tas/tas_a"), "tas")
    for k, d in enumerate(("200001", "200002")):
        (tmp_path / f"m1/day/tas/tas_m1_{d}-{d}.nc").write_bytes((tmp_path / f"m1/day/tas/tas_a/tas_{d}-{d}.nc").read_bytes())
    netcdf.write_series(target.selectExpr("cell_id", "timestamp_ntz '2000-01-01' as time", "0.0 as value"), target, str(tmp_path / "grid"), "tas")
    (to,) = files.find(spark, f"{tmp_path}/grid/*.nc")
    text = f"""
[MODELS]
m1 = {{'fpath': '{tmp_path}/m1', 'start year': 2000, 'end year': 2000, 'months': [1, 2]}}
[SETTINGS]
output dir = '{tmp_path}/out'
variables = {{'tas': {{'freq': 'day', 'regrid to': {{'name': 'g', 'file': '{to}'}}, 'regrid method': '{{}}'}}}}
[STATISTICS]
stats = {{'moments': {{'moment stat': ['all', 'mean']}}}}
"""
    want = {i * files.ROW_CELLS + j: a + 2 * b for i, b in enumerate(range(48, 54)) for j, a in enumerate(range(6, 15))}
    for method, near in (("bilinear", 1e-6), ("conservative", 2.5)):
        (result,) = config.analyse(spark, text.replace("'{}'", f"'{method}'"))
        got = {r.cell_id: r.value for r in result.frame.collect()}
        assert set(got) == set(want)
        covered = [c for c, v in got.items() if v is not None]
        assert len(covered) > 20 and all(abs(got[c] - want[c]) < near for c in covered)
