"""NetCDF files, written here byte by byte or by the sink, against what they hold."""

import math
import os
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.sources import files, netcdf

TIME, SPACE = 3, (2, 3)


def text(s):
    return struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)


def attribute(name, kind, value):
    if kind == 2:
        raw, n = value.encode(), len(value)
    else:
        fmt = {3: "h", 4: "i", 5: "f", 6: "d"}[kind]
        raw, n = struct.pack(f">{len(value)}{fmt}", *value), len(value)
    return text(name) + struct.pack(">ii", kind, n) + raw + b"\0" * (-len(raw) % 4)


def attributes(*found):
    return struct.pack(">ii", 12 if found else 0, len(found)) + b"".join(attribute(*a) for a in found)


def classic(path, version=1, units="hours since 2000-01-01 00:00:00", calendar="standard", streaming=False, bent=False, numbers=(0.0, 6.0, 30.0)):
    """A file with packed values (time, lat, lon) of 16 bits, of two records' variables, so that records are padded."""
    ny, nx = SPACE
    dims = struct.pack(">ii", 10, 3) + text("time") + struct.pack(">i", 0) + text("lat") + struct.pack(">i", ny) + text("lon") + struct.pack(">i", nx)
    place = [1, 2] if bent else None
    variables = [
        ("lon", place or [2], attributes(("units", 2, "degrees_east")), 6, 8 * (ny * nx if bent else nx)),
        ("lat", place or [1], attributes(("units", 2, "degrees_north")), 6, 8 * (ny * nx if bent else ny)),
        ("time", [0], attributes(("units", 2, units), ("calendar", 2, calendar)), 6, 8),
        ("tas", [0, 1, 2], attributes(("scale_factor", 6, [0.5]), ("add_offset", 6, [10.0]), ("_FillValue", 3, [-99])), 3, 2 * ny * nx),
        ("odd", [0, 2], attributes(), 3, 2 * nx),
    ]

    def head(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", -1 if streaming else TIME) + dims + attributes(("title", 2, "made by hand")) + struct.pack(">ii", 11, len(variables))
        for (name, at, own, kind, size), b in zip(variables, begins):
            out += text(name) + struct.pack(f">{len(at) + 1}i", len(at), *at) + own + struct.pack(">ii", kind, size + -size % 4) + struct.pack(">i" if version == 1 else ">q", b)
        return out

    at, begins = len(head([0] * 5)), []
    for v in variables:
        begins.append(at)
        at += v[4] + -v[4] % 4
    body = head(begins)
    lon, lat = [350.0, 0.0, 10.0], [50.0, 55.0]
    if bent:
        lon, lat = [x + 0.1 * y for y in range(ny) for x in (1, 2, 3)], [50 + y + 0.2 * x for y in range(ny) for x in range(nx)]
    body += struct.pack(f">{len(lon)}d", *lon) + struct.pack(f">{len(lat)}d", *lat)
    for t in range(TIME):
        values = [100 * t + 10 * y + x for y in range(ny) for x in range(nx)]
        values[4] = -99
        body += struct.pack(">d", numbers[t]) + struct.pack(">6h", *values) + struct.pack(">3h", 1, 2, 3) + b"\0\0"
    path.write_bytes(body)
    return str(path)


def value(t, y, x):
    return None if (y, x) == (1, 1) else (100 * t + 10 * y + x) * 0.5 + 10


@pytest.mark.parametrize(("version", "streaming"), [(1, False), (2, False), (1, True)])
def test_reads_bytes(spark, tmp_path, version, streaming):
    path = classic(tmp_path / "tas_200001-200001.nc", version, streaming=streaming)
    df, g = files.open_series(spark, [path], "tas")
    got = {(r.cell_id, r.time): r.value for r in df.collect()}
    hours = [datetime(2000, 1, 1), datetime(2000, 1, 1, 6), datetime(2000, 1, 2, 6)]
    assert got == {(y * files.ROW_CELLS + x, hours[t]): value(t, y, x) for t in range(3) for y in range(2) for x in range(3)}
    assert {(r.y, r.x): (r.lon, r.lat) for r in g.collect()} == {(y, x): ((-10.0, 0.0, 10.0)[x], (50.0, 55.0)[y]) for y in range(2) for x in range(3)}
    dumped = netcdf.dump(path)
    assert "int16 tas(time, lat, lon)" in dumped and "tas:scale_factor = [0.5]" in dumped and ":title = made by hand" in dumped and "time = 3" in dumped


def test_filters_choose_steps(tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    path = classic(tmp_path / "a_200001.nc")
    r = netcdf.NetcdfReader({"paths": f'["{path}"]', "variable": "tas"})
    assert len(list(r.pushFilters([GreaterThanOrEqual(("time",), datetime(2000, 1, 1, 6)), LessThan(("value",), 3.0)]))) == 2  # Spark holds rows against both again
    (part,) = r.partitions()
    assert sum(b.num_rows for b in r.read(part)) == 12


def test_large_steps_are_cut(monkeypatch, tmp_path):
    path = classic(tmp_path / "a_200001.nc")
    whole = netcdf.NetcdfReader({"paths": f'["{path}"]', "variable": "tas"})
    want = [r for p in whole.partitions() for b in whole.read(p) for r in b.to_pylist()]
    monkeypatch.setattr(netcdf, "TASK_BYTES", 6)
    parts = whole.partitions()
    assert len(parts) == 6
    assert sorted((r for p in parts for b in whole.read(p) for r in b.to_pylist()), key=lambda r: (r["time"], r["y"], r["x"])) == want


def test_spark_prunes_times(spark, tmp_path):
    path = classic(tmp_path / "a_200001.nc")
    df = netcdf.series(spark, [path], "tas").where(F.col("time") >= F.lit("2000-01-02").cast("timestamp_ntz"))
    assert df.count() == 6 and {r.time for r in df.select("time").distinct().collect()} == {datetime(2000, 1, 2, 6)}


def test_two_dimensional_coordinates_and_bounds(spark, tmp_path):
    path = classic(tmp_path / "a_200001.nc", bent=True)
    g = {(r.y, r.x): (round(r.lon, 6), round(r.lat, 6)) for r in files.read_grid(spark, path).collect()}
    assert g[1, 2] == (3.1, 51.4) and len(g) == 6
    with pytest.raises(ValueError, match="no times"):
        files.read_bounds(spark, path, "tas")


@pytest.mark.parametrize(
    ("units", "calendar", "number", "want"),
    [
        ("days since 1949-12-01", "standard", 0.5, datetime(1949, 12, 1, 12)),
        ("minutes since 2000-02-28T23:00:00Z", "proleptic_gregorian", 1500, datetime(2000, 3, 1)),
        ("days since 2000-01-01", "noleap", 59, datetime(2000, 3, 1)),
        ("days since 2001-01-01", "365_day", 365 * 3 + 31 + 28, datetime(2004, 3, 1)),
        ("day as %Y%m%d.%f", "standard", 20000229.25, datetime(2000, 2, 29, 6)),
        ("seconds since 1970-01-01 00:00:00", "gregorian", -1, datetime(1969, 12, 31, 23, 59, 59)),
    ],
)
def test_times(units, calendar, number, want):
    assert netcdf.times(np.array([number]), {"units": units, "calendar": calendar}).astype("M8[us]")[0].item() == want


def test_what_is_refused(tmp_path):
    with pytest.raises(ValueError, match="no timestamp"):
        netcdf.times(np.array([1.0]), {"units": "days since 2000-01-01", "calendar": "360_day"})
    for raw, match in ((b"\x89HDF\r\n\x1a\n", "HDF5"), (b"PAR1", "not a NetCDF")):
        (tmp_path / "x.nc").write_bytes(raw * 3)
        with pytest.raises(ValueError, match=match):
            netcdf.header_of(str(tmp_path / "x.nc"))


def table(spark, bent=False):
    g = spark.range(20).selectExpr("id + 5 as cell_id", "cast(id div 5 as int) y", "cast(id % 5 as int) x").withColumn("lon", 10.0 + F.col("x") + (0.3 * F.col("y") if bent else 0)).withColumn("lat", 50.0 + F.col("y") + (0.1 * F.col("x") if bent else 0))
    hours = spark.range(0, 24 * 70, 5).selectExpr("timestamp_ntz '2000-01-15 00:00:00' + make_dt_interval(0, int(id)) as time", "id as h")
    df = g.crossJoin(hours).where("(cell_id + h) % 7 != 0").selectExpr("cell_id", "time", "case when h % 11 != 0 then cell_id + h / 8 end as value")
    return df, g


@pytest.mark.parametrize("bent", [False, True])
def test_round_trip(spark, tmp_path, bent):
    df, g = table(spark, bent)
    path = str(tmp_path / "out")
    netcdf.write_series(df, g, path, "tas", attributes={"units": "K"}, about={"title": "t"})
    names = sorted(os.listdir(path))
    assert names == ["tas_200001-200001.nc", "tas_200002-200002.nc", "tas_200003-200003.nc"]
    back, cells = files.open_series(spark, [f"{path}/{n}" for n in names], "tas")
    got = {(r.cell_id // files.ROW_CELLS * 5 + r.cell_id % files.ROW_CELLS + 5, r.time): r.value for r in back.collect()}
    want = {(r.cell_id, r.time): r.value for r in df.collect()}
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in want.items() if v is not None}
    assert len(got) == 20 * len({t for _, t in want})
    near = lambda rows: sorted((r.y, r.x, round(r.lon, 9), round(r.lat, 9)) for r in rows)
    assert near(cells.collect()) == near(g.collect())
    assert "tas:units = K" in netcdf.dump(f"{path}/{names[0]}")


def test_writer_refuses_and_leaves_nothing(spark, tmp_path):
    df, g = table(spark)
    with pytest.raises(Exception, match="two values of one cell"):
        netcdf.write_series(df.union(df.limit(1)), g, str(tmp_path / "a"), "tas")
    assert [n for n in os.listdir(tmp_path / "a") if n.endswith(".nc") or n == "_temporary" and os.listdir(tmp_path / "a" / n)] == []
    with pytest.raises(Exception, match="without a time or a cell"):
        netcdf.write_series(df.selectExpr("cell_id + 1 as cell_id", "time", "value"), g, str(tmp_path / "b"), "tas")
    netcdf.write_series(df.where("false"), g, str(tmp_path / "c"), "tas")
    assert [n for n in os.listdir(tmp_path / "c") if n.endswith(".nc")] == []


def test_tables_of_numbers(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2000, 1, 1), 1, 2.5), (None, 2, None), (datetime(2001, 5, 1, 3), 3, -1.0)], "time timestamp_ntz, label int, area double")
    path = str(tmp_path / "rows")
    for _ in range(2):  # the second takes the first's place
        netcdf.write_rows(df, path, {"title": "objects"})
    back = netcdf.rows(spark, [f"{path}/{n}" for n in sorted(os.listdir(path)) if n.endswith(".nc")])
    assert back.columns == ["time", "label", "area"]
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted((tuple(r) for r in df.selectExpr("time", "double(label)", "area").collect()), key=str)


def test_large_files_take_wide_numbers():
    head = netcdf.encode_header(2, [("time", 0), ("y", 40000), ("x", 40000)], {}, [("t", ["time", "y", "x"], {}, ">f8")])
    import io

    h = netcdf.read_header(io.BytesIO(head), 0)
    assert head[3] == 5 and h.variables["t"].shape == [2, 40000, 40000] and h.variables["t"].begin == len(head) and h.variables["t"].stride == 8 * 40000**2 and math.prod(h.dims.values()) == 2 * 40000**2


def test_results_of_objects_are_written_and_read(spark, tmp_path):
    from cellweave.operators import objects

    rng = np.random.default_rng(3)
    field = lambda shift: [(datetime(2000, 1, d), int(y), int(x), float(v)) for d in (1, 2) for (y, x), v in np.ndenumerate(np.roll(np.outer(np.hanning(12), np.hanning(15)) + 0.01 * rng.random((12, 15)), shift + d, 1))]
    model, reference = (spark.createDataFrame(field(k), "time timestamp_ntz, y int, x int, value double") for k in (0, 2))
    weights = np.full((3, 3), 1 / 9)
    whole, parts = objects.sal_files(model, reference, str(tmp_path / "out"), weights=weights, how="F", value=0.3)
    smooth = [objects.smooth_fft(df, weights) for df in (model, reference)]
    key = lambda r: tuple(r)
    assert sorted(whole.collect(), key=key) == sorted(objects.sal(*smooth, how="F", value=0.3).collect(), key=key) and whole.count() == 2
    want = {(r.time, r.side, r.label): (r["size"], r.total) for r in objects.sal_objects(*smooth, how="F", value=0.3).collect()}
    assert {(r.time, objects.SIDES[r.side], r.label): (r["size"], r.total) for r in parts.collect()} == want
    empty, none = objects.sal_files(model.where("false"), reference, str(tmp_path / "out"))
    assert empty.collect() == none.collect() == [] and not list((tmp_path / "out/sal").glob("*.nc"))
