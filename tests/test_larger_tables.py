"""Queries against their SQL where the grid that a table's keys make is longer than the smallest tables', and plans that hold at any size."""

from datetime import datetime

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.operators import curved, grid, indices, series
from cellweave.plans import fields, more  # noqa: F401  register their queries
from cellweave.plans.queries import ORACLE_SQL, QUERIES, Tables


def compared(spark, path, name, **tables):
    """The rows of a query and of its SQL over tables made by SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    df = QUERIES[name](spark, str(path))
    rel = con.sql(ORACLE_SQL[name]).order("cell_id, month")
    return [tuple(r) for r in df.select(*rel.columns).orderBy("cell_id", "month").collect()], rel.fetchall()


@pytest.mark.parametrize("name", ["regrid_conservative", "regrid_uncovered"])
def test_rows_of_many_suppliers_stay_on_the_sphere(spark, tmp_path, name):
    items = "select s::bigint as l_suppkey, make_timestamp(1995, m::int, 1, 0, 0, 0) as l_shipdate, (s * 7 + m) % 50 + 1.0::double as l_quantity from range(2000) a(s), range(1, 3) b(m)"
    got, expected = compared(spark, tmp_path, name, supplier="select range as s_suppkey from range(2000)", lineitem=items)
    assert len(got) == len(expected) >= 1000
    assert all(a[:2] == b[:2] and (a[2] is None if b[2] is None else a[2] is not None and abs(a[2] - b[2]) <= 2e-6) for a, b in zip(got, expected))


def test_draws_are_not_broadcast(spark):
    """They come from a row for each series, which looks small, and are as many as the rows of all samples."""
    df = spark.range(100).selectExpr("id % 2 as cell", "timestamp_seconds(id) as time", "double(id) as value")
    found = indices.block_bootstrap(df, ["cell"], 5, 4)
    assert found.count() == 400
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_cells_of_many_customers_stay_on_the_sphere(spark, tmp_path):
    got, expected = compared(spark, tmp_path, "regrid_conservative_rotated", customer="select range as c_custkey from range(19000)")
    assert got == expected


def test_bilinear_at_the_pole_and_the_date_line(spark, tmp_path):
    """Customer 8000's centre is the pole; rows beyond it lie at the date line."""
    got, expected = compared(spark, tmp_path, "regrid_bilinear_rotated", customer="select range as c_custkey from range(7800, 8600)")
    assert len(got) == len(expected) > 2000
    assert all(a[:2] == b[:2] and a[2] is not None and abs(a[2] - b[2]) <= 2e-6 for a, b in zip(got, expected))


@pytest.mark.parametrize("name", ["regrid_bilinear_rotated", "regrid_conservative_rotated"])
def test_values_of_many_cells_are_not_broadcast(spark, tmp_path, name):
    """They come from a small file of cells, several for each, so they look smaller than they are."""
    duckdb.sql(f"copy (select range as c_custkey from range(30000)) to '{tmp_path}/customer.parquet' (format parquet)")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "Join [source_cell" in plan and "BroadcastHashJoin [source_cell" not in plan


def test_cells_with_their_corners_are_not_broadcast(spark, tmp_path):
    duckdb.sql(f"copy (select range as c_custkey from range(30000)) to '{tmp_path}/customer.parquet' (format parquet)")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        plan = curved.sphere_rings(fields.bent(Tables(spark, str(tmp_path))))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "SortMergeJoin [y" in plan and "BroadcastHashJoin" not in plan


def test_grid_that_goes_around_the_sphere_again(spark, monkeypatch):
    """Rows lie on each other from the second lap on: each target's weights are of the first lap, and later quadrilaterals aren't tried."""
    cells = spark.range(3 * 900).selectExpr("id as cell_id", "int(id div 3) as y", "int(id % 3) as x")
    place = lambda dx, dy: grid.rotate((F.col("x") + dx) * 2, F.col("y") + dy, -170.0, 40.0)
    source = cells.select("*", *(c.alias(n) for c, n in zip(place(0.0, 0.0), ("lon", "lat"))))
    target = cells.where("x < 2 and y < 890").select("*", *(c.alias(n) for c, n in zip(place(0.3, 0.4), ("lon", "lat"))))
    found = {}
    for r in curved.bilinear_weights_in_space(source, target).collect():
        found.setdefault(r.target_cell, []).append((r.source_cell, r.w))
    assert len(found) == 2 * 890
    for c, w in found.items():
        first = c % 1080  # 360 rows of three cells
        assert sorted(s for s, _ in w) == [first, first + 1, first + 3, first + 4] and abs(sum(v for _, v in w) - 1) < 1e-9
    # one at a time in a cube, each is tried until all targets are held
    q = pa.table({"y": pa.array([5, 3, 4], pa.int32()), "x": pa.array([0, 0, 0], pa.int32()), "ids": [[9] * 4, [1, 2, 3, 4], [5] * 4], "points": [[1.0, 0, 0, 1.0, 0.1, 0, 1.0, 0, 0.1, 1.0, 0.1, 0.1]] * 3, "r": [0.1] * 3})
    t = pa.table({"target_cell": [7, 8], "t": [[1.0, 0.02, 0.03], [1.0, -0.5, 0.0]]})
    tried = []
    inverse = curved.inverse_bilinear
    monkeypatch.setattr(curved, "TRIED", 1)
    monkeypatch.setattr(curved, "inverse_bilinear", lambda xs, ys, px, py: tried.append(len(px)) or inverse(xs, ys, px, py))
    held = curved._held(q, t).to_pylist()
    assert [(h["target_cell"], h["y"], h["ids"]) for h in held] == [(7, 3, [1, 2, 3, 4])]
    assert sum(tried) == 1 and curved._held(q.slice(0, 0), t).num_rows == 0


def test_times_are_looked_through_once(spark):
    rows, read = [(1, datetime(2000, 1, 1, h, 30), float(h)) for h in range(0, 24, 3)], spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    schema = "cell bigint, time timestamp_ntz, value double"
    found = series.whole_hours(spark.createDataFrame(rows, schema).mapInPandas(counted, schema))
    assert read.value == len(rows)
    assert [r.time.hour for r in found.orderBy("value").collect()] == [2, 5, 8, 11, 14, 17, 20, 23]
