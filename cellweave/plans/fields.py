"""Registered queries of files and of grids with bent lines, each with its SQL.

`customer` gives a grid of ten columns in rotated coordinates, a row for each ten
customers; `lineitem` daily series of the suppliers' grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import curved, grid, large, objects, series, statistics
from cellweave.sources import files, netcdf
from cellweave.sources.scratch import folder, store

from .queries import DAY, GRID, Tables, query

POLE = (-170.0, 40.0)


def rotated_sql(name: str, x: str, y: str) -> str:
    """Columns lon and lat of rotated coordinates (degrees), for the pole above."""
    return f"""
{name}_v as (
  select *, cos(radians({x})) * cos(radians({y})) as px, sin(radians({x})) * cos(radians({y})) as py, sin(radians({y})) as pz from {name}_r),
{name} as (
  select *, (degrees(atan2(py, cos(radians(50.0)) * px - sin(radians(50.0)) * pz)) + 10.0 + 540.0) % 360.0 - 180.0 as lon,
    degrees(asin(sin(radians(50.0)) * px + cos(radians(50.0)) * pz)) as lat
  from {name}_v)"""


def bent(t: Tables, dx: float = 0.0, dy: float = 0.0, part: int = 1) -> DataFrame:
    """A customer's cell: column and row from its number, half a degree and a twentieth (or a `part` of these) apart; moved by parts of a step."""
    c = F.col("c_custkey")
    cells = t.table("customer").select(c.alias("cell_id"), F.floor(c / 10).cast("int").alias("y"), (c % 10).cast("int").alias("x"))
    lon, lat = grid.rotate((F.col("x") + dx) / (2 * part), (F.col("y") + dy) / (20 * part), *POLE)
    return cells.select("cell_id", "y", "x", lon.alias("lon"), lat.alias("lat"))


def inner(t: Tables, dx: float, dy: float, margin: int, part: int = 1) -> DataFrame:
    """Cells moved into the grid's inside, away from its ragged first and last row."""
    last = t.table("customer").agg(F.floor(F.max("c_custkey") / 10).alias("last"))
    return bent(t, dx, dy, part).join(last, F.col("y").between(margin, F.col("last") - 1 - margin)).where(F.col("x").between(margin - 1, 9 - margin)).drop("last")


def months(t: Tables) -> DataFrame:
    """Three months, for a cross join: Spark counts its rows, but not those that `explode` adds, and would take the series for small and broadcast it."""
    return t.spark.range(1, 4).select(F.col("id").alias("month"))


INNER = """
k as (select c_custkey as cell_id, c_custkey // 10 as y, c_custkey % 10 as x from customer),
t_r as (select cell_id, (x + {dx}) / 2 as rx, (y + {dy}) / 20 as ry from k
  where y between {margin} and (select max(y) from k) - 1 - {margin} and x between {margin} - 1 and 9 - {margin})"""


# a field of places comes out exactly, whatever the quadrilaterals look like; longitudes jump at the date line and turn at the pole, which the grid passes
# from 8,000 customers on, so it is the places' points in space that are interpolated
@query(
    "regrid_bilinear_rotated",
    f"""with {INNER.format(dx=0.3, dy=0.4, margin=1)}, {rotated_sql('t', 'rx', 'ry')}
select cell_id, n as month, round(n * (lon + 2 * lat), 6) as value from t, range(1, 4) m(n)""",
)
def regrid_bilinear_rotated(t: Tables) -> DataFrame:
    source, target = bent(t), inner(t, 0.3, 0.4, 1)
    a, b = F.radians("lon"), F.radians("lat")
    parts = F.array(*(F.struct(F.lit(k).alias("part"), v.alias("v")) for k, v in enumerate((F.cos(a) * F.cos(b), F.sin(a) * F.cos(b), F.sin(b)))))
    values = source.select("cell_id", F.explode(parts).alias("p")).crossJoin(months(t)).select("cell_id", "month", "p.part", (F.col("month") * F.col("p.v")).alias("value"))
    found = grid.regrid(values, store(curved.bilinear_weights_in_space(source, target), "weights"), target, ["month", "part"])
    x, y, z = (F.max(F.when(F.col("part") == k, F.col("value"))) for k in range(3))
    lon, lat = F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))
    return found.groupBy("cell_id", "month").agg((F.col("month") * (lon + 2 * lat)).alias("value"))


# a constant stays one in all cells that the sources cover, here those inside; from 17,000 customers on rows a twentieth of a degree apart would run over
# the rotated pole and cover cells again, so both steps are then smaller by a power of two
@query(
    "regrid_conservative_rotated",
    f"""with {INNER.format(dx=0.3, dy=0.4, margin=2)}
select cell_id, n as month, round(n::double, 6) as value from t_r, range(1, 4) m(n)""",
)
def regrid_conservative_rotated(t: Tables) -> DataFrame:
    last, part = t.last("customer", "c_custkey"), 1
    while (last + 2) / (20 * part) > 85:
        part *= 2
    target = inner(t, 0.3, 0.4, 2, part)
    full = bent(t, part=part).where((F.col("y") > 0) & (F.col("y") < last))
    source = full.withColumn("y", F.col("y") - 1)
    cells = target.withColumns({"y": F.col("y") - 2, "x": F.col("x") - 1})
    values = source.select("cell_id").crossJoin(months(t)).withColumn("value", F.col("month").cast("double"))
    return grid.regrid(values, store(curved.conservative_weights(source, cells), "weights"), cells, ["month"])


# what is written and read again is the table it was made of
@query(
    "netcdf_series",
    f"""with {DAY}, {GRID}
select cell_id, round(any_value(lon)::double, 6) as lon, round(any_value(lat)::double, 6) as lat, date_trunc('month', time)::timestamp as time,
  count(value) as n, round(sum(value), 6) as value
from d join g on cell = cell_id where time >= '1995-01-01' and time < '1996-07-01' group by cell_id, date_trunc('month', time)""",
)
def netcdf_series(t: Tables) -> DataFrame:
    path = folder(t.spark, "netcdf")
    netcdf.write_series(t.days().withColumnRenamed("cell", "cell_id"), t.grid(), path, "qty")
    df, cells = files.open_series(t.spark, files.find(t.spark, f"{path}/qty_*.nc"), "qty")
    number = (F.col("cell_id") / files.ROW_CELLS).cast("int") * 10 + F.col("cell_id") % files.ROW_CELLS
    month = df.where("time >= '1995-01-01' and time < '1996-07-01' and value is not null").groupBy("cell_id", F.date_trunc("month", "time").cast("timestamp_ntz").alias("time")).agg(F.count("value").alias("n"), F.sum("value").alias("value"))
    return month.join(cells, "cell_id").select(number.alias("cell_id"), "lon", "lat", "time", "n", "value")


@query(
    "netcdf_rows",
    """select o_orderdate::timestamp as time, count(*) as n, round(sum(o_totalprice), 2) as value, round(max(o_totalprice), 2) as largest
from orders group by o_orderdate""",
)
def netcdf_rows(t: Tables) -> DataFrame:
    path = folder(t.spark, "netcdf")
    days = t.orders().groupBy("time").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.max("value").alias("largest"))
    netcdf.write_rows(days, path)
    found = netcdf.rows(t.spark, files.find(t.spark, f"{path}/*.nc"))
    return found.select("time", F.col("n").cast("bigint").alias("n"), F.round("value", 2).alias("value"), F.round("largest", 2).alias("largest"))


# objects of months, strip by strip: cells of the suppliers' grid where the month's mean is above the middle
@query(
    "labels_in_strips",
    f"""with recursive {GRID},
m as (select l_suppkey as cell_id, date_trunc('month', l_shipdate)::timestamp as time, avg(l_quantity) as value from lineitem where year(l_shipdate) = 1995 group by all),
c as materialized (select time, y, x, y * 10 + x as k from m join g using (cell_id) where value > 27),
link as materialized (select a.time, a.k, b.k as o from c a join c b on a.time = b.time and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1),
reach as (select time, k, o from link union select r.time, r.k, l.o from reach r join link l on l.time = r.time and l.k = r.o),
first as (select time, k, min(o) as k0 from reach group by time, k)
select time, label, count(*) as cells, min(k) as first from (select time, k, dense_rank() over (partition by time order by k0) as label from first) group by time, label""",
)
def labels_in_strips(t: Tables) -> DataFrame:
    month = series.select_years(t.items(), 1995, 1995).groupBy(F.col("cell").alias("cell_id"), F.date_trunc("month", "time").cast("timestamp_ntz").alias("time")).agg(F.avg("value").alias("value"))
    cells = month.join(t.grid(), "cell_id").select("time", "y", "x", (F.col("value") > 27).alias("on"))
    runs = objects.labels_of_fields(cells, height=3)
    return runs.groupBy("time", "label").agg(F.sum(F.col("after") - F.col("first")).alias("cells"), F.min(10 * F.col("y") + F.col("first")).alias("first"))


# quantiles of a group that no task holds, for all prices and for each status
@query(
    "quantiles_pooled",
    """select p::double as pctl, round(quantile_cont(l_extendedprice::double, [0.01, 0.5, 0.95, 0.999])[i], 6) as value
from lineitem, (values (1, 1), (2, 50), (3, 95), (4, 99.9)) v(i, p) group by i, p""",
)
def quantiles_pooled(t: Tables) -> DataFrame:
    prices = t.table("lineitem").select(F.col("l_extendedprice").cast("double").alias("value"))
    return statistics.percentiles(prices, [], [1, 50, 95, 99.9])


@query(
    "quantiles_large_groups",
    """select l_returnflag, round(quantile_cont(l_quantity::double, 0.25), 6) as lower, round(quantile_cont(l_quantity::double, 0.75), 6) as upper
from lineitem group by l_returnflag""",
)
def quantiles_large_groups(t: Tables) -> DataFrame:
    found = large.quantiles(t.table("lineitem"), ["l_returnflag"], [0.25, 0.75], value="l_quantity")
    return found.select("l_returnflag", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"))


# ranks and running totals of one long order
@query(
    "ranked_pooled",
    """select l_orderkey, l_linenumber, row_number() over w as place,
  round(sum(l_quantity::double) over (w rows unbounded preceding) / sum(l_quantity::double) over (), 6) as share
from lineitem window w as (order by l_extendedprice desc, l_orderkey, l_linenumber)""",
)
def ranked_pooled(t: Tables) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    found = large.running(t.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), [], order, {"_sum": F.col("l_quantity").cast("double")})
    return found.select("l_orderkey", "l_linenumber", "place", (F.col("_sum") / F.col("_sum_all")).alias("share"))
