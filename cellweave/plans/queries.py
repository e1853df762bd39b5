"""The registered queries of the series operators, each with the same query in SQL.

`events` gives a series for each user, `lineitem` one for each supplier (a cell of
a grid of ten columns), `orders` one for each customer. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import thermo
from cellweave.operators import compare, grid, indices, objects, runs, series, statistics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BY = ["cell"]

EV = "ev as (select user_id as cell, ts as time, value from events)"
LI = "li as (select l_suppkey as cell, l_shipdate as time, l_quantity as value from lineitem)"
OR = "o as (select o_custkey as cell, o_orderdate as time, o_totalprice as value from orders)"
DAY = LI + ", d as (select cell, date_trunc('day', time)::timestamp as time, sum(value) as value from li group by all)"
GRID = "g as (select s_suppkey as cell_id, (s_suppkey // 10)::int as y, (s_suppkey % 10)::int as x, 10.0 + s_suppkey % 10 as lon, 50.0 + (s_suppkey // 10) / 4 as lat from supplier)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self) -> DataFrame:
        return series.series(self.table("events").withColumnRenamed("user_id", "cell"), BY, "ts", "value")

    def items(self) -> DataFrame:
        return series.series(self.table("lineitem").withColumnRenamed("l_suppkey", "cell"), BY, "l_shipdate", "l_quantity")

    def days(self) -> DataFrame:
        return series.resample(self.items(), BY, "D", "sum")

    def orders(self) -> DataFrame:
        return series.series(self.table("orders").withColumnRenamed("o_custkey", "cell"), BY, "o_orderdate", "o_totalprice")

    def grid(self) -> DataFrame:
        c = F.col("s_suppkey")
        return self.table("supplier").select(c.alias("cell_id"), F.floor(c / 10).cast("int").alias("y"), (c % 10).cast("int").alias("x"), (10.0 + c % 10).alias("lon"), (50.0 + F.floor(c / 10) / 4).alias("lat"))

    def last(self, table: str, key: str) -> int:
        """The last row of the grid that a table's keys make, ten cells a row; -1 of an empty table."""
        found = self.table(table).agg(F.floor(F.max(key) / 10)).first()[0]
        return -1 if found is None else found


# cycles and moments
SQL_METHOD = {"mean": "avg({})", "max": "max({})", "min": "min({})", "std": "stddev_pop({})", "median": "quantile_cont({}, 0.5)", "sum": "coalesce(sum({}), 0)", "percentile 95": "quantile_cont({}, 0.95)", "percentile 90": "quantile_cont({}, 0.9)"}
SEASON = "case month(time) % 12 // 3 when 0 then 'DJF' when 1 then 'MAM' when 2 then 'JJA' else 'SON' end"

for _name, _how, _least in (("annual_cycle_mean", "mean", 5.0), ("annual_cycle_p95", "percentile 95", None), ("annual_cycle_std", "std", None)):
    _v = f"case when value >= {_least} then value end" if _least else "value"
    query(_name, f"with {LI} select cell, month(time)::bigint as month, round({SQL_METHOD[_how].format(_v)}, 6) as value, count({_v}) as n from li group by all")(lambda t, how=_how, least=_least: statistics.annual_cycle(t.items(), BY, how, least))
for _name, _how in (("seasonal_cycle_mean", "mean"), ("seasonal_cycle_p90", "percentile 90"), ("seasonal_cycle_max", "max")):
    query(_name, f"with {LI}, f as (select cell, {SEASON} as season, {SQL_METHOD[_how].format('value')} as value, count(value) as n from li group by all), e as (select * from (select distinct cell from li), (values ('DJF'), ('MAM'), ('JJA'), ('SON')) s(season)) select cell, season, round(value, 6) as value, coalesce(n, 0) as n from e left join f using (cell, season)")(lambda t, how=_how: statistics.seasonal_cycle(t.items(), BY, how))
for _name, _how in (("diurnal_cycle_mean", "mean"), ("diurnal_cycle_p95", "percentile 95")):
    query(_name, f"with {EV} select cell, hour(time)::bigint as hour, round({SQL_METHOD[_how].format('value')}, 6) as value, count(value) as n from ev group by all")(lambda t, how=_how: statistics.diurnal_cycle(t.events(), BY, how))
query("diurnal_hours_selected", f"with {EV} select cell, hour(time)::bigint as hour, round(avg(value), 6) as value, count(value) as n from ev where hour(time) in (0, 6, 12, 18) group by all")(lambda t: statistics.diurnal_cycle(series.select_hours(t.events(), [0, 6, 12, 18]), BY))
query("diurnal_frequency", f"with {EV}, s as (select hour(time) as hour, count(distinct time) as steps from ev group by all) select cell, hour(time)::bigint as hour, count(*) filter (value >= 50) as n, any_value(steps) as steps from ev join s on s.hour = hour(time) group by cell, hour(time)")(lambda t: statistics.diurnal_frequency(t.events(), BY, 50.0))
for _name, _how, _freq, _unit in (("moments_daily_mean", "mean", "D", "day"), ("moments_monthly_max", "max", "MS", "month"), ("moments_yearly_std", "std", "YS", "year")):
    query(_name, f"with {LI} select cell, date_trunc('{_unit}', time)::timestamp as time, round({SQL_METHOD[_how].format('value')}, 6) as value from li group by all")(lambda t, how=_how, freq=_freq: statistics.moments(t.items(), BY, how, freq))
query("moments_all_median", f"with {LI} select cell, round(quantile_cont(value, 0.5), 6) as value from li group by all")(lambda t: statistics.moments(t.items(), BY, "median"))
query("moments_pooled_mean", f"with {LI} select round(avg(value), 6) as value from li")(lambda t: statistics.moments(t.items(), []))
query("resample_6h_sum", f"with {EV} select cell, time_bucket(interval 6 hour, time, timestamp '1970-01-01') as time, round(sum(value), 6) as value from ev group by all")(lambda t: series.resample(t.events(), BY, "6H", "sum", label="start"))
query("resample_3h_midpoint_label", f"with {EV} select cell, time_bucket(interval 3 hour, time, timestamp '1970-01-01') + interval 90 minute as time, round(avg(value), 6) as value from ev group by all")(lambda t: series.resample(t.events(), BY, "3H", "mean"))
query("resample_qs_dec", f"with {LI} select cell, (date_trunc('quarter', time + interval 1 month) - interval 1 month)::timestamp as time, round(avg(value), 6) as value from li group by all")(lambda t: series.resample(t.items(), BY, "QS-DEC"))
query("select_months", f"with {LI} select cell, count(*) as n, round(sum(value), 6) as total from li where year(time) between 1996 and 1998 and month(time) in (6, 7, 8) group by all")(lambda t: series.select_years(t.items(), 1996, 1998, [6, 7, 8]).groupBy("cell").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
query("select_interval", f"with {LI} select cell, count(*) as n from li where time >= '1996-03-01' and time < '1997-03-01' group by all")(lambda t: series.select_interval(t.items(), "1996-03", "1997-02").groupBy("cell").agg(F.count("*").alias("n")))
query("scale_offset", "select l_suppkey as cell, round(avg(l_quantity * 0.1 + 273.15), 6) as value from lineitem group by all")(lambda t: statistics.moments(series.series(t.table("lineitem").withColumnRenamed("l_suppkey", "cell"), BY, "l_shipdate", "l_quantity", 0.1, 273.15), BY))

# percentiles and distributions
query("percentiles_multi", f"with {LI} select cell, p::double as pctl, round(quantile_cont(value, [0.05, 0.5, 0.95, 0.99])[i], 6) as value from li, (values (1, 5), (2, 50), (3, 95), (4, 99)) q(i, p) group by cell, i, p")(lambda t: statistics.percentiles(t.items(), BY, [5, 50, 95, 99]))
query("percentile_thresholded", f"with {EV} select cell, 90.0::double as pctl, round(quantile_cont(value, 0.9) filter (value >= 20), 6) as value from ev group by all")(lambda t: statistics.percentiles(t.events(), BY, [90], 20.0))
EDGES = [0.0, 5.0, 10.0, 20.0, 35.0, 50.0]


def bins_sql(edges: list[float], closed: bool, table: str, value: str = "value") -> str:
    """CTEs e (lo, hi, bin), c (cell, bin, n_bin, total, n) of every cell and bin."""
    rows = ", ".join(f"({k}::bigint, {a}::double, {b}::double)" for k, (a, b) in enumerate(zip(edges, edges[1:])))
    top = f"v <= hi and bin = {len(edges) - 2} or v < hi" if closed else "v < hi"
    return f"e(bin, lo, hi) as (values {rows}), v0 as (select cell, {value} as v from {table}), f as (select cell, bin, count(*) as n_bin, sum(v) as total from v0 join e on v >= lo and ({top}) group by all), c as (select cell, n, e.bin, lo, hi, coalesce(n_bin, 0) as n_bin, coalesce(total, 0) as total from (select cell, count(v) as n from v0 group by all) s cross join e left join f using (cell, bin))"


query("pdf_density", f"with {LI}, {bins_sql(EDGES, True, 'li')} select cell, bin, lo, hi, round(n_bin / (nullif(sum(n_bin) over (partition by cell), 0) * (hi - lo)), 6) as value from c")(lambda t: statistics.pdf(t.items(), BY, EDGES))
query("pdf_thresholded", f"with {LI}, {bins_sql(EDGES, True, 'li', 'case when value >= 10 then value end')} select cell, bin, lo, hi, round(n_bin / (nullif(sum(n_bin) over (partition by cell), 0) * (hi - lo)), 6) as value from c")(lambda t: statistics.pdf(t.items(), BY, EDGES, 10.0))
query("pdf_normalized", f"with {LI}, {bins_sql(EDGES, False, 'li')} select cell, bin, lo, hi, round(total / nullif(sum(total) over (partition by cell), 0), 6) as value from c")(lambda t: statistics.pdf(t.items(), BY, EDGES, normalised=True))
query("pdf_dry_events", f"with {EV} select cell, count(*) filter (value < 10) as n from ev group by all")(lambda t: statistics.dry_count(t.events(), BY, 10.0))
query("diurnal_pdf", f"with ev as (select ts as time, value, hour(ts)::bigint as cell from events), {bins_sql([0.0, 25.0, 100.0, 500.0], True, 'ev')} select cell as hour, bin, lo, hi, round(n_bin / (nullif(sum(n_bin) over (partition by cell), 0) * (hi - lo)), 6) as value from c")(lambda t: statistics.pdf(t.events().withColumn("hour", F.hour("time")), ["hour"], [0.0, 25.0, 100.0, 500.0]))
for _name, _edges in (("asop_klingaman", statistics.klingaman_edges(40)), ("asop_exponential", statistics.exponential_edges(60))):
    query(_name, f"with {LI}, {bins_sql(_edges, False, 'li')} select cell, bin, round(lo, 6) as lo, round(hi, 6) as hi, round(total / nullif(n, 0), 6) as contrib, round((total / nullif(n, 0)) / nullif(sum(total / nullif(n, 0)) over (partition by cell), 0), 6) as share from c")(lambda t, edges=_edges: statistics.asop(t.items(), BY, edges))


def halves(t: Tables, edges):
    rows = t.items().withColumn("first", F.month("time") <= 6)
    return tuple(statistics.asop(rows.where(c).drop("first"), BY, edges) for c in ("first", "not first"))


_E = statistics.klingaman_edges(40)
query("asop_fc_index", f"with {LI}, a as (select * from li where month(time) <= 6), b as (select * from li where month(time) > 6), x as (with {bins_sql(_E, False, 'a')} select cell, bin, total / nullif(sum(total) over (partition by cell), 0) as share from c), y as (with {bins_sql(_E, False, 'b')} select cell, bin, total / nullif(sum(total) over (partition by cell), 0) as share from c) select cell, round(sum(abs(x.share - y.share)), 6) as value from x join y using (cell, bin) group by all")(lambda t: compare.share_index(*halves(t, _E), BY))
query("perkins_skill_score", f"with {LI}, a as (select * from li where month(time) <= 6), b as (select * from li where month(time) > 6), x as (with {bins_sql(EDGES, True, 'a')} select cell, bin, n_bin / (nullif(sum(n_bin) over (partition by cell), 0) * (hi - lo)) as p from c), y as (with {bins_sql(EDGES, True, 'b')} select cell, bin, n_bin / (nullif(sum(n_bin) over (partition by cell), 0) * (hi - lo)) as p from c) select cell, round(sum(least(x.p, y.p)), 6) as value from x join y using (cell, bin) group by all")(lambda t: indices.skill(*(statistics.pdf(t.items().where(c), BY, EDGES) for c in ("month(time) <= 6", "month(time) > 6")), BY))
query("survival_fraction", f"with {LI}, q as (select cell, p::double as pctl, quantile_cont(value, [0.5, 0.9, 0.99])[i] as q from li, (values (1, 50), (2, 90), (3, 99)) v(i, p) group by cell, i, p) select cell, pctl, round(sum(value) filter (value >= q) / sum(value), 6) as value from li join q using (cell) group by all")(lambda t: statistics.survival_fraction(t.items(), BY, [50, 90, 99]))
query("ranked_cumsum", f"with {EV} select cell, row_number() over w as place, round(value, 6) as value, round(sum(value) over (w rows unbounded preceding) / sum(value) over (partition by cell), 6) as share from ev window w as (partition by cell order by value desc, time)")(lambda t: indices.ranked_share(t.events(), BY, ["time"]))
query("prob_of_exceedance", f"with {EV} select cell, row_number() over w as place, round(value, 6) as value, round(1 - (row_number() over w - 1) / nullif(count(*) over (partition by cell) - 1, 0), 6) as chance from ev window w as (partition by cell order by value, time)")(lambda t: indices.exceedance(t.events(), BY, ["time"]))

# indices
query("rxx_count", f"with {LI} select cell, count(*) filter (value > 40) as value from li group by all")(lambda t: indices.days_over(t.items(), BY, 40.0))
query("rxx_normalized", f"with {LI} select cell, round(count(*) filter (value > 40) / count(value), 6) as value from li group by all")(lambda t: indices.days_over(t.items(), BY, 40.0, True))
query("rrtx", f"with {LI} select cell, round(coalesce(sum(value) filter (value >= 30), 0), 6) as value from li group by all")(lambda t: indices.total_from(t.items(), BY, 30.0))
query("rrpx", f"with {LI}, q as (select cell, quantile_cont(value, 0.95) filter (value >= 1) as q from li group by all) select cell, round(sum(value) filter (value >= q), 6) as value from li join q using (cell) group by all")(lambda t: indices.total_from_percentile(t.items(), BY, 95, 1.0))
query("sdii", f"with {LI} select cell, round(avg(value) filter (value >= 10), 6) as value from li group by all")(lambda t: indices.intensity(t.items(), BY, 10.0))
query("ehi", f"with {DAY}, m as (select cell, avg(value) over w as m, count(value) over w as n from d window w as (partition by cell order by time rows 2 preceding)) select cell, count(*) filter (n = 3 and m > 40) as value from m group by all")(lambda t: indices.heat_index(t.days(), BY, 40.0))
query("running_mean", f"with {DAY} select cell, time, round(value, 6) as value, round(sum(value) over (partition by cell order by time rows between 2 preceding and 2 following) / 5, 6) as mean from d")(lambda t: indices.running_mean(t.days(), BY, 5))


def fir_sql(weights: list[float]) -> str:
    half = len(weights) // 2
    terms = " + ".join(f"coalesce({'lag' if j >= half else 'lead'}(value, {abs(j - half)}) over w, 0) * ({x!r}::double)" for j, x in enumerate(weights))
    return f"with {DAY} select cell, time, round(value, 6) as value, round({terms}, 6) as filtered from d window w as (partition by cell order by time)"


for _kind, _second in (("lowpass", None), ("highpass", None), ("bandpass", 0.3)):
    _w = indices.lanczos(11, 0.1, _second, _kind)
    query(f"lanczos_{_kind}", fir_sql(_w))(lambda t, w=_w: indices.filtered(t.days(), BY, w))

# runs
RUN = "r as (select *, row_number() over (partition by cell order by time) - row_number() over (partition by cell, flag order by time) as run from x), u as (select cell, flag, run, count(*) as length, sum(value) as total, avg(value) as mean, max(value) as most from r group by all)"
SPELLS = [1, 2, 3, 5, 10, 30]
query("cdd_histogram", f"with {DAY}, x as (select *, not coalesce(value > 30, false) as flag from d), {RUN}, e(bin, lo, hi) as (values (0, 1, 2), (1, 2, 3), (2, 3, 5), (3, 5, 10), (4, 10, 30)), k as (select cell, bin::bigint as bin, coalesce(n, 0) as n from (select distinct cell from d) cross join e left join (select cell, bin, count(*) as n from u join e on flag and length >= lo and (length < hi or bin = 4 and length <= hi) group by all) using (cell, bin)), l as (select cell, max(length) as longest from u where flag group by all) select cell, bin, n, coalesce(longest, 0) as longest from k left join l using (cell)")(lambda t: runs.dry_spells(t.days(), BY, 30.0, SPELLS))
for _measure, _edges in (("total", [0.0, 50.0, 100.0, 200.0, 1000.0]), ("mean", [0.0, 30.0, 40.0, 50.0, 200.0]), ("most", [0.0, 35.0, 50.0, 300.0])):
    _rows = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip(_edges, _edges[1:])))
    query(f"eda_{_measure}", f"with {DAY}, x as (select *, coalesce(value >= 25, false) as flag from d), {RUN}, e(bin, lo, hi) as (values {_rows}) select cell, g.duration::bigint as duration, bin::bigint as bin, coalesce(n, 0) as n from (select distinct cell from d) cross join (values (1), (2), (3), (4)) g(duration) cross join e left join (select cell, length as duration, bin, count(*) as n from u join e on flag and {_measure} >= lo and ({_measure} < hi or bin = {len(_edges) - 2} and {_measure} <= hi) group by all) using (cell, duration, bin)")(lambda t, m=_measure, e=_edges: runs.events(t.days(), BY, 25.0, m, [1, 2, 3, 4], e))

# order and alignment
query("deaccumulate", f"with {DAY}, s as (select cell, time, value - lag(value) over w as v, lag(time) over w as before from d window w as (partition by cell order by time)) select cell, time - to_seconds(floor(date_diff('second', before, time) / 2)::bigint) as time, round(v, 6) as value from s where before is not null")(lambda t: series.deaccumulate(t.days(), BY))
query("dedup_keep_last", "select l_suppkey as cell, l_shipdate as time, round(l_quantity, 6) as value, l_orderkey from lineitem qualify row_number() over (partition by l_suppkey, l_shipdate order by l_orderkey desc, l_partkey desc, l_linenumber desc, l_quantity desc) = 1")(lambda t: series.keep_last(t.table("lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_shipdate").alias("time"), F.col("l_quantity").alias("value"), "l_orderkey", "l_partkey", "l_linenumber"), BY, ["l_orderkey", "l_partkey", "l_linenumber", "value"]).drop("l_partkey", "l_linenumber"))
query("ffill_align", f"with {DAY}, m as (select cell, date_trunc('month', time)::timestamp as time, max(value) as m from d where day(time) < 15 group by all), j as (select d.cell, d.time, d.value, m.m from d left join m using (cell, time)) select cell, time, round(value, 6) as value, round(last_value(m ignore nulls) over (partition by cell order by time rows unbounded preceding), 6) as other from j")(lambda t: series.forward_fill(t.days(), series.resample(t.days().where(F.dayofmonth("time") < 15), BY, "MS", "max"), BY))
query("derived_variable", f"with {LI}, a as (select cell, date_trunc('month', time)::timestamp as time, max(value) as a from li group by all), b as (select cell, date_trunc('month', time)::timestamp as time, min(value) as b from li group by all) select cell, time, round(sqrt(a * a + b * b), 6) as value from a join b using (cell, time)")(lambda t: series.derive("sqrt(hi * hi + lo * lo)", BY, hi=series.resample(t.items(), BY, "MS", "max"), lo=series.resample(t.items(), BY, "MS", "min")))
query("condition_static", f"with {DAY}, k as (select cell, date_trunc('month', time)::timestamp as m, avg(value) as a from d group by all) select cell, time, round(case when a > 28 then value end, 6) as value from d join k using (cell) where k.m = date_trunc('month', time)")(lambda t: series.condition(t.days(), series.resample(t.days(), BY, "MS"), BY, ">", 28.0, freq="MS"))
query("condition_percentile", f"with {DAY}, q as (select cell, quantile_cont(value, 0.75) as q from d group by all) select cell, time, round(case when value > q then value end, 6) as value from d join q using (cell)")(lambda t: (lambda d: series.condition(d, d, BY, ">", percentile=75))(t.days()))
def harmonic_sql(k: int) -> str:
    """p, q and level of one harmonic of the cycle c (g, t, v), 24 hours each."""
    x, y = f"cos(2 * pi() * {k} / 24 * t)", f"sin(2 * pi() * {k} / 24 * t)"
    cov = lambda a, b: f"(sum({a} * {b}) - sum({a}) * sum({b}) / count(v))"
    det = f"({cov(x, x)} * {cov(y, y)} - {cov(x, y)} * {cov(x, y)})"
    return f"({cov(x, 'v')} * {cov(y, y)} - {cov(y, 'v')} * {cov(x, y)}) / {det} as p{k}, ({cov(y, 'v')} * {cov(x, x)} - {cov(x, 'v')} * {cov(x, y)}) / {det} as q{k}, avg({x}) as x{k}, avg({y}) as y{k}"


CYCLE = f"{EV}, c0 as (select cell % 3 as g, hour(time) as h, avg(value) as v from ev group by all), c as (select g, v, row_number() over (partition by g order by h) - 1 as t from c0)"
query("harmonic_fit", f"with {CYCLE}, f as (select g, count(v) as n, avg(v) as m, {harmonic_sql(1)} from c group by g) select g, round(case when n = 24 then sqrt(p1 * p1 + q1 * q1) end, 6) as amplitude, round(case when n = 24 then atan2(q1, p1) end, 6) as phase, round(case when n = 24 then m - p1 * x1 - q1 * y1 end, 6) as level from f")(lambda t: statistics.harmonic(statistics.diurnal_cycle(t.events().withColumn("g", F.col("cell") % 3), ["g"]), ["g"]))

# space and comparison
RING = [(10.5, 49.5), (16.2, 49.5), (18.4, 54.3), (13.1, 57.2), (12.2, 53.4)]


def side_sql(a, b) -> str:
    return f"case when ({a[1]} > lat) != ({b[1]} > lat) and lon < ({b[0]} - {a[0]}) * (lat - {a[1]}) / nullif({b[1]} - {a[1]}, 0) + {a[0]} then 1 else 0 end"


IN_RING = "(" + " + ".join(side_sql(a, b) for a, b in zip(RING, RING[1:] + RING[:1])) + ") % 2 = 1"
_ring = lambda t: t.spark.createDataFrame([("North", RING)], "region string, ring array<struct<x:double,y:double>>")
query("region_mask", f"with {GRID} select 'North' as region, cell_id from g where {IN_RING}")(lambda t: grid.membership(t.grid(), _ring(t)))
query("regional_mean", f"with {GRID}, {LI} select 'North' as region, month(time)::bigint as month, round(avg(value), 6) as value from li join g on cell = cell_id where {IN_RING} group by all")(lambda t: compare.regional_mean(t.items().withColumnRenamed("cell", "cell_id").withColumn("month", F.month("time")), grid.membership(t.grid(), _ring(t)), ["month"]))
query("region_crop", f"with {GRID}, {LI} select count(*) as n, round(sum(value), 6) as total from li join g on cell = cell_id where {IN_RING}")(lambda t: grid.mask(t.items().withColumnRenamed("cell", "cell_id"), grid.membership(t.grid(), _ring(t)), crop=True).agg(F.count("*").alias("n"), F.sum("value").alias("total")))
query("nearest_cell", f"with {GRID}, p(point, a, b) as (values ('p', 12.3, 52.2), ('q', 15.5, 50.5), ('r', 0.0, 0.0)) select point, arg_min(cell_id, (sqrt((lon - a) * (lon - a) + (lat - b) * (lat - b)), y, x)) as cell_id, round(min(sqrt((lon - a) * (lon - a) + (lat - b) * (lat - b))), 6) as distance from g, p group by all")(lambda t: grid.nearest(t.spark.createDataFrame([("p", 12.3, 52.2), ("q", 15.5, 50.5), ("r", 0.0, 0.0)], "point string, lon double, lat double"), t.grid()))
query("wrap_longitude", "select s_suppkey as cell_id, round(((s_suppkey * 37 + 180) % 360)::double - 180, 6) as lon from supplier")(lambda t: t.table("supplier").select(F.col("s_suppkey").alias("cell_id"), grid.wrap_longitude((F.col("s_suppkey") * 37).cast("double")).alias("lon")))
TILT = "radians(90 - 39.25)"
XYZ = "v as (select cell_id, cos(radians(lon)) * cos(radians(lat)) as a, sin(radians(lon)) * cos(radians(lat)) as b, sin(radians(lat)) as c from g)"
query("rotated_pole", f"with {GRID}, {XYZ}, r as (select cell_id, degrees(atan2(b, cos({TILT}) * a - sin({TILT}) * c)) + 180 - 162 as lon, degrees(asin(greatest(-1, least(1, sin({TILT}) * a + cos({TILT}) * c)))) as lat from v) select cell_id, round(lon + 180 - 360 * floor((lon + 180) / 360) - 180, 6) as lon, round(lat, 6) as lat from r")(lambda t: (lambda c: t.grid().select("cell_id", c[0].alias("lon"), c[1].alias("lat")))(grid.rotate(F.col("lon"), F.col("lat"), -162.0, 39.25)))
query("model_minus_reference", f"with {LI}, a as (select cell, month(time)::bigint as month, avg(value) as v from li where year(time) <= 1997 group by all), b as (select cell, month(time)::bigint as month, avg(value) as v from li where year(time) > 1997 group by all) select cell, month, round(a.v - b.v, 6) as value from a join b using (cell, month)")(lambda t: compare.difference(*(statistics.annual_cycle(t.items().where(c), BY) for c in ("year(time) <= 1997", "year(time) > 1997")), ["cell", "month"]))
query("trend_line", f"with {LI}, y as (select cell, year(time) as year, avg(value) as value from li group by all) select cell, round(regr_slope(value, year - 1990), 5) as slope, round(regr_intercept(value, year - 1990), 5) as intercept from y group by all")(lambda t: rounded(compare.trend(series.resample(t.items(), BY, "YS").withColumn("year", F.year("time") - 1990), BY, "year"), 5))
query("ttest", f"with {LI}, a as (select cell, avg(value) as m, var_samp(value) / count(value) as e, count(value) as n from li where month(time) <= 6 group by all), b as (select cell, avg(value) as m, var_samp(value) / count(value) as e, count(value) as n from li where month(time) > 6 group by all) select cell, round((a.m - b.m) / sqrt(a.e + b.e), 6) as t, a.n + b.n - 2 as df from a join b using (cell)")(lambda t: compare.t_test(t.items().where("month(time) <= 6"), t.items().where("month(time) > 6"), BY))


def coarse(t: Tables) -> DataFrame:
    """Cells of two by two of the grid's."""
    return t.grid().select(F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).distinct().withColumn("cell_id", (F.col("y") * 100 + F.col("x")).cast("bigint")).withColumn("lon", 10.5 + 2 * F.col("x")).withColumn("lat", 50.125 + F.col("y") / 2)


def bounds(g: DataFrame, half: float) -> DataFrame:
    """Cells as wide as their step, a quarter as high."""
    return g.select("*", (F.col("lon") - half).alias("lon_lo"), (F.col("lon") + half).alias("lon_hi"), (F.col("lat") - half / 4).alias("lat_lo"), (F.col("lat") + half / 4).alias("lat_hi"))


def fitted(t: Tables, g: DataFrame, half: float) -> DataFrame:
    """Bounds as above, all rows nearer together by a power of two where the last would lie beyond the pole (from 1600 suppliers on): no cell has an area there. Powers of two are exact, so bounds of both grids still meet."""
    part = 1
    while (t.last("supplier", "s_suppkey") + 2) / 4 / part > 40:
        part *= 2
    lat = lambda c: (50.0 + (F.col(c) - 50.0) / part).alias(c)
    return bounds(g, half).withColumns({c: lat(c) for c in ("lat", "lat_lo", "lat_hi")})


query("regrid_conservative", f"with {GRID}, {LI}, m as (select cell as cell_id, month(time)::bigint as month, avg(value) as value from li group by all), w as (select cell_id, (y // 2) * 100 + x // 2 as target from g) select target::bigint as cell_id, month, round(sum(value) / count(*), 6) as value from m join w using (cell_id) group by all")(lambda t: grid.regrid(statistics.annual_cycle(t.items().withColumnRenamed("cell", "cell_id"), ["cell_id"]).select("cell_id", "month", "value"), grid.conservative_weights(fitted(t, t.grid(), 0.5), fitted(t, coarse(t), 1.0)), coarse(t), ["month"]).where("month is not null"))
FULL = "q as (select (y // 2) * 100 + x // 2 as target, count(*) as n from g group by all)"
query("regrid_bilinear", f"with {GRID}, {LI}, {FULL}, m as (select cell as cell_id, month(time)::bigint as month, avg(value) as value from li group by all), r as (select target, month, avg(value) as value from m join g using (cell_id) join q on target = (y // 2) * 100 + x // 2 where n = 4 group by all) select target::bigint as cell_id, month, round(value, 6) as value from r union all select target::bigint, month, null from q, (select distinct month from m) where n < 4")(lambda t: grid.regrid(statistics.annual_cycle(t.items().withColumnRenamed("cell", "cell_id"), ["cell_id"]).select("cell_id", "month", "value"), grid.bilinear_weights(t.grid(), coarse(t)), coarse(t), ["month"]))
query("grid_corners", f"with {GRID}, k as (select count(distinct y) > 1 as several from g) select cell_id, y::bigint as y, x::bigint as x, lon::double as lon, lat::double as lat, lon::double - 0.5 as lon_lo, lon::double + 0.5 as lon_hi, case when several then lat - 0.125 end as lat_lo, case when several then lat + 0.125 end as lat_hi from g, k")(lambda t: grid.corners(t.grid()))
SAL_FIELDS = f"with {GRID}, {LI}, a as (select cell, date_trunc('month', time)::timestamp as time, sum(value) as v from li where day(time) <= 15 group by all), b as (select cell, date_trunc('month', time)::timestamp as time, sum(value) as v from li where day(time) > 15 group by all)"


def fields(t: Tables) -> tuple[DataFrame, DataFrame]:
    g = t.grid().select(F.col("cell_id").alias("cell"), "y", "x")
    return tuple(series.resample(t.items().where(c), BY, "MS", "sum").join(g, "cell").select("time", "y", "x", "value") for c in ("day(time) <= 15", "day(time) > 15"))


query("sal_amplitude", SAL_FIELDS + ", p as (select time, avg(v) as m from a group by all), q as (select time, avg(v) as r from b group by all) select time, round((m - r) / ((m + r) / 2), 6) as a from p join q using (time)")(lambda t: objects.amplitude(*fields(t)))
query("sal_structure_location", None)(lambda t: objects.sal(*fields(t), how="P", value=80))
SIDE = "case when {0} + {1} < 0 then -({0} + {1}) - 1 when {0} + {1} >= {2} then 2 * {2} - 1 - ({0} + {1}) else {0} + {1} end"
query("smooth_2d", SAL_FIELDS + f", f as (select time, y, x, v from a join g on cell = cell_id), n as (select max(y) + 1 as h, max(x) + 1 as w from g), k(d) as (values (-1), (0), (1)), asked as (select f.time, f.y, f.x, {SIDE.format('f.y', 'dy.d', 'h')} as y2, {SIDE.format('f.x', 'dx.d', 'w')} as x2 from f, n, k dy, k dx) select asked.time as time, asked.y::bigint as y, asked.x::bigint as x, round(sum(f.v) / 9, 6) as value from asked join f on f.time = asked.time and f.y = y2 and f.x = x2 group by all")(lambda t: objects.smooth(fields(t)[0], objects.kernel(3), ["time"], *t.grid().agg(F.max("y") + 1, F.max("x") + 1).first()))
query("block_bootstrap", None)(lambda t: indices.block_bootstrap(t.days(), BY, 5, 4).groupBy("cell", "sample").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))

# moist air and wind, over the items' numbers
T, P, RH = "(250 + l_quantity)", "(800 + l_discount * 1000)", "(l_tax * 10)"
ES = f"(6.112 * exp(17.67 * ({T} - 273.15) / ({T} - 273.15 + 243.5)))"
EPS = "(287.04 / 461.5)"
AIR_SQL = {
    "es": ES, "ws": f"0.622 * {ES} / ({P} - {ES})", "e_w": f"{RH} / 100 * {P} / ({EPS} + {RH} / 100)", "e_q": f"{RH} / 100 * {P} / ({RH} / 100 * (1 - {EPS}) + {EPS})",
    "q": f"{EPS} * {RH} * {ES} / ({P} - {RH} * {ES} * (1 - {EPS}))", "q_td": f"{EPS} * {ES} / ({P} - 0.378 * {ES})", "vpd": f"(100 - {RH} * 100) / 100 * {ES}",
    "lcl": f"56 + 1 / (1 / ({T} - 3 - 56) + ln({T} / ({T} - 3)) / 800)", "u": "-l_quantity * sin(radians(l_discount * 3600))", "speed": "sqrt(l_quantity * l_quantity + l_tax * l_tax)", "direction": "270 - atan2(l_tax, l_quantity) * (180 / pi())",
}


@query("thermo_and_wind", "select l_suppkey as cell, " + ", ".join(f"round(avg({s}), 6) as {n}" for n, s in AIR_SQL.items()) + " from lineitem group by all")
def thermo_and_wind(t: Tables) -> DataFrame:
    k, p, rh, n = 250 + F.col("l_quantity"), 800 + F.col("l_discount") * 1000, F.col("l_tax") * 10, F.col("l_quantity")
    air = {
        "es": thermo.saturation_pressure(k), "ws": thermo.saturation_mixing_ratio(k, p), "e_w": thermo.pressure_from_mixing_ratio(rh / 100, p), "e_q": thermo.pressure_from_specific_humidity(rh / 100, p),
        "q": thermo.specific_from_relative(rh, k, p), "q_td": thermo.specific_from_dew_point(k, p), "vpd": thermo.vapour_deficit(rh * 100, k), "lcl": thermo.condensation_temperature(k, k - 3),
        "u": thermo.wind_parts(n, F.col("l_discount") * 3600)[0], "speed": thermo.wind_speed(n, F.col("l_tax")), "direction": thermo.wind_direction(n, F.col("l_tax")),
    }
    return t.table("lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(*(F.avg(c).alias(x) for x, c in air.items()))
