"""More registered queries: data with gaps, pooled series, rules of resampling, air, and whole configured runs. `gaps` are items with missing values and a missing key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import thermo
from cellweave.operators import compare, grid, indices, runs, series, statistics

from . import config
from .queries import BY, DAY, EDGES, EV, GRID, LI, RING, RUN, Tables, bins_sql, coarse, fir_sql, harmonic_sql, query, side_sql

GAPS = "gp as (select case when l_suppkey % 10 <> 3 then l_suppkey end as cell, l_shipdate as time, case when l_quantity % 7 <> 0 and l_suppkey % 10 <> 4 then l_quantity end as value from lineitem)"


def gaps(t: Tables) -> DataFrame:
    c = F.col("cell")
    return t.items().select(F.when(c % 10 != 3, c).alias("cell"), "time", F.when((F.col("value") % 7 != 0) & (c % 10 != 4), F.col("value")).alias("value"))


# resampling
query("resample_gaps_sum", f"with {GAPS} select cell, date_trunc('month', time)::timestamp as time, round(coalesce(sum(value), 0), 6) as value from gp group by all")(lambda t: series.resample(gaps(t), BY, "MS", "sum"))
query("resample_gaps_mean", f"with {GAPS}, r as (select cell, date_trunc('month', time)::timestamp as time, avg(value) as value from gp group by all) select cell, time, round(value, 6) as value from r where time in (select time from r where value is not null)")(lambda t: series.resample(gaps(t), BY, "MS"))
query("resample_gaps_count", f"with {GAPS} select cell, date_trunc('year', time)::timestamp as time, count(value)::double as value from gp group by all")(lambda t: series.resample(gaps(t), BY, "YS", "count"))
query("resample_month_end", f"with {LI} select cell, last_day(time)::timestamp as time, round(max(value), 6) as value from li group by all")(lambda t: series.resample(t.items(), BY, "M", "max"))
query("resample_year_end", f"with {LI} select cell, make_timestamp(year(time), 12, 31, 0, 0, 0) as time, round(min(value), 6) as value from li group by all")(lambda t: series.resample(t.items(), BY, "Y", "min"))
query("resample_quarter_end", f"with {LI} select cell, last_day(date_trunc('quarter', time) + interval 2 month)::timestamp as time, round(avg(value), 6) as value from li group by all")(lambda t: series.resample(t.items(), BY, "Q"))
query("resample_three_days", f"with {LI} select cell, time_bucket(interval 3 day, time, timestamp '1995-01-01') as time, round(avg(value), 6) as value from li group by all")(lambda t: series.resample(t.items(), BY, "3D", origin="1995-01-01"))
query("resample_first_last", f"with {EV}, f as (select cell, date_trunc('day', time)::timestamp as time, round(arg_min(value, time), 6) as first, round(arg_max(value, time), 6) as last from ev group by all) select * from f")(lambda t: series.resample(t.events(), BY, "D", "first").withColumnRenamed("value", "first").join(series.resample(t.events(), BY, "D", "last").withColumnRenamed("value", "last"), ["cell", "time"]))
SIX = "p as (select cell, floor(epoch(time))::bigint as s, value, lead(floor(epoch(time))::bigint) over w as n, lead(value) over w as v from ev window w as (partition by cell order by time)), k as (select *, unnest(generate_series(ceil(s / 21600)::bigint, coalesce(ceil(n / 21600)::bigint - 1, floor(s / 21600)::bigint))) * 21600 as a from p)"
query("interpolate_linear", f"with {EV}, {SIX} select cell, make_timestamp(a * 1000000) as time, round(case when a = s then value else value + (v - value) * (a - s) / (n - s) end, 6) as value from k")(lambda t: series.interpolate(t.events(), BY, "6H"))
query("interpolate_nearest", f"with {EV}, {SIX} select cell, make_timestamp(a * 1000000) as time, round(case when a = s then value when v is null then null when (a - s) / (n - s) <= 0.5 then value else v end, 6) as value from k")(lambda t: series.interpolate(t.events(), BY, "6H", "nearest"))
query("select_dates", f"with {LI} select cell, count(*) as n from li where time in ('1996-02-03', '1997-05-06', '1998-01-01') group by all")(lambda t: series.select_dates(t.items(), ["1996-02-03", "1997-05-06", "1998-01-01"]).groupBy("cell").agg(F.count("*").alias("n")))
query("whole_hours_shift", f"with {LI} select cell, time + interval 1 hour as time, round(8 * sum(value), 6) as value from li group by all")(lambda t: series.whole_hours(_three_hourly(t)).groupBy("cell", F.timestamp_add("HOUR", -3 * F.col("k"), F.col("time")).alias("time")).agg(F.sum("value").alias("value")))


def _three_hourly(t: Tables) -> DataFrame:
    """Each item at all hours of three, half an hour early: whole hours and one more is what stands there in the end."""
    return t.items().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("time", F.timestamp_add("MINUTE", 180 * F.col("k") - 30, F.col("time")))


query("deaccumulate_files", f"with {DAY}, s as (select cell, year(time) as file, time, value - lag(value) over w as v, lag(time) over w as before from d window w as (partition by cell, year(time) order by time)) select cell, time - to_seconds(floor(date_diff('second', before, time) / 2)::bigint) as time, round(v, 6) as value from s where before is not null")(lambda t: series.deaccumulate(t.days().withColumn("file", F.year("time")), BY, file="file"))

# gaps and null keys
query("seasonal_cycle_gaps", f"with {GAPS}, s(season, k) as (values ('DJF', 0), ('MAM', 1), ('JJA', 2), ('SON', 3)), c as (select distinct cell from gp) select c.cell, season, round(avg(value), 6) as value, count(value) as n from c cross join s left join gp on gp.cell is not distinct from c.cell and month(time) % 12 // 3 = k group by all")(lambda t: statistics.seasonal_cycle(gaps(t), BY))
query("annual_cycle_gaps", f"with {GAPS} select cell, month(time)::bigint as month, round(quantile_cont(value, 0.9), 6) as value, count(value) as n from gp group by all")(lambda t: statistics.annual_cycle(gaps(t), BY, "percentile 90"))
NULLS = lambda s: s.replace("left join f using (cell, bin)", "left join f on f.cell is not distinct from s.cell and f.bin = e.bin").replace("select cell, n, e.bin", "select s.cell, n, e.bin")
query("pdf_gaps", f"with {GAPS}, {NULLS(bins_sql(EDGES, True, 'gp'))} select cell, bin, lo, hi, round(n_bin / (nullif(sum(n_bin) over (partition by cell), 0) * (hi - lo)), 6) as value from c")(lambda t: statistics.pdf(gaps(t), BY, EDGES))
query("histogram_gaps", f"with {GAPS}, {NULLS(bins_sql(EDGES, True, 'gp'))} select cell, bin, lo, hi, n_bin::double as value from c")(lambda t: statistics.histogram(gaps(t), BY, EDGES))
query("pdf_with_dry", f"with {GAPS}, {NULLS(bins_sql(EDGES, True, 'gp', 'case when value >= 10 then value end'))}, k as (select cell, count(*) filter (value < 5) as dry from gp group by all) select c.cell, bin, lo, hi, round(n_bin / (nullif(sum(n_bin) over (partition by c.cell), 0) * (hi - lo)), 6) as value, dry from c join k on k.cell is not distinct from c.cell")(lambda t: statistics.pdf(gaps(t), BY, EDGES, 10.0, dry_under=5.0))
query("pdf_auto_bins", "with li as (select 0 as cell, l_quantity as value from lineitem), m as (select min(value) as a, max(value) as b from li), e as (select k as bin, a + (b - a) * k / 19 as lo, a + (b - a) * (k + 1) / 19 as hi from m, range(19) r(k)), f as (select bin, lo, hi, count(value) as n from e left join li on value >= lo and (value < hi or bin = 18 and value <= hi) group by all) select bin, round(lo, 6) as lo, round(hi, 6) as hi, round(n / (sum(n) over () * (hi - lo)), 6) as value from f")(lambda t: statistics.pdf(t.items(), [], statistics.auto_edges(t.items())))
query("rxx_gaps", f"with {GAPS} select cell, round(count(*) filter (value > 40) / nullif(count(value), 0), 6) as value from gp group by all")(lambda t: indices.days_over(gaps(t), BY, 40.0, True))
query("percentiles_gaps", f"with {GAPS}, q as (select cell, quantile_cont(value, 0.5) as a, quantile_cont(value, 0.99) as b from gp group by all) select cell, 50::double as pctl, round(a, 6) as value from q union all select cell, 99, round(b, 6) from q")(lambda t: statistics.percentiles(gaps(t), BY, [50, 99]).groupBy("cell").agg(F.max(F.when(F.col("pctl") == 50, F.col("value"))).alias("a"), F.max(F.when(F.col("pctl") == 99, F.col("value"))).alias("b")).select("cell", F.explode(F.array(F.struct(F.lit(50.0).alias("pctl"), F.col("a").alias("value")), F.struct(F.lit(99.0).alias("pctl"), F.col("b").alias("value")))).alias("r")).select("cell", "r.*"))

# pooled series: runs follow each series
query("cdd_pooled", f"with {DAY}, x as (select *, not coalesce(value > 30, false) as flag from d), {RUN}, e(bin, lo, hi) as (values (0, 1, 2), (1, 2, 3), (2, 3, 5), (3, 5, 10), (4, 10, 30)) select bin::bigint as bin, count(u.length) as n, (select coalesce(max(length), 0) from u where flag) as longest from e left join u on flag and length >= lo and (length < hi or bin = 4 and length <= hi) group by all")(lambda t: runs.dry_spells(t.days(), BY, 30.0, [1, 2, 3, 5, 10, 30], keep=[]))
query("eda_pooled", f"with {DAY}, x as (select *, coalesce(value >= 25, false) as flag from d), {RUN}, e(bin, lo, hi) as (values (0, 0, 50), (1, 50, 100), (2, 100, 1000)) select g.duration::bigint as duration, bin::bigint as bin, count(u.length) as n from (values (1), (2), (3)) g(duration) cross join e left join u on flag and length = g.duration and total >= lo and (total < hi or bin = 2 and total <= hi) group by all")(lambda t: runs.events(t.days(), BY, 25.0, "total", [1, 2, 3], [0.0, 50.0, 100.0, 1000.0], keep=[]))
query("eda_dry", f"with {DAY}, x as (select *, coalesce(value < 25, false) as flag from d), {RUN}, e(bin, lo, hi) as (values (0, 1, 2), (1, 2, 4), (2, 4, 50)) select c.cell, bin::bigint as bin, count(u.length) as n from (select distinct cell from d) c cross join e left join u on u.cell = c.cell and flag and length >= lo and (length < hi or bin = 2 and length <= hi) group by all")(lambda t: runs.dry_lengths(t.days(), BY, 25.0, [1, 2, 4, 50]))
query("survival_pooled", f"with {LI}, q as (select p::double as pctl, quantile_cont(value, [0.5, 0.9])[i] as q from li, (values (1, 50), (2, 90)) v(i, p) group by i, p) select pctl, round(sum(value) filter (value >= q) / sum(value), 6) as value from li, q group by all")(lambda t: statistics.survival_fraction(t.items(), [], [50, 90]))
query("harmonic_cycle", f"with {EV}, c0 as (select cell % 3 as g, hour(time) as h, avg(value) as v from ev group by all), c as (select g, v, row_number() over (partition by g order by h) - 1 as t from c0), f as (select g, count(v) as n, avg(v) as m, {harmonic_sql(1)}, {harmonic_sql(2)} from c group by g), k as (select g, sqrt(p1 * p1 + q1 * q1) as c1, atan2(q1, p1) as a1, sqrt(p2 * p2 + q2 * q2) as c2, atan2(q2, p2) as a2, m - p2 * x2 - q2 * y2 as l from f where n = 24) select g, i::bigint as place, round(l + c1 * cos(2 * pi() / 24 * 23 / 199 * i - a1) + c2 * cos(4 * pi() / 24 * 23 / 199 * i - a2), 6) as value, round(c1, 6) as c1, round(c2, 6) as c2 from k, range(200) r(i)")(lambda t: statistics.harmonic_cycle(statistics.diurnal_cycle(t.events().withColumn("g", F.col("cell") % 3), ["g"]), ["g"]).select("g", F.posexplode("curve").alias("place", "value"), "c1", "c2"))

# indices, filters, conditions
OWN = "b as (select cell, quantile_cont(value, {}) as q from li group by all)"
query("hotdays", f"with {LI}, {OWN.format(0.75)} select cell, count(*) filter (value > q) as value from li join b using (cell) group by all")(lambda t: indices.days_over_own(t.items(), BY, statistics.moments(t.items(), BY, "percentile 75")))
query("extreme_hotdays", f"with {LI}, {OWN.format(0.95)} select cell, count(*) filter (value > q) as value from li join b using (cell) group by all")(lambda t: indices.days_over_own(t.items(), BY, statistics.moments(t.items(), BY, "percentile 95")))
query("tropical_nights", f"with {LI} select cell, count(*) filter (value + 260 > 293) as value from li group by all")(lambda t: indices.days_over(t.items().withColumn("value", F.col("value") + 260), BY, 293.0))
query("exceedance_levels", f"with {LI} select cell, p::double as pctl, round(quantile_cont(value, [0.5, 0.9, 0.999])[i], 6) as value, round(1 - p / 100, 6) as chance from li, (values (1, 50), (2, 90), (3, 99.9)) v(i, p) group by cell, i, p")(lambda t: indices.exceedance_levels(t.items(), BY, [50, 90, 99.9]))
_w = indices.lanczos(11, 0.1)
query("lanczos_valid", f"with f as ({fir_sql(_w)}), k as (select *, row_number() over (partition by cell order by time) as i, count(*) over (partition by cell) as n from f) select cell, time, value, filtered from k where i > 5 and i <= n - 5")(lambda t: indices.filtered(t.days(), BY, _w, mode="valid"))
query("lanczos_full", f"with {DAY}, r as (select cell, value, row_number() over (partition by cell order by time) - 1 as i from d), w(j, k) as (values {', '.join(f'({j}, {x!r}::double)' for j, x in enumerate(_w))}) select cell, (i + j)::bigint as place, round(sum(value * k), 6) as filtered from r, w group by all")(lambda t: indices.filtered(t.days(), BY, _w, mode="full").select("cell", F.col("_place").alias("place"), "filtered"))
query("condition_table", f"with {LI}, b as (select cell, avg(value) as q from li where cell % 4 <> 1 group by all) select li.cell, time, round(case when value >= q then value end, 6) as value from li left join b using (cell)")(lambda t: series.condition_table(t.items(), statistics.moments(t.items().where("cell % 4 != 1"), BY), ">=", cell="cell"))
query("topo_mask", f"with {GRID}, {LI} select cell_id, count(value) as n, count(case when x between 2 and 5 then value end) as kept from li join g on cell = cell_id group by all")(lambda t: grid.topo_mask(t.items().withColumnRenamed("cell", "cell_id").withColumn("all", F.col("value")), t.grid().withColumn("orog", F.col("x").cast("double")), 2, 5).groupBy("cell_id").agg(F.count("all").alias("n"), F.count("value").alias("kept")))
query("regrid_uncovered", f"with {GRID}, {LI}, m as (select cell as cell_id, month(time)::bigint as month, avg(value) as value from li group by all), w as (select cell_id, (y // 2) * 100 + x // 2 as target from g), r as (select target::bigint as cell_id, month, avg(value) as value from m join w using (cell_id) group by all) select cell_id, month, round(value, 6) as value from r union all select 9999, month, null from (select distinct month from m)")(lambda t: _uncovered(t))


def _uncovered(t: Tables) -> DataFrame:
    """The conservative grid with one cell that no source reaches."""
    from .queries import fitted

    far = coarse(t).limit(1).withColumn("x", F.lit(99)).withColumn("y", F.lit(99)).withColumn("cell_id", F.lit(9999).cast("bigint")).withColumn("lon", F.lit(-100.0)).withColumn("lat", F.lit(-40.0))
    target = coarse(t).unionByName(far)
    values = statistics.annual_cycle(t.items().withColumnRenamed("cell", "cell_id"), ["cell_id"]).select("cell_id", "month", "value")
    return grid.regrid(values, grid.conservative_weights(fitted(t, t.grid(), 0.5), fitted(t, target, 1.0)), target, ["month"])


# air
T, P, Q = "(270 + l_quantity / 2)", "(900 + l_discount * 1000)", "(l_tax / 8 + 0.001)"
ES = f"(6.112 * exp(17.67 * ({T} - 273.15) / ({T} - 273.15 + 243.5)))"
EPS = "(287.04 / 461.5)"
TL = f"(56 + 1 / (1 / ({T} - 2 - 56) + ln({T} / ({T} - 2)) / 800))"
DRY = f"{T} * pow(1000 / {P}, 0.2854 * (1 - 0.28 * {Q}))"
WS = f"(0.622 * {ES} / ({P} - {ES}))"
E_PA = f"({Q} * {P} * 100 / ({Q} * (1 - {EPS}) + {EPS}))"
TD_C = f"(243.5 * ln({E_PA} / 611.2) / (17.67 - ln({E_PA} / 611.2)))"
MORE_AIR = {
    "theta_e": f"{DRY} * pow({T} / {TL}, 0.28 * {WS}) * exp({WS} * (1 + 0.448 * {WS}) * (3036 / {TL} - 1.78))", "theta_ep": f"{DRY} * exp({Q} * (1 + 0.81 * {Q}) * (3376 / {TL} - 2.54))",
    "td": TD_C, "td_q": f"{TD_C} + 273.15", "rh": f"least(greatest({Q} * {P} / ({Q} * (1 - {EPS}) + {EPS}) / {ES}, 0), 1)",
    "n2": f"9.81 * (ln((1 + 0.61 * {Q}) * ({T} - 30) * pow(1000 / 500.0, 287 / 1005.0)) - ln((1 + 0.61 * {Q}) * {T} * pow(1000 / 850.0, 287 / 1005.0))) / ((40000.0 + l_quantity) / 9.81)",
}


@query("thermo_more", "select l_suppkey as cell, " + ", ".join(f"round(avg({s}), 5) as {n}" for n, s in MORE_AIR.items()) + " from lineitem group by all")
def thermo_more(t: Tables) -> DataFrame:
    from .queries import rounded

    n = F.col("l_quantity")
    k, p, q = 270 + n / 2, 900 + F.col("l_discount") * 1000, F.col("l_tax") / 8 + 0.001
    air = {
        "theta_e": thermo.equivalent_potential(k, k - 2, p, q), "theta_ep": thermo.pseudo_equivalent_potential(k, k - 2, p, q), "td": thermo.dew_point_celsius(thermo.pressure_from_specific_humidity(q, p * 100)),
        "td_q": thermo.dew_point_from_specific(q, p * 100), "rh": thermo.relative_from_specific(q, k, p),
        "n2": thermo.brunt_vaisala_squared(thermo.virtual_potential(k, q, 850.0), thermo.virtual_potential(k - 30, q, 500.0), F.lit(0.0), 40000.0 + n),
    }
    return rounded(t.table("lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(*(F.avg(c).alias(x) for x, c in air.items())), 5)


# whole runs: two models on a grid, regions, several statistics
RING_2 = [(9.5, 49.9), (12.5, 49.9), (12.5, 80.0), (9.5, 80.0)]
IN_2 = "(" + " + ".join(side_sql(a, b) for a, b in zip(RING_2, RING_2[1:] + RING_2[:1])) + ") % 2 = 1"
IN_1 = "(" + " + ".join(side_sql(a, b) for a, b in zip(RING, RING[1:] + RING[:1])) + ") % 2 = 1"
PERIOD = {"start year": 1996, "end year": 1998, "months": list(range(1, 13))}
RINGS = {"North": RING, "West": RING_2}


def opener(t: Tables):
    """Data sets of the test tables: items of the first and the second half of each month as two models."""

    def opened(spark, c, dataset, variable, catalogue):
        df = series.select_years(t.items().where("day(time) <= 15" if dataset == "m1" else "day(time) > 15"), PERIOD["start year"], PERIOD["end year"])
        return df.select(F.col("cell").alias("cell_id"), "time", (F.col("value") + (273.15 if variable == "tas" else 0.0)).alias("value")), t.grid()

    return opened


def _small(t: Tables) -> DataFrame:
    """Two rows of ten cells."""
    c = F.col("id")
    return t.spark.range(20).select(c.alias("cell_id"), F.floor(c / 10).cast("int").alias("y"), (c % 10).cast("int").alias("x"), (10.0 + c % 10).alias("lon"), (50.0 + F.floor(c / 10)).alias("lat"))


def _middle(t: Tables) -> DataFrame:
    """Cells at the middle of each four of `_small`."""
    c = F.col("id")
    return t.spark.range(9).select(c.alias("cell_id"), F.lit(0).alias("y"), c.cast("int").alias("x"), (10.5 + c).alias("lon"), F.lit(50.5).alias("lat"))


def together(results: list[config.Result], *keys: str) -> DataFrame:
    """All results as one table (dataset, variable, statistic, region, cell_id, keys..., value)."""
    parts = []
    for r in results:
        own = [F.col(k).cast("string").alias(k) if k in r.frame.columns else F.lit(None).cast("string").alias(k) for k in keys]
        parts.append(r.frame.select(F.lit(r.dataset).alias("dataset"), F.lit(r.variable).alias("variable"), F.lit(r.statistic).alias("statistic"), F.lit(r.region).cast("string").alias("region"), "cell_id", *own, "value"))
    return reduce(DataFrame.unionByName, parts)


MODEL_SQL = f"with {GRID}, {LI}, m0 as (select case when day(time) <= 15 then 'm1' else 'm2' end as dataset, cell as cell_id, time, value from li where year(time) between 1996 and 1998), m as (select dataset, 'pr' as variable, cell_id, time, value from m0 union all select dataset, 'tas', cell_id, time, value + 273.15 from m0), r as (select 'North' as region, cell_id from g where {IN_1}), "


@query("run_cycles", MODEL_SQL + "mr as (select * from m join r using (cell_id)), a as (select dataset, variable, 'annual cycle' as statistic, region, cell_id, month(time)::varchar as month, null::varchar as season, avg(value) as value from mr group by all), s as (select dataset, variable, 'seasonal cycle', region, cell_id, null::varchar as month, s.season, avg(case when variable = 'tas' or value >= 10 then value end) filter (month(time) % 12 // 3 = k) as value from mr cross join (values ('DJF', 0), ('MAM', 1), ('JJA', 2), ('SON', 3)) s(season, k) group by all) select dataset, variable, statistic, region, cell_id, month, season, round(value, 6) as value from (select * from a union all select * from s)")
def run_cycles(t: Tables) -> DataFrame:
    """Annual and seasonal cycles of two models' precipitation and temperature in a region."""
    variable = {"freq": "day", "scale factor": None, "obs": None, "var names": None, "regrid to": None}
    c = {"MODELS": {"m1": PERIOD, "m2": PERIOD}, "SETTINGS": {"variables": {"pr": variable, "tas": variable}, "regions": ["North"], "full domain": False}, "STATISTICS": {"stats": {"annual cycle": "default", "seasonal cycle": {"thr": {"pr": 10.0}}}}}
    return together(config.analyse(t.spark, c, opener(t), RINGS), "month", "season")


@query("run_pdf", MODEL_SQL + "w as (select 'West' as region, cell_id from g where " + IN_2 + "), d as (select dataset, variable, region, cell_id, value from (select dataset, variable, cell_id, date_trunc('month', time), max(value) as value from m group by all) join w using (cell_id)), e as (select 'pr' as variable, k as bin, k * 10.0 as lo, k * 10.0 + 10 as hi, k = 4 as last from range(5) t(k) union all select 'tas', k, 274.0 + k * 10, 284.0 + k * 10, k = 3 from range(4) t(k)), c as (select distinct dataset, variable, region, cell_id from d), f as (select c.dataset, c.variable, c.region, c.cell_id, bin, hi - lo as width, count(d.value) as n from c join e using (variable) left join d on d.dataset = c.dataset and d.variable = c.variable and d.cell_id = c.cell_id and d.value >= lo and (d.value < hi or last and d.value <= hi) group by all) select dataset, variable, 'pdf' as statistic, region, cell_id, bin::varchar as bin, round(n / (nullif(sum(n) over (partition by dataset, variable, cell_id), 0) * width), 6) as value from f")
def run_pdf(t: Tables) -> DataFrame:
    """Distributions of monthly maxima of two models in a region."""
    variable = {"freq": "1H", "scale factor": None, "obs": None, "var names": None, "regrid to": None}
    stats = {"pdf": {"resample resolution": ["MS", "max"], "bins": {"pr": (0, 60, 10), "tas": (274, 324, 10)}}}
    c = {"MODELS": {"m1": PERIOD, "m2": PERIOD}, "SETTINGS": {"variables": {"pr": variable, "tas": variable}, "regions": ["West"], "full domain": False}, "STATISTICS": {"stats": stats}}
    return together(config.analyse(t.spark, c, opener(t), RINGS), "bin")


@query("run_diurnal", f"with {EV}, e as (select cell % 10 + 10 * (cell // 10 % 2) as cell_id, date_trunc('hour', time)::timestamp as time, value from ev where hour(time) % 3 = 0), b as (select c.cell_id, time, avg(value) as value from e join range(9) c(cell_id) on e.cell_id % 10 in (c.cell_id, c.cell_id + 1) group by all) select 'src' as dataset, 'pcape' as variable, 'diurnal cycle' as statistic, null::varchar as region, cell_id, hour(time)::varchar as hour, round(avg(value), 6) as value from b group by all")
def run_diurnal(t: Tables) -> DataFrame:
    """The diurnal cycle of one model, at hours of three, on the grid of another."""
    variable = {"freq": "3H", "scale factor": None, "obs": None, "var names": None, "regrid to": "target", "regrid method": "bilinear"}
    year = {"start year": 2024, "end year": 2024, "months": [1]}
    c = {"MODELS": {"src": year, "target": year}, "SETTINGS": {"variables": {"pcape": variable}, "regions": [], "full domain": True}, "STATISTICS": {"stats": {"diurnal cycle": {"hours": [0, 3, 6, 9, 12, 15, 18, 21]}}}}
    results = [r for r in config.analyse(t.spark, c, lambda s, c, d, v, k: _hourly(t, d), RINGS) if r.dataset == "src"]
    return together(results, "hour")


def _hourly(t: Tables, dataset: str) -> tuple[DataFrame, DataFrame]:
    df = t.events().withColumn("cell_id", F.pmod(F.col("cell"), F.lit(10)) + 10 * F.pmod(F.floor(F.col("cell") / 10), F.lit(2)))
    df = df.where("hour(time) % 3 = 0").select("cell_id", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time"), "value")
    return df, _small(t) if dataset == "src" else _middle(t)
