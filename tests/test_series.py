"""Series operators on small hand-made data: gaps, ties, null keys, empty tables, clashing columns."""

import datetime as dt
import math

import numpy as np
import pytest

from cellweave.operators import compare, indices, runs, series, statistics
from cellweave.plans import config


def at(day, hour=0, minute=0):
    return dt.datetime(2000, 1, 1) + dt.timedelta(days=day, hours=hour, minutes=minute)


def table(spark, rows, extra=False):
    """(cell, time, value); extra: a column that the operators' own names could clash with."""
    schema = "cell long, time timestamp_ntz, value double"
    return spark.createDataFrame([(*r, "x") for r in rows], schema + ", bin string") if extra else spark.createDataFrame(rows, schema)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def test_buckets_without_values(spark):
    df = table(spark, [(1, at(0), None), (2, at(0), 4.0), (1, at(1), None), (2, at(1), None), (None, at(0), 2.0)], extra=True)
    assert got(series.resample(df, ["cell"], "D", "sum"), "cell", "value") == [(1, 0.0), (1, 0.0), (2, 0.0), (2, 4.0), (None, 2.0)]
    assert got(series.resample(df, ["cell"], "D", "count"), "cell", "value") == [(1, 0.0), (1, 0.0), (2, 0.0), (2, 1.0), (None, 1.0)]
    assert got(series.resample(df, ["cell"], "D"), "cell", "time", "value") == [(1, at(0), None), (2, at(0), 4.0), (None, at(0), 2.0)], "the second day is missing everywhere"
    assert series.resample(df.where("false"), ["cell"], "3H").collect() == []
    with pytest.raises(ValueError):
        series.resample(df, ["cell"], "2M")


def test_labels(spark):
    df = table(spark, [(1, at(40, 4), 1.0)])
    label = lambda freq, **o: series.resample(df, ["cell"], freq, **o).first().time
    assert label("6H") == at(40, 3) and label("6H", label="start") == at(40) and label("D") == at(40) and label("2D", label="middle", origin="2000-01-01") == at(41)
    assert label("M") == dt.datetime(2000, 2, 29) and label("Q") == dt.datetime(2000, 3, 31) and label("Y") == dt.datetime(2000, 12, 31)
    assert label("MS") == dt.datetime(2000, 2, 1) and label("YS") == dt.datetime(2000, 1, 1) and label("QS-DEC") == dt.datetime(1999, 12, 1)
    assert label("3D", origin="2000-01-01") == at(39)


def test_configured_resampling(spark):
    df = table(spark, [(1, at(0, h), float(h)) for h in range(0, 24, 3)])
    assert series.first_step(df) == 10800 and series.first_step(df.limit(1)) is None
    assert series.resampled(df, ["cell"], ["3H", "mean"]) is df, "already at that step"
    assert got(series.resampled(df, ["cell"], ["select hours", [0, 6]]), "value") == [(0.0,), (6.0,)]
    assert got(series.resampled(df, ["cell"], ["select dates", "2000-01-01 03:00:00"]), "value") == [(3.0,)]
    assert got(series.resampled(df, ["cell"], ["1H", "interpolate", "linear"]), "value") == [(float(h),) for h in range(22)]
    assert got(series.resampled(df, ["cell"], ["D", "max"]), "value") == [(21.0,)]
    with pytest.raises(ValueError):
        series.resampled(df, ["cell"], ["D"])


def test_interpolation_next_to_missing_values(spark):
    df = table(spark, [(1, at(0, 0, 30), 1.0), (1, at(0, 2, 30), 5.0), (1, at(0, 4), None), (1, at(0, 6), 3.0)])
    assert got(series.interpolate(df, ["cell"], "1H"), "time", "value") == [(at(0, 1), 2.0), (at(0, 2), 4.0), (at(0, 3), None), (at(0, 4), None), (at(0, 5), None), (at(0, 6), 3.0)]
    assert [v for _, v in got(series.interpolate(df, ["cell"], "1H", "zero"), "time", "value")][:2] == [1.0, 1.0]


@pytest.mark.parametrize("minute,step,moved", [(30, 3, 1), (0, 3, 0), (15, 6, 3), (45, 1, 0)])
def test_times_move_to_whole_hours(spark, minute, step, moved):
    rows = [(1, at(0, h, minute), float(h)) for h in range(0, 48, step)]
    found = [t for t, _ in got(series.whole_hours(table(spark, rows)), "time", "value")]
    shift = 0 if minute == 0 else moved + (minute >= 30)
    assert found == [at(0, h + shift) for h in range(0, 48, step)]


def test_counters_start_anew_in_each_file(spark):
    df = spark.createDataFrame([(1, at(k), float(v), f) for k, (v, f) in enumerate([(1, "a"), (3, "a"), (6, "a"), (2, "b"), (7, "b")])], "cell long, time timestamp_ntz, value double, file string")
    assert got(series.deaccumulate(df, ["cell"], file="file"), "time", "value") == [(at(0, 12), 2.0), (at(1, 12), 3.0), (at(3, 12), 5.0)]


def test_conditions_with_null_keys(spark):
    df = table(spark, [(None, at(0), 1.0), (None, at(1), 3.0), (1, at(0), 2.0), (1, at(1), None)])
    assert got(series.condition(df, df, ["cell"], ">", 1.5), "cell", "value") == [(1, 2.0), (1, None), (None, 3.0), (None, None)]
    assert got(series.condition(df, df, ["cell"], ">=", percentile=100), "cell", "value") == [(1, 2.0), (1, None), (None, 3.0), (None, None)]
    bounds = spark.createDataFrame([(1, 2.5)], "cell long, value double")
    assert got(series.condition_table(df, bounds, "<", cell="cell"), "cell", "value") == [(1, 2.0), (1, None), (None, None), (None, None)]


def test_statistics_of_empty_tables(spark):
    empty = table(spark, [])
    for f in (
        lambda: statistics.seasonal_cycle(empty, ["cell"]), lambda: statistics.annual_cycle(empty, ["cell"]), lambda: statistics.pdf(empty, ["cell"], [0, 1, 2]), lambda: statistics.percentiles(empty, ["cell"], [50]),
        lambda: statistics.asop(empty, ["cell"], [0, 1, 2]), lambda: statistics.survival_fraction(empty, ["cell"], [50]), lambda: statistics.harmonic_cycle(statistics.diurnal_cycle(empty, ["cell"]), ["cell"]),
        lambda: runs.events(empty, ["cell"], 1.0, "total", [1, 2], [0, 1]), lambda: runs.dry_spells(empty, ["cell"], 1.0, [1, 2]), lambda: indices.days_over(empty, ["cell"], 1.0), lambda: indices.intensity(empty, ["cell"]),
        lambda: indices.filtered(empty, ["cell"], [1.0, 2.0, 1.0], mode="full"), lambda: indices.block_bootstrap(empty, ["cell"], 2, 3), lambda: indices.heat_index(empty, ["cell"], 1.0), lambda: compare.trend(empty.withColumn("x", empty.value), ["cell"], "x"),
    ):
        assert f().collect() == []
    assert got(statistics.pdf(empty, [], [0.0, 1.0]), "bin", "value") == [(0, None)]


def test_missing_values_and_the_last_edge(spark):
    df = table(spark, [(1, at(k), v) for k, v in enumerate([0.0, 1.0, 2.0, None, 2.0, 5.0])] + [(2, at(0), None), (None, at(0), 1.5)], extra=True)
    edges = [0.0, 1.0, 2.0]
    assert got(statistics.histogram(df, ["cell"], edges), "cell", "bin", "value") == [(1, 0, 1.0), (1, 1, 3.0), (2, 0, 0.0), (2, 1, 0.0), (None, 0, 0.0), (None, 1, 1.0)]
    assert got(statistics.pdf(df, ["cell"], edges), "cell", "bin", "value") == [(1, 0, 0.25), (1, 1, 0.75), (2, 0, None), (2, 1, None), (None, 0, 0.0), (None, 1, 1.0)]
    assert got(statistics.pdf(df, ["cell"], edges, normalised=True), "cell", "bin", "value")[:2] == [(1, 0, 0.0), (1, 1, 1.0)], "values on the last edge go"
    seasons = {(r.cell, r.season): (r.value, r.n) for r in statistics.seasonal_cycle(df, ["cell"], "sum").collect()}
    assert seasons[1, "DJF"] == (10.0, 5) and seasons[1, "JJA"] == (None, 0) and seasons[2, "DJF"] == (0.0, 0) and seasons[None, "DJF"] == (1.5, 1) and len(seasons) == 12


def test_runs_with_gaps_and_none(spark):
    df = table(spark, [(1, at(k), v) for k, v in enumerate([5.0, 6.0, None, 0.0, 7.0, 0.0, 0.0, None])] + [(2, at(k), 9.0) for k in range(3)] + [(3, at(0), None)], extra=True)
    ev = {(r.cell, r.duration, r.bin): r.n for r in runs.events(df, ["cell"], 1.0, "total", [1, 2], [0.0, 8.0, 20.0]).collect()}
    assert ev[1, 2, 1] == 1 and ev[1, 1, 0] == 1 and sum(ev.values()) == 2 and len(ev) == 12
    dry = {(r.cell, r.bin): (r.n, r.longest) for r in runs.dry_spells(df, ["cell"], 1.0, [1, 2, 4]).collect()}
    assert dry == {(1, 0): (0, 3), (1, 1): (2, 3), (2, 0): (0, 0), (2, 1): (0, 0), (3, 0): (1, 1), (3, 1): (0, 1)}
    pooled = {(r.duration, r.bin): r.n for r in runs.events(df, ["cell"], 1.0, "total", [1, 2], [0.0, 8.0, 20.0], keep=[]).collect()}
    assert pooled == {(1, 0): 1, (1, 1): 0, (2, 0): 0, (2, 1): 1}


@pytest.mark.parametrize("mode", ["same", "valid", "full"])
def test_filters_equal_convolution(spark, mode):
    rng = np.random.default_rng(3)
    values = {k: rng.normal(size=n) for k, n in ((1, 20), (2, 5), (None, 9))}
    weights = [0.5, -1.0, 2.0, 0.25, 0.1]
    rows = [(k, at(d), float(v)) for k, x in values.items() for d, v in enumerate(x)]
    found = indices.filtered(table(spark, rows), ["cell"], weights, mode=mode)
    order = "_place" if mode == "full" else "time"
    for k, x in values.items():
        own = [v for _, v in got(found.where(found.cell.eqNullSafe(k)), order, "filtered")]
        assert np.allclose(own, np.convolve(x, weights, mode))


def test_bootstrap_equals_its_rule(spark):
    """Blocks begin where Spark's 64-bit hash of (seed, cell, sample, block) says."""
    import xxhash

    def spark_hash(*values):
        h = 42
        for v, size in values:
            h = xxhash.xxh64_intdigest(int(v).to_bytes(size, "little", signed=True), h)
        return h - (h >> 63 << 64)

    x = [float(v) for v in range(100, 111)]
    found = got(indices.block_bootstrap(table(spark, [(7, at(d), v) for d, v in enumerate(x)]).withColumn("twice", 2 * series.F.col("value")), ["cell"], 4, 3, seed=5, columns=("value", "twice")), "sample", "place", "value", "twice")
    expected = []
    for sample in (1, 2, 3):
        for b in range(3):
            start = spark_hash((5, 4), (7, 8), (sample, 4), (b, 4)) % (len(x) - 3)
            expected += [(sample, 4 * b + k, x[start + k], 2 * x[start + k]) for k in range(4) if 4 * b + k < len(x)]
    assert found == expected


def test_confidence_band_equals_brute_force(spark):
    x = [float(v % 7) for v in range(40)]
    df = table(spark, [(1, at(d), v) for d, v in enumerate(x)] + [(1, at(99), None)])
    edges = [0.0, 2.0, 4.0, 7.0]
    samples = {}
    for r in indices.block_bootstrap(df.where("value is not null"), ["cell"], 5, 20).collect():
        samples.setdefault(r.sample, []).append(r.value)
    spread = np.array([np.histogram(v, edges, density=True)[0] for v in samples.values()])
    whole = np.histogram(x, edges, density=True)[0]
    for r in indices.pdf_band(df, ["cell"], edges, samples=20, block=5, level=90).collect():
        assert np.allclose([r.value, r.low, r.high], [whole[r.bin], *np.percentile(spread[:, r.bin], [5, 95])])
    counts = {r.bin: r.value for r in indices.pdf_band(df, ["cell"], edges, density=False, samples=5, block=2).collect()}
    assert counts == dict(enumerate(np.histogram(x, edges)[0].astype(float)))


def test_t_test(spark):
    """Bounds of the t distribution as printed in tables."""
    assert abs(compare.t_bound(0.05, 10) - 1.8125) < 1e-3 and abs(compare.t_bound(0.025, 30) - 2.0423) < 1e-3 and abs(compare.t_tail(2.228, 10) - 0.05) < 1e-3
    a, b = [1.0, 2.0, 4.0, 7.0], [2.0, 9.0, 8.0, 12.0, 3.0]
    df = lambda v: table(spark, [(1, at(k), x) for k, x in enumerate(v)] + [(2, at(0), 1.0)])
    found = {r.cell: r for r in compare.t_test(df(a), df(b), ["cell"], 0.05).collect()}
    t = (np.mean(a) - np.mean(b)) / math.sqrt(np.var(a, ddof=1) / 4 + np.var(b, ddof=1) / 5)
    x = np.linspace(-abs(t), abs(t), 200_001)
    density = math.gamma(4) / (math.sqrt(7 * math.pi) * math.gamma(3.5)) * (1 + x * x / 7) ** -4
    inside = float(((density[1:] + density[:-1]) / 2 * np.diff(x)).sum())
    assert abs(found[1].t - t) < 1e-12 and found[1].df == 7 and abs(found[1].p - (1 - inside)) < 1e-8 and abs(found[1].bound - 1.8946) < 1e-3
    assert found[2].t is None and found[2].p is None


def test_harmonic_curve(spark):
    cycle = spark.createDataFrame([(1, h, 3 + 2 * math.cos(2 * math.pi * h / 24 - 1) + 0.5 * math.cos(4 * math.pi * h / 24 - 2)) for h in range(24)] + [(2, h, 1.0) for h in range(23)], "cell long, hour int, value double")
    found = {r.cell: r for r in statistics.harmonic_cycle(cycle, ["cell"]).collect()}
    t = np.linspace(0, 23, 200)
    assert np.allclose([found[1].c1, found[1].p1, found[1].c2, found[1].p2], [2, 1, 0.5, 2])
    assert np.allclose(found[1].curve, 3 + 2 * np.cos(2 * np.pi * t / 24 - 1) + 0.5 * np.cos(4 * np.pi * t / 24 - 2))
    assert found[2].curve is None and found[2].c1 is None
    assert len(statistics.harmonic_cycle(cycle.where("cell = 1"), []).first().curve) == 200


def test_every_statistic_runs_pooled_and_not(spark):
    statistics.register("range", lambda part: part.value.max() - part.value.min())
    rows = [(c, at(d, h), float((d * 7 + h + c) % 11)) for c in (1, 2) for d in range(80) for h in range(0, 24, 1)]
    df = table(spark, rows).cache()
    asked = {
        "moments": {"moment stat": ["D", "max"]}, "seasonal cycle": "default", "annual cycle": {"stat method": "range"}, "diurnal cycle": {"hours": [0, 6]}, "dcycle harmonic": "default", "percentile": "default",
        "pdf": {"bins": {"pr": (0, 12, 2)}, "dry event thr": 2.0}, "asop": {"nr_bins": 10}, "eda": {"dry events": True, "dry bins": [1, 2, 5], "duration bins": [1, 2, 3]}, "Rxx": "default", "cdd": {"maxper": True}, "pr survival fraction": {"percentiles": [50, 90]},
        "signal filtering": {"window": 5, "1st cutoff": 10},
    }
    for pool in (False, True):
        options = {k: ({} if o == "default" else dict(o)) | {"pool data": pool} for k, o in asked.items()}
        for name, found in config.calculate(df, ["cell"], options, "pr").items():
            assert ("cell" in found.columns) == (not pool or name == "signal filtering"), name
            assert found.limit(1).count() == 1, name
    frequency = config.calculate(df, ["cell"], {"diurnal cycle": {"dcycle stat": "frequency", "thr": {"pr": 5.0}}, "dcycle harmonic": {"dcycle stat": "frequency", "thr": 5.0}}, "pr")
    assert frequency["diurnal cycle"].count() == 48 and frequency["dcycle harmonic"].count() == 2
    with pytest.raises(ValueError):
        config.calculate(df, ["cell"], {"pdf": {"bin": 1}})
    with pytest.raises(ValueError):
        config.calculate(df, ["cell"], {"unknown": {}})
    df.unpersist()


def test_levels_kernels_and_own_functions(spark):
    from cellweave.operators import objects

    df = table(spark, [(1, at(k), float(k)) for k in range(101)] + [(1, at(200), None)])
    assert np.allclose(compare.levels(df, 5), np.linspace(2, 98, 5))
    skewed = table(spark, [(1, at(k), float(k)) for k in range(100)] + [(1, at(200), 1e6)])
    assert np.allclose(compare.levels(skewed, 3)[-1], np.percentile([*range(100), 1e6], 99))
    with pytest.raises(ValueError):
        compare.levels(df.where("false"))
    assert objects.kernel(3).sum() == pytest.approx(1) and objects.kernel(3, how="sum").sum() == 9
    assert objects.kernel(5, "disk", "sum").tolist() == [[0, 0, 1, 0, 0], [0, 1, 1, 1, 0], [1, 1, 1, 1, 1], [0, 1, 1, 1, 0], [0, 0, 1, 0, 0]] and objects.kernel(5, "disk").max() == 1 / 25
    statistics.register("steps", lambda part: part.assign(value=part.value.diff())[["cell", "time", "value"]].dropna())
    found = statistics.generic(table(spark, [(1, at(2), 5.0), (1, at(0), 1.0), (1, at(1), 2.0), (2, at(0), 1.0)]), ["cell"], "steps", "cell long, time timestamp_ntz, value double")
    assert got(found, "cell", "value") == [(1, 1.0), (1, 3.0)]
    with pytest.raises(ValueError):
        statistics.generic(df, [], "steps", "value double")


def test_plans_stay_on_the_jvm_and_read_once(spark):
    """No Python in aggregates, one scan for distributions and runs, and date ranges at the Parquet scan."""
    items = series.series(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumnRenamed("l_suppkey", "cell"), ["cell"], "l_shipdate", "l_quantity")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (statistics.pdf(items, ["cell"], [0.0, 10.0, 60.0]), statistics.seasonal_cycle(items, ["cell"]), runs.dry_spells(items, ["cell"], 5.0, [1, 2, 9]), statistics.survival_fraction(items, ["cell"], [50, 90]), indices.filtered(items, ["cell"], [1.0, 2.0, 1.0])):
        text = plan(df)
        assert text.count("FileScan parquet") == 1 and "Python" not in text and "Arrow" not in text
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan(series.select_interval(items, "1996-01", "1996-03"))
