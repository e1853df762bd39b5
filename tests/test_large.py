"""Ranks, running totals and quantiles of large groups against SQL and plain sorting, and their plans."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import indices, large, statistics

FRACTIONS = [0, 0.01, 0.25, 0.5, 0.9, 0.999, 1]


def table(spark, seed, n):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, 0.0, 0.0, 0.0, 1.5, -2.0, rng.gauss(0, 5), float(rng.randrange(20))])
    return [(rng.choice([None, 1, 2, 3]), k, value()) for k in range(n)] + [(9, n, None)]


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_quantiles_equal_sorting(spark, by, n):
    rows = table(spark, n, n)
    df = spark.createDataFrame(rows, "g int, k int, value double").repartition(7)
    got = {r[0] if by else None: r["_q"] for r in large.quantiles(df, by, FRACTIONS).collect()}
    for g in {r[0] for r in rows} if by else {None}:
        own = [v for h, _, v in rows if v is not None and (not by or h == g)]
        want = np.quantile(own, FRACTIONS).tolist() if own else [None] * len(FRACTIONS)
        assert all(a == b or abs(a - b) < 1e-12 for a, b in zip(got[g], want, strict=True)), (g, got[g], want)
    assert len(got) == (len({r[0] for r in rows}) if by else 1)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_equals_windows(spark, by):
    rows = table(spark, 3, 3000)
    df = spark.createDataFrame(rows, "g int, k int, value double").repartition(5)
    got = {r.k: (r.place, r.size, r.s, r.s_all) for r in large.running(df, by, [F.desc("value"), F.col("k")], {"s": F.col("value")}).collect()}
    con = duckdb.connect()
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["g", "k", "value"]).astype({"g": "Int64"})
    con.register("t", frame)
    part = "partition by g" if by else ""
    for k, *want in con.execute(f"select k, row_number() over w, count(*) over ({part}), sum(coalesce(value, 0)) over (w rows unbounded preceding), sum(coalesce(value, 0)) over ({part}) from t window w as ({part} order by value desc nulls last, k)").fetchall():
        assert got[k][:2] == tuple(want[:2]) and all(abs(a - b) < 1e-8 for a, b in zip(got[k][2:], want[2:]))


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "g int, value double")
    assert large.running(df, ["g"], [F.col("value")]).collect() == []
    assert large.quantiles(df, ["g"], [0.5]).collect() == [] and large.quantiles(df, [], [0.5]).collect()[0][0] == [None]


def test_pooled_statistics_hold_no_whole_group(spark):
    """No percentile of all values in one task, and no window over all rows."""
    df = spark.range(1000).selectExpr("id as cell", "timestamp_ntz '2000-01-01' as time", "double(id * 7 % 1000) as value")
    for frame in (statistics.survival_fraction(df, [], [50, 90]), statistics.percentiles(df, [], [50, 90]), indices.ranked_share(df, [], ["cell"]), indices.exceedance(df, [], ["cell"])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan
        lines = plan.splitlines()
        for k, line in enumerate(lines):
            if "Window [" in line and "_part" not in line:
                assert any("HashAggregate" in x for x in lines[k + 1 : k + 10])  # only sums of partitions
    assert [round(r.value, 6) for r in statistics.percentiles(df, [], [50, 90]).orderBy("pctl").collect()] == [499.5, 899.1]
