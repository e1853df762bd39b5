"""Plans that read their table once."""

from pyspark.sql import functions as F

from cellweave.operators import series


def table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).selectExpr("id % 7 as cell", "timestamp_ntz '2000-01-01 00:00:00' + make_dt_interval(int(id div 7)) as time", "case when id % 5 != 0 then double(id % 31) end as value").write.parquet(path)
    return spark.read.parquet(path)


def read(df):
    """Files read and exchanges of the plan as it ran, without those that were used again."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return ran.count("FileScan parquet"), ran


def test_means_of_buckets_read_once(spark, tmp_path):
    scans, plan = read(series.resample(table(spark, tmp_path), ["cell"], "MS", "mean"))
    assert scans == 1 and "ReusedExchange" in plan


def test_a_table_s_own_percentile_reads_once(spark, tmp_path):
    df = table(spark, tmp_path)
    for options in ({"percentile": 75.0}, {"bound": 12.0}):
        one, other = series.condition(df, df, ["cell"], ">", **options), series.condition(df, df.select("*"), ["cell"], ">", **options)
        scans, plan = read(one)
        assert scans == 1 and plan.count("Exchange hashpartitioning") == 1
        assert sorted(one.collect(), key=str) == sorted(other.collect(), key=str)
    twice = df.union(df.withColumn("value", F.lit(30.0)).limit(20))  # a time that holds two values: either may meet the bound
    assert sorted(series.condition(twice, twice, ["cell"], ">", bound=29.0).collect(), key=str) == sorted(series.condition(twice, twice.select("*"), ["cell"], ">", bound=29.0).collect(), key=str)
