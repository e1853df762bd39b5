"""Configured runs: derived variables, names of data sets, one reading of each data set, regions as a key."""

import shutil

import pytest
from pyspark.sql import functions as F

from cellweave.plans import config

INI = """
[MODELS]
m1 = {'start year': 2000, 'end year': 2000, 'months': [1]}
m2 = {'start year': 2000, 'end year': 2000, 'months': [1]}
[OBS]
start year = 2000
end year = 2000
months = [1]
[SETTINGS]
output dir = /nowhere
variables = {'fine': {'freq': '3H', 'obs': ['o1', 'o2']}, 'coarse': {'freq': '6H', 'obs': ['o1', 'o2']}}
variable modification = {'both': %s}
regions = []
[STATISTICS]
stats = {'moments': {'moment stat': None}}
"""


def opener(spark, c, dataset, variable, catalogue):
    """Two cells; `fine` has six times a day apart by three hours, `coarse` every second of them."""
    n, step = (6, 3) if variable == "fine" else (3, 6)
    df = spark.range(2 * n).selectExpr("id % 2 as cell_id", f"timestamp_ntz '2000-01-01 00:00:00' + make_dt_interval(0, int(id div 2) * {step}) as time", f"double({'id div 2' if variable == 'fine' else '100 * (id div 2 + 1)'}) as value")
    g = spark.range(2).selectExpr("id as cell_id", "0 as y", "int(id) as x", "double(10 + id) as lon", "50d as lat")
    return df, g


def derived(spark, models, obs):
    given = {"models": models, "obs": obs, "input": {"x": "fine", "y": "coarse"}, "expression": "x + y", "replace": True}
    found = {}
    for r in config.analyse(spark, INI % given, opener=opener):
        if r.variable == "both":
            found[r.dataset] = sorted((x.cell_id, x.time.hour, x.value) for x in r.frame.collect())
    return found


FILLED = [(c, 3 * k, k + 100.0 * (k // 2 + 1)) for c in (0, 1) for k in range(6)]
MET = [x for x in FILLED if x[1] % 6 == 0]


def test_a_coarser_second_input_is_filled_forward_for_models(spark):
    assert derived(spark, "all", None) == {"m1": FILLED, "m2": FILLED}


def test_observations_meet_at_equal_times(spark):
    assert derived(spark, None, "all") == {"o1": MET, "o2": MET}


@pytest.mark.parametrize(("models", "obs", "names"), [("m1", None, {"m1"}), (["m2"], "o2", {"m2", "o2"}), (None, ["o1", "o2"], {"o1", "o2"})])
def test_one_name_or_a_list_of_them(spark, models, obs, names):
    assert set(derived(spark, models, obs)) == names


def test_files_are_read_once_for_all_statistics_and_regions(spark, tmp_path):
    """All results can still be read when the files are gone, and each reads one table."""
    df, g = opener(spark, None, "m1", "fine", None)
    df.write.parquet(str(tmp_path / "in"))
    scans = []

    def reading(spark, c, dataset, variable, catalogue):
        scans.append(dataset)
        return spark.read.parquet(str(tmp_path / "in")), g

    text = """
[MODELS]
m1 = {'start year': 2000, 'end year': 2000, 'months': [1]}
[SETTINGS]
output dir = /nowhere
variables = {'fine': {'freq': '3H', 'obs': None}}
regions = ['west', 'east', 'all']
[STATISTICS]
stats = {'annual cycle': 'default', 'diurnal cycle': 'default', 'moments': {'moment stat': ['all', 'mean']}, 'percentile': {'pctls': [50], 'pool data': True}}
"""
    ring = lambda a, b: [(a, 49.0), (b, 49.0), (b, 51.0), (a, 51.0)]
    results = config.analyse(spark, text, opener=reading, rings={"west": ring(9.5, 10.5), "east": ring(10.5, 11.5), "all": ring(9.0, 12.0)})
    assert scans == ["m1"] and len(results) == 4 * 3
    shutil.rmtree(tmp_path / "in")
    for r in results:
        plan = r.frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation ") == 1, plan
        cells = {x.cell_id for x in r.frame.collect()} if "cell_id" in r.frame.columns else None
        assert cells == {"west": {0}, "east": {1}, "all": {0, 1}}[r.region] if cells is not None else r.statistic == "percentile"
    means = {r.region: {x.cell_id: x.value for x in r.frame.collect()} for r in results if r.statistic == "moments"}
    assert means == {"west": {0: 2.5}, "east": {1: 2.5}, "all": {0: 2.5, 1: 2.5}}
    assert {r.region: r.frame.where(F.col("pctl") == 50).first().value for r in results if r.statistic == "percentile"} == {"west": 2.5, "east": 2.5, "all": 2.5}
