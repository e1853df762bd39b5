"""A configuration file, and the run that it asks for: from files to statistics of each data set, variable and region."""

from __future__ import annotations

import ast
import configparser
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import curved
from cellweave.operators import grid as grids
from cellweave.operators import indices, runs, series, statistics
from cellweave.sources import files
from cellweave.sources.scratch import store


def read_config(text: str) -> dict[str, dict]:
    """Sections of names and values; values that are Python literals are read as such, others are text."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.optionxform = str
    parser.read_string(text)

    def value(x: str):
        try:
            return ast.literal_eval(x)
        except (ValueError, SyntaxError):
            return x

    return {s: {k: value(v) for k, v in parser[s].items()} for s in parser.sections()}


#: Options that every statistic has, and each one's own, with their defaults (fixed values).
COMMON = {"vars": [], "resample resolution": None, "pool data": False, "thr": None, "cond analysis": None, "chunk dimension": None}
DEFAULTS: dict[str, dict] = {
    "generic": {"name": None, "schema": None},
    "moments": {"moment stat": ["D", "mean"]},
    "seasonal cycle": {"stat method": "mean"},
    "annual cycle": {"stat method": "mean"},
    "diurnal cycle": {"hours": None, "dcycle stat": "amount", "stat method": "mean", "method kwargs": None},
    "dcycle harmonic": {"dcycle stat": "amount"},
    "percentile": {"pctls": [95, 99]},
    "pdf": {"bins": None, "normalized": False, "dry event thr": None},
    "asop": {"vars": ["pr"], "nr_bins": 80, "bin_type": "Klingaman"},
    "eda": {"vars": ["pr"], "duration bins": list(range(1, 51)), "event statistic": "amount", "statistic bins": [0.1, 0.2, 0.5, 1, 2, 5, 10, 20, 50, 100, 150, 200], "dry events": False, "dry bins": None, "event thr": 0.1},
    "Rxx": {"vars": ["pr"], "normalize": False, "thr": 1.0},
    "cdd": {"vars": ["pr"], "thr": 1.0, "periods": list(range(1, 61)), "maxper": False},
    "pr survival fraction": {"vars": ["pr"], "percentiles": list(range(1, 100))},
    "signal filtering": {"cutoff type": "lowpass", "window": 61, "mode": "same", "1st cutoff": None, "2nd cutoff": None},
}


def options_of(asked: dict[str, dict | str]) -> dict[str, dict]:
    """The options of each asked statistic over its defaults; unknown names and options are errors."""
    out = {}
    for name, own in asked.items():
        if name not in DEFAULTS:
            raise ValueError(f"unknown statistic {name!r}")
        own, known = {} if own == "default" else dict(own), COMMON | DEFAULTS[name]
        if unknown := own.keys() - known.keys():
            raise ValueError(f"unknown options of {name}: {sorted(unknown)}")
        out[name] = known | own
    return out


def of_variable(option, variable: str):
    """An option's value for a variable: options may be given for each variable by name."""
    return option.get(variable) if isinstance(option, dict) else option


def _edges(bins: Sequence) -> list[float]:
    """(start, stop, step), a tuple, without stop; or a list of edges."""
    if isinstance(bins, tuple) and len(bins) == 3:
        start, stop, step = bins
        return [float(start + k * step) for k in range(math.ceil((stop - start) / step))]
    return [float(x) for x in bins]


def _needs(what: str, value):
    if value is None:
        raise ValueError(f"{what} must be set")
    return value


def _moments(df, by, keep, o, variable):
    asked, least = of_variable(o["moment stat"], variable), of_variable(o["thr"], variable)
    df = df.withColumn("value", series.threshold(F.col("value"), least))
    if asked is None:
        return df
    if asked[0] == "all":
        return statistics.moments(df, keep, asked[1])
    step = series.first_step(df)
    if step is not None and step >= series.step_seconds(asked[0]):
        return df
    if asked[1] == "interpolate":
        return series.interpolate(df, by, asked[0], asked[2])
    if asked[1] == "apply function":
        bucketed = df.withColumn("bucket", series.bucket_label(series.bucket(F.col("time"), asked[0]), asked[0]))
        return own_reducer(bucketed, [*keep, "bucket"], asked[2]).withColumnRenamed("bucket", "time")
    return statistics.moments(df, keep, asked[1], asked[0])


def own_reducer(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """A registered function of a group's values in time order (a pandas frame to a number): (by..., value)."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "value double"])
    f = statistics.OWN[name]

    def run(part):
        out = part[list(by)].head(1).copy()
        out["value"] = float(f(part.sort_values("time")))
        return out

    return df.groupBy(*by).applyInPandas(run, schema)


def _annual(df, by, keep, o, variable):
    how, least = o["stat method"], of_variable(o["thr"], variable)
    if how in statistics.OWN:
        return own_reducer(df.withColumn("value", series.threshold(F.col("value"), least)).withColumn("month", F.month("time")), [*keep, "month"], how)
    return statistics.annual_cycle(df, keep, how, least)


def _diurnal(df, by, keep, o, variable):
    df, least = series.whole_hours(df), of_variable(o["thr"], variable)
    if o["hours"] is not None:
        df = series.select_hours(df, o["hours"])
    if o["dcycle stat"] == "frequency":
        return statistics.diurnal_frequency(df, keep, _needs("a threshold", least))
    if o["dcycle stat"] != "amount":
        raise ValueError(f"unknown diurnal statistic {o['dcycle stat']!r}")
    if o["stat method"] == "pdf":
        return statistics.pdf(df.withColumn("hour", F.hour("time")), [*keep, "hour"], _edges(_needs("method kwargs", o["method kwargs"])["bins"]), least)
    return statistics.diurnal_cycle(df, keep, o["stat method"], least)


def _harmonic(df, by, keep, o, variable):
    df, least = series.whole_hours(df), of_variable(o["thr"], variable)
    if o["dcycle stat"] == "frequency":
        cycle = statistics.diurnal_frequency(df, keep, _needs("a threshold", least)).withColumn("value", F.col("n").cast("double"))
    else:
        cycle = statistics.diurnal_cycle(df, keep, "mean", least)
    return statistics.harmonic_cycle(cycle, keep)


def _pdf(df, by, keep, o, variable):
    bins = of_variable(o["bins"], variable)
    edges = _edges(bins) if bins is not None else statistics.auto_edges(df)
    return statistics.pdf(df, keep, edges, of_variable(o["thr"], variable), o["normalized"], o["dry event thr"])


def _asop(df, by, keep, o, variable):
    edges = {"Klingaman": statistics.klingaman_edges, "exponential": statistics.exponential_edges}
    return statistics.asop(df, keep, edges[o["bin_type"] if o["bin_type"] == "Klingaman" else "exponential"](o["nr_bins"]))


def _eda(df, by, keep, o, variable):
    measure = {"amount": "total", "mean": "mean", "max": "most", "mean_int": "mean", "max_int": "most"}[o["event statistic"]]
    found = runs.events(df, by, o["event thr"], measure, o["duration bins"], _edges(o["statistic bins"]), keep=keep)
    if not o["dry events"]:
        return found
    dry = runs.dry_lengths(df, by, o["event thr"], _edges(_needs("dry bins", o["dry bins"])), keep=keep)
    return dry.select(*keep, F.lit(None).cast("bigint").alias("duration"), "bin", "n").unionByName(found)


def _filter(df, by, keep, o, variable):
    kind = o["cutoff type"]
    first, second = 1 / _needs("the first cutoff", o["1st cutoff"]), 1 / _needs("the second cutoff", o["2nd cutoff"]) if kind == "bandpass" else None
    df = df.withColumn("value", series.threshold(F.col("value"), of_variable(o["thr"], variable)))
    return indices.filtered(df, by, indices.lanczos(o["window"], first, second, kind), mode=o["mode"])


#: Each statistic's function of (series, keys, keys that the result keeps, options, variable).
STATISTICS: dict[str, Callable[..., DataFrame]] = {
    "generic": lambda df, by, keep, o, v: statistics.generic(df, by, o["name"], o["schema"]),
    "moments": _moments,
    "seasonal cycle": lambda df, by, keep, o, v: statistics.seasonal_cycle(df, keep, o["stat method"], of_variable(o["thr"], v)),
    "annual cycle": _annual,
    "diurnal cycle": _diurnal,
    "dcycle harmonic": _harmonic,
    "percentile": lambda df, by, keep, o, v: statistics.percentiles(df, keep, o["pctls"], of_variable(o["thr"], v)),
    "pdf": _pdf,
    "asop": _asop,
    "eda": _eda,
    "Rxx": lambda df, by, keep, o, v: indices.days_over(df, keep, _needs("a threshold", of_variable(o["thr"], v)), o["normalize"]),
    "cdd": lambda df, by, keep, o, v: (lambda r: r if o["maxper"] else r.drop("longest"))(runs.dry_spells(df, by, _needs("a threshold", of_variable(o["thr"], v)), _edges(o["periods"]), keep=keep)),
    "pr survival fraction": lambda df, by, keep, o, v: statistics.survival_fraction(df, keep, o["percentiles"]),
    "signal filtering": _filter,
}


def calculate(df: DataFrame, by: Sequence[str], asked: dict[str, dict | str], variable: str = "") -> dict[str, DataFrame]:
    """The asked statistics of one series table (by..., time, value), lazily.

    `resample resolution` comes first. `pool data` puts all series together in the
    result; runs and filters still follow each series by itself.
    """
    out = {}
    for name, o in options_of(asked).items():
        step = of_variable(o["resample resolution"], variable)
        rows = series.resampled(df, by, step) if step else df
        out[name] = STATISTICS[name](rows, list(by), [] if o["pool data"] else list(by), o, variable)
    return out


@dataclass(frozen=True)
class Result:
    """One statistic of a data set's variable, in a region or (None) the whole domain."""

    dataset: str
    variable: str
    statistic: str
    region: str | None
    frame: DataFrame
    name: str


CELL = ["cell_id"]


def _period(c: dict) -> tuple[list[str], str]:
    """The months (YYYYMM) that a data set's section asks for, and their name."""
    start, end = c.get("date interval start"), c.get("date interval end")
    if start is not None:
        a, b = (int(x[:4]) * 12 + int(x[5:7]) - 1 for x in (start, end))
        return [f"{m // 12:04d}{m % 12 + 1:02d}" for m in range(a, b + 1)], f"{start.replace('-', '')}-{end.replace('-', '')}"
    months = c.get("months", list(range(1, 13)))
    return [f"{y:04d}{m:02d}" for y in range(c["start year"], c["end year"] + 1) for m in months], f"{c['start year']}-{c['end year']}_{files.period_name(months)}"


def _selected(df: DataFrame, c: dict) -> DataFrame:
    if c.get("date interval start") is not None:
        return series.select_interval(df, c["date interval start"], c["date interval end"])
    return series.select_years(df, c["start year"], c["end year"], c.get("months", list(range(1, 13))))


def _nth(x, dataset: str, names: Sequence[str]):
    """A factor for all data sets, or one of a list in their order."""
    return x[list(names).index(dataset)] if isinstance(x, (list, tuple)) else x


def open_dataset(spark: SparkSession, config: dict, dataset: str, variable: str, catalogue: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The series (cell_id, time, value) and the grid of a variable, of a model or (named in `obs`) an observation, read from files, selected, scaled and shifted."""
    v = config["SETTINGS"]["variables"][variable]
    models = config["MODELS"]
    if dataset in models:
        c, names = models[dataset], (v.get("var names") or {})
        own = names.get("all") or names.get(dataset) or {"prfx": variable, "vname": variable}
        months, _ = _period(c)
        paths = files.in_any_month(files.find(spark, f"{c['fpath']}/{v['freq']}/{own['prfx']}/{own['prfx']}_*.{{parquet,nc}}"), months)
        df, g = files.open_series(spark, paths, own["vname"], accumulated=bool(v.get("accumulated")), rotated=c.get("pole") if c.get("grid type") == "rot" else None)
        scale, offset = _nth(v.get("scale factor"), dataset, models), _nth(v.get("offset factor"), dataset, models)
    else:
        c = config["OBS"]
        months, _ = _period(c)
        paths = files.observation_files(spark, _needs("an observation catalogue", catalogue)[variable][dataset], months[0], months[-1])
        df, g = files.open_series(spark, paths, variable, keep_last=False)
        observed = v["obs"] if isinstance(v["obs"], (list, tuple)) else [v["obs"]]
        scale, offset = _nth(v.get("obs scale factor"), dataset, observed), None
    df = _selected(df, c)
    return df.withColumn("value", F.col("value") * float(scale if scale is not None else 1) + float(offset or 0)), g


def _step_name(step: Sequence | None, freq) -> str:
    if not step:
        return freq if isinstance(freq, str) else ""
    return step[0].replace(" ", "_") if step[0].startswith("select") else "_".join(map(str, step[:2]))


def analyse(spark: SparkSession, config: dict | str, opener: Callable = open_dataset, rings: dict[str, list] | None = None, catalogue: dict | None = None) -> list[Result]:
    """All results of a configuration.

    Series that several statistics use, and results that several regions do, are
    written once to the shared folder; else nothing is computed before it is read.

    For each variable and data set: files, selection, scaling, the common grid,
    derived variables; then for each statistic: resampling, condition, region and
    the statistic. With `full domain` the statistic comes first and its result is
    masked, else its input is. `opener` (spark, config, data set, variable,
    catalogue) gives (series, grid); `rings` the corners of the regions by name.
    """
    config = read_config(config) if isinstance(config, str) else config
    settings, asked = config["SETTINGS"], options_of(config["STATISTICS"]["stats"])
    tables: dict[str, dict[str, tuple[DataFrame, DataFrame]]] = {}
    for variable, v in settings["variables"].items():
        obs = v.get("obs")
        sets = [*config["MODELS"], *((obs if isinstance(obs, (list, tuple)) else [obs]) if obs else [])]
        opened = {d: opener(spark, config, d, variable, catalogue) for d in sets}
        to = v.get("regrid to")
        if isinstance(to, dict):
            to = files.read_grid(spark, to["file"])
        for d, (df, g) in opened.items():
            target = grids.choose_target({k: t for k, (_, t) in opened.items()}, d, to)
            if target is not None:
                df, g = regridded(df, g, target, v.get("regrid method") or "bilinear"), target
            tables.setdefault(variable, {})[d] = (df, g)
    for name, m in (settings.get("variable modification") or {}).items():
        inputs = m["input"]
        models = _names(m.get("models"), list(config["MODELS"]))
        observed = [d for d in tables[next(iter(inputs.values()))] if d not in config["MODELS"] and all(d in tables[var] for var in inputs.values())]
        for d in models + _names(m.get("obs"), observed):
            frames = {k: tables[var][d][0] for k, var in inputs.items()}
            if d in models:
                for k, var in inputs.items():
                    step = (m.get("resample resolution") or {}).get(var)
                    frames[k] = series.resampled(frames[k], CELL, step) if step else frames[k]
                first, *others = frames
                for k in others[:1]:  # a coarser second input holds until its next time
                    frames[k] = series.forward_fill(frames[first], frames[k], CELL).select(*CELL, "time", F.col("other").alias("value"))
            tables.setdefault(name, {})[d] = (series.derive(m["expression"], CELL, **frames), tables[next(iter(inputs.values()))][d][1])
        settings["variables"].setdefault(name, settings["variables"][next(iter(inputs.values()))])
        if m.get("replace"):
            for var in inputs.values():
                tables.pop(var, None)
    wanted = settings.get("regions") or []
    areas = files.regions(spark, {r: (rings or {})[r] for r in wanted}) if wanted else None
    uses = {v: sum(not o["vars"] or v in o["vars"] for o in asked.values()) for v in tables}
    for variable, found in tables.items():
        if uses[variable] > 1:
            # written once, so that files are read and values regridded once, however many statistics there are
            found.update({d: (store(df, "series"), g) for d, (df, g) in found.items()})
    members = {}
    out = []
    for statistic, o in asked.items():
        for variable in [v for v in tables if not o["vars"] or v in o["vars"]]:
            for dataset, (df, g) in tables[variable].items():
                step = of_variable(o["resample resolution"], variable)
                rows = series.resampled(df, CELL, step) if step else df
                rows = conditioned(rows, o, variable, lambda var, d=dataset: tables[var][d][0], spark)
                c = config["MODELS"].get(dataset, config.get("OBS"))

                def call(region: str | None, frame: DataFrame) -> None:
                    shown = statistic if statistic != "diurnal cycle" else f"{statistic}_{o['dcycle stat']}"  # noqa: B023
                    freq = settings["variables"][variable].get("freq", "")  # noqa: B023
                    name = files.result_name(dataset, shown, variable, _step_name(step, freq), c.get("grid name", "native"), _period(c)[1], of_variable(o["thr"], variable), o.get("stat method"), region)  # noqa: B023
                    out.append(Result(dataset, variable, statistic, region, frame, name))  # noqa: B023

                # regions are a key, so all of them are one plan; it is written once where several results read it
                of = lambda part, key: STATISTICS[statistic](part, [*key, *CELL], key if o["pool data"] else [*key, *CELL], o, variable)  # noqa: B023, E731
                once = (lambda df: store(df, "result")) if len(wanted) > 1 else (lambda df: df)
                whole = of(rows, []) if not wanted or settings.get("full domain") else None
                if whole is not None:
                    whole = once(whole)
                    call(None, whole)
                if wanted:
                    if (variable, dataset) not in members:
                        members[variable, dataset] = once(grids.membership(g, areas))
                    cells = members[variable, dataset]
                    here = lambda df, region: df.where(F.col("region") == region).drop("region")
                    if whole is not None and not o["pool data"]:
                        each = whole.join(cells, "cell_id")
                    elif statistic == "generic":  # a function of one's own returns the columns it was given a schema for, which know no regions
                        each = None
                    else:
                        each = once(of(rows.join(cells, "cell_id"), ["region"]))
                    for region in wanted:
                        call(region, of(here(rows.join(cells, "cell_id"), region), []) if each is None else here(each, region))
    return out


def _names(asked, every: Sequence[str]) -> list[str]:
    """A list of names, one name, all of them or (None) none."""
    return list(every) if asked == "all" else [asked] if isinstance(asked, str) else list(asked or [])


def regridded(df: DataFrame, source: DataFrame, target: DataFrame, method: str) -> DataFrame:
    """Values of every time on another grid: bilinear or conservative, whatever the grids' lines are. Weights are written once."""
    weights = store(curved.weights(source, target, method), "weights")
    return grids.regrid(df, weights, target, ["time"]).select("cell_id", "time", "value")


def conditioned(df: DataFrame, o: dict, variable: str, other: Callable[[str], DataFrame], spark: SparkSession) -> DataFrame:
    """Values that meet the statistic's condition, which may look at another variable: a bound for each cell from a file, one bound, or a percentile of each series."""
    c = (o["cond analysis"] or {}).get(variable)
    if c is None:
        return df
    if c["type"] == "file":
        return series.condition_table(df, files.read_bounds(spark, c["file in"], c["file var"]), c["operator"])
    given = df if c["cvar"] == variable else other(c["cvar"])
    step = c.get("resample resolution")
    if step:
        n, unit = series.split_freq(step[0])
        given = series.resample(given, CELL, step[0], step[1], label="start")
    freq = step[0] if step else None
    if c["type"] == "static":
        return series.condition(df, given, CELL, c["operator"], float(c["value"]), freq=freq)
    if c["type"] == "percentile":
        return series.condition(df, given, CELL, c["operator"], percentile=float(c["value"]), freq=freq)
    raise ValueError(f"unknown kind of condition {c['type']!r}")


def run(spark: SparkSession, config: dict | str, **options) -> list[str]:
    """`analyse`, each result written as Parquet to <output dir>/<statistic>/<name>; the paths."""
    config = read_config(config) if isinstance(config, str) else config
    paths = []
    for r in analyse(spark, config, **options):
        paths.append(f"{config['SETTINGS']['output dir']}/{r.statistic.replace(' ', '_')}/{r.name}")
        r.frame.write.mode("overwrite").parquet(paths[-1])
    return paths
