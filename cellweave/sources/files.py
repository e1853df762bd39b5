"""Files of series, chosen by the months in their names; regions from text; days with fractions; names of results."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.operators.grid import rotate, wrap_longitude
from cellweave.operators.series import clean, deaccumulate
from cellweave.operators.series import keep_last as last_rows

from . import netcdf

#: Names that coordinates go by, first choice first (fixed values).
X_NAMES, Y_NAMES = ("lon", "rlon", "longitude", "x", "X", "i"), ("lat", "rlat", "latitude", "y", "Y", "j")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def coordinate(columns: Sequence[str], names: Sequence[str]) -> str:
    for n in names:
        if n in columns:
            return n
    raise ValueError(f"none of {names} among {list(columns)}")


def find(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in any store that Spark reads, sorted."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    out = sorted(s.getPath().toString() for s in found or [])
    if not out:
        raise FileNotFoundError(f"no file matches {pattern}")
    return out


def dates_of(path: str) -> tuple[str, str]:
    """First and last month (YYYYMM) of a file, from the last two dates in its name; of one date, both."""
    dates = re.findall(r"(?<!\d)(\d{6})\d*", path.rstrip("/").rsplit("/", 1)[-1])
    if not dates:
        raise ValueError(f"no dates in {path}")
    return dates[-2] if len(dates) > 1 else dates[-1], dates[-1]


def in_any_month(paths: Sequence[str], months: Sequence[str]) -> list[str]:
    """Paths whose dates hold one of the months (YYYYMM). Names of different lengths bring a warning, for they may be of different kinds."""
    out = [p for p in sorted(paths) if any(dates_of(p)[0] <= m <= dates_of(p)[1] for m in months)]
    if not out:
        raise FileNotFoundError("no file holds the months asked for")
    if len({len(p) for p in out}) > 1:
        warnings.warn("file names differ in length: all are read", stacklevel=2)
    return out


def in_months(paths: Sequence[str], first: int, last: int, months: Sequence[int]) -> list[str]:
    """Paths whose dates hold one of the months of the years first to last."""
    return in_any_month(paths, [f"{y:04d}{m:02d}" for y in range(first, last + 1) for m in months])


def observation_files(spark: SparkSession, entry: dict, first: str, last: str) -> list[str]:
    """Files of a catalogue's entry ({path, file pattern}) from the one that holds the month `first` to the one that holds `last` (YYYYMM).

    The pattern has YYYYMM where a file's first and last month stand, or once.
    """
    pattern = entry["file pattern"]
    start, end = pattern.find("YYYYMM"), pattern.rfind("YYYYMM")
    if start < 0:
        raise ValueError(f"no YYYYMM in {pattern}")
    suffix = pattern.rsplit(".", 1)[-1]
    paths = find(spark, f"{entry['path']}/{pattern[:start]}*.{suffix}")
    names = [p.rsplit("/", 1)[-1] for p in paths]
    spans = [(n[start : start + 6], n[end : end + 6]) for n in names]
    places = []
    for month in (first, last):
        at = [k for k, (a, b) in enumerate(spans) if a <= month <= b]
        if not at:
            raise FileNotFoundError(f"no file of {entry['path']} holds {month}")
        places.append(at[0])
    return paths[places[0] : places[1] + 1]


#: Cells of a row that a cell's number has room for.
ROW_CELLS = 1_000_000


def cells_of(df: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """A table of grid values with cell_id, y, x, lon and lat, of coordinates by any of their usual names.

    Without y and x, the rows and columns of a rectilinear grid are numbered in
    ascending order of the latitudes and longitudes of `first` (a part of the table
    that has the whole grid), or of the table itself; coordinates that aren't among
    them are an error, and so is a grid whose lines aren't those of latitude and
    longitude. Longitudes over 180 are wrapped.
    """
    names = df.columns
    out, known = _located(df), _located(first if first is not None else df)
    if not {"y", "x"} <= set(names):
        cells = known.select("lat", "lon").distinct()
        n, lats, lons = cells.agg(F.count("*"), F.count_distinct("lat"), F.count_distinct("lon")).first()
        if n > 3 and min(lats, lons) > n / 2:
            raise ValueError("nearly each cell has a latitude and a longitude of its own: give the grid's y and x")
        for c, name in (("lat", "y"), ("lon", "x")):
            line = cells.select(c).distinct().withColumn(name, (F.row_number().over(Window.orderBy(c)) - 1).cast("int"))  # a row for each line of the grid
            line = line.select(F.col(c).alias("_c"), name)
            none = F.when(F.col(c).isNotNull(), F.raise_error(F.lit(f"a {c} that the first file's grid doesn't have")).cast("int"))
            out = out.join(line, F.col(c) == F.col("_c"), "left").withColumn(name, F.coalesce(name, none)).drop("_c")
    if "cell_id" not in names:
        out = out.withColumn("cell_id", F.col("y").cast("bigint") * ROW_CELLS + F.col("x"))
    return out


def _located(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c not in ("x", "y")] or df.columns
    out = df.withColumnsRenamed({coordinate(names, X_NAMES): "lon", coordinate(names, Y_NAMES): "lat"})
    return out.withColumn("lon", F.when(F.col("lon") > 180, wrap_longitude(F.col("lon"))).otherwise(F.col("lon")).cast("double"))


def is_netcdf(path: str) -> bool:
    return path.rstrip("/").endswith((".nc", ".nc3", ".cdf"))


def _netcdf_grid(spark: SparkSession, path: str, variable: str = "") -> DataFrame:
    """The cells (cell_id, y, x, lon, lat) of a NetCDF file; where it has only rotated coordinates and names their pole, the true ones."""
    cell = F.col("y").cast("bigint") * ROW_CELLS + F.col("x")
    g = netcdf.grid(spark, path, variable).select(cell.alias("cell_id"), "y", "x", F.when(F.col("lon") > 180, wrap_longitude(F.col("lon"))).otherwise(F.col("lon")).alias("lon"), "lat")
    return turned(g, netcdf.pole(path))


def turned(g: DataFrame, pole: tuple[float, float] | None) -> DataFrame:
    """A grid of rotated coordinates in true ones."""
    if not pole:
        return g
    lon, lat = rotate(F.col("lon"), F.col("lat"), *pole)
    return g.select("cell_id", "y", "x", lon.alias("lon"), lat.alias("lat"))


def _cells(df: DataFrame) -> DataFrame:
    return df.select("cell_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "lon", "lat").distinct()


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """The cells (cell_id, y, x, lon, lat) of a Parquet or NetCDF file that has at least longitudes and latitudes."""
    return _netcdf_grid(spark, path) if is_netcdf(path) else _cells(cells_of(spark.read.parquet(path)))


def read_bounds(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """A bound for each cell (cell_id, value) of a file without times."""
    if is_netcdf(path):
        df = netcdf.series(spark, [path], variable)
        if df.where("time is not null").limit(1).count():
            raise ValueError("bounds from a file have no times")
        return df.select((F.col("y").cast("bigint") * ROW_CELLS + F.col("x")).alias("cell_id"), "value")
    df = spark.read.parquet(path)
    if "time" in df.columns:
        raise ValueError("bounds from a file have no times")
    return cells_of(df).select("cell_id", clean(F.col(variable)).alias("value"))


def open_series(spark: SparkSession, paths: Sequence[str], variable: str, accumulated: bool = False, keep_last: bool = True, rotated: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """The series (cell_id, time, value) and the grid (cell_id, y, x, lon, lat) of Parquet or NetCDF files; the grid is that of the first file.

    A time that several files hold is that of the last of them by name.
    accumulated: counters, which start anew in each file, as steps. rotated: the
    pole (lon, lat) of the grid's coordinates. Days with fractions become times.
    Null values, times and coordinates stay null. Files without rows give an empty
    table. Columns beside those read are ignored.
    """
    if len({is_netcdf(p) for p in paths}) > 1:
        raise ValueError("Parquet and NetCDF files of one series can't be mixed")
    if is_netcdf(paths[0]):
        cell = F.col("y").cast("bigint") * ROW_CELLS + F.col("x")
        rows = netcdf.series(spark, paths, variable).select(cell.alias("cell_id"), "time", "value", F.col("file").alias("_file"))
        g = _netcdf_grid(spark, paths[0], variable)
        g = g if netcdf.pole(paths[0]) else turned(g, rotated)
    else:
        df, first = spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("_file", F.col("_metadata.file_path")), spark.read.parquet(paths[0])
        time = F.col("time") if dict(df.dtypes)["time"] not in ("double", "float", "int", "bigint") else fractional_day(F.col("time"))
        df = cells_of(df, first).withColumn("time", time.cast("timestamp_ntz")).withColumn("value", clean(F.col(variable)))
        g = turned(_cells(cells_of(first)), rotated)
        rows = df.select("cell_id", "time", "value", "_file")
    if accumulated:
        rows = deaccumulate(rows, ["cell_id"], file="_file", keep_file=True)
    if keep_last and len(paths) > 1:
        rows = last_rows(rows, ["cell_id"], ["_file"])
    return rows.select("cell_id", "time", "value"), g


def read_series(spark: SparkSession, paths: Sequence[str], dataset: str, variable: str, by: Sequence[str], time: str, value: str, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """(dataset, variable, by..., time, value) of Parquet files, NaN as null."""
    v = clean(F.col(value)) * scale + offset
    return spark.read.parquet(*paths).select(F.lit(dataset).alias("dataset"), F.lit(variable).alias("variable"), *by, F.col(time).cast("timestamp_ntz").alias("time"), v.alias("value"))


def grid_text(rings: DataFrame, columns: int, rows: int) -> str:
    """The text that describes a bent grid (of `grid.cell_rings`): centres and corners, six numbers a line. As long as the grid, which one machine writes."""
    cells = rings.orderBy("y", "x").select("lon", "lat", "ring").collect()

    def lines(values: Sequence[float]) -> str:
        return "\n".join(" ".join(map(str, values[k : k + 6])) for k in range(0, len(values), 6))

    parts = ["#\n# gridID 0\n#\ngridtype  = curvilinear", f"gridsize  = {columns * rows}", "xname     = lon", "xlongname = longitude", "xunits    = degrees_east", "yname     = lat", "ylongname = latitude", "yunits    = degrees_north", f"xsize     = {columns}", f"ysize     = {rows}"]
    for c, name in (("lon", "x"), ("lat", "y")):
        parts += [f"{name}vals     =\n{lines([r[c] for r in cells])}", f"{name}bounds     =\n{lines([p[name] for r in cells for p in r['ring']])}"]
    return "\n".join(parts)


def read_region(text: str, name: str) -> tuple[str, list[tuple[float, float]]]:
    """A region file: a title line, then longitude and latitude on each line; underscores in its name are blanks."""
    ring = [tuple(map(float, line.split()[:2])) for line in text.splitlines()[1:] if line.strip()]
    if len(ring) < 3:
        raise ValueError("a ring has three points at least")
    return name.replace("_", " "), ring


def regions(spark: SparkSession, rings: dict[str, list[tuple[float, float]]]) -> DataFrame:
    return spark.createDataFrame(list(rings.items()), "region string, ring array<struct<x:double,y:double>>")


def fractional_day(day: Column) -> Column:
    """YYYYMMDD.fraction as a time, to the second."""
    whole = F.floor(day)
    start = F.to_timestamp_ntz(whole.cast("string"), F.lit("yyyyMMdd"))
    return F.timestamp_add("SECOND", F.round((day - whole) * 86400).cast("int"), start)


def period_name(months: Sequence[int]) -> str:
    """ANN for all months, the month's name for one, else initials, winter beginning in December."""
    m = sorted(set(months))
    if len(m) == 12:
        return "ANN"
    if len(m) == 1:
        return MONTHS[m[0] - 1]
    if m[0] == 1 and m[-1] == 12:
        m = [k for k in m if k > 6] + [k for k in m if k <= 6]
    return "".join(MONTHS[k - 1][0] for k in m)


def result_name(dataset: str, statistic: str, variable: str, step: str, grid: str, period: str, threshold: float | None = None, how: str | None = None, region: str | None = None) -> str:
    parts = [dataset, statistic.replace(" ", "_"), variable, None if threshold is None else f"thr{threshold}", step, how and how.replace(" ", "_"), region and region.replace(" ", "_"), grid, period]
    return "_".join(p for p in parts if p)


def write_result(df: DataFrame, path: str, by: Sequence[str] = ("statistic", "variable")) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
