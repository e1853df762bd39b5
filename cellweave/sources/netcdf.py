"""NetCDF files of the classic kinds (CDF-1, CDF-2, CDF-5) as a Spark source and sink, by byte ranges in numpy.

Files are read where pyarrow reaches them (local and mounted folders, hdfs, s3,
gs). A task reads the times and the values of some steps of one file; steps that
a filter on `time` rules out aren't read, and neither are other variables.

Read: scale_factor and add_offset are applied; _FillValue, missing_value and NaN
are null. A variable has the dimensions time, row and column, in this order, or
lacks some; others must have one entry. Times follow their units and calendar;
years of 360 days are refused, for they have days that no timestamp has. Files of
the HDF5 kind are an error that says so.

Written: one file for each month (or day) of a series with all cells of its grid,
missing values as _FillValue; two values of one cell and time are an error. Tables
of numbers become files of one record for each row, nulls as _FillValue. Files
get their names when all tasks are done; if one fails none appears. An empty table
writes no file.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .scratch import reachable

# fixed values of the file format: external types by number, the marks of lists, the names of coordinates
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
LON_NAMES, LAT_NAMES = ("lon", "longitude", "nav_lon", "rlon", "x", "X", "i"), ("lat", "latitude", "nav_lat", "rlat", "y", "Y", "j")
SECONDS = {"second": 1, "seconds": 1, "sec": 1, "s": 1, "minute": 60, "minutes": 60, "min": 60, "hour": 3600, "hours": 3600, "hr": 3600, "h": 3600, "day": 86400, "days": 86400, "d": 86400}
FILL = 9.969209968386869e36

#: Bytes of values that a task reads, about; rows of a batch, and of a file of records.
TASK_BYTES, BATCH_ROWS, FILE_ROWS = 64 << 20, 1 << 16, 1 << 20


def open_file(path: str, write: bool = False):
    """(file system, path in it) of a path or address."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path)
    return fs.LocalFileSystem(), path


# headers


@dataclass
class Variable:
    name: str
    dims: list[str]
    shape: list[int]
    attributes: dict
    kind: str
    begin: int
    stride: int  # bytes from one entry of the first dimension to the next
    record: bool

    @property
    def size(self) -> int:
        """Bytes of one value."""
        return np.dtype(self.kind).itemsize

    def step_bytes(self) -> int:
        return math.prod(self.shape[1:]) * self.size


@dataclass
class Header:
    dims: dict[str, int]
    attributes: dict
    variables: dict[str, Variable] = field(default_factory=dict)


class _Reader:
    """Numbers and names of a header, in the width that the version has."""

    def __init__(self, file, version: int):
        self.file, self.wide, self.offset = file, ">i8" if version == 5 else ">i4", ">i4" if version == 1 else ">i8"

    def number(self, kind: str = ">i4") -> int:
        return int(np.frombuffer(self.file.read(np.dtype(kind).itemsize), kind)[0])

    def count(self) -> int:
        return self.number(self.wide)

    def padded(self, n: int) -> bytes:
        return self.file.read(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def list_of(self, mark: int, one) -> list:
        found, n = self.number(), self.count()
        if found not in (0, mark) or (found == 0 and n):
            raise ValueError("not a NetCDF header")
        return [one() for _ in range(n)]

    def attribute(self) -> tuple:
        name, kind = self.name(), np.dtype(TYPES[self.number()])
        n = self.count()
        raw = self.padded(n * kind.itemsize)
        return name, raw.decode(errors="replace").rstrip("\0") if kind.kind == "S" else np.frombuffer(raw, kind)


def read_header(file, length: int) -> Header:
    """The header of an open file of `length` bytes."""
    magic = file.read(4)
    if magic[:4] == b"\x89HDF":
        raise ValueError("this is a NetCDF-4 (HDF5) file; only the classic kinds are read: convert it by `nccopy -k cdf5`")
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a NetCDF file of a classic kind")
    r = _Reader(file, magic[3])
    records = r.count()
    dims = r.list_of(DIMENSIONS, lambda: (r.name(), r.count()))
    header = Header(dict(dims), dict(r.list_of(ATTRIBUTES, r.attribute)))

    def variable() -> Variable:
        name = r.name()
        at = [dims[r.count()] for _ in range(r.count())]
        attributes, kind = dict(r.list_of(ATTRIBUTES, r.attribute)), TYPES[r.number()]
        r.count()  # its size, which follows from the dimensions
        record = bool(at) and at[0][1] == 0
        out = Variable(name, [d for d, _ in at], [n for _, n in at], attributes, kind, r.number(r.offset), 0, record)
        out.stride = out.step_bytes() if at else out.size
        return out

    found = r.list_of(VARIABLES, variable)
    of_records = [v for v in found if v.record]
    whole = of_records[0].stride if len(of_records) == 1 else sum(v.stride + -v.stride % 4 for v in of_records)
    if records < 0 and of_records:  # counted by the file's length
        records = (length - min(v.begin for v in of_records)) // max(1, whole)
    for v in of_records:
        v.stride, v.shape[0] = whole, records
    header.dims = {d: n or records for d, n in header.dims.items()}
    header.variables = {v.name: v for v in found}
    return header


def header_of(path: str) -> Header:
    system, at = open_file(path)
    with system.open_input_file(at) as f:
        return read_header(f, f.size())


def dump(path: str) -> str:
    """Dimensions, variables and attributes of a file as text."""
    h = header_of(path)
    lines = ["dimensions:", *(f"  {d} = {n}" for d, n in h.dims.items()), "variables:"]
    for v in h.variables.values():
        lines += [f"  {np.dtype(v.kind).name} {v.name}({', '.join(v.dims)})", *(f"    {v.name}:{k} = {x if isinstance(x, str) else x.tolist()}" for k, x in v.attributes.items())]
    return "\n".join([*lines, "attributes:", *(f"  :{k} = {x if isinstance(x, str) else x.tolist()}" for k, x in h.attributes.items())])


# values


def read_steps(file, v: Variable, first: int, n: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values `start` to `stop` of each of `n` steps from `first`, as they are stored."""
    one = math.prod(v.shape[1:]) if v.dims else 1
    stop = one if stop is None else stop
    if v.stride == one * v.size and (start, stop) == (0, one):
        file.seek(v.begin + first * v.stride)
        return np.frombuffer(file.read(n * v.stride), v.kind).reshape(n, one)
    out = np.empty((n, stop - start), v.kind)
    for k in range(n):
        file.seek(v.begin + (first + k) * v.stride + start * v.size)
        out[k] = np.frombuffer(file.read((stop - start) * v.size), v.kind)
    return out


def decoded(raw: np.ndarray, attributes: dict) -> np.ndarray:
    """Doubles, unpacked; NaN where a value is missing."""
    out = raw.astype(np.float64)
    for name in ("_FillValue", "missing_value"):
        if name in attributes and not isinstance(attributes[name], str):
            for gap in attributes[name]:
                out[raw == gap] = np.nan
    scale, offset = (attributes.get(k) for k in ("scale_factor", "add_offset"))
    if scale is not None:
        out *= float(scale[0])
    if offset is not None:
        out += float(offset[0])
    return out


def times(raw: np.ndarray, attributes: dict) -> np.ndarray:
    """Times in microseconds since 1970 of numbers with units `<unit> since <time>` or `day as %Y%m%d.%f`."""
    units, calendar = attributes.get("units", ""), attributes.get("calendar", "standard").lower()
    x = raw.astype(np.float64).ravel()
    if units.startswith("day as"):
        whole = np.floor(x)
        day = np.array([np.datetime64(f"{int(d):08d}"[:4] + "-" + f"{int(d):08d}"[4:6] + "-" + f"{int(d):08d}"[6:]) for d in whole], "M8[us]")
        return day.astype(np.int64) + np.round((x - whole) * 86400).astype(np.int64) * 1_000_000
    unit, _, since = units.partition(" since ")
    if unit.strip().lower() not in SECONDS or not since:
        raise ValueError(f"units of time {units!r} aren't understood")
    parts = since.strip().replace("T", " ").removesuffix("Z").removesuffix("UTC").split()
    year, month, day = (int(p) for p in parts[0].split("-"))
    clock = [float(p) for p in parts[1].split(":")] if len(parts) > 1 else []
    start = sum(round(c * 1e6) * 60 ** (2 - k) for k, c in enumerate(clock))
    step = np.round(x * SECONDS[unit.strip().lower()] * 1e6)
    step = step.astype(np.int64) + start
    if calendar in ("standard", "gregorian", "proleptic_gregorian", "none", ""):
        return np.datetime64(f"{year:04d}-{month:02d}-{day:02d}", "us").astype(np.int64) + step
    if calendar in ("noleap", "365_day"):
        before = np.cumsum([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30])
        days, rest = np.divmod(step, 86_400_000_000)
        days += year * 365 + int(before[month - 1]) + day - 1
        y, d = np.divmod(days, 365)
        m = np.searchsorted(before, d, "right") - 1
        months = (y - 1970) * 12 + m
        return months.astype("M8[M]").astype("M8[D]").astype("M8[us]").astype(np.int64) + (d - before[m]) * 86_400_000_000 + rest
    raise ValueError(f"the calendar {calendar!r} has days that no timestamp has")


def coordinates(h: Header, variable: str | None = None) -> tuple[str, str]:
    """The names of the longitudes and latitudes: two-dimensional ones before lines, usual names first."""
    named = h.variables[variable].attributes.get("coordinates", "").split() if variable in h.variables else []

    def first(names: Sequence[str]) -> str:
        known = [n for n in (*[c for c in named if c in names], *names) if n in h.variables and 1 <= len(h.variables[n].dims) <= 2]
        if not known:
            raise ValueError(f"none of {names} among {list(h.variables)}")
        return max(known, key=lambda n: len(h.variables[n].dims))

    return first(LON_NAMES), first(LAT_NAMES)


def pole(path: str) -> tuple[float, float] | None:
    """The pole (lon, lat) of a rotated grid whose file has only rotated coordinates."""
    h = header_of(path)
    for v in h.variables.values():
        if "grid_north_pole_longitude" in v.attributes and not {"lon", "longitude", "nav_lon"} & set(h.variables):
            return float(v.attributes["grid_north_pole_longitude"][0]), float(v.attributes["grid_north_pole_latitude"][0])
    return None


def _layout(h: Header, name: str) -> tuple[Variable, bool, int, int]:
    """A variable, whether it has times, and its rows and columns."""
    if name not in h.variables:
        raise ValueError(f"no variable {name!r} among {list(h.variables)}")
    v = h.variables[name]
    timed = bool(v.dims) and (v.dims[0] == "time" or v.record)
    space = [n for n in v.shape[1 if timed else 0 :] if n != 1]
    if len(space) > 2:
        raise ValueError(f"{name} has more than two dimensions beside time: {v.dims}")
    last = v.shape[1 if timed else 0 :][-2:]
    ny, nx = space if len(space) == 2 else last if len(last) == 2 else (1, space[0] if space else 1)
    return v, timed, ny, nx


# source


@dataclass
class Steps(InputPartition):
    path: str
    first: int
    n: int
    start: int
    stop: int


SERIES = "file string, time timestamp_ntz, y int, x int, value double"
GRID = "y int, x int, lon double, lat double"


class NetcdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.variable, self.kind = json.loads(options["paths"]), options.get("variable"), options.get("kind", "series")
        self.low, self.high = -(2**63), 2**63 - 1

    def pushFilters(self, filters):
        """Bounds of time are kept; Spark holds rows against all filters again."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("time",):
                try:
                    at = int(np.datetime64(f.value, "us").astype(np.int64))
                except (TypeError, ValueError):
                    at = None
                if at is not None:
                    if not isinstance(f, (LessThan, LessThanOrEqual)):
                        self.low = max(self.low, at)
                    if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                        self.high = min(self.high, at)
            yield f

    def partitions(self) -> list[Steps]:
        out = []
        for path in self.paths:
            h = header_of(path)
            if self.kind == "grid":
                lon, _ = coordinates(h, self.variable)
                return [Steps(path, 0, 1, 0, len(h.variables[lon].dims))]  # all files have the first one's grid
            if self.kind == "rows":
                n, each = max((v.shape[0] for v in h.variables.values() if v.record), default=0), 1 << 20
                out += [Steps(path, k, min(each, n - k), 0, 1) for k in range(0, n, each)]
                continue
            v, timed, ny, nx = _layout(h, self.variable)
            one = ny * nx * v.size
            steps, rows = max(1, TASK_BYTES // max(1, one)), max(1, TASK_BYTES // max(1, nx * v.size))
            total = v.shape[0] if timed else 1
            for k in range(0, total, steps):
                for r in range(0, ny, rows):
                    out.append(Steps(path, k, min(steps, total - k), r, min(ny, r + rows)))
        return out or [Steps("", 0, 0, 0, 0)]

    def read(self, partition: Steps) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        system, at = open_file(partition.path)
        with system.open_input_file(at) as f:
            h = read_header(f, f.size())
            yield from {"series": self._series, "grid": self._grid, "rows": self._rows}[self.kind](f, h, partition)

    def _series(self, f, h: Header, p: Steps) -> Iterator[pa.RecordBatch]:
        v, timed, ny, nx = _layout(h, self.variable)
        when = times(read_steps(f, t := h.variables["time"], p.first, p.n), t.attributes) if timed and "time" in h.variables else [None] * p.n
        rows = max(1, BATCH_ROWS // nx)
        for k, at in enumerate(when):
            if at is not None and not self.low <= at <= self.high:
                continue
            for r in range(p.start, p.stop, rows):
                end = min(p.stop, r + rows)
                if timed:
                    raw = read_steps(f, v, p.first + k, 1, r * nx, end * nx)[0]
                else:
                    f.seek(v.begin + r * nx * v.size)
                    raw = np.frombuffer(f.read((end - r) * nx * v.size), v.kind)
                value = decoded(raw, v.attributes)
                n = len(value)
                time = pa.nulls(n, pa.timestamp("us")) if at is None else pa.array(np.full(n, at).astype("M8[us]"), pa.timestamp("us"))
                y, x = np.divmod(np.arange(n) + r * nx, nx)
                yield pa.RecordBatch.from_arrays([pa.array([p.path]).take(pa.array(np.zeros(n, np.int32))), time, pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(value, mask=np.isnan(value))], names=["file", "time", "y", "x", "value"])

    def _grid(self, f, h: Header, p: Steps) -> Iterator[pa.RecordBatch]:
        lon, lat = (h.variables[c] for c in coordinates(h, self.variable))

        def values(v: Variable, start: int, n: int) -> np.ndarray:
            f.seek(v.begin + start * v.size)
            return decoded(np.frombuffer(f.read(n * v.size), v.kind), v.attributes)

        if len(lon.dims) == 2:
            ny, nx = lon.shape
        else:
            ny, nx = lat.shape[0], lon.shape[0]
            a, b = values(lon, 0, nx), values(lat, 0, ny)
        rows = max(1, BATCH_ROWS // nx)
        for r in range(0, ny, rows):
            end = min(ny, r + rows)
            y, x = np.divmod(np.arange(r * nx, end * nx), nx)
            here = (values(lon, r * nx, len(y)), values(lat, r * nx, len(y))) if len(lon.dims) == 2 else (a[x], b[y])
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.int32()), *(pa.array(c, mask=np.isnan(c)) for c in here)], names=["y", "x", "lon", "lat"])

    def _rows(self, f, h: Header, p: Steps) -> Iterator[pa.RecordBatch]:
        found = [v for v in h.variables.values() if v.record and len(v.dims) == 1]
        for k in range(p.first, p.first + p.n, BATCH_ROWS):
            n = min(BATCH_ROWS, p.first + p.n - k)
            begin, stride = min(v.begin for v in found), found[0].stride
            f.seek(begin + k * stride)
            raw = np.frombuffer(f.read(n * stride).ljust(n * stride, b"\0"), np.uint8).reshape(n, -1)  # the last record may end before the next one's start
            columns = []
            for v in found:
                own = np.ascontiguousarray(raw[:, v.begin - begin : v.begin - begin + v.size]).view(v.kind)[:, 0]
                if "since" in v.attributes.get("units", ""):
                    gap = np.isnan(decoded(own, {k: x for k, x in v.attributes.items() if k == "_FillValue"}))
                    columns.append(pa.array(times(np.where(gap, 0, own), v.attributes).astype("M8[us]"), pa.timestamp("us"), mask=gap))
                else:
                    value = decoded(own, v.attributes)
                    columns.append(pa.array(value, mask=np.isnan(value)))
            yield pa.RecordBatch.from_arrays(columns, names=[v.name for v in found])


class Netcdf(DataSource):
    """Options: paths (a JSON list), variable, kind: series, grid (of the first file) or rows."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        kind = self.options.get("kind", "series")
        if kind != "rows":
            return {"series": SERIES, "grid": GRID}[kind]
        h = header_of(json.loads(self.options["paths"])[0])
        return ", ".join(f"`{v.name}` {'timestamp_ntz' if 'since' in v.attributes.get('units', '') else 'double'}" for v in h.variables.values() if v.record and len(v.dims) == 1)

    def reader(self, schema) -> NetcdfReader:
        return NetcdfReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> NetcdfWriter:
        return NetcdfWriter(dict(self.options), overwrite)


def _load(spark: SparkSession, paths: Sequence[str], **options: str) -> DataFrame:
    reachable(spark)
    spark.dataSource.register(Netcdf)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("netcdf").options(paths=json.dumps(list(paths)), **options).load()


def series(spark: SparkSession, paths: Sequence[str], variable: str) -> DataFrame:
    """(file, time, y, x, value) of a variable of files; filters on time choose the steps that are read."""
    return _load(spark, paths, variable=variable)


def grid(spark: SparkSession, path: str, variable: str = "") -> DataFrame:
    """(y, x, lon, lat) of a file's grid, lines or two-dimensional coordinates."""
    return _load(spark, [path], variable=variable, kind="grid")


def rows(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The variables of files that have nothing but records, as columns; numbers with units of time as timestamps."""
    return _load(spark, paths, kind="rows")


# sink


def _number(n: int, kind: str = ">i4") -> bytes:
    return np.array(n, kind).tobytes()


def encode_header(records: int, dims: list[tuple[str, int]], attributes: dict, variables: list[tuple[str, list[str], dict, str]]) -> bytes:
    """The header of a file: dims (the first one, of size 0, is that of records), and variables (name, dims, attributes, type), those without records first."""
    sizes = dict(dims)
    each = [math.prod(sizes[d] for d in at if sizes[d]) * np.dtype(kind).itemsize for _, at, _, kind in variables]
    version = 5 if max(each, default=0) > 2**31 - 8 or records > 2**31 - 1 else 2
    wide, number = ">i8" if version == 5 else ">i4", {kind: k for k, kind in TYPES.items()}
    name = lambda s: _number(len(s.encode()), wide) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    many = lambda mark, parts: (_number(mark) + _number(len(parts), wide) if parts else _number(0) + _number(0, wide)) + b"".join(parts)

    def attribute(k: str, x) -> bytes:
        kind, raw, n = (2, x.encode(), len(x.encode())) if isinstance(x, str) else (6, np.array([x], ">f8").tobytes(), 1)
        return name(k) + _number(kind) + _number(n, wide) + raw + b"\0" * (-len(raw) % 4)

    listed = lambda d: many(ATTRIBUTES, [attribute(k, x) for k, x in d.items()])

    def whole(begins: list[int]) -> bytes:
        order = [d for d, _ in dims]
        parts = [name(v) + _number(len(at), wide) + b"".join(_number(order.index(d), wide) for d in at) + listed(own) + _number(number[kind]) + _number(size + -size % 4, wide) + _number(b, ">i8") for (v, at, own, kind), size, b in zip(variables, each, begins)]
        return b"CDF" + bytes([version]) + _number(records, wide) + many(DIMENSIONS, [name(d) + _number(n, wide) for d, n in dims]) + listed(attributes) + many(VARIABLES, parts)

    at, begins = len(whole([0] * len(variables))), []
    for size in each:
        begins.append(at)
        at += size + -size % 4
    return whole(begins)


class NetcdfWriter(DataSourceArrowWriter):
    """Rows (bucket, steps, time, y, x, value), sorted, as a file for each bucket; or any rows of numbers as a file for each task."""

    def __init__(self, options: dict, overwrite: bool):
        self.o, self.overwrite, self.run = options, overwrite, uuid.uuid4().hex

    def _out(self, name: str):
        system, base = open_file(self.o["path"])
        system.create_dir(f"{base}/_temporary/{self.run}", recursive=True)
        path = f"_temporary/{self.run}/{uuid.uuid4().hex}"  # a task that is tried again writes another file
        return system.open_output_stream(f"{base}/{path}"), (path, name)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        message = WriterCommitMessage()
        message.files = list(self._rows(batches) if self.o.get("kind") == "rows" else self._series(batches))
        return message

    def _series(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        system, base = open_file(self.o["grid"])
        import pyarrow.dataset as ds

        g = ds.dataset(base, filesystem=system, format="parquet").to_table().to_pydict()
        y, x = np.array(g["y"]), np.array(g["x"])
        ny, nx = int(y.max()) + 1, int(x.max()) + 1
        lon, lat = np.full((ny, nx), np.nan), np.full((ny, nx), np.nan)
        lon[y, x], lat[y, x] = g["lon"], g["lat"]
        with np.errstate(all="ignore"):
            lines = [np.nanmax(lon, 0), np.nanmax(lat, 1)]
            plain = bool((np.nanmax(lon, 0) == np.nanmin(lon, 0)).all() and (np.nanmax(lat, 1) == np.nanmin(lat, 1)).all())
        places = lines if plain else [lon, lat]
        dims = [("time", 0), ("lat" if plain else "y", ny), ("lon" if plain else "x", nx)]
        space = [d for d, _ in dims[1:]]
        units = [("lon", {"units": "degrees_east", "standard_name": "longitude", "_FillValue": FILL}), ("lat", {"units": "degrees_north", "standard_name": "latitude", "_FillValue": FILL})]
        own = json.loads(self.o.get("attributes", "{}")) | {"_FillValue": FILL} | ({} if plain else {"coordinates": "lon lat"})
        variables = [*((c, [c] if plain else space, a, ">f8") for c, a in units), ("time", ["time"], {"units": "seconds since 1970-01-01 00:00:00", "calendar": "standard"}, ">f8"), (self.o["variable"], ["time", *space], own, ">f8")]
        out, now, slab = None, (None, None), np.full(ny * nx, FILL)
        filled = np.zeros(ny * nx, bool)

        def flush() -> None:
            if out is not None and now[1] is not None:
                out.write(np.array(now[1] / 1e6, ">f8").tobytes())
                out.write(slab.astype(">f8").tobytes())
                slab[:] = FILL
                filled[:] = False

        for batch in batches:
            bucket = batch.column("bucket").to_pylist()
            time = batch.column("time").cast(pa.int64()).to_numpy()
            place = batch.column("y").to_numpy().astype(np.int64) * nx + batch.column("x").to_numpy()
            value = batch.column("value").to_numpy(zero_copy_only=False).astype(np.float64)
            cut = np.flatnonzero(np.r_[True, time[1:] != time[:-1], True]) if len(time) else []
            for a, b in zip(cut, cut[1:]):
                if (bucket[a], time[a]) != now:
                    flush()
                    if bucket[a] != now[0]:
                        if out is not None:
                            out.close()
                        out, entry = self._out(f"{self.o['variable']}_{bucket[a]}-{bucket[a]}.nc")
                        yield entry
                        out.write(encode_header(int(batch.column("steps")[int(a)].as_py()), dims, json.loads(self.o.get("global", "{}")), variables))
                        out.write(b"".join(np.where(np.isnan(p), FILL, p).astype(">f8").tobytes() for p in places))
                    now = (bucket[a], time[a])
                part = place[a:b]
                if filled[part].any() or len(np.unique(part)) < len(part):
                    raise ValueError("two values of one cell and time")
                filled[part] = True
                slab[part] = np.where(np.isnan(value[a:b]), FILL, value[a:b])
        flush()
        if out is not None:
            out.close()

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            record = np.empty(batch.num_rows, [(f"c{k}", ">f8") for k in range(batch.num_columns)])
            for k, c in enumerate(batch.columns):
                timed = pa.types.is_timestamp(c.type)
                values = c.cast(pa.int64()).cast(pa.float64(), safe=False) if timed else c.cast(pa.float64(), safe=False)
                own = values.to_numpy(zero_copy_only=False) / (1e6 if timed else 1)
                record[f"c{k}"] = np.where(np.isnan(own), FILL, own)
            parts.append(record.tobytes())
            held += len(record)
            if held >= FILE_ROWS:
                yield self._records(batch.schema, parts, held)
                parts, held = [], 0
        if held:
            yield self._records(batch.schema, parts, held)

    def _records(self, schema: pa.Schema, parts: list[bytes], n: int) -> tuple[str, str]:
        seconds = {"units": "seconds since 1970-01-01 00:00:00", "calendar": "standard"}
        variables = [(c.name, ["record"], {"_FillValue": FILL} | (seconds if pa.types.is_timestamp(c.type) else {}), ">f8") for c in schema]
        out, entry = self._out(f"part-{uuid.uuid4().hex}.nc")
        with out:
            out.write(encode_header(n, [("record", 0)], json.loads(self.o.get("global", "{}")), variables))
            for part in parts:
                out.write(part)
        return entry

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        from pyarrow import fs

        system, base = open_file(self.o["path"])
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if info.path.endswith(".nc"):
                    system.delete_file(info.path)
        for m in messages:
            for path, name in m.files if m else ():
                system.move(f"{base}/{path}", f"{base}/{name}")
        self.abort([])

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        from pyarrow import fs

        system, base = open_file(self.o["path"])
        if system.get_file_info(f"{base}/_temporary/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_temporary/{self.run}")
            if not system.get_file_info(fs.FileSelector(f"{base}/_temporary")):
                system.delete_dir(f"{base}/_temporary")


#: Letters of a time that name a file, by how much of it a file holds.
BUCKETS = {"month": "yyyyMM", "day": "yyyyMMdd"}


def write_series(df: DataFrame, cells: DataFrame, path: str, variable: str, bucket: str = "month", attributes: dict | None = None, about: dict | None = None) -> None:
    """A series (cell_id, time, value) on a grid (cell_id, y, x, lon, lat) as a file `<variable>_<first>-<last>.nc` for each month or day.

    A task writes a file, step after step, with one step in memory; the grid is
    written beside the files for the tasks, and deleted again. Rows without a time
    or a cell of the grid are an error.
    """
    spark = df.sparkSession
    reachable(spark)
    spark.dataSource.register(Netcdf)
    beside = f"{path}/_grid-{uuid.uuid4().hex}"
    cells.select("y", "x", "lon", "lat").write.parquet(beside)
    refuse = F.raise_error(F.lit("a row without a time or a cell of the grid"))
    met = df.select("cell_id", "time", "value").join(cells.select("cell_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")), "cell_id", "left")
    placed = met.select(F.coalesce(F.date_format("time", BUCKETS[bucket]), refuse.cast("string")).alias("bucket"), F.col("time").cast("timestamp_ntz").alias("time"), F.coalesce("y", refuse.cast("int")).alias("y"), "x", F.col("value").cast("double").alias("value"))
    steps = placed.groupBy("bucket").agg(F.count_distinct("time").cast("int").alias("steps"))
    ready = placed.join(F.broadcast(steps), "bucket").select("bucket", "steps", "time", "y", "x", "value")  # a row for each file
    ready = ready.repartition("bucket").sortWithinPartitions("bucket", "time", "y", "x")
    options = {"path": path, "grid": beside, "variable": variable, "attributes": json.dumps(attributes or {}), "global": json.dumps(about or {})}
    ready.write.format("netcdf").mode("append").options(**options).save()
    system, base = open_file(beside)
    system.delete_dir(base)


def write_rows(df: DataFrame, path: str, about: dict | None = None) -> None:
    """A table of numbers and times as files of records, one or more for each task; what stood there is replaced."""
    reachable(df.sparkSession)
    df.sparkSession.dataSource.register(Netcdf)
    df.write.format("netcdf").mode("overwrite").options(path=path, kind="rows", **{"global": json.dumps(about or {})}).save()


def replaced_rows(df: DataFrame, path: str, about: dict | None = None) -> DataFrame:
    """`write_rows`, and the table read back with the columns' types that it had; without rows an empty one."""
    write_rows(df, path, about)
    from pyarrow import fs

    system, base = open_file(path)
    found = sorted(i.path for i in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.path.endswith(".nc"))
    spark = df.sparkSession
    if not found:
        return spark.createDataFrame([], df.schema)
    back = rows(spark, [f"{path}/{p.rsplit('/', 1)[-1]}" for p in found])
    return back.select(*(F.col(c).cast(t).alias(c) for c, t in df.dtypes))
