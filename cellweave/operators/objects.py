"""Object-based comparison of fields (structure, amplitude, location), a step of time in each group; 2-D smoothing.

A field is the rows (y, x, value) of one time and fits a task (`labels_of_fields` takes larger ones). Null values and cells
without a row are not valid. Of repeated cells the last one read counts, so keep
them unique. Rows with a null y or x are errors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.sources.scratch import reachable

from . import large

SAL = "time timestamp_ntz, s double, a double, l1 double, l2 double, l double, objects_model int, objects_reference int"


def row_runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column after the last) of each stretch of true cells in a row, row by row."""
    edge = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1]


def touching(row: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in neighbouring rows that touch, at corners too. Runs are sorted by row and column."""
    wide = int(after.max(initial=0)) + 2
    low = np.searchsorted(row * wide + after, (row + 1) * wide + first, "left")
    high = np.searchsorted(row * wide + first, (row + 1) * wide + after, "right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n reaches over links a-b: links join the ends' roots, then ways to the roots are cut short."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root != (up := root[root])).any():
            root = up


def label(on: np.ndarray) -> np.ndarray:
    """Connected parts of a field, diagonal neighbours too, numbered from 1 in the order of their last cells."""
    row, first, after = row_runs(on)
    root = roots(len(row), *touching(row, first, after))
    last = np.zeros(len(row), np.int64)
    np.maximum.at(last, root, row * on.shape[1] + after)
    own = np.flatnonzero(root == np.arange(len(row)))
    number = np.zeros(len(row), np.int64)
    number[own[np.argsort(last[own])]] = np.arange(1, len(own) + 1)
    step = np.zeros((on.shape[0], on.shape[1] + 1), np.int64)
    np.add.at(step, (row, first), number[root])
    np.add.at(step, (row, after), -number[root])
    return np.cumsum(step, 1)[:, :-1]


RUNS = "time timestamp_ntz, strip bigint, y bigint, first bigint, after bigint, part bigint"


def strip_runs(df: DataFrame, height: int) -> DataFrame:
    """The runs (time, strip, y, first, after, part) of true cells (time, y, x, on) of fields cut into strips of `height` rows; part: the smallest run of the strip that is connected, by its number."""

    def run(part: pa.Table) -> pa.Table:
        y, x = (part.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
        key = np.unique(y * (int(x.max()) + 3) + x) if len(x) else np.zeros(0, np.int64)
        y, x = np.divmod(key, int(x.max()) + 3)
        new = np.r_[True, key[1:] != key[:-1] + 1]
        row, first, after = y[new], x[new], x[np.r_[np.flatnonzero(new)[1:] - 1, len(x) - 1]] + 1
        own = roots(len(row), *touching(row - row[0], first, after))
        n = len(row)
        return pa.table([pa.array([part.column("time")[0].as_py()] * n, pa.timestamp("us")), pa.array([part.column("strip")[0].as_py()] * n, pa.int64()), *(pa.array(c, pa.int64()) for c in (row, first, after, own))], names=["time", "strip", "y", "first", "after", "part"])

    reachable(df.sparkSession)
    cells = df.where("on and y is not null and x is not null").select("time", F.floor(F.col("y") / height).cast("bigint").alias("strip"), F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))
    return cells.groupBy("time", "strip").applyInArrow(run, RUNS)


def labels_of_fields(df: DataFrame, height: int = 256) -> DataFrame:
    """(time, y, first, after, label): the runs of connected true cells of fields of any size, cells (time, y, x, on), numbered at each time in the order of their first cells.

    Strips of rows are labelled alone; runs on both sides of a seam that touch join
    their parts, whose components are found by joins. Null or false cells are none,
    repeated ones count once; a null time is a field of its own; y and x are not negative.
    """
    runs = large.store(strip_runs(df, height), "runs")
    # names of parts, kept in a table so that they stay
    parts = large.store(runs.groupBy("time", "strip", "part").agg(F.min(F.struct("y", "first")).alias("begin")).withColumn("node", F.monotonically_increasing_id()), "parts")
    named = runs.join(parts.withColumnsRenamed({"time": "t", "strip": "s", "part": "p"}), F.col("time").eqNullSafe(F.col("t")) & (F.col("strip") == F.col("s")) & (F.col("part") == F.col("p"))).select("time", "strip", "y", "first", "after", "node")

    def seam(part: pa.Table) -> pa.Table:
        part = part.sort_by([("y", "ascending"), ("first", "ascending")])
        y, first, after, node = (part.column(c).to_numpy() for c in ("y", "first", "after", "node"))
        a, b = touching(y - y[0], first, after)
        return pa.table([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    last, top = named.where((F.col("y") + 1) % height == 0), named.where(F.col("y") % height == 0)
    ends = last.select("time", F.col("y").alias("seam"), "y", "first", "after", "node").union(top.select("time", (F.col("y") - 1).alias("seam"), "y", "first", "after", "node"))
    edges = ends.groupBy("time", "seam").applyInArrow(seam, "a bigint, b bigint")
    found = large.components(edges)
    whole = parts.join(found.withColumnsRenamed({"id": "i"}), F.col("node") == F.col("i"), "left").select("node", "time", "begin", F.coalesce("component", "node").alias("component"))
    first = whole.groupBy("time", "component").agg(F.min("begin").alias("begin"))
    numbers = first.withColumn("label", F.row_number().over(Window.partitionBy("time").orderBy("begin")))  # a row for each object of a field
    label_of = whole.select("node", "component").join(numbers.select("component", "label"), "component").select("node", "label")
    return named.join(label_of, "node").select("time", "y", "first", "after", "label")


def bound_of(field: np.ndarray, how: str, value: float) -> float:
    """What objects exceed: an absolute value (S), a fraction of the maximum (F) or a percentile (P)."""
    if how not in ("S", "F", "P"):
        raise ValueError(f"unknown kind of bound {how!r}")
    return value if how == "S" else value * np.nanmax(field) if how == "F" else np.nanpercentile(field, value)


def labelled(field: np.ndarray, how: str, value: float, least: int = 1, most: int | None = None) -> np.ndarray:
    """The objects of a field, numbered from 1, of `least` to `most` cells."""
    names = label(np.nan_to_num(field, nan=-np.inf) > bound_of(field, how, value))
    sizes = np.bincount(names.ravel())
    kept = [k for k in range(1, len(sizes)) if sizes[k] >= least and (most is None or sizes[k] <= most)]
    new = np.zeros(len(sizes), np.int64)
    new[kept] = np.arange(1, len(kept) + 1)
    return new[names]


def members(names: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The cells (y, x) of each object from 1 on, by one pass over the field."""
    y, x = np.nonzero(names)
    of = names[y, x]
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=int(names.max(initial=0)) + 1)[1:])
    return list(zip(np.split(y[order], ends[:-1]), np.split(x[order], ends[:-1]))) if len(of) else []


def properties(field: np.ndarray, names: np.ndarray, sea: np.ndarray | None = None) -> list[dict]:
    """Each object's centre (of its cells), size, sums, axes (of the ellipse with its second moments), part of its bounding box, and kind: sea 0, land 1, coast 2."""
    out = []
    for k, (y, x) in enumerate(members(names), 1):
        v = field[y, x]
        spread = np.sort(np.linalg.eigvalsh(np.cov(np.stack([y, x]), bias=True))) if len(y) > 1 else np.zeros(2)
        wet = float(sea[y, x].mean()) if sea is not None else None
        out.append({
            "label": k, "centre_y": float(y.mean()), "centre_x": float(x.mean()), "size": len(y), "total": float(v.sum()), "most": float(v.max()), "ratio": float(v.max() / v.mean()) if v.mean() else None,
            "major_axis": float(4 * np.sqrt(max(spread[1], 0))), "minor_axis": float(4 * np.sqrt(max(spread[0], 0))), "extent": len(y) / float((np.ptp(y) + 1) * (np.ptp(x) + 1)),
            "kind": None if wet is None else 0 if wet >= 0.9 else 1 if wet <= 0.1 else 2,
        })
    return out


def _centre(field: np.ndarray, y: np.ndarray, x: np.ndarray) -> float:
    """How far from the first cell the centre of mass of some cells is."""
    v = field[y, x]
    return float(np.hypot((y * v).sum(), (x * v).sum()) / v.sum())


def farthest(valid: np.ndarray) -> float:
    """The longest distance on the first contour of the valid cells, in whole cells; the field's diagonal where all are valid.

    A contour crosses each pair of neighbours of which one is valid, and is taken
    at the first cell of the pair. Squares of four cells join crossings to contours.
    """
    cross = {(y, x, 0): (y, x) for y, x in np.argwhere(valid[:, 1:] != valid[:, :-1]).tolist()} | {(y, x, 1): (y, x) for y, x in np.argwhere(valid[1:] != valid[:-1]).tolist()}
    joined: dict[tuple, list[tuple]] = {}
    first = None
    for y, x in sorted({(y - dy, x - dx) for y, x, way in cross for dy, dx in (((0, 0), (1, 0)) if way == 0 else ((0, 0), (0, 1)))}):
        if not (0 <= y < valid.shape[0] - 1 and 0 <= x < valid.shape[1] - 1):
            continue
        top, bottom, left, right = (y, x, 0), (y + 1, x, 0), (y, x, 1), (y, x + 1, 1)
        met = [e for e in (top, bottom, left, right) if e in cross]
        pairs = [met] if len(met) == 2 else [(top, left), (bottom, right)] if valid[y, x] else [(top, right), (bottom, left)]
        for a, b in pairs:
            first = first or a
            joined.setdefault(a, []).append(b)
            joined.setdefault(b, []).append(a)
    if first is None:
        return float(np.hypot(*valid.shape))
    seen, open_ = {first}, [first]
    while open_:
        for e in joined[open_.pop()]:
            if e not in seen:
                seen.add(e)
                open_.append(e)
    points = sorted({cross[e] for e in seen})

    def half(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    hull = np.array(half(points) + half(points[::-1]), float)
    return float(np.hypot(*(hull[:, None] - hull[None]).transpose(2, 0, 1)).max())


def _fields(part: pd.DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    y, x = part.y - part.y.min(), part.x - part.x.min()
    out = []
    for c in columns:
        f = np.full((int(y.max()) + 1, int(x.max()) + 1), np.nan)
        f[y, x] = part[c].to_numpy(float)
        out.append(f)
    return out


def _together(model: DataFrame, reference: DataFrame, sea: DataFrame | None) -> DataFrame:
    reachable(model.sparkSession)
    both = model.select("time", "y", "x", F.col("value").alias("m")).join(reference.select("time", "y", "x", F.col("value").alias("r")), ["time", "y", "x"])
    if sea is None:
        return both.withColumn("sea", F.lit(None).cast("boolean"))
    return both.join(sea.select("y", "x", "sea"), ["y", "x"], "left")


def sal(model: DataFrame, reference: DataFrame, how: str = "F", value: float = 1 / 15, least: int = 1, most: int | None = None) -> DataFrame:
    """SAL of two series of fields (time, y, x, value), a row for each time where both have objects.

    S compares the objects' volumes over their maxima, A the means of the fields.
    L1 takes the distances of both centres of mass from the first cell, over the
    longest distance of the field (`farthest`, of the model's valid cells); L2
    twice the difference of how far objects are from the centre, in such distances;
    both are null where that distance is 0.
    Null values are not valid and in no object. Times are independent: a task
    holds the two fields of one time. Smooth the fields first (`smooth`) if wanted.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        fields = _fields(part, "mr")
        names = [labelled(f, how, value, least, most) if np.isfinite(f).any() else np.zeros(f.shape, int) for f in fields]
        columns = ["time", "s", "a", "l1", "l2", "l", "objects_model", "objects_reference"]
        if not all(n.any() for n in names):
            return pd.DataFrame(columns=columns)
        sides = []
        for f, n in zip(fields, names):
            objects, centre = properties(f, n), _centre(f, *np.nonzero(n))
            total = np.array([o["total"] for o in objects])
            volume = sum(o["total"] ** 2 / o["most"] for o in objects) / total.sum()
            scatter = sum(o["total"] * abs(_centre(f, *cells) - centre) for o, cells in zip(objects, members(n))) / total.sum()
            sides.append((volume, centre, scatter, len(objects), float(np.nanmean(f))))
        (vm, cm, rm, nm, am), (vr, cr, rr, nr, ar) = sides
        far = farthest(np.isfinite(fields[0])) or np.nan  # a contour of one cell has no length: no location
        l1, l2 = abs(cm - cr) / far, 2 * abs(rm - rr) / far
        return pd.DataFrame([(part.time.iloc[0], (vm - vr) / (0.5 * (vm + vr)), (am - ar) / (0.5 * (am + ar)), l1, l2, l1 + l2, nm, nr)], columns=columns)

    return _together(model, reference, None).groupBy("time").applyInPandas(run, SAL)


#: Sides by number, as files of numbers have them.
SIDES = ("model", "reference")


def sal_files(model: DataFrame, reference: DataFrame, path: str, weights: np.ndarray | None = None, sea: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """`sal` and `sal_objects` of two series of fields, smoothed first where `weights` are given, written as NetCDF to <path>/sal and <path>/objects; both tables as read back.

    Objects have their side as a number, 0 for the model and 1 for the reference.
    What stood there is replaced; without any row nothing is written, and the
    tables are empty.
    """
    from cellweave.sources import netcdf

    if weights is not None:
        model, reference = (smooth_fft(df, weights) for df in (model, reference))
    about = {"comment": "kind of objects: ocean 0, land 1, coast 2; side: model 0, reference 1"}
    whole = sal(model, reference, **options)
    side = F.array_position(F.array(*(F.lit(x) for x in SIDES)), F.col("side")) - 1
    objects = sal_objects(model, reference, sea=sea, **options).withColumn("side", side)
    return tuple(netcdf.replaced_rows(df, f"{path}/{name}", about) for df, name in ((whole, "sal"), (objects, "objects")))


OBJECTS = "time timestamp_ntz, side string, label int, centre_y double, centre_x double, size bigint, total double, most double, ratio double, major_axis double, minor_axis double, extent double, kind int"


def sal_objects(model: DataFrame, reference: DataFrame, how: str = "F", value: float = 1 / 15, least: int = 1, most: int | None = None, sea: DataFrame | None = None) -> DataFrame:
    """The objects that `sal` compares: a row for each time, side (model, reference) and object. sea: (y, x, sea) tells what kind they are."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        known = part.sea.notna().all()
        m, r, water = _fields(part.assign(sea=part.sea.astype(float) if known else 0.0), ("m", "r", "sea"))
        rows = []
        if np.isfinite(m).any() and np.isfinite(r).any():
            names = [labelled(f, how, value, least, most) for f in (m, r)]
            if all(n.any() for n in names):
                rows = [{"time": part.time.iloc[0], "side": side} | o for side, f, n in zip(("model", "reference"), (m, r), names) for o in properties(f, n, water if known else None)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OBJECTS.split(", ")])

    return _together(model, reference, sea).groupBy("time").applyInPandas(run, OBJECTS)


def convolved(field: np.ndarray, weights: np.ndarray, fill: float = 0.0, wrap: bool = False, interpolate: bool = False, ignore_edges: bool = False, least_weight: float = 0.0) -> np.ndarray:
    """A field convolved with centred weights by Fourier transforms, of the field's size.

    Beyond the borders stands `fill`, or the field again (wrap). Missing values are
    0, or (interpolate) left out and made up for by the weights of the others;
    ignore_edges does so for what is beyond the borders. Places with less than
    `least_weight` of all weight are missing; those without any are 0.
    """
    weights = np.nan_to_num(weights.astype(float))
    missing = ~np.isfinite(field)
    h, w = weights.shape[0] // 2, weights.shape[1] // 2
    shape = field.shape if wrap else tuple(a + b - 1 for a, b in zip(field.shape, weights.shape))
    if wrap and any(b > a for a, b in zip(field.shape, weights.shape)):
        raise ValueError("weights that wrap are no larger than the field")
    kernel = np.fft.rfft2(weights, shape)

    def apply(x: np.ndarray, beyond: float) -> np.ndarray:
        out = np.fft.irfft2(np.fft.rfft2(x - (0 if wrap else beyond), shape) * kernel, shape)
        if wrap:
            return np.roll(out, (-h, -w), (0, 1))
        return out[h : h + x.shape[0], w : w + x.shape[1]] + beyond * weights.sum()

    out = apply(np.where(missing, 0.0, field), fill)
    if interpolate or ignore_edges:
        share = np.maximum(apply(1.0 - missing * interpolate, 0.0 if ignore_edges else 1.0) / weights.sum(), 0)
        share[share < 1e-12] = 0
        with np.errstate(all="ignore"):
            out = out / share
        out[share < least_weight] = np.nan
        if least_weight == 0:
            out[share == 0] = 0
    return out


def smooth_fft(df: DataFrame, weights: np.ndarray, **options) -> DataFrame:
    """`convolved` of the field of each time (time, y, x, value): for weights of many cells. A task holds one time's field; cells without a row are missing."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = convolved(_fields(part, ("value",))[0], weights, **options)
        return part[["time", "y", "x"]].assign(value=found[part.y - part.y.min(), part.x - part.x.min()])

    v = F.col("value")
    return df.select("time", F.col("y").cast("int"), F.col("x").cast("int"), F.col("value").cast("double")).groupBy("time").applyInPandas(run, "time timestamp_ntz, y int, x int, value double").withColumn("value", F.when(~F.isnan(v), v))


def amplitude(model: DataFrame, reference: DataFrame) -> DataFrame:
    """The A part alone, by means: no Python."""
    m = model.groupBy("time").agg(F.avg("value").alias("m"))
    r = reference.groupBy("time").agg(F.avg("value").alias("r"))
    return m.join(r, "time").select("time", ((F.col("m") - F.col("r")) / F.nullif((F.col("m") + F.col("r")) / 2, F.lit(0.0))).alias("a"))


def kernel(n: int, shape: str = "square", how: str = "mean") -> np.ndarray:
    """Weights of n x n cells; a disk's are 1 / n² inside."""
    k = np.ones((n, n))
    if shape == "disk":
        y, x = np.indices((n, n)) - n // 2
        k = (x * x + y * y <= (n // 2) ** 2).astype(float)
    return k / n**2 if how == "mean" else k


def smooth(df: DataFrame, weights: np.ndarray, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Weighted sums around each cell (y, x) of a field, mirrored at its borders, as a join on shifted cells."""
    h, w = weights.shape[0] // 2, weights.shape[1] // 2
    offsets = F.array(*(F.struct(F.lit(j - h).alias("dy"), F.lit(i - w).alias("dx"), F.lit(float(weights[j, i])).alias("k")) for j in range(weights.shape[0]) for i in range(weights.shape[1]) if weights[j, i]))
    mirror = lambda c, n: F.when(c < 0, -c - 1).when(c >= n, 2 * n - 1 - c).otherwise(c)
    asked = df.select(*keys, "y", "x").withColumn("o", F.explode(offsets)).select(*keys, "y", "x", mirror(F.col("y") + F.col("o.dy"), height).alias("_y"), mirror(F.col("x") + F.col("o.dx"), width).alias("_x"), F.col("o.k").alias("_k"))
    values = df.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("value").alias("_v"))
    return asked.join(values, [*keys, "_y", "_x"]).groupBy(*keys, "y", "x").agg(F.sum(F.col("_k") * F.col("_v")).alias("value"))
