"""Weights between grids of which at least one has lines that aren't those of longitude and latitude.

Grids are tables of cells (cell_id, y, x, lon, lat), y and x from 0. Cells meet in
tiles, so all joins are equi-joins. Cells without coordinates have no weights, and
quadrilaterals or cells with such a corner don't exist. Repeated cells count each.
Empty grids give no weights. Cells that the other grid doesn't reach have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.sources.scratch import reachable, store

from . import grid as grids

#: How far outside, in parts of a quadrilateral, a point may lie by rounding; the least part of a cell that is an overlap.
EDGE, LEAST = 1e-9, 1e-12
STEPS = 30
#: Quadrilaterals of a cube of space that are tried at once.
TRIED = 64


def is_rectilinear(grid: DataFrame) -> bool:
    """Whether each column has one longitude and each row one latitude."""
    for c, line in (("lon", "x"), ("lat", "y")):
        if grid.where(F.col(c).isNotNull()).groupBy(line).agg((F.max(c) - F.min(c)).alias("d")).where("d > 1e-9").limit(1).count():
            return False
    return True


def weights(source: DataFrame, target: DataFrame, method: str) -> DataFrame:
    """(target_cell, source_cell, w) of a method, by the way that the grids' lines ask for."""
    if method == "bilinear":
        return grids.bilinear_weights(source, target) if is_rectilinear(source) and is_rectilinear(target) else bilinear_weights(source, target)
    if method == "conservative":
        if is_rectilinear(source) and is_rectilinear(target):
            return grids.conservative_weights(grids.corners(source), grids.corners(target), of="target")
        return conservative_weights(source, target)
    raise ValueError(f"unknown regrid method {method!r}")


# bilinear


def quadrilaterals(grid: DataFrame) -> DataFrame:
    """(y, x, corners): four centres that are neighbours, in the order (y, x), (y, x + 1), (y + 1, x), (y + 1, x + 1); each with cell_id, lon, lat."""
    cells = grid.where("lon is not null and lat is not null")
    near = cells.select(F.explode(F.array(*(F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(2 * dy + dx).alias("k")) for dy in (0, 1) for dx in (0, 1)))).alias("q"), "cell_id", "lon", "lat")
    corner = F.struct(F.col("q.k").alias("k"), "cell_id", "lon", "lat")
    return near.groupBy("q.y", "q.x").agg(F.array_sort(F.collect_list(corner)).alias("corners")).where((F.size("corners") == 4) & (F.get("corners", 0)["k"] == 0) & (F.get("corners", 1)["k"] == 1) & (F.get("corners", 2)["k"] == 2))


def bilinear_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """(target_cell, source_cell, w): the four source centres around each target centre, by the bilinear map of their quadrilateral, which is inverted by Newton's method.

    The map is one of degrees, so fields that are linear in longitude and latitude
    come out exactly; longitudes count from the quadrilateral's first, so it may
    cross the date line. One that holds a pole has no such map and gives no
    weights. Of several that a centre lies on, that with the smallest y and x.
    """
    reachable(source.sparkSession)
    lon = lambda c: F.col("corners")[0]["lon"] + grids.wrap_longitude(c - F.col("corners")[0]["lon"])
    q = quadrilaterals(source)
    xs, ys = F.array(*(lon(F.col("corners")[k]["lon"]) for k in range(4))), F.array(*(F.col("corners")[k]["lat"] for k in range(4)))
    q = q.select("y", "x", F.array(*(F.col("corners")[k]["cell_id"] for k in range(4))).alias("ids"), xs.alias("xs"), ys.alias("ys"))
    q = q.withColumns({"x0": F.array_min("xs"), "x1": F.array_max("xs"), "y0": F.array_min("ys"), "y1": F.array_max("ys")}).where("x1 - x0 < 180")
    wide, high = q.agg(F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0"))).first()
    columns = max(1, int(360 / max(2 * (wide or 0), 1e-3)))
    step, rise = 360 / columns, max(2 * (high or 0), 1e-3)
    column = lambda c: F.floor((c + 180) / step).cast("bigint")
    tiles = F.explode(F.sequence(column(F.col("x0")), column(F.col("x1"))))
    q = q.withColumn("_c", tiles).withColumn("_c", F.pmod("_c", F.lit(columns))).withColumn("_r", F.explode(F.sequence(F.floor(F.col("y0") / rise).cast("bigint"), F.floor(F.col("y1") / rise).cast("bigint"))))
    t = target.where("lon is not null and lat is not null").select(F.col("cell_id").alias("target_cell"), grids.wrap_longitude(F.col("lon")).alias("lon"), "lat")
    t = t.withColumn("_c", F.pmod(column(F.col("lon")), F.lit(columns))).withColumn("_r", F.floor(F.col("lat") / rise).cast("bigint"))
    at = F.col("xs")[0] + grids.wrap_longitude(F.col("lon") - F.col("xs")[0])
    met = t.join(q, ["_c", "_r"]).withColumn("px", at)
    slack = 1e-6
    met = met.where(F.col("px").between(F.col("x0") - slack, F.col("x1") + slack) & F.col("lat").between(F.col("y0") - slack, F.col("y1") + slack)).select("target_cell", "y", "x", "ids", "xs", "ys", "px", "lat")
    found = met.mapInArrow(_inverted, "target_cell bigint, y int, x int, ids array<bigint>, w array<double>")
    return _first(found)


def _first(found: DataFrame) -> DataFrame:
    """Weights of the quadrilateral with the smallest y and x."""
    best = found.groupBy("target_cell").agg(F.min(F.struct("y", "x", "ids", "w")).alias("b"))
    return best.select("target_cell", F.explode(F.arrays_zip("b.ids", "b.w")).alias("e")).select("target_cell", F.col("e.ids").alias("source_cell"), F.col("e.w").alias("w")).where("w > 0")


def bilinear_weights_in_space(source: DataFrame, target: DataFrame) -> DataFrame:
    """Like `bilinear_weights`, by the bilinear map of the corners' points in space, as seen from the sphere's middle: neither the date line nor a pole is special.

    The weighted mean of the corners' points lies in the direction of the target,
    so points on the sphere come out exactly. Quadrilaterals and targets meet in
    cubes of space, by a shuffle. There quadrilaterals are tried in order of y and
    x until one holds the target, so those of a grid that goes around the sphere
    many times aren't all tried.
    """
    reachable(source.sparkSession)
    q = store(quadrilaterals(source).mapInArrow(_placed, "y int, x int, ids array<bigint>, points array<double>, r double"), "quadrilaterals")
    side = max(4 * (q.agg(F.max("r")).first()[0] or 0.0), 1e-9)
    cube = lambda v: F.floor(v / side).cast("bigint")
    slack = F.col("r") * F.col("r") + 1e-12
    for i in range(3):
        along = F.array(*(F.get("points", F.lit(3 * k + i)) for k in range(4)))
        q = q.withColumn(f"_{i}", F.explode(F.sequence(cube(F.array_min(along) - slack), cube(F.array_max(along) + slack))))
    a, b = F.radians("lon"), F.radians("lat")
    t = target.where("lon is not null and lat is not null").select(F.col("cell_id").alias("target_cell"), F.array(F.cos(a) * F.cos(b), F.sin(a) * F.cos(b), F.sin(b)).alias("t"))
    t = t.select("*", *(cube(F.col("t")[i]).alias(f"_{i}") for i in range(3)))
    cubes = ["_0", "_1", "_2"]
    return _first(q.groupBy(*cubes).cogroup(t.groupBy(*cubes)).applyInArrow(_held, "target_cell bigint, y int, x int, ids array<bigint>, w array<double>"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quadrilaterals with their corners' points in space and the radius of a ball that holds the part of the sphere between them."""
    for batch in batches:
        corners = batch.column("corners").flatten()
        lon, lat = (np.radians(corners.field(c).to_numpy(zero_copy_only=False)) for c in ("lon", "lat"))
        points = np.stack([np.cos(lon) * np.cos(lat), np.sin(lon) * np.cos(lat), np.sin(lat)], 1).reshape(-1, 4, 3)
        # the sphere is farther out than the corners' flat middle by less than the square of the radius
        r = np.sqrt(((points - points.mean(1)[:, None]) ** 2).sum(2).max(1))
        r = r + r * r + 1e-12
        keep = r < 1
        n = int(keep.sum())
        lists = lambda width, values: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), values)  # noqa: B023, E731
        ids = corners.field("cell_id").cast(pa.int64()).filter(pa.array(np.repeat(keep, 4)))
        part = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([part.column("y").cast(pa.int32()), part.column("x").cast(pa.int32()), lists(4, ids), lists(12, pa.array(points[keep].ravel())), pa.array(r[keep])], names=["y", "x", "ids", "points", "r"])


def _held(q: pa.Table, t: pa.Table) -> pa.Table:
    """Targets of a cube of space with the first of its quadrilaterals, by y and x, that holds them, and the corners' weights."""
    schema = pa.schema({"target_cell": pa.int64(), "y": pa.int32(), "x": pa.int32(), "ids": pa.list_(pa.int64()), "w": pa.list_(pa.float64())})
    if not len(q) or not len(t):
        return schema.empty_table()
    q = q.sort_by([("y", "ascending"), ("x", "ascending")])
    points, p = _matrix(q["points"].combine_chunks(), 12).reshape(-1, 4, 3), _matrix(t["t"].combine_chunks(), 3)
    middle, r = points.mean(1), q["r"].to_numpy()
    slack = (r * r + 1e-12)[:, None]
    low, high = points.min(1) - slack, points.max(1) + slack
    e1 = np.where(np.abs(p[:, :1]) < 0.6, np.cross(p, [1.0, 0.0, 0.0]), np.cross(p, [0.0, 1.0, 0.0]))
    e2 = np.cross(p, e1)
    left, found = np.arange(len(p)), []
    for start in range(0, len(q), TRIED):
        # in each direction no farther than the corners, and within the ball
        near = np.ones((len(left), min(TRIED, len(q) - start)), bool)
        for k in range(3):
            c = p[left, k][:, None]
            near &= (c >= low[start : start + TRIED, k]) & (c <= high[start : start + TRIED, k])
        i, j = np.nonzero(near)
        i, j = left[i], j + start
        ball = ((p[i] - middle[j]) ** 2).sum(1) <= r[j] * r[j]
        i, j = i[ball], j[ball]
        xs, ys = (np.einsum("nkc,nc->nk", points[j], e[i]) for e in (e1, e2))
        inside, w = _corner_weights(*inverse_bilinear(xs, ys, np.zeros(len(i)), np.zeros(len(i))))
        i, first = np.unique(i[inside], return_index=True)
        found.append((i, j[inside][first], w[first]))
        left = np.setdiff1d(left, i, assume_unique=True)
        if not len(left):
            break
    i, j, w = (np.concatenate(c) for c in zip(*found))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * 4, pa.int32()), pa.array(w.ravel()))
    return pa.Table.from_arrays([t["target_cell"].take(pa.array(i)).cast(pa.int64()), *(q[c].take(pa.array(j)) for c in ("y", "x", "ids")), lists], names=schema.names).cast(schema)


def _corner_weights(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which points are inside their quadrilaterals, and the corners' weights of those."""
    inside = (u >= -EDGE) & (u <= 1 + EDGE) & (v >= -EDGE) & (v <= 1 + EDGE)
    u, v = np.clip(u[inside], 0, 1), np.clip(v[inside], 0, 1)
    return inside, np.stack([(1 - u) * (1 - v), u * (1 - v), (1 - u) * v, u * v], 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of points and quadrilaterals, those where the point is inside, with the corners' weights."""
    for batch in batches:
        px, py = batch.column("px").to_numpy(), batch.column("lat").to_numpy()
        u, v = inverse_bilinear(_matrix(batch.column("xs"), 4), _matrix(batch.column("ys"), 4), px, py)
        inside, w = _corner_weights(u, v)
        part = batch.filter(pa.array(inside))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * 4, pa.int32()), pa.array(w.ravel()))
        yield pa.RecordBatch.from_arrays([part.column("target_cell"), part.column("y").cast(pa.int32()), part.column("x").cast(pa.int32()), part.column("ids"), lists], names=["target_cell", "y", "x", "ids", "w"])


def inverse_bilinear(xs: np.ndarray, ys: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) with the point at (1-u)(1-v) c0 + u(1-v) c1 + (1-u)v c2 + uv c3, for rows of corners; NaN where the steps don't settle."""
    u, v = np.full(len(px), 0.5), np.full(len(px), 0.5)
    ax, bx, cx = xs[:, 1] - xs[:, 0], xs[:, 2] - xs[:, 0], xs[:, 3] - xs[:, 2] - xs[:, 1] + xs[:, 0]
    ay, by, cy = ys[:, 1] - ys[:, 0], ys[:, 2] - ys[:, 0], ys[:, 3] - ys[:, 2] - ys[:, 1] + ys[:, 0]
    dx, dy = px - xs[:, 0], py - ys[:, 0]
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            fx, fy = ax * u + bx * v + cx * u * v - dx, ay * u + by * v + cy * u * v - dy
            j00, j01, j10, j11 = ax + cx * v, bx + cx * u, ay + cy * v, by + cy * u
            det = j00 * j11 - j01 * j10
            u, v = u - (fx * j11 - fy * j01) / det, v - (fy * j00 - fx * j10) / det
        fx, fy = ax * u + bx * v + cx * u * v - dx, ay * u + by * v + cy * u * v - dy
        size = np.abs(ax) + np.abs(bx) + np.abs(ay) + np.abs(by)
        good = np.abs(fx) + np.abs(fy) <= 1e-9 * size
    return np.where(good, u, np.nan), np.where(good, v, np.nan)


# conservative, on the sphere


def sphere_rings(grid: DataFrame) -> DataFrame:
    """(cell_id, ring): the corners of each cell as points (x, y, z) of the unit sphere, in order around it.

    Of a rectilinear grid they are the bounds half way to the next lines. Else a
    corner is the mean of the four centres around, carried on at the border as
    `grid.vertices` does, but of points in space, so neither the date line nor a
    pole is special.
    """
    a, b = F.radians("lon"), F.radians("lat")
    point = lambda a, b: (F.cos(a) * F.cos(b), F.sin(a) * F.cos(b), F.sin(b))
    if is_rectilinear(grid):
        pole = lambda c: F.radians(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col(c))))
        around = [("lon_lo", "lat_lo"), ("lon_hi", "lat_lo"), ("lon_hi", "lat_hi"), ("lon_lo", "lat_hi")]
        ring = F.array(*(c for x, y in around for c in point(F.radians(x), pole(y))))
        return grids.corners(grid.where("lon is not null and lat is not null")).select("cell_id", ring.alias("ring"))
    cells = grid.where("lon is not null and lat is not null")
    x, y, z = point(a, b)
    v = grids.vertices(cells.select("y", "x", x.alias("px"), y.alias("py"), z.alias("pz")), ("px", "py", "pz"))
    size = F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz"))
    places = F.array(*(F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(k).alias("k")) for k, (dy, dx) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))))
    given = v.select(F.explode(places).alias("c"), *((F.col(p) / size).alias(p) for p in ("px", "py", "pz")))
    rings = given.groupBy("c.y", "c.x").agg(F.array_sort(F.collect_list(F.struct("c.k", F.array("px", "py", "pz").alias("p")))).alias("r")).where("size(r) = 4")
    # a row for each cell, which a file of keys makes look like few
    return cells.select("cell_id", "y", "x").join(rings.hint("merge"), ["y", "x"]).select("cell_id", F.flatten(F.transform("r", lambda p: p["p"])).alias("ring"))


def conservative_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """(target_cell, source_cell, w): the area of the overlap, bounded by great circles, over the target cell's area; w of all sources adds up to the part of the target that is covered.

    Cells meet where the balls around them do: each target is in all cubes of
    space that its ball, widened by the largest of the sources, reaches (eight at
    most), each source in that of its middle.
    """

    def balls(grid: DataFrame, name: str) -> DataFrame:
        # `get`: conditions on the join's keys may be asked of rings that have too few corners, before those are left out
        middle = [sum((F.get("ring", 3 * k + i) for k in range(4)), F.lit(0.0)) / 4 for i in range(3)]
        cells = sphere_rings(grid).select(F.col("cell_id").alias(name), "ring", F.array(*middle).alias("m"))
        square = lambda k: sum(((F.get("ring", 3 * k + i) - F.col("m")[i]) * (F.get("ring", 3 * k + i) - F.col("m")[i]) for i in range(3)), F.lit(0.0))
        return cells.withColumn("r", F.sqrt(F.greatest(*(square(k) for k in range(4)))))

    reachable(source.sparkSession)
    s, t = (store(balls(df, name), "cells") for df, name in ((source, "source_cell"), (target, "target_cell")))
    rs, rt = (df.agg(F.max("r")).first()[0] or 0.0 for df in (s, t))
    side = max(2 * (rs + rt), 1e-9)
    cube = lambda c: F.floor(c / side).cast("bigint")
    s = s.select("source_cell", F.col("ring").alias("s"), F.col("m").alias("ms"), F.col("r").alias("rs"), *(cube(F.col("m")[i]).alias(f"_{i}") for i in range(3)))
    for i in range(3):
        t = t.withColumn(f"_{i}", F.explode(F.sequence(cube(F.col("m")[i] - F.col("r") - rs), cube(F.col("m")[i] + F.col("r") + rs))))
    apart = F.sqrt(sum(((F.col("m")[i] - F.col("ms")[i]) * (F.col("m")[i] - F.col("ms")[i]) for i in range(3)), F.lit(0.0)))
    met = s.join(t, ["_0", "_1", "_2"]).where(apart <= F.col("r") + F.col("rs") + 1e-12).select("target_cell", "source_cell", "s", F.col("ring").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), 12).reshape(-1, 4, 3) for c in ("s", "t"))
            whole = np.abs(sphere_area(b, np.full(len(b), 4)))
            with np.errstate(all="ignore"):
                w = sphere_overlap(a, b) / whole
            keep = w > LEAST
            part = batch.select(["target_cell", "source_cell"]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(w[keep])], names=["target_cell", "source_cell", "w"])

    return met.mapInArrow(run, "target_cell bigint, source_cell bigint, w double")


def sphere_area(rings: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Areas of rows of polygons on the unit sphere, of `sizes` corners each; negative where the corners run clockwise, seen from outside."""
    out = np.zeros(len(rings))
    a = rings[:, 0]
    for k in range(1, rings.shape[1] - 1):
        b, c = rings[:, k], rings[:, k + 1]
        dot = lambda p, q: np.einsum("ij,ij->i", p, q)
        part = 2 * np.arctan2(dot(a, np.cross(b, c)), 1 + dot(a, b) + dot(b, c) + dot(c, a))
        out += np.where(k + 1 < sizes, part, 0)
    return out


def sphere_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The area that rows of convex polygons have in common: the first is cut at the great circle of each side of the second."""
    n = len(b)
    turn = np.where(sphere_area(b, np.full(n, b.shape[1])) < 0, -1.0, 1.0)
    ring, size = a, np.full(n, a.shape[1])
    for k in range(b.shape[1]):
        normal = np.cross(b[:, k], b[:, (k + 1) % b.shape[1]]) * turn[:, None]
        m = ring.shape[1]
        real = np.arange(m) < size[:, None]
        side = np.einsum("ikj,ij->ik", ring, normal)
        nxt = np.where(np.arange(m) + 1 < size[:, None], np.arange(m) + 1, 0)
        after, side_after = np.take_along_axis(ring, nxt[:, :, None], 1), np.take_along_axis(side, nxt, 1)
        cross = real & (side * side_after < 0)
        with np.errstate(all="ignore"):
            f = np.where(cross, side / (side - side_after), 0)
        point = ring + f[:, :, None] * (after - ring)
        point /= np.maximum(np.sqrt((point * point).sum(2)), 1e-300)[:, :, None]
        # corners that stay, and after each the point where its side is cut
        both = np.stack([ring, point], 2).reshape(n, 2 * m, 3)
        kept = np.stack([real & (side >= 0), cross], 2).reshape(n, 2 * m)
        order = np.argsort(~kept, 1, kind="stable")[:, : m + 1]
        ring, size = np.take_along_axis(both, order[:, :, None], 1), kept.sum(1)
    return np.where(size > 2, np.abs(sphere_area(ring, size)), 0.0)
