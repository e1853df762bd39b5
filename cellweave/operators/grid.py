"""Cells in space: coordinates, regions, nearest cells, regridding. Values stay in long series.

Null coordinates give null coordinates, and such cells are in no region, nearest to
nothing and without weights. Repeated cells count each. Empty grids give empty
tables. Lines of a grid are numbered, and grids outlined, on a row for each line.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.sources.scratch import store


def wrap_longitude(lon: Column) -> Column:
    """Into -180 to 180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def rotate(lon: Column, lat: Column, pole_lon: float, pole_lat: float, back: bool = True) -> tuple[Column, Column]:
    """Between geographic and rotated coordinates; back: from rotated ones. The pole is that of the rotated grid."""
    tilt, turn = F.radians(F.lit(90.0 - pole_lat)), F.radians(F.lit(180.0 + pole_lon))
    a = F.radians(lon) if back else F.radians(lon) - turn
    b = F.radians(lat)
    x, y, z = F.cos(a) * F.cos(b), F.sin(a) * F.cos(b), F.sin(b)
    s = -F.sin(tilt) if back else F.sin(tilt)
    c = F.cos(tilt)
    u, w = c * x + s * z, -s * x + c * z
    out = F.atan2(y, u) + (turn if back else F.lit(0.0))
    return wrap_longitude(F.degrees(out)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w))))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of struct x, y), open or closed: an odd number of sides cross the ray to its right."""
    n = F.size(ring)

    def crosses(a: Column, b: Column) -> Column:
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    count = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.coalesce(crosses(F.get(ring, i), F.get(ring, F.pmod(i + 1, n))), F.lit(False)).cast("int"))
    return count % 2 == 1


#: Degrees in a tile where cells and regions meet.
TILE = 10


def membership(grid: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, cell_id) of cell centres in each region (region, ring).

    Cells and rings meet in tiles of TILE degrees: a ring is in those of its bounding
    box, a cell in one. So it is an equi-join, however many regions there are.
    Cells without coordinates and empty rings are in no pair.
    """
    tile = lambda c: F.floor(c / TILE).cast("int")
    tiles = lambda lo, hi: F.sequence(tile(lo), tile(hi))
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    r = regions.where(F.size("ring") > 0)
    r = r.select("region", "ring", F.explode(tiles(side(F.array_min, "x"), side(F.array_max, "x"))).alias("_tx"), tiles(side(F.array_min, "y"), side(F.array_max, "y")).alias("_ys")).withColumn("_ty", F.explode("_ys")).drop("_ys")
    g = grid.select("cell_id", "lon", "lat", tile(F.col("lon")).alias("_tx"), tile(F.col("lat")).alias("_ty"))
    return g.join(r, ["_tx", "_ty"]).where(inside(F.col("lon"), F.col("lat"), F.col("ring"))).select("region", "cell_id")


def mask(df: DataFrame, cells: DataFrame, crop: bool = False, cell: str = "cell_id") -> DataFrame:
    """Values outside `cells` as missing, or (crop) without their rows; `region` names the region."""
    m = cells.withColumnRenamed("cell_id", cell)
    if crop:
        return df.join(m, cell)
    return df.join(m, cell, "left").withColumn("value", F.when(F.col("region").isNotNull(), F.col("value")))


def topo_mask(df: DataFrame, grid: DataFrame, low: float, high: float) -> DataFrame:
    """Values at heights (column orog) outside low to high as missing."""
    return df.join(grid.select("cell_id", "orog"), "cell_id", "left").withColumn("value", F.when(F.col("orog").between(low, high), F.col("value"))).drop("orog")


def nearest(points: DataFrame, grid: DataFrame) -> DataFrame:
    """The cell nearest to each point (point, lon, lat) in degrees; of equals, the one with the smallest y and x. Longitudes aren't taken around the date line.

    Points meet cells in the nine tiles around the place in the grid's extent that
    is nearest to them. A cell elsewhere is a tile's side away from that place, and
    farther still from a point outside the extent; points that haven't found one
    nearer than that go on to tiles twice as large. Points without coordinates, and
    all of an empty grid's, have no row.
    """
    g = grid.where("lon is not null and lat is not null")
    n, x0, x1, y0, y1 = g.agg(F.count("*"), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    left = points.where("lon is not null and lat is not null").select("point", F.col("lon").cast("double").alias("_x"), F.col("lat").cast("double").alias("_y"))
    found = left.select("point", F.lit(None).cast("struct<distance:double,y:int,x:int,cell_id:bigint>").alias("m")).where("false")
    side = max(2 * math.sqrt((x1 - x0) * (y1 - y0) / n), 2 * (x1 - x0) / n, 2 * (y1 - y0) / n, 1e-9) if n else 0.0
    while n and left.limit(1).count():
        tile = lambda c, start: F.floor((c - start) / side).cast("bigint")  # noqa: B023, E731
        within = [F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c))) for c, lo, hi in (("_x", x0, x1), ("_y", y0, y1))]
        away = (F.col("_x") - within[0]) * (F.col("_x") - within[0]) + (F.col("_y") - within[1]) * (F.col("_y") - within[1])
        around = F.array(*(F.struct((tile(within[0], x0) + i).alias("_tx"), (tile(within[1], y0) + j).alias("_ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        asked = left.select("point", "_x", "_y", away.alias("_away"), F.explode(around).alias("_t")).select("point", "_x", "_y", "_away", "_t.*")
        cells = g.select("lon", "lat", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("cell_id").cast("bigint").alias("cell_id"), tile(F.col("lon"), x0).alias("_tx"), tile(F.col("lat"), y0).alias("_ty"))
        d = F.sqrt((F.col("lon") - F.col("_x")) * (F.col("lon") - F.col("_x")) + (F.col("lat") - F.col("_y")) * (F.col("lat") - F.col("_y")))
        best = asked.join(cells, ["_tx", "_ty"], "left").groupBy("point", "_x", "_y", "_away").agg(F.min(F.when(F.col("cell_id").isNotNull(), F.struct(d.alias("distance"), "y", "x", "cell_id"))).alias("m"))
        whole = side > x1 - x0 and side > y1 - y0  # nothing lies outside the tiles
        sure = F.lit(True) if whole else F.coalesce(F.col("m.distance") * F.col("m.distance") < (F.col("_away") + side * side) * (1 - 1e-12), F.lit(False))
        best = store(best.withColumn("_sure", sure), "nearest")
        found = found.unionByName(best.where("_sure").select("point", "m"))
        left, side = best.where("not _sure").select("point", "_x", "_y"), 2 * side
    return found.groupBy("point").agg(F.min("m").alias("m")).select("point", "m.cell_id", "m.distance")


def corners(grid: DataFrame) -> DataFrame:
    """Bounds of the cells of a rectilinear grid: half way to each neighbour, as far again at the border."""
    for c, name in (("lon", "x"), ("lat", "y")):
        line = grid.select(name, c).distinct()
        w = Window.orderBy(name)  # one row for each row or column of the grid
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        line = line.select(name, ((F.col(c) + F.coalesce(before, 2 * F.col(c) - after)) / 2).alias(f"{c}_a"), ((F.col(c) + F.coalesce(after, 2 * F.col(c) - before)) / 2).alias(f"{c}_b"))
        line = line.select(name, F.least(f"{c}_a", f"{c}_b").alias(f"{c}_lo"), F.greatest(f"{c}_a", f"{c}_b").alias(f"{c}_hi"))
        grid = grid.join(line, name)
    return grid


def conservative_weights(source: DataFrame, target: DataFrame, of: str = "source") -> DataFrame:
    """(target_cell, source_cell, w) between rectilinear grids with bounds: the overlap on the sphere over the area of the source's cell, or (of="target") the target's, by which totals are kept.

    Bounds beyond a pole end at it; a cell without an area has no weights.

    Overlaps of columns and of rows are found apart and then joined, so no pair of
    cells without an overlap arises.
    """

    def along(c: str, name: str, size) -> DataFrame:
        s = source.select(F.col(name).alias(f"s{name}"), F.col(f"{c}_lo").alias("sl"), F.col(f"{c}_hi").alias("sh")).distinct()
        t = target.select(F.col(name).alias(f"t{name}"), F.col(f"{c}_lo").alias("tl"), F.col(f"{c}_hi").alias("th")).distinct()
        over = s.join(t, (F.col("sl") < F.col("th")) & (F.col("tl") < F.col("sh")))
        whole = size(F.col("sl"), F.col("sh")) if of == "source" else size(F.col("tl"), F.col("th"))
        share = size(F.greatest("sl", "tl"), F.least("sh", "th")) / F.nullif(whole, F.lit(0.0))
        return over.select(f"s{name}", f"t{name}", share.alias(f"w{name}")).where(f"w{name} > 0")

    columns = along("lon", "x", lambda a, b: b - a)
    pole = lambda c: F.radians(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), c)))
    rows = along("lat", "y", lambda a, b: F.sin(pole(b)) - F.sin(pole(a)))
    s = source.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("cell_id").alias("source_cell"))
    t = target.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("cell_id").alias("target_cell"))
    return s.join(columns, "sx").join(rows, "sy").join(t, ["tx", "ty"]).select("target_cell", "source_cell", (F.col("wx") * F.col("wy")).alias("w"))


def bilinear_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """(target_cell, source_cell, w): up to four source centres of a rectilinear grid around each target centre within them."""

    def along(c: str, name: str) -> DataFrame:
        line = source.select(F.col(name).alias("i"), F.col(c).alias("a")).distinct().withColumn("b", F.lead("a").over(Window.orderBy("a"))).withColumn("j", F.lead("i").over(Window.orderBy("a")))
        last = F.col("b") == F.max("b").over(Window.partitionBy())
        line = line.where("b is not null").withColumn("last", last)
        t = target.select(F.col(name).alias(f"t{name}"), F.col(c).alias("v")).distinct()
        m = t.join(line, (F.col("v") >= F.col("a")) & ((F.col("v") < F.col("b")) | (F.col("last") & (F.col("v") == F.col("b")))))
        part = (F.col("v") - F.col("a")) / (F.col("b") - F.col("a"))
        both = F.explode(F.array(F.struct(F.col("i").alias("s"), (1 - part).alias("w")), F.struct(F.col("j").alias("s"), part.alias("w"))))
        return m.select(f"t{name}", both.alias("e")).select(f"t{name}", F.col("e.s").alias(f"s{name}"), F.col("e.w").alias(f"w{name}")).where(f"w{name} > 0")

    s = source.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("cell_id").alias("source_cell"))
    t = target.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("cell_id").alias("target_cell"))
    return t.join(along("lon", "x"), "tx").join(along("lat", "y"), "ty").join(s, ["sx", "sy"]).select("target_cell", "source_cell", (F.col("wx") * F.col("wy")).alias("w"))


def regrid(df: DataFrame, weights: DataFrame, target: DataFrame, keys: Sequence[str] = ("time",)) -> DataFrame:
    """Weighted means of source values on each target cell: (cell_id, keys..., value); missing if a source value is, or where no source is.

    Each target cell has a row for each combination of keys that the series has.
    Weights are a row for each pair of cells that overlap; whether they are
    broadcast is left to Spark, which knows their size by then.
    """
    joined = df.withColumnRenamed("cell_id", "source_cell").join(weights, "source_cell")
    mean = F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0.0)))
    found = joined.groupBy("target_cell", *keys).agg(mean.alias("value")).withColumnRenamed("target_cell", "cell_id")
    bare = target.select("cell_id").join(weights.select(F.col("target_cell").alias("cell_id")), "cell_id", "left_anti")
    return found.unionByName(bare.crossJoin(df.select(*keys).distinct()).select("cell_id", *keys, F.lit(None).cast("double").alias("value")))  # the rows of the result


def choose_target(grids: dict[str, DataFrame], name: str, to: str | DataFrame | None) -> DataFrame | None:
    """The grid that data set `name` goes to: None for its own, a grid table, or the grid of another data set; a data set stays on its own."""
    if to is None or to == name if not isinstance(to, DataFrame) else False:
        return None
    if isinstance(to, DataFrame):
        return to
    if to not in grids:
        raise ValueError(f"no grid called {to!r} among {sorted(grids)}")
    return grids[to]


# grids whose lines are bent: cells (cell_id, y, x, lon, lat), y and x from 0 without gaps


def _shifted(grid: DataFrame, **by: tuple[int, int]) -> DataFrame:
    """The grid with the coordinates of cells a step away: columns <name>_lon, <name>_lat, null outside."""
    for name, (dy, dx) in by.items():
        near = grid.select((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("lon").alias(f"{name}_lon"), F.col("lat").alias(f"{name}_lat"))
        grid = grid.join(near, ["y", "x"], "left")
    return grid


def _extent(grid: DataFrame) -> tuple[int, int]:
    ny, nx = grid.agg(F.max("y") + 1, F.max("x") + 1).first()
    if ny is None or ny < 3 or nx < 3:
        raise ValueError("a bent grid has three rows and three columns at least")
    return ny, nx


def vertices(grid: DataFrame, columns: Sequence[str] = ("lon", "lat")) -> DataFrame:
    """The corners (y, x, lon, lat, or other `columns`) of a bent grid's cells, from 0 to rows and columns: the mean of the four centres around, carried on in a straight line at the border.

    Corner (y, x) is the lower left one of cell (y, x). First rows, then columns
    are carried on, so the outermost four follow from both.
    """
    ny, nx = _extent(grid)
    own = grid.select("y", "x", *columns)
    near = own.select(F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (0, 1) for dx in (0, 1)))).alias("c"), *columns)
    out = near.groupBy("c.y", "c.x").agg(*(F.avg(v).alias(v) for v in columns), F.count("*").alias("n")).where("n = 4").select("y", "x", *columns)
    for c, other, last in (("y", "x", ny), ("x", "y", nx)):
        edge = lambda to, one, two: out.where(F.col(c).isin(one, two)).groupBy(other).agg(*(F.max(F.when(F.col(c) == one, 2 * F.col(v))) + F.max(F.when(F.col(c) == two, -F.col(v))) for v in columns)).toDF(other, *columns).withColumn(c, F.lit(to).cast("int")).select("y", "x", *columns)  # noqa: B023, E731
        out = out.unionByName(edge(0, 1, 2)).unionByName(edge(last, last - 1, last - 2))
    return out


def cell_rings(grid: DataFrame) -> DataFrame:
    """(cell_id, y, x, lon, lat, ring): each cell of a bent grid with its four vertices, counterclockwise from the lower left."""
    v = vertices(grid)
    around = ((0, 0), (0, 1), (1, 1), (1, 0))
    asked = grid.select("cell_id", "y", "x", "lon", "lat", F.posexplode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in around))).alias("_k", "d"))
    met = asked.withColumn("_y", F.col("y") + F.col("d.dy")).withColumn("_x", F.col("x") + F.col("d.dx")).join(v.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("lon").alias("_a"), F.col("lat").alias("_b")), ["_y", "_x"])
    ring = F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col("_a").alias("x"), F.col("_b").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return met.groupBy("cell_id", "y", "x", "lon", "lat").agg(ring.alias("ring"))


def bent_corners(grid: DataFrame) -> DataFrame:
    """Another estimate of the corners (y, x, lon, lat), from cells on the diagonal: half a step back from each centre, at the borders half a step on."""
    ny, nx = _extent(grid)
    at = grid.sparkSession.range((ny + 1) * (nx + 1)).select(F.floor(F.col("id") / (nx + 1)).cast("int").alias("y"), (F.col("id") % (nx + 1)).cast("int").alias("x"))
    low, left = F.col("y") < ny - 1, F.col("x") < nx - 1
    # the centre a corner starts from, and the one whose distance it halves
    y0, x0 = F.when(low, F.col("y")).otherwise(F.col("y") - 1), F.when(left, F.col("x")).otherwise(F.col("x") - 1)
    y1 = F.when(low, F.col("y") + 1).otherwise(F.col("y") - 2)
    x1 = F.when(left, F.col("x") + 1).otherwise(F.col("x") - 2)
    asked = at.select("y", "x", y0.alias("_y0"), x0.alias("_x0"), y1.alias("_y1"), x1.alias("_x1"))
    for k in (0, 1):
        asked = asked.join(grid.select(F.col("y").alias(f"_y{k}"), F.col("x").alias(f"_x{k}"), F.col("lon").alias(f"_lon{k}"), F.col("lat").alias(f"_lat{k}")), [f"_y{k}", f"_x{k}"])
    return asked.select("y", "x", *((F.col(f"_{c}0") - (F.col(f"_{c}1") - F.col(f"_{c}0")) / 2).alias(c) for c in ("lon", "lat")))


def ring_area(ring: Sequence[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def ring_overlap(a: Sequence[tuple[float, float]], b: Sequence[tuple[float, float]]) -> float:
    """The area that two convex rings have in common, by cutting the first at each side of the second."""
    if ring_area(b) < 0:
        b = list(b)[::-1]
    out = list(a)
    for (x0, y0), (x1, y1) in zip(b, [*b[1:], b[0]]):
        side = [(x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) for x, y in out]
        cut = []
        for k, p in enumerate(out):
            q, s, t = out[k - 1], side[k], side[k - 1]
            if s * t < 0:
                f = t / (t - s)
                cut.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if s >= 0:
                cut.append(p)
        out = cut
        if not out:
            return 0.0
    return abs(ring_area(out))


def bent_weights(source: DataFrame, target: DataFrame, radius: float | None = None) -> DataFrame:
    """(target_cell, source_cell, w) between grids of rings (`cell_rings`): the part of the source cell's area, in degrees, in the target cell.

    Candidates are source centres nearer than `radius` in both coordinates (0.6
    times the sum of the mean spacings unless given); they meet in tiles of that
    size, so it is an equi-join. Pairs without an overlap have no row.
    """
    if radius is None:
        radius = 0.6 * (spacing(source) + spacing(target))
    tile = lambda c, d=0: (F.floor(F.col(c) / radius) + d).cast("bigint")
    s = source.select(F.col("cell_id").alias("source_cell"), F.col("lon").alias("_a"), F.col("lat").alias("_b"), F.col("ring").alias("_s"), tile("lon").alias("_tx"), tile("lat").alias("_ty"))
    t = target.select(F.col("cell_id").alias("target_cell"), "lon", "lat", F.col("ring").alias("_t"), F.explode(F.array(*(F.struct(tile("lon", dx).alias("_tx"), tile("lat", dy).alias("_ty")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))).alias("_c")).select("target_cell", "lon", "lat", "_t", "_c.*")
    near = s.join(t, ["_tx", "_ty"]).where((F.abs(F.col("lon") - F.col("_a")) < radius) & (F.abs(F.col("lat") - F.col("_b")) < radius)).select("target_cell", "source_cell", "_s", "_t")

    def run(batches):
        for part in batches:
            rings = [([(p["x"], p["y"]) for p in a], [(p["x"], p["y"]) for p in b]) for a, b in zip(part["_s"], part["_t"])]
            w = [ring_overlap(a, b) / (abs(ring_area(a)) or float("nan")) for a, b in rings]
            yield part[["target_cell", "source_cell"]].assign(w=w)

    return near.mapInPandas(run, "target_cell bigint, source_cell bigint, w double").where("w > 0 and not isnan(w)")


def spacing(grid: DataFrame) -> float:
    """The mean step of a grid: that of longitudes along rows and of latitudes along columns."""
    g = _shifted(grid.select("y", "x", "lon", "lat"), e=(0, 1), n=(1, 0))
    a, b = g.agg(F.avg(F.col("e_lon") - F.col("lon")), F.avg(F.col("n_lat") - F.col("lat"))).first()
    return (abs(a or 0) + abs(b or 0)) / 2


def outline(grid: DataFrame, border: int = 0) -> dict:
    """A grid's middle cell (lon_0, lat_0), first and last cell (corners) and the ring of its outer cells (domain), `border` cells further in."""
    ny, nx = grid.agg(F.max("y") + 1, F.max("x") + 1).first()
    k, y, x = border, F.col("y"), F.col("x")
    edge = y.isin(k, ny - 1 - k) & x.between(k, nx - 1 - k) | x.isin(k, nx - 1 - k) & y.between(k, ny - 1 - k)
    # as many rows as the outer ring has cells
    cells = {(r.y, r.x): (r.lon, r.lat) for r in grid.where(edge | (y == ny // 2) & (x == nx // 2)).select("y", "x", "lon", "lat").collect()}
    path = [(k, i) for i in range(k, nx - k)] + [(j, nx - 1 - k) for j in range(k + 1, ny - k)] + [(ny - 1 - k, i) for i in range(nx - 2 - k, k - 1, -1)] + [(j, k) for j in range(ny - 2 - k, k - 1, -1)]
    middle, first, last = cells[ny // 2, nx // 2], cells[k, k], cells[ny - 1 - k, nx - 1 - k]
    return {"lon_0": middle[0], "lat_0": middle[1], "corners": [first[1], first[0], last[1], last[0]], "domain": [cells[p] for p in path]}


def domain_mask(df: DataFrame, grid: DataFrame, other: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Values of cells of `grid` that lie outside the outer ring of the grid `other` as missing."""
    spark = df.sparkSession
    ring = spark.createDataFrame([("domain", outline(other)["domain"])], "region string, ring array<struct<x:double,y:double>>")
    return mask(df, membership(grid, ring), cell=cell).drop("region")


def crop(grid: DataFrame, cells: DataFrame) -> tuple[DataFrame, tuple[int, int, int, int] | None]:
    """The rectangle of a grid around `cells` and its first and last row and column; all of nothing where there are none."""
    y0, y1, x0, x1 = grid.join(cells.select("cell_id").distinct(), "cell_id").agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    if y0 is None:
        return grid.where("false"), None
    return grid.where(F.col("y").between(y0, y1) & F.col("x").between(x0, x1)), (y0, y1, x0, x1)
