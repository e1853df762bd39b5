"""Order statistics of groups that are larger than a task: ranks, running totals and exact quantiles.

Rows are dealt to partitions by ranges of (keys, order). Each partition is summed
up; the sums before it, a row for each partition and key, tell where its rows
begin. So no task holds a whole group, only a range of it; rows that agree in all
keys and the whole order are in one range, so the order should tell rows apart.

Null keys are keys of their own. Null values count nowhere in quantiles; groups
that have no others get null. An empty table gives no rows, without keys one row
of nulls. Equal values are counted, not listed. Columns that start with `_` are
used inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.sources.scratch import store


def same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> Column:
    """Keys that are equal or both null; those of b are called `_k0`, `_k1` and so on."""
    out = F.lit(True)
    for k, c in enumerate(by):
        out = out & a[c].eqNullSafe(b[f"_k{k}"])
    return out


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """Rows with `place` (from 1) in the order of their group and, for each of `sums`, the total up to and with the row (its name) and of the group (`<name>_all`).

    `size` is the number of the group's rows. Null amounts add nothing.
    """
    sums = sums or {}
    amounts = df.withColumns({f"_s_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}) if sums else df
    dealt = store(amounts.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    local = dealt.groupBy("_part", *by).agg(F.count("*").alias("_n"), *(F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums))
    # a row for each partition and key
    before, whole = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    parts = ["n", *(f"t_{n}" for n in sums)]
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = local.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_k{k}") for k, c in enumerate(by)), *(zero(F.sum(f"_{p}").over(before)).alias(f"_before_{p}") for p in parts), *(F.sum(f"_{p}").over(whole).alias(f"_all_{p}") for p in parts))
    here = Window.partitionBy("_part", *by).orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumns({"_row": F.row_number().over(here)} | {f"_r_{n}": F.sum(f"_s_{n}").over(so_far) for n in sums})
    met = inside.join(offsets, (inside["_part"] == offsets["_p"]) & same(inside, offsets, by))
    out = {"place": F.col("_before_n") + F.col("_row"), "size": F.col("_all_n")}
    for n in sums:
        out |= {n: F.col(f"_before_t_{n}") + F.col(f"_r_{n}"), f"{n}_all": F.col(f"_all_t_{n}")}
    return met.withColumns(out).select(*df.columns, *out)


def quantiles(df: DataFrame, by: Sequence[str], fractions: Sequence[float], value: str = "value", name: str = "_q") -> DataFrame:
    """(by..., name): an array of the exact quantiles of each group, between ranks linearly."""
    own = df.select(*by, F.col(value).cast("double").alias("_v"))
    counted = own.where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    placed = running(counted, by, [F.col("_v")], {"_end": F.col("_c")})
    start, end = F.col("_end") - F.col("_c"), F.col("_end")
    at = lambda f: f * (F.col("_end_all") - 1)
    holds = lambda k: (k >= start) & (k < end)
    wanted = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("f")) for i, f in enumerate(fractions))), lambda x: holds(F.floor(at(x["f"]))) | holds(F.ceil(at(x["f"]))))
    few = placed.withColumn("_w", wanted).where(F.size("_w") > 0).withColumn("_x", F.explode("_w"))
    position = at(F.col("_x")["f"])
    low, high = F.floor(position), F.ceil(position)
    pairs = few.groupBy(*by, F.col("_x")["i"].alias("_i")).agg(F.max(F.when(holds(low), F.col("_v"))).alias("_low"), F.max(F.when(holds(high), F.col("_v"))).alias("_high"), F.max(position).alias("_at"))
    part = F.col("_at") - F.floor("_at")
    exact = F.when(part == 0, F.col("_low")).otherwise((1 - part) * F.col("_low") + part * F.col("_high"))
    found = pairs.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", exact.alias("q")))), lambda x: x["q"]).alias("_found"))  # as many as fractions
    none = F.array(*(F.lit(None).cast("double") for _ in fractions))
    groups = own.select(*by).distinct() if by else df.sparkSession.range(1).select()
    other = found.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(by)), "_found")
    return groups.join(other, same(groups, other, by), "left").select(*by, F.coalesce(F.when(F.size("_found") > 0, F.col("_found")), none).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of the links (a, b: bigint) reaches.

    In each round every id takes the smallest root among its neighbours' roots, and
    roots take each other's; ways to the root are cut short by a join. Rounds grow
    with the logarithm of the longest way; each is written. Null ends are no links.
    """
    links = store(edges.where("a is not null and b is not null and a != b").select("a", "b").distinct(), "links")
    both = links.union(links.select("b", "a"))
    root = store(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "roots")
    while True:
        at = root.select(F.col("id").alias("i"), F.col("component").alias("c"))
        ends = links.join(at, F.col("a") == F.col("i")).select("b", F.col("c").alias("x")).join(at.toDF("j", "y"), F.col("b") == F.col("j")).where("x != y").select("x", "y")
        hooks = ends.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).groupBy("x").agg(F.min("y").alias("y"))
        hooks = store(hooks, "hooks")
        if not hooks.limit(1).count():
            return root
        moved = root.join(hooks, F.col("component") == F.col("x"), "left").select("id", F.coalesce("y", "component").alias("component"))
        # twice the way up, as long as it leads on
        for _ in range(2):
            moved = store(moved, "moved")
            up = moved.select(F.col("id").alias("u"), F.col("component").alias("v"))
            moved = moved.join(up, F.col("component") == F.col("u"), "left").select("id", F.coalesce("v", "component").alias("component"))
        root = store(moved, "roots")
