"""Clusters of vectors around centroids, by exact integer distances with Elkan's bounds.

A vector keeps, from round to round, an upper bound of the distance to its own
centroid and a lower bound to each other one. When centroids move, the bounds
move by as much, upper ones rounded up and lower ones down (they are stored with
24 bits). A distance is worked out only where a bound doesn't rule the centroid
out strictly, so equal distances are always compared and the smaller number wins;
distances that are worked out are exact integers.

Vectors with another number of components than asked for, or with null or
non-finite ones, are left out, as are null vectors. Rows that repeat count each.
Rows without an id take part, but start no centroid while others can. With fewer
vectors than centroids each starts one. An empty table gives an empty table.
Components of 2 ** 28 and more, once scaled, are an error, for their squared
distances don't fit in 64 bits. Columns beside vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, prepare

#: Scaled components from here on are refused; below EXACT all sums of products are whole numbers that doubles hold.
MOST, EXACT = 1 << 28, 1 << 22
#: Vectors a task looks at together.
BLOCK = 4096
STATE = "vec_id bigint, v array<int>, cluster int, upper float, lower array<float>"


def whole_vectors(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that take part, as floor(scale * component)."""
    own = pick(vectors, vec_id="vec_id", embedding="embedding").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("e", lambda x: F.when(F.abs(x * scale) < MOST, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit("components are too large for distances of 64 bits"))))
    return own.where((F.size("e") == size) & F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("v"))


def first_centroids(whole: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors whose SHA-256 of salt and id is smallest, in ascending order; of equal ids, the smaller vector."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = whole.select(mark.alias("mark"), "v").orderBy(F.asc_nulls_last("mark"), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of v to one centroid."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def _up(x: np.ndarray) -> np.ndarray:
    """Of 32 bits, not below x."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def _down(x: np.ndarray) -> np.ndarray:
    """Of 32 bits, not above x."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def _root_down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squares.astype(np.float64)), -np.inf) * (1 - 2**-50), 0)


def _root_up(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares.astype(np.float64)), np.inf) * (1 + 2**-50)


def start(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) of vectors seen for the first time: all distances are worked out."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * a @ c.T  # whole numbers below 2 ** 53
    else:
        d = np.stack([_squares(v, c) for c in centroids], 1)
    cluster = d.argmin(1)  # the first of equals
    return cluster, _up(_root_up(d[np.arange(len(v)), cluster])), _down(_root_down(d))


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, distances worked out) after the centroids have moved by at most `moved`."""
    up, low = upper.astype(np.float64), lower.astype(np.float64)
    up = np.nextafter(up + moved[cluster], np.inf)
    low = np.maximum(np.nextafter(low - moved[None, :], -np.inf), 0)
    k = len(centroids)
    # half the distance between centroids, rounded down
    half = _root_down(np.stack([_squares(centroids, c) for c in centroids])) / 2
    nearest = np.where(np.eye(k, dtype=bool), np.inf, half).min(1)
    open_ = np.flatnonzero(~(up < nearest[cluster]))
    worked = 0
    if len(open_):
        best = _squares(v[open_], centroids[cluster[open_]])
        worked += len(open_)
        tight, now = _root_up(best), cluster[open_].copy()
        low[open_, now] = _root_down(best)
        for c in range(k):
            ask = np.flatnonzero((now != c) & ~(tight < low[open_, c]) & ~(tight < half[now, c]))
            if not len(ask):
                continue
            d = _squares(v[open_[ask]], centroids[c])
            worked += len(ask)
            low[open_[ask], c] = _root_down(d)
            better = (d < best[ask]) | ((d == best[ask]) & (c < now[ask]))
            won = ask[better]
            best[won], now[won], tight[won] = d[better], c, _root_up(d[better])
        cluster = cluster.copy()
        cluster[open_], up[open_] = now, tight
    return cluster, _up(up), _down(low), worked


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), width)


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, moved: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    k, size = centroids.shape
    for batch in batches:
        v = _matrix(batch.column("v"), size, np.int64)
        if moved is None:
            cluster, upper, lower = start(v, centroids)
        else:
            cluster, upper, lower, _ = assign(v, batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), _matrix(batch.column("lower"), k, np.float32), centroids, moved)
        at = pa.array(np.arange(len(v) + 1) * k, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper, pa.float32()), pa.ListArray.from_arrays(at, pa.array(lower.ravel(), pa.float32()))], names=["vec_id", "v", "cluster", "upper", "lower"]
        )


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's components; an empty cluster's centroid stays. A row for each centroid comes to the driver."""
    k, size = centroids.shape
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("v")[i].cast("bigint")) for i in range(size))).alias("s")).collect()
    new = centroids.copy()
    for r in sums:
        new[r.cluster] = [s // r.n for s in r.s]
    return new


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Each of `rounds` rounds assigns every vector to the nearest centroid and moves
    centroids to the floor of their vectors' mean; at the end vectors are assigned
    once more. distance is squared; inertias are sums of it. The vectors with
    their bounds are written after each round; k centroids go to every task.
    """
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "cluster")
    whole = whole_vectors(vectors, size, scale)
    centroids = first_centroids(whole, k, salt)
    if not len(centroids):
        return whole.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    state, moved = whole, None
    for r in range(rounds + 1):
        state = scratch.store(state.mapInArrow(lambda b, c=centroids, m=moved: _round(b, c, m), STATE), f"round{r}")
        scratch.keep(f"round{r}")
        if r == rounds:
            break
        new = means(state, centroids)
        moved, centroids = _root_up(np.einsum("ij,ij->i", new - centroids, new - centroids)), new
    rows = spark.createDataFrame([(c, [int(x) for x in v], hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)], "c int, centre array<int>, centroid_sha256 string")
    d = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a.cast("bigint") - b) * (a.cast("bigint") - b)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    met = state.join(F.broadcast(rows), F.col("cluster") == F.col("c")).select("vec_id", "cluster", d.alias("distance"), "centroid_sha256")
    sums = {r.cluster: int(r.s) for r in met.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    inertia = spark.createDataFrame([(c, s, sum(sums.values())) for c, s in sums.items()], "c int, cluster_inertia bigint, inertia bigint")
    return met.join(F.broadcast(inertia), F.col("cluster") == F.col("c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """The same over a table `embeddings` in SQL, one row of a table for each vector, centroid and component."""
    steps = [
        f"""kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
  from embeddings
  where len(embedding) = {size} and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))))""",
        f"""c0 as materialized (
  select cast(row_number() over (order by sha256('{salt}' || cast(vec_id as varchar)) nulls last, v) - 1 as integer) as cluster, v
  from kept qualify cluster < {k})""",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} as materialized (
  select r, min(struct_pack(d := d, cluster := cluster)) as best
  from (select k.r, c.cluster, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from kept k, c{n} c)
  group by r)"""
        )
        if n < rounds:
            steps.append(
                f"""s{n} as materialized (
  select cluster, i, floor_sum from (
    select a.best.cluster as cluster, i, sum(v[i])::bigint as s, count(*) as n, (s - ((s % n) + n) % n) // n as floor_sum
    from a{n} a join kept using (r), range(1, {size + 1}) t(i) group by 1, 2)),
c{n + 1} as materialized (
  select c.cluster, coalesce(m.v, c.v) as v
  from c{n} c left join (select cluster, list(floor_sum order by i) as v from s{n} group by cluster) m using (cluster))"""
            )
    last = f"""select vec_id, best.cluster as cluster, best.d as distance,
  sum(best.d) over (partition by best.cluster)::bigint as cluster_inertia, sum(best.d) over ()::bigint as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} join kept using (r) join c{rounds} c on c.cluster = best.cluster"""
    return "with " + ",\n".join(steps) + "\n" + last
