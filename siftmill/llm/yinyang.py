"""Centroid clustering of integer vectors with Yinyang bounds.

Each vector carries its cluster, an upper bound of the distance to its own centroid, and for each
group of centroids one lower bound of the distance to the group's others. Centroids are grouped
once, at the start. When they move, the upper bound grows by the own centroid's way and each lower
bound shrinks by the longest way in its group. A vector whose upper bound is below all its lower
bounds keeps its cluster and nothing is computed (the filter over all groups); else its own distance
is computed and the filter is tried again; what is left is compared group by group, and only
groups whose bound is not above the upper one are scanned, all their centroids exactly.

Bounds are floating-point numbers kept apart by a slack that exceeds their rounding; what decides
is always the squared distance in whole numbers, ties going to the smaller centroid. So the result
is that of the plain algorithm, to the last unit.

A round is one pass over a table of vectors and bounds, written as Parquet in the shared folder, and
an aggregation of sums with a row for each cluster. Vectors are never shuffled; what reaches the
driver and the tasks is k centroids. A lost executor costs the tasks of one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.shared import discard, settled, shared_folder, stored

#: Squared distances of vectors whose components stay below this fit a long at up to 512 components.
LIMIT = 1 << 26
DIMS, MOST_DIMS = 64, 512
_STATE = "id long, v array<int>, cluster int, distance long, upper double, lower array<double>"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v array<int>): floor(scale * x) of each vector with `dims` components, all finite and below
    LIMIT in size after that; others have no row."""
    x = F.transform(F.col(vector_col), lambda e: F.floor(e.cast("double") * scale))
    good = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) < LIMIT)
    kept = df.where((F.size(vector_col) == dims) & F.forall(vector_col, good))
    return kept.select(F.col(id_col).cast("long").alias("id"), x.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the k smallest SHA-256 of `seed:id`, in that order (all, if they are fewer); of
    rows of one id, by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows] or np.zeros((0, 0)), "int64")


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of clustering among the centroids themselves. Which groups
    come out changes the work only."""
    points = centroids.astype("float64")
    heads = points[np.linspace(0, len(points) - 1, groups).astype(int)]
    for _ in range(rounds):
        at = ((points[:, None, :] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        heads = np.array([points[at == g].mean(axis=0) if (at == g).any() else heads[g] for g in range(groups)])
    return np.unique(at, return_inverse=True)[1]


def squared(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid, or to a row each."""
    gap = v - centroid
    return np.einsum("ij,ij->i", gap, gap)


def _slack(x: np.ndarray) -> np.ndarray:
    """More than what rounding can add up to in a bound of this size."""
    return 1e-9 * (1.0 + np.abs(x))


def scanned(v: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, lower bounds) of rows compared with every centroid."""
    every = np.stack([squared(v, c) for c in centroids], axis=1)
    cluster = every.argmin(axis=1)  # the first of equals
    rows = np.arange(len(v))
    best = every[rows, cluster]
    others = np.sqrt(every.astype("float64"))
    others[rows, cluster] = np.inf
    lower = np.stack([others[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1)
    return cluster, best, lower


def moved(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, before: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, distances computed) of rows after centroids moved from `before`."""
    way = np.sqrt(((centroids - before).astype("float64") ** 2).sum(axis=1))
    way = way + _slack(way)
    longest = np.array([way[group == g].max() for g in range(group.max() + 1)])
    cluster, upper, lower, cost = cluster.copy(), upper + way[cluster], lower - longest, 0
    open_ = np.flatnonzero(upper + _slack(upper) >= lower.min(axis=1))  # over all groups
    own = squared(v[open_], centroids[cluster[open_]])
    cost += len(open_)
    upper[open_] = np.sqrt(own.astype("float64"))
    still = upper[open_] + _slack(upper[open_]) >= lower[open_].min(axis=1)
    open_, own = open_[still], own[still]
    if not len(open_):
        return cluster, upper, lower, cost
    # Group by group: the best so far is kept as (squared distance, centroid).
    low, reach = lower[open_], upper[open_] + _slack(upper[open_])
    old, best, at = cluster[open_], own.copy(), cluster[open_].copy()
    second = low.copy()  # each group's bound without the final centroid, filled in as groups are scanned
    dist = np.full((len(open_), len(centroids)), np.inf)
    dist[np.arange(len(open_)), old] = np.sqrt(own.astype("float64"))
    need = low <= reach[:, None]
    for g in range(low.shape[1]):
        rows = np.flatnonzero(need[:, g])
        if not len(rows):
            continue
        for j in np.flatnonzero(group == g):
            d = squared(v[open_[rows]], centroids[j])
            cost += len(rows)
            dist[rows, j] = np.sqrt(d.astype("float64"))
            wins = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
            best[rows[wins]], at[rows[wins]] = d[wins], j
    line = np.arange(len(open_))
    left = dist.copy()
    left[line, at] = np.inf
    for g in range(low.shape[1]):
        mine = left[:, group == g].min(axis=1)
        # A group that wasn't scanned keeps its bound, but for the centroid that a row has just left.
        second[:, g] = np.where(need[:, g], mine, np.minimum(low[:, g], mine))
    cluster[open_], upper[open_], lower[open_] = at, np.sqrt(best.astype("float64")), second
    return cluster, upper, lower, cost


def _matrix(column: pa.Array, kind: str, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(rows, -1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(x) + 1, dtype="int32") * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel(), kind))


def _assigned(table: DataFrame, centroids: np.ndarray, before: np.ndarray | None, group: np.ndarray, last: bool) -> DataFrame:
    """The state after a round; distance is filled in only on the last one."""
    held = table.sparkSession.sparkContext.broadcast((centroids, before, group))  # k rows each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, before, group = held.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = _matrix(batch.column("v"), "int64", n)
            if before is None:
                cluster, best, lower = scanned(v, centroids, group)
                upper = np.sqrt(best.astype("float64"))
            else:
                cluster = batch.column("cluster").to_numpy().astype("int64")
                cluster, upper, lower, _ = moved(v, cluster, batch.column("upper").to_numpy(), _matrix(batch.column("lower"), "float64", n), centroids, before, group)
            distance = pa.array(squared(v, centroids[cluster])) if last else pa.nulls(n, pa.int64())
            columns = [batch.column("id"), batch.column("v"), pa.array(cluster.astype("int32")), distance, pa.array(upper), _lists(lower, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cluster", "distance", "upper", "lower"])

    return table.mapInArrow(run, _STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster, exactly; a cluster without vectors keeps its centroid."""
    dims = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)))
    now = centroids.copy()
    for r in sums.collect():  # a row a cluster
        now[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    return now


def _text(centroid: np.ndarray) -> str:
    return ",".join(map(str, centroid.tolist()))


def clusters(df: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = 1024, seed: int = 3, groups: int | None = None) -> DataFrame:
    """(id_col, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>), stored:
    a row for each vector that takes part.

    Vectors are floor(scale * x). Those that are null, of another length, hold null or non-finite
    components, or components of LIMIT units or more (whose squared distances might not fit a long),
    take no part. The first centroids are the k vectors with the smallest SHA-256 of `seed:id` (all
    vectors, if they are fewer). Each round assigns every vector to the nearest centroid, the smaller
    number of equals, then takes the floor of each mean; after the last one vectors are assigned
    once more. distance is squared, inertia is its sum over all vectors and cluster_inertia over a
    cluster's (null where a sum doesn't fit a long). Repeated rows each count; a null id counts as an
    empty one. df may be empty. groups: of centroids, a quarter of k unless given.
    """
    if not 0 < dims <= MOST_DIMS:
        raise ValueError(f"vectors of 1 to {MOST_DIMS} components")
    spark = df.sparkSession

    def found() -> DataFrame:
        vectors = stored(whole_vectors(df, id_col, vector_col, dims, scale))
        centroids = first_centroids(vectors, k, seed)
        if not len(centroids):
            return vectors.select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<int>"))))
        group = grouped(centroids, groups or -(-len(centroids) // 4))
        state, before, older = vectors, None, None
        for turn in range(rounds + 1):
            path = shared_folder(spark)
            _assigned(state, centroids, before, group, turn == rounds).write.parquet(path)
            state = spark.read.schema(_STATE).parquet(path)
            if older:
                discard(spark, older)  # no more than two rounds' tables stand at a time
            older = path
            if turn < rounds:
                before, centroids = centroids, _means(state, centroids)
        return _summed(state, centroids, id_col)

    return settled(spark, found)


def _summed(state: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    total = F.sum(F.col("distance").cast("decimal(20,0)"))
    per = state.groupBy("cluster").agg(total.alias("part")).withColumn("whole", F.sum("part").over(Window.partitionBy()))  # k rows
    at = state.sparkSession.createDataFrame([(j, c) for j, c in enumerate(centroids.tolist())], "cluster int, centroid array<int>")
    long = lambda c: F.col(c).try_cast("long")
    per = per.join(at, "cluster").select("cluster", long("part").alias("cluster_inertia"), long("whole").alias("inertia"), "centroid")
    return state.join(F.broadcast(per), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: Column) -> Column:
    """The SHA-256 of a centroid's components as decimal integers with commas between them."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
