"""Exact k-means on integer vectors with balls around centroids.

Each round is one pass over a written table of vectors with the cluster that each is in. The members
of a cluster in a batch form a ball around its centroid, whose radius is that of the farthest. A centroid whose half distance
from the ball's own exceeds the radius can hold none of them; the others are the ball's neighbours, in order of
distance. Members nearer to their centroid than half the way to the first neighbour are the stable core and stay; the rest lie in annuli,
the k-th of which meets only the first k neighbours. All comparisons are of exact integers.
A task adds up the new members of each cluster while it writes them; Spark adds up the tasks' rows, and only the
centroids, k rows, reach the driver. A round whose centroids stay as they were ends the rounds early: the rest would change nothing.

Components are floor(scale * x), held within +-2^26 (beyond that squared distances would leave
64 bits).

Defined cases: a vector that is null, has another number of components than asked for or holds a null
or non-finite one takes no part; rows that share a vec_id are vectors of their own; a null vec_id hashes
like an empty one, so its row may be a first centroid too; equal hashes are ordered by components;
fewer than k vectors give as many centroids; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.work import removed, written

MOST = 1 << 26
EXACT = 1 << 22  # up to here squared distances are exact in doubles
STATE = "vec_id long, v array<int>, cluster int, distance long, sums array<long>, members long"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each row of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) * max(1, x.shape[1]) ** 0.5 <= EXACT * 8:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = squared(x, centroids)
    best = d.argmin(axis=1)  # the first of equals
    return best, d[np.arange(len(x)), best]


def by_balls(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroids and squared distances, and how many distances were computed; own: the clusters that rows are in."""
    between = squared(centroids, centroids)
    best, distance = own.astype(np.int64), np.empty(len(x), np.int64)
    made = 0
    turn = np.argsort(own, kind="stable")
    for members in np.split(turn, np.flatnonzero(np.diff(own[turn])) + 1) if len(x) else []:
        i = int(own[members[0]])
        d = squared(x[members], centroids[i : i + 1])[:, 0]
        made += len(members)
        near = np.argsort(d, kind="stable")
        members, d = members[near], d[near]
        around = np.argsort(between[i], kind="stable")
        around = around[(around != i) & (between[i][around] <= 4 * d[-1])]  # the ball's neighbours
        annulus = np.searchsorted(between[i][around], 4 * d, "right")  # how many of them a member may be as near to
        least, chosen = d.copy(), np.full(len(d), i)
        outer = np.searchsorted(annulus, np.arange(1, len(around) + 1), "left")  # distances ascend, so do the annuli
        for k in range(len(around)):
            j, part = int(around[k]), slice(int(outer[k]), None)
            other = squared(x[members[part]], centroids[j : j + 1])[:, 0]
            made += len(other)
            better = (other < least[part]) | ((other == least[part]) & (j < chosen[part]))
            least[part] = np.where(better, other, least[part])
            chosen[part] = np.where(better, j, chosen[part])
        best[members], distance[members] = chosen, least
    return best, distance, made


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def _round(centroids: np.ndarray, scale: float | None):
    """A pass over ids and vectors (floats, times scale) or over the state of the round before; writes the next state, with a row of sums a cluster at its end."""
    k, dim = centroids.shape

    def run(batches):
        sums, members = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        names = [f.split()[0] for f in STATE.split(", ")]
        for b in batches:
            if scale is None:
                x = _matrix(b.column(1), dim).astype(np.int64)
                best, distance, _ = by_balls(x, np.asarray(b.column(2)), centroids)
            else:
                x = np.clip(np.floor(scale * _matrix(b.column(1), dim).astype(np.float64)), -MOST, MOST).astype(np.int64)
                best, distance = nearest(x, centroids)
            members += (n := np.bincount(best, minlength=k))
            there = np.flatnonzero(n)
            if len(there):
                sums[there] += np.add.reduceat(x[np.argsort(best, kind="stable")], (np.cumsum(n) - n)[there], axis=0)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel(), pa.int32()))
            none = len(x)
            yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array(best, pa.int32()), pa.array(distance), pa.nulls(none, pa.list_(pa.int64())), pa.nulls(none, pa.int64())], names)
        there = np.flatnonzero(members)
        total = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1) * dim, pa.int32()), pa.array(sums[there].ravel()))
        none = len(there)
        yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.int32())), pa.array(there, pa.int32()), pa.nulls(none, pa.int64()), total, pa.array(members[there])], names)

    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the members' means; a cluster without members keeps its centroid."""
    dim = centroids.shape[1]
    tasks = state.filter("members is not null").select("cluster", "members", "sums")
    out = centroids.copy()
    for r in tasks.groupBy("cluster").agg(F.sum("members").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """vec_id, v (the integer components), cluster and squared distance of every vector, and the final centroids.

    First centroids are the k vectors with the smallest SHA-256 of ``seed:vec_id``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.filter((F.size("v") == dim) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    first = rows.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h")).orderBy("h", "v").limit(k).collect()
    centroids = np.clip(np.floor(scale * np.array([r["v"] for r in first], np.float64).reshape(len(first), dim)), -MOST, MOST).astype(np.int64)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, v array<int>, cluster int, distance long"), centroids
    state = written(rows.mapInArrow(_round(centroids, scale), STATE), "ball-kmeans")
    for _ in range(rounds):
        moved = _moved(state, centroids)
        if (moved == centroids).all():
            break
        centroids, old = moved, state
        state = written(old.filter("members is null").select("vec_id", "v", "cluster").mapInArrow(_round(centroids, None), STATE), "ball-kmeans")
        removed(old)
    return state.filter("members is null").select("vec_id", "v", "cluster", "distance"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the summed distance of its cluster and of all, and its cluster's centroid; the sums are a row a cluster."""
    spark = assigned.sparkSession
    places = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    table = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], sum(x["cluster_inertia"] for x in sums)) for r in sums], "cluster int, cluster_inertia long, inertia long")
    return assigned.join(F.broadcast(places.join(table, "cluster")), "cluster")
