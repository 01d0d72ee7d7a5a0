"""Exact top-k inner products by a ball tree per shard, with branch and bound.

Vectors are dealt to shards by the nearest of some pivots (a bounded sample that only
decides which vectors lie together; all are indexed); a pivot with more than a shard's
vectors has several shards, by a hash of vec_id. Each shard has a ball tree, whose
nodes are visited by their upper bound q.c + |q| r and left once no query's bound reaches its
current k-th score.

Queries come in blocks of one shard. A block is searched in its own shard first. Its k-th
scores, shared, are held against the root balls of all shards; only pairs of a block and a
shard that may still enter a result are made, the most promising first, and the rest are held
against the scores known by then before any tree is sent.

Components are floor(scale * x); scores are exact integers (beyond 64 bits they
stop at the limits of a long).

Defined cases: a vector that is null or holds a null or non-finite component
takes no part, nor does a null vec_id; of rows that share a vec_id the one
smallest in array order takes part; a query's own vec_id is no candidate; a
query meets only vectors of its dimension; ties go to the smaller vec_id. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.work import written

SHARD = 8192
LEAF = 128
QUERIES = 256
PIVOTS = 1024
FIRST_SHARDS = 4  # of a block, searched before the rest are looked at again
LONG = (1 << 63) - 1
INDEX = "dim int, shard long, ids binary, vectors binary, centre binary, radius binary, first binary, last binary, left binary"
FOUND = "query_id long, vec_id long, score long"


def _build(scale: float):
    def run(key, table):
        ids = table.column("vec_id").to_numpy()
        dim = key[0].as_py()
        flat = table.column("embedding").combine_chunks()
        x = np.floor(scale * np.asarray(flat.flatten().cast(pa.float64())).reshape(len(ids), dim)) if dim else np.zeros((len(ids), 0))
        order = np.lexsort((*x.T[::-1], ids)) if dim else np.argsort(ids)
        order = order[np.concatenate([[True], np.diff(ids[order]) != 0])]
        ids, x = ids[order], x[order]
        centre, radius, first, last, left = [], [], [], [], []
        turn = np.arange(len(ids))

        def add(a, b):
            part = x[turn[a:b]]
            c = part.mean(axis=0)
            centre.append(c)
            radius.append(np.sqrt(((part - c) ** 2).sum(axis=1)).max(initial=0.0))
            first.append(a)
            last.append(b)
            left.append(-1)

        add(0, len(ids))
        node = 0
        while node < len(left):  # children get places at the end, the right one next to the left one
            a, b = first[node], last[node]
            if b - a > LEAF and radius[node] > 0:
                part = x[turn[a:b]]
                far = part[((part - centre[node]) ** 2).sum(axis=1).argmax()]
                other = part[((part - far) ** 2).sum(axis=1).argmax()]
                turn[a:b] = turn[a:b][np.argsort(part @ (far - other), kind="stable")]
                left[node] = len(left)
                add(a, (a + b) // 2)
                add((a + b) // 2, b)
            node += 1
        arrays = [ids[turn], x[turn], np.array(centre), np.array(radius), *(np.array(v, np.int64) for v in (first, last, left))]
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), **{n: pa.array([v.tobytes()], pa.binary()) for n, v in zip(("ids", "vectors", "centre", "radius", "first", "last", "left"), arrays)}})

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of whole numbers held as doubles."""
    most = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most < 2**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(x).T, -LONG - 1, LONG).astype(np.int64)


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries with all that balls hold, a little above what rounding could lose."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = q @ centre.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius
        return np.nan_to_num(bound + np.abs(bound) * 1e-9 + 1e-3 + 1e-12 * np.abs(q).sum(axis=1)[:, None] * np.abs(centre).max(initial=0.0), nan=np.inf)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), dim) if dim else np.zeros((len(column), 0))


def _cells(shared, names: list[str]):
    """Rows with the number of the nearest pivot of their dimension; 0 where there is none."""

    def run(batches):
        for b in batches:
            e, dims = b.column(names.index("embedding")), b.column(names.index("dim")).to_numpy()
            cell = np.zeros(b.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                at, pivots = np.flatnonzero(dims == dim), shared.value.get(dim)
                if pivots is not None and dim:
                    with np.errstate(over="ignore", invalid="ignore"):
                        cell[at] = ((pivots * pivots).sum(axis=1) - 2 * _matrix(e.take(pa.array(at)), dim) @ pivots.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*names, "cell"])

    return run


PAIRS = "dim int, block long, shard long, excess double"


def _promising(key, queries, roots):
    """Of a block and some shards' root balls the pairs that may hold something, by how far the best bound exceeds the k-th score."""
    dim = key[0].as_py()
    none = pa.table({"dim": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "excess": pa.array([], pa.float64())})
    if not queries.num_rows or not roots.num_rows:
        return none
    q = _matrix(queries.column("vector").combine_chunks(), dim)
    centre = np.stack([np.frombuffer(x, np.float64)[:dim] for x in roots.column("centre").to_pylist()])
    radius = np.array([np.frombuffer(x, np.float64)[0] for x in roots.column("radius").to_pylist()])
    kth = queries.column("kth").fill_null(-LONG - 1).to_numpy().astype(np.float64)
    excess = (bounds(q, centre, radius) - kth[:, None]).max(axis=0)
    open_ = np.flatnonzero(excess >= -np.abs(kth).max(initial=0.0) * 1e-12)
    shard = roots.column("shard").to_numpy()[open_]
    return pa.table({"dim": pa.array(np.full(len(open_), dim), pa.int32()), "block": pa.array(np.full(len(open_), key[1].as_py()), pa.int64()), "shard": pa.array(shard), "excess": pa.array(excess[open_])})


def _search(k: int):
    def run(key, queries, shards):
        if not queries.num_rows or not shards.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        dim = key[0].as_py()
        one = {n: shards.column(n)[0].as_py() for n in shards.column_names}
        ids = np.frombuffer(one["ids"], np.int64)
        x = np.frombuffer(one["vectors"]).reshape(len(ids), dim)
        radius = np.frombuffer(one["radius"])
        centre = np.frombuffer(one["centre"]).reshape(len(radius), dim)
        first, last, left = (np.frombuffer(one[n], np.int64) for n in ("first", "last", "left"))
        own = queries.column("query_id").to_numpy()
        q = np.asarray(queries.column("vector").combine_chunks().flatten()).reshape(len(own), dim) if dim else np.zeros((len(own), 0))
        bound = bounds(q, centre, radius)
        floor = queries.column("kth").fill_null(-LONG - 1).to_numpy()
        score = np.full((len(own), k), -LONG - 1)
        vec = np.full((len(own), k), LONG)
        there = np.zeros((len(own), k), bool)
        kth = floor.copy()
        stack = [0]
        while stack:
            node = stack.pop()
            active = np.flatnonzero(bound[:, node] >= kth)
            if not len(active):
                continue
            if left[node] >= 0:
                a, b = left[node], left[node] + 1
                stack += [a, b] if bound[active, b].sum() > bound[active, a].sum() else [b, a]
                continue
            a, b = first[node], last[node]
            s = products(q[active], x[a:b])
            with_ids = np.broadcast_to(ids[a:b], s.shape)
            fits = (with_ids != own[active][:, None]) & (s >= floor[active][:, None])
            s, v, t = np.hstack([score[active], s]), np.hstack([vec[active], with_ids]), np.hstack([there[active], fits])
            turn = np.lexsort((v, -s.astype(np.float64) if np.abs(s[t]).max(initial=0) < 2**53 else ~s, ~t), axis=-1)[:, :k]
            score[active], vec[active], there[active] = (np.take_along_axis(w, turn, 1) for w in (s, v, t))
            full = active[there[active, k - 1]]
            kth[full] = np.maximum(kth[full], score[full, k - 1])
        row, col = np.nonzero(there)
        return pa.table({"query_id": pa.array(own[row]), "vec_id": pa.array(vec[row, col]), "score": pa.array(score[row, col])})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best; ``is_query`` is a condition on the columns of ``vectors``."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = vectors.select(F.col("vec_id").cast("long"), "embedding", is_query.alias("is_query")).filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    twice = written(valid.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "repeated-ids")
    several = valid.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("is_query").alias("is_query"))
    rows = valid.join(twice, "vec_id", "left_anti").unionByName(several).withColumn("dim", F.size("embedding"))

    sample = rows.select("dim", "embedding", "vec_id").orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id").limit(min(PIVOTS, max(1, -(-valid.count() // shard_rows)))).collect()
    pivots = {d: np.array([r["embedding"] for r in sample if r["dim"] == d], np.float64) for d in {r["dim"] for r in sample}}
    names = rows.columns
    placed = rows.mapInArrow(_cells(rows.sparkSession.sparkContext.broadcast(pivots), names), rows.withColumn("cell", F.lit(0)).schema)
    parts = written(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).alias("parts")), "cells")  # a row a pivot and dimension
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    dealt = placed.join(parts, ["dim", "cell"]).withColumn("shard", F.shiftleft(F.col("cell").cast("long"), 32) + part)
    index = written(dealt.select("vec_id", "embedding", "dim", "shard").groupBy("dim", "shard").applyInArrow(_build(scale), INDEX), "ball-trees")

    def floored(batches):
        for b in batches:
            e = b.column(1)
            v = pa.array(np.floor(scale * np.asarray(e.flatten().cast(pa.float64()))))
            vector = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.asarray(e.value_lengths()))]), pa.int32()), v)
            yield pa.RecordBatch.from_arrays([b.column(0), vector, b.column(2), b.column(3)], ["query_id", "vector", "dim", "home"])

    asked = dealt.filter("is_query").select("vec_id", "embedding", "dim", "shard").mapInArrow(floored, "query_id long, vector array<double>, dim int, home long")
    blocks = written(asked.groupBy("dim", "home").agg(F.ceil(F.count("*") / QUERIES).alias("blocks")), "blocks")
    block = F.xxhash64("dim", "home", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("blocks")))
    queries = written(asked.join(blocks, ["dim", "home"]).withColumn("block", block).drop("blocks"), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def known(found: DataFrame) -> DataFrame:
        """Queries with their k-th score so far, null where there are fewer."""
        kth = found.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") == k).drop("n")
        return queries.join(kth, "query_id", "left")

    def search(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """What the shards of the pairs (dim, block, shard) hold for the queries of their blocks."""
        by = ("dim", "shard", "block")
        fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides come from the pairs
        left = fresh(asked.select("query_id", "dim", "block", "kth", "vector").join(pairs, ["dim", "block"]))
        return left.groupBy(*by).cogroup(fresh(index.join(fresh(pairs), ["dim", "shard"])).groupBy(*by)).applyInArrow(_search(k), FOUND)

    home = written(queries.select("dim", "block", F.col("home").alias("shard")).distinct(), "own-pairs")
    found = written(search(queries.withColumn("kth", F.lit(None).cast("long")), home), "own-shards")
    done = home
    roots = index.select("dim", "shard", "centre", "radius")

    def promising(asked: DataFrame) -> DataFrame:
        """Pairs not searched yet that may hold something; a block meets root balls, in groups, but no tree."""
        own = asked.select("dim", "block", "kth", "vector")
        group = F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("group")
        balls = roots.select("*", group).join(home.select("dim", "block").distinct(), "dim")
        spread = own.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        open_ = spread.groupBy("dim", "block", "group").cogroup(balls.groupBy("dim", "block", "group")).applyInArrow(_promising, PAIRS)
        return open_.join(done, ["dim", "block", "shard"], "left_anti")

    shards = index.count()
    if shards > 1:
        groups = -(-shards // 4096)
        turn = F.row_number().over(Window.partitionBy("dim", "block").orderBy(F.desc("excess"), "shard"))
        first = written(promising(known(found)).withColumn("turn", turn).filter(F.col("turn") <= FIRST_SHARDS).select("dim", "block", "shard"), "first-shards")
        found = written(best(found.union(search(known(found), first))).drop("rank"), "found")
        done = home.union(first)
        rest = written(promising(known(found)).select("dim", "block", "shard"), "other-shards")
        found = found.union(search(known(found), rest))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
