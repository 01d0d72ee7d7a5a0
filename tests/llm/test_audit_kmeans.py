import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import ball_kmeans, blocks, filter_audit, queries

from .fixtures import WORD, documents


def plain_fails(text, limits=filter_audit.Limits()):
    text = text or ""
    w = WORD.findall(text)
    tests = len(w) < limits.words, 100 * len(set(w)) < limits.distinct * len(w), 100 * sum("A" <= c <= "Z" for c in text) > limits.capitals * len(text), any(c in limits.symbols for c in text)
    return {x for x, t in zip("ABCD", tests) if t}


def plain_audit(rows, labels):
    """rows: (doc_id, text, part)."""
    label = lambda i, k: max((x[k] or 0 for x in labels if x[0] == i and i is not None), default=0) == 1
    docs = []
    for i, text, part in rows:
        fails = plain_fails(text)
        if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows):
            fails.add("E")
        docs.append((part or "", fails, label(i, 1), label(i, 2)))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            every = left
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[part, x] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), sum(x in d[1] for d in every) - len(gone), sum(d[1] == {x} for d in every), sum(d[2] for d in gone), sum(d[3] for d in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_matches_the_plain_version(spark):
    docs, rows = documents(spark, n=25)
    rnd = random.Random(3)
    more = [(20_000 + i, " ".join(rnd.choice(["Alpha", "beta", "gamma|", "DELTA", "epsilon", "zeta"]) + str(rnd.randrange(120)) for _ in range(rnd.choice([99, 100, 101, 140]))), rnd.choice(["en", "fr"]), None, 0, 0, "") for i in range(40)]
    more += [(30_000 + i, more[0][1], ["en", "de", None, "fr"][i % 4], None, 0, 0, "") for i in range(60)] + [(20_000, more[0][1], "de", None, 0, 0, ""), (None, more[0][1], "de", None, 0, 0, "")]
    labels = [(i * 3, rnd.randrange(2), rnd.randrange(2)) for i in range(40)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (20_000, None, 1), (30_003, 1, None), (77_777, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash")).withColumn("n", F.lit(1))
    got = collected(filter_audit.audit(docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("digest", F.lit("x")), frame))
    want = plain_audit([(r[0], r[1], r[2]) for r in rows + more], labels)
    assert got == want and any(v[0] for v in want.values()) and any(v[4] for v in want.values())


def test_audit_of_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    long = "Word wörd " * 300_000 + "漢字 end"
    docs = spark.createDataFrame([(1, long, None), (2, None, None), (3, "", None), (4, "a\u0085b c \x1fd", None)], "doc_id long, text string, lang string")
    one = {r.doc_id: r for r in filter_audit.measured(docs).collect()}
    assert (one[1].n_chars, one[1].n_words, one[1].n_distinct, one[1].n_capitals) == (len(long), 600_002, 4, 300_000)
    assert (one[2].n_chars, one[2].n_words, one[2].n_distinct) == (0, 0, 0) and (one[4].n_words, one[4].n_chars) == (2, 8)
    assert one[2].digest == one[3].digest == hashlib.sha256(b"").digest()
    assert collected(filter_audit.audit(docs, labels)) == plain_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], [])


def test_colliding_hashes_are_verified():
    texts = ["one two three two", "", "aa ab aa ba", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    n, found = filter_audit.distinct_words(data, bounds, hashes=lambda w: np.zeros(len(w.start), np.uint64))
    assert n.tolist() == [4, 0, 4, 1] and found.tolist() == [3, 0, 3, 1]
    assert filter_audit.distinct_words(data, bounds)[1].tolist() == [3, 0, 3, 1]
    assert blocks.words(data, bounds).first.tolist() == [0, 4, 4, 8, 9]


def plain_kmeans(rows, k, rounds, dim, scale):
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    hashed = lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashed(r), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((dist(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=str), centroids


@pytest.mark.parametrize("seed,scale", [(1, 256.0), (2, 4.0), (3, 2e6)])
def test_ball_kmeans_matches_the_plain_version(spark, seed, scale):
    rnd = random.Random(seed)
    centre = [[rnd.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rnd.gauss(0, 0.2) for c in rnd.choice(centre)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # one vector holds a third of the rows
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [None] * 6), (2004, [float("nan")] * 6), (2005, [float("inf")] + [0.0] * 5), (3, [0.5] * 6), (3, [0.5] * 6), (None, [0.25] * 6), (None, [-0.25] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("cluster", F.lit(7)).repartition(5)
    got, centroids = ball_kmeans.clustered(frame, k=12, rounds=4, dim=6, scale=scale)
    want, at = plain_kmeans(rows, 12, 4, 6, scale)
    assert centroids.tolist() == at
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=str) == want
    out = ball_kmeans.with_inertia(got, centroids).collect()
    assert all(r.inertia == sum(x[2] for x in want) and r.cluster_inertia == sum(x[2] for x in want if x[1] == r.cluster) and r.centroid == at[r.cluster] for r in out)


def test_balls_leave_out_far_centroids():
    rnd = np.random.default_rng(4)
    centroids = rnd.integers(-10_000, 10_000, (30, 8))
    x = np.concatenate([c + rnd.integers(-300, 300, (50, 8)) for c in centroids])
    own, distance = ball_kmeans.nearest(x, centroids)
    best, d, made = ball_kmeans.by_balls(x, own, centroids)
    assert (best == own).all() and (d == distance).all() and made < 2 * len(x)  # of 30 a row
    best, d, _ = ball_kmeans.by_balls(x, rnd.integers(0, 30, len(x)), centroids)  # whatever the clusters that rows are in
    assert (best == own).all() and (d == distance).all()
    best, d, _ = ball_kmeans.by_balls(np.zeros((4, 1), np.int64), np.array([3, 2, 1, 0]), np.array([[2], [-2], [2], [2]]))
    assert best.tolist() == [0] * 4 and d.tolist() == [4] * 4  # ties: the smaller number


def test_ball_kmeans_of_few_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op11_ball_kmeans(spark, str(tmp_path)).count() == 0
    got, centroids = ball_kmeans.clustered(spark.createDataFrame([(1, [0.5]), (2, [0.5]), (3, [9.0])], "vec_id long, embedding array<float>"), k=40, dim=1)
    assert len(centroids) == 3 and {r.vec_id: (r.cluster in (0, 1, 2), r.distance) for r in got.collect()} == {1: (True, 0), 2: (True, 0), 3: (True, 0)}
