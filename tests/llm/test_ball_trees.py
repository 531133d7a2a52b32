import hashlib

import numpy as np

from loomgraph.llm import ball_trees as B


def brute(rows, k, rounds, tag="2"):
    """rows: (id, integer vector). Plain Lloyd rounds in Python's integers."""
    h = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"{tag}:{i}".encode()).hexdigest())
    centroids = [list(v) for _, v in sorted(rows, key=lambda r: (h(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return [(i, near(v)[1], near(v)[0]) for i, v in rows], centroids


def cloud(n, dims, spread, seed):
    r = np.random.default_rng(seed)
    return (r.normal(size=(12, dims))[r.integers(0, 12, n)] * spread + r.normal(size=(n, dims)) * 0.05).astype(np.float32)


def check(spark, vectors, k=7, rounds=3, parts=3, **over):
    dims = vectors.shape[1]
    ids = list(range(100, 100 + len(vectors)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>").repartition(parts)
    rows = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in zip(ids, vectors)]
    want, centroids = brute(rows, k, rounds)
    got = B.cluster(df, k, rounds, dims=dims, **over).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    total = sum(d for *_, d in want)
    for r in got:
        assert r["centroid"] == centroids[r["cluster"]] and r["inertia"] == total
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])


def test_rounds_equal_plain_lloyd(spark):
    check(spark, cloud(700, 6, 3.0, 1))
    check(spark, cloud(300, 64, 0.2, 2), k=20, rounds=2)
    check(spark, cloud(60, 5, 1e5, 3), rounds=2)  # beyond what doubles hold exactly


def test_ties_go_to_the_smaller_number_and_equal_vectors_stay_together(spark):
    v = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0, 0.0]] * 40, np.float32)
    check(spark, v, k=5, rounds=4)
    check(spark, np.ones((500, 3), np.float32), k=4)


def test_whole_balls_and_leaves_agree_with_all_distances():
    r = np.random.default_rng(4)
    v = np.floor(256 * cloud(3000, 8, 3.0, 5)).astype(np.int64)
    t = B.Tree.read(*B.Tree.of(list(range(len(v))), v).row())
    assert sorted(t.ids) == list(range(len(v))) and (t.vectors == v[t.ids]).all()
    for lo_hi, s, radius in zip(t.spans, t.sums, t.radii):
        own = t.vectors[lo_hi[0] : lo_hi[1]]
        assert (own.sum(0) == s).all() and np.sqrt(((own - own.mean(0)) ** 2).sum(1)).max() <= radius * (1 + 1e-9)
    centroids = v[r.choice(len(v), 15, replace=False)]
    balls, to, places, near = t.assign(centroids)
    cluster = np.full(len(v), -1)
    for (lo, hi), c in zip(t.spans[balls, :2], to):
        assert (cluster[lo:hi] == -1).all()
        cluster[lo:hi] = c
    assert (cluster[places] == -1).all() and len(balls) and (t.spans[balls, 1] - t.spans[balls, 0]).max() > B.LEAF
    cluster[places] = near
    assert (cluster == ((t.vectors[:, None] - centroids) ** 2).sum(2).argmin(1)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [0.3, 0.4]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-0.001, 0.001])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string")
    got = B.cluster(df, 40, 2, dims=2).collect()
    assert sorted((r["vec_id"] or -1) for r in got) == [-1, 1, 1, 8] and all(r["distance"] == 0 for r in got)
    assert B.whole_vectors(df, dims=2).where("vec_id = 8").first()["vector"] == [-1, 0]
    assert B.cluster(df.limit(0), dims=2).count() == 0 and B.cluster(df.where("vec_id = 4"), dims=2).count() == 0
