import numpy as np

from loomgraph.llm import toxicity as T


def corpus(spark):
    r = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{r.integers(300)}" for _ in range(30)]
        kind = i % 3
        if kind == 0:
            words[5], words[20] = "dolt", "groupname"  # only both together are toxic
        elif kind == 1:
            words[7] = "dolt"
        else:
            words[9] = "groupname"
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_needs_pairs(spark):
    docs, labels = corpus(spark)
    m = T.fit(docs, labels.where(~T.held_out()))
    got = {r["doc_id"]: r["score"] for r in T.score(docs, m).where(T.held_out()).collect()}
    assert len(got) > 100
    assert np.mean([(s >= 0.5) == (i % 3 == 0) for i, s in got.items()]) > 0.95


def test_nulls_repeats_and_no_labels(spark):
    docs, labels = corpus(spark)
    m = T.fit(docs, labels)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (2, "dolt groupname", 0.0), (2, "dolt groupname", 0.0), (3, "dolt, GROUPNAME! " * 40_000, 0.0)], "doc_id long, text string, score double")
    got = T.score(odd, m).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert len(got) == 5 and by[None] == by[1] and len(set(by[2])) == 1 and by[3][0] == by[2][0]
    assert all(0 <= r["score"] <= 1 for r in got)
    blank = T.fit(docs, labels.limit(0))
    assert T.score(docs.limit(5), blank).count() == 5 and T.score(docs.limit(0), m).count() == 0


def test_scores_add_weights_and_products_of_pairs():
    r = np.random.default_rng(5)
    input_of = np.full(T.BUCKETS, -1, np.int64)
    buckets = r.choice(T.BUCKETS, 12, replace=False)
    input_of[buckets] = np.arange(12)
    m = T.Machine(input_of, 0.3, r.normal(size=12), r.normal(size=(12, 3)))
    texts = [np.array([0, 3, 7, 3]), np.array([], np.int64), np.arange(12), np.array([5])]
    want = []
    for x in texts:
        own = sorted(set(x.tolist()))
        want.append(0.3 + sum(m.weights[i] for i in own) + sum(float(m.vectors[i] @ m.vectors[j]) for i in own for j in own if i < j))
    text = np.repeat(np.arange(4), [len(x) for x in texts])
    assert np.allclose(m.logits(text, buckets[np.concatenate(texts)], 4), want)
    # buckets that are no inputs count for nothing
    other = next(b for b in range(T.BUCKETS) if input_of[b] < 0)
    assert np.allclose(m.logits(np.array([0]), np.array([other]), 1), [0.3])


def test_pairs_tell_what_weights_alone_cannot(spark):
    docs, labels = corpus(spark)
    m = T.fit(docs, labels.where(~T.held_out()))
    linear = T.Machine(m.input_of, m.bias, m.weights, np.zeros_like(m.vectors))
    right = lambda x: np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in T.score(docs, x).where(T.held_out()).collect()])
    assert right(m) > 0.95 > right(linear) + 0.1


def test_rows_without_id_are_held_out(spark):
    df = spark.createDataFrame([(None,), (1,), (5,)], "doc_id long")
    assert df.where(T.held_out()).where("doc_id is null").count() == 1
