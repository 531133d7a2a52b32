import numpy as np
import pyarrow as pa

from loomgraph.llm import compression as C
from loomgraph.llm import toxicity as T


def corpus(spark, n=600):
    r = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "su", "to") for c in ("d", "n", "st")]
    rows, labels = [], []
    for i in range(n):
        own = [words[k] for k in r.integers(0, len(words), r.integers(20, 200))]
        good = i % 3 > 0
        rows.append((i, " ".join(own if good else [f"{w}$$$" if r.random() < 0.7 else w for w in own])))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_rows_and_calibration(spark):
    docs, labels = corpus(spark)
    m = C.fit(docs, labels.where(~T.held_out()))
    got = C.score(docs, m).join(labels, "doc_id").where(T.held_out()).toPandas()
    right = (got["score"] >= 0.5) == (got["quality"] == 1)
    assert len(got) > 80 and right.mean() > 0.97
    assert abs(got["score"].mean() - got["quality"].mean()) < 0.06


def test_whole_texts_count(spark):
    docs, labels = corpus(spark)
    m = C.fit(docs, labels)
    c = C.Compressors(m)
    text = next(iter(C.views(pa.array(["karad losun mitost nerad " * 20_000]))))
    late = next(iter(C.views(pa.array(["karad losun mitost nerad " * 10_000 + "karad$$$ losun$$$ mitost$$$ nerad$$$ " * 10_000]))))
    assert c.differences(text)[1] > c.differences(late)[1]


def test_odd_rows_and_missing_labels(spark):
    docs, labels = corpus(spark, 200)
    m = C.fit(docs, labels)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (2, "karad losun", 0.0), (2, "karad losun", 0.0), (3, "ä" * 300_000, 0.0)], "doc_id long, text string, score double")
    got = C.score(odd, m).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 5 and by[None] == by[1] and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] == 2} == {by[2]}
    assert C.score(docs.limit(0), m).count() == 0
    assert {r["score"] for r in C.score(odd, C.fit(docs, labels.limit(0))).collect()} == {0.5}
    only = {r["score"] for r in C.score(odd, C.fit(docs, labels.where("quality = 1"))).collect()}
    assert len(only) == 1 and only.pop() > 0.9
    few = C.fit(docs, labels.limit(4).unionByName(spark.createDataFrame([(1, None), (None, 1)], labels.schema)))
    assert all(0 <= r["score"] <= 1 for r in C.score(odd, few).collect())


def test_outlines_keep_kinds_and_repetitions():
    got = [x.decode() for _, x in C.views(pa.array(["The the the THE 12!", None, "the", "na na na", "été été"]))]
    assert got == ["Aaa aaa \x01 AAA 12!", "", "aaa", "aa \x01 \x01", "aaaaa \x01"]


def test_the_curve_is_that_of_least_loss():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 2)) * 0.1
    good = r.random(4000) < 1 / (1 + np.exp(-(0.5 + 20 * x[:, 0] - 8 * x[:, 1])))
    w = C.curve(x, good)
    assert np.allclose(w, [0.5, 20, -8], rtol=0.15, atol=0.1)
