import collections
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from loomgraph.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + d for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for d in range(8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def stats(texts):
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    rows = [r for b in Q._stats(iter([batch])) for r in b.to_pylist()]
    return [tuple(r[k] for k in Q.BASE) for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é|　", max_size=120), min_size=1, max_size=6))
def test_statistics_match_brute_force(texts):
    assert stats(texts) == [brute(x) for x in texts]


def test_nulls_empty_and_long_texts():
    texts = [None, "", "a " * 50_000, "x" * 3_000_000, "one\none\n\n \none", None]
    assert stats(texts) == [brute(x) for x in texts]


def test_learnt_list_is_one_expression_and_separates(spark):
    r = np.random.default_rng(0)
    good = [" ".join(f"w{r.integers(500)}" for _ in range(60)) for _ in range(150)]
    bad = [" ".join(f"w{r.integers(500)}###" for _ in range(60)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(900, None), (None, 0)], "doc_id long, quality int")
    rules = Q.fit_rules(docs, labels)
    out = Q.apply_rules(docs, rules).collect()
    assert rules and {x["doc_id"] for x in out if x["kept"]} == set(range(150))
    assert sum(x["doc_id"] is None for x in out) == 1 and len(out) == 302
    assert Q.fit_rules(docs, labels.where("quality = 1")) == []
    assert all(x["kept"] == (not x["base_failed"]) for x in Q.apply_rules(docs, []).collect())
    assert Q.apply_rules(docs.limit(0), rules).count() == 0


def test_every_count_is_computed():
    line = "One two two # 3, four five six seven eight nine!\n"
    batch = pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": pa.array([line * 3])})
    row = next(Q._stats(iter([batch]))).to_pylist()[0]
    assert set(row) == {"doc_id", *Q.COUNTS} and all(row[k] > 0 for k in Q.COUNTS)


def test_verdicts_match_brute_force_and_repeated_labels_change_nothing(spark):
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{r.integers(400)}{'#' if r.random() < 0.4 * (i % 2) else ''}" for _ in range(r.integers(5, 80))) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, rule string, n_words int")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(240)], "doc_id long, quality int")
    rules = Q.fit_rules(docs, labels)
    assert rules and Q.fit_rules(docs, labels.union(labels).union(labels)) == rules
    out = {x["doc_id"]: x for x in Q.apply_rules(docs, rules).collect()}
    stats = Q.text_statistics(docs).selectExpr("doc_id", *(f"cast({sql} as double) as {k}" for k, sql in Q.FEATURES.items())).toPandas()
    for i, row in stats.set_index("doc_id").iterrows():
        fires = [k for k, rule in enumerate(rules, 1) if all((row[name] >= cut) if up else (row[name] < cut) for name, up, cut in rule.conditions)]
        assert out[i]["rule"] == (fires[0] if fires else None)
        assert out[i]["kept"] == (not out[i]["base_failed"] and not fires)
