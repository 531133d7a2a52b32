import random
import re

import numpy as np

from loomgraph.llm.components import connected_components
from loomgraph.llm.ngram_join import ngram_jaccard_join


def brute(rows, width, num, den):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)], links[i]) for i, (doc, _) in enumerate(rows))


def near_copies(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, base = [], None
    for k in range(n):
        if k % 6 == 0 or base is None:
            base = [r.choice(vocab) for _ in range(r.choice([3, 4, 5, 30, 80, 150]))]
        words = list(base)
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((k * 7 % 997, " ".join(words)))
    rows += [(2001, None), (2002, ""), (2003, " \n\t"), (2004, "One two"), (2005, "one TWO"), (2006, "é two")]
    return rows


def test_against_brute_force(spark):
    for seed, width, num, den in ((1, 4, 85, 100), (2, 5, 80, 100), (3, 2, 50, 100)):
        rows = near_copies(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, ngram_jaccard_join(df, width, num, den).collect())) == brute(rows, width, num, den)


def test_blocks_of_a_large_candidate_group(spark, monkeypatch):
    from loomgraph.llm import ngram_join

    for name, value in (("BLOCK", 900), ("LEAST", 1), ("SKETCHES", 6), ("ROWS", 10)):
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(50):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            words[r.randrange(len(words))] = f"x{r.randrange(9)}"
        rows.append((k, " ".join(words[: r.choice([120, 120, 110, 100])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_jaccard_join(df, 4, 85, 100).collect())) == brute(rows, 4, 85, 100)


def test_repeated_rows_nulls_and_extra_columns(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (None, text, None), (7, "q", None)], "doc_id long, text string, component_id string")
    got = sorted(map(tuple, ngram_jaccard_join(df, 4, 85, 100).collect()), key=str)
    assert got == sorted([(1, 7, 1, 2), (1, 7, 1, 2), (None, 7, 1, 2), (7, 1, 7, 0)], key=str)
    assert ngram_jaccard_join(df.limit(0), 4, 85, 100).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_very_long_texts_among_many_short_ones(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    near = list(words)
    for _ in range(700):
        near[r.randrange(len(near))] = "other"
    far = list(words)
    for _ in range(9000):
        far[r.randrange(len(far))] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "x" * 3_000_000), (5, "short one here it is")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_jaccard_join(df, 4, 85, 100).collect())) == brute(rows, 4, 85, 100)


def test_candidates_hold_every_linked_pair():
    """Of two linked sets at least the bound of the smaller one's keys are shared, whatever is frequent."""
    from loomgraph.llm import ngram_join as J

    r = np.random.default_rng(3)
    for _ in range(400):
        n, num, den = int(r.integers(4, 400)), *((80, 100), (85, 100), (50, 100))[r.integers(3)]
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        gone, new = int(r.integers(0, n // 3 + 1)), int(r.integers(0, n // 3 + 1))
        y = np.unique(np.concatenate([r.permutation(x)[gone:], r.integers(0, 2**63, new).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if not common or den * common < num * (len(x) + len(y) - common) or (len(x) == len(y) == common):
            continue
        frequent = r.permutation(np.union1d(x, y))[: int(r.integers(0, len(x) + len(y) - common + 1))]
        k = J.size_range(min(len(x), len(y)))
        (a, at_least), (b, other) = (J.parts_of(s, np.setdiff1d(s, frequent), k, num, den) for s in (x, y))
        shared = len(np.intersect1d(a, b))
        assert shared >= min(at_least, other) >= 1


def test_keep_one_with_any_column_names(spark):
    from loomgraph.llm.ngram_join import keep_one

    words = " ".join(f"w{k}" for k in range(40))
    rows = [(1, words, "x", 1), (1, words, "y", 2), (2, words + " tail", "z", 3), (3, "other words stand here alone", "v", 4), (None, None, "n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__id` string, `a.b` int").selectExpr("*", "7 AS __key")
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, [(1, words), (3, rows[3][1]), (None, None)]))
