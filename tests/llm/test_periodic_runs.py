import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import periodic_runs as P
from loomgraph.llm import registry


def brute(x):
    """Every lag, every stretch of equal words that far apart, word by word."""
    out = {}
    for p in range(1, len(x) // 4 + 1):
        i = 0
        while i + p < len(x):
            if x[i] != x[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                out.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=7), st.integers(1, 9)), max_size=8))
def test_runs_equal_brute_force(parts):
    x = [w for block, times in parts for w in block * times]
    assert P.find_runs(np.array(x, np.int64)) == brute(x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=9), st.integers(1, 9)), max_size=8))
def test_lags_that_are_left_out_have_no_run(parts):
    x = np.array([w for block, times in parts for w in block * times], np.int64)
    held = P.SIEVE, P.NEAR
    try:
        P.SIEVE, P.NEAR = 6, 1
        assert P.find_runs(x) == brute(x.tolist())
    finally:
        P.SIEVE, P.NEAR = held


def test_a_run_stands_under_its_smallest_period_and_ends_where_it_breaks():
    words = "x a b a b a b a b y".split()
    assert P.find_runs(P._number(words)) == [(1, 8, 2)]
    assert P.collapse(words, [(1, 8, 2)]) == "x a b y"
    assert P.find_runs(P._number(["z"] * 5)) == [] and P.find_runs(P._number(["z"] * 6)) == [(0, 6, 1)]


def test_very_long_texts():
    r = np.random.default_rng(3)
    x = r.integers(0, 500, 60_000)
    x[20_000:50_000] = np.tile(x[20_000:26_000], 5)
    x[55_000:55_900] = np.tile(x[55_000:55_100], 9)
    assert [(p, n >= 4 * p) for _, n, p in P.find_runs(x)] == [(6_000, True), (100, True)]
    assert P.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def test_odd_rows(spark):
    rows = [(None, "a a a a a a", "x"), (1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "q r " * 4 + "\t\n", "x"), (4, "w " * 40_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = P.periodic_runs(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and [tuple(x) for x in by[None]["runs"]] == [(0, 6, 1)] and by[None]["collapsed"] == "a"
    assert by[1]["runs"] == [] and by[1]["collapsed"] == "" and by[1]["n_words"] == 0
    assert by[3]["n_words"] == 4 and by[3]["runs"] == [] and by[4]["collapsed"] == "w"  # a no-break space is part of a word
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_the_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in registry.op11_periodic_runs(spark, sf).collect()}
    tails = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, tails = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], tails + 1
        runs = brute(w)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        r = got[d["doc_id"]]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{x},{p}\n" for s, x, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert tails > 5
