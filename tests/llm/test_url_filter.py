import numpy as np
import pytest

from loomgraph.llm import url_filter as L

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    best = None
    for rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best, RULES.get(best, "allow")


def test_matches_brute_force(spark):
    urls = [None, "", "x", "http://", "http://EXAMPLE.org/es/a?b#c", "https://a.b.example.org/en/12/3", "http://notexample.org/es/", "http://com/de/x", "http://x.com/de", "http://x.com?/de/", "http://x.com#/fr/", "http://ex.net/a://b.org/c", "http://ÀB.org/"]
    urls += [f"http://{h}.{d}/{lang}/{i}" for i, h in enumerate(["www.example", "m.q", "example"] * 40) for d in ("org", "com", "net") for lang in ("en", "es", "fr", "de")]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(list(RULES.items()), "rule string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in L.filter_urls(df, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert L.filter_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in L.filter_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    r = np.random.default_rng(2)
    keys = r.integers(-(2**63), 2**63, 4000)
    as_df = lambda x: spark.createDataFrame([(int(k), int(k) ^ 5) for k in x], "h long, g long")
    cascade = L.build_cascade(as_df(keys[:300]), as_df(keys))
    assert len(cascade.levels) > 1
    assert (cascade.has(keys.view(np.uint64)) == (np.arange(4000) < 300)).all()


def test_a_shared_hash_is_seen(spark):
    listed, universe = spark.createDataFrame([(1, 1)], "h long, g long"), spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "h long, g long")
    with pytest.raises(ValueError, match="share a hash"):
        L.build_cascade(listed, universe)


def test_a_filter_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_BYTES", 8)
    keys = spark.createDataFrame([(k, k) for k in range(90)], "h long, g long")
    with pytest.raises(ValueError, match="MOST_BYTES"):
        L.build_cascade(keys, keys)


def test_very_long_urls(spark):
    urls = ["http://example.org/es/" + "a" * 300_000, "http://" + "a." * 400 + "com/de/x", "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in L.filter_urls(df, spark.createDataFrame(list(RULES.items()), "rule string, verdict string")).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
