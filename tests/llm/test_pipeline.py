import re

import corpus_pipeline as P
from loomgraph.llm import ngram_join, toxicity
from loomgraph.llm.registry import queries

SF = "/root/testdata/sf0.001"


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30", "v30")
    rows = [(3, long, "a"), (1, near, "b"), (2, long, "c"), (4, "something else entirely, not like it at all", "d"), (4, "something else entirely, not like it at all", "d"), (None, long, "e"), (None, "only here and only here, without any id", "f"), (5, None, "g"), (6, "", "h"), (6, "", "h"), (7, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, ngram_join.keep_one(df).collect()), key=str)
    want = [rows[1], rows[3], rows[6], rows[7], rows[8], rows[9], rows[10]]
    assert got == sorted(want, key=str)
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_each_stage_takes_effect_and_keeps_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    counts = {}
    for name, stage in P.STAGES:
        docs = P.common.written(stage(spark, docs, SF), name)
        counts[name] = docs.count()
        if name != "byte_bpe":
            assert docs.columns == columns
    assert counts["toxicity"] < before and counts["near_duplicates"] < counts["toxicity"] and counts["decontamination"] < counts["near_duplicates"]
    assert counts["secrets"] == counts["byte_bpe"] == counts["decontamination"]
    assert not docs.where("size(ids) <> n_tokens").count()


def test_toxic_rows_go_by_the_score(spark):
    docs = spark.createDataFrame([(k, ("you are a fool and scum " if k % 2 else "a calm and kind reply ") + f"w{k}", "s") for k in range(200)], "doc_id long, text string, doc string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, m).collect()}
    assert kept == {r["doc_id"] for r in toxicity.score(docs, m).collect() if r["score"] < 0.5} == set(range(0, 200, 2))
    assert toxicity.drop_toxic(docs.limit(0), m).count() == 0


def test_every_number_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries() if k != "pipeline") == list(range(1, 14))


def test_stages_on_nulls_repeats_clashing_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    schema = docs.schema.add("key", "string").add("component", "long").add("score", "double").add("spans", "string").add("ids", "integer")
    text = "The same words again and again, twice in this table and no more than that, all told."
    rows = [(None, None, None, None, None), (None, text, "en", None, 3), (901, "", "en", "s", 0), (901, "", "en", "s", 0), (902, text, None, "s", None), (902, text, None, "s", None), (903, "my password=abcdefgh12345 is it", "en", "s", 31), (904, "long " * 50_000, "en", "s", 1)]
    odd = spark.createDataFrame([(*r, "k", 1, 0.5, "sp", 2) for r in rows], schema)
    for name, stage in P.STAGES:
        got = stage(spark, odd, SF)
        empty = stage(spark, odd.limit(0), SF)
        assert empty.count() == 0 and empty.columns == got.columns, name
        if name == "byte_bpe":
            assert got.count() == len(rows) and got.columns == ["doc_id", "n_tokens", "ids", "n_bytes"]
            continue
        assert got.columns == odd.columns, name
        kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in got.collect()))
        want = sorted((r[0] or 0, r[1] or "") for r in rows)
        if name == "near_duplicates":  # of the three rows with one text the first id stays, once
            want = [x for x in want if x != (0, text)]
            want.remove((902, text))
        if name == "secrets":
            want = sorted((d, "my [assign] is it" if d == 903 else t) for d, t in want)
        assert kept == want, name
