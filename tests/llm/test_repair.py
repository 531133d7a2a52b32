import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomgraph.llm import repair

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a  b<|endoftext|>  c\n\n d", "\x1c,\x1c x", "  lead", "trail  ", "a　b \x85c's  don't", "", None, "  ", "ab " * 4000, "tie", "tie", "x" * 5000, "é ü\tñ"]


def test_round_trip_offsets_and_checksums(spark, monkeypatch):
    rows = [(9 - i if i % 2 else 50 + i, t, i) for i, t in enumerate(TEXTS)] + [(None, "no id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = repair.repair_token_files(df, PATH, 2, 50257).collect()
    tokenizer = Tokenizer.from_file(PATH)
    at, want = 0, []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_grammar_ranges_and_runs():
    r = np.random.default_rng(1)
    for ids in (np.zeros(1000, np.uint32), r.integers(0, 9, 5000).astype(np.uint32), np.tile(np.arange(37, dtype=np.uint32), 90), np.zeros(0, np.uint32), np.array([5], np.uint32)):
        symbols, rules, lengths = repair.compress(ids, 100, 60)
        g = repair.Grammar(100, 2, rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u2").tobytes(), repair.sampled_offsets(symbols, 100, lengths).astype("<i8").tobytes())
        assert (g.ids() == ids).all() and len(rules) <= 60
        for a, b in ((0, 3), (10, 700), (len(ids) - 2, len(ids) + 9)):
            assert (g.ids(max(0, a), b) == ids[max(0, a) : b]).all()
        if len(ids) > 10:
            assert len(symbols) < len(ids)


def test_random_access_and_empty_table(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * 30) for i in range(20)], "doc_id long, text string")
    out = repair.shared_dir(spark, "t")
    repair.write_token_files(df.coalesce(1), out, PATH, 2, 50257)
    docs = {r["doc_id"]: np.frombuffer(r["ids"], "<u4") for r in repair.read_token_files(spark, out).collect()}
    first = spark.read.parquet(out).select("part", "seq").orderBy("part", "seq").first()
    assert (repair.read_id_range(spark, out, first["part"], first["seq"], 5, 60) == docs[0][5:60]).all()
    assert repair.repair_token_files(df.limit(0), PATH, 2, 50257).count() == 0


def test_long_runs_are_halved_each_round():
    r = np.random.default_rng(2)
    mixed = np.concatenate([x for k in range(40) for x in (r.integers(10, 60, 30), np.full(int(r.integers(2, 90)), k % 3))])
    for ids, most in ((np.zeros(1 << 12, np.uint32), 16), (np.concatenate([np.zeros(4001), np.arange(1, 60)]), 80), (mixed, len(mixed))):
        ids = ids.astype(np.uint32)
        symbols, rules, lengths = repair.compress(ids, 100, 60)
        g = repair.Grammar(100, 2, rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u2").tobytes(), repair.sampled_offsets(symbols, 100, lengths).astype("<i8").tobytes())
        assert (g.ids() == ids).all() and len(symbols) <= most


def test_a_range_expands_only_what_reaches_into_it(monkeypatch):
    r = np.random.default_rng(4)
    monkeypatch.setattr(repair, "EVERY", 64)
    ids = np.concatenate([np.tile(r.integers(0, 50, 40), 30), r.integers(0, 50, 3000)]).astype(np.uint32)
    symbols, rules, lengths = repair.compress(ids, 100, 400)
    g = repair.Grammar(100, 2, rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u2").tobytes(), repair.sampled_offsets(symbols, 100, lengths).astype("<i8").tobytes())
    expanded, measured = [], []
    expand, length = repair.Grammar.expand, repair.Grammar._length
    monkeypatch.setattr(repair.Grammar, "expand", lambda self, s: (expanded.append(len(s)), expand(self, s))[1])
    monkeypatch.setattr(repair.Grammar, "_length", lambda self, s: (measured.append(len(s)), length(self, s))[1])
    for a in (0, 1, 700, 1199, 2500, len(ids) - 1):
        assert (g.ids(a, a + 1) == ids[a : a + 1]).all()
        assert (g.ids(a, a + 150) == ids[a : a + 150]).all()
    assert max(expanded[::2]) == 1 and max(measured) <= 64 * 4
