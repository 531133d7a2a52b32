import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from loomgraph.llm import bpe, bpe_codec, token_counts

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["", None, "a  b\n\n c", "it's  DON'T 12345 ½x", "\x1c,\x1c x", "naïve　ü\t\tñ", "<|endoftext|> <|startoftext|>x", "￿\U000e0000 ԯՈ", " " * 90, "ab" * 500]


def long_texts():
    r = random.Random(3)
    yield " ".join(r.choice(["alpha", "é", "12", "\n", "", "x's", "..."]) for _ in range(40_000))
    yield "z" * 100_000  # no border in any overlap
    yield "ok " * 11_000 + " " * 40_000 + "end" + "՘ " * 20_000
    yield ("word\n" * 7000)[: bpe_codec.CHUNK * 1]


def test_round_trip_of_chunks(spark):
    codec = bpe.rank_encoding(RANKS, P.PATTERN)
    assert isinstance(codec, tiktoken.Encoding)
    texts = [*ODD, *long_texts()]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(len(texts) - 3, texts[-3], "again"), (None, texts[-4], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], list(r["ids"]), bytes(r["decoded"])) for r in bpe_codec.bpe_round_trip(df, RANKS, P.PATTERN).collect()))
    want = sorted((-1 if i is None else i, len(x := codec.encode_ordinary(t or "")), x, (t or "").encode()) for i, t, _ in rows)
    assert [hashlib.md5(repr(x).encode()).hexdigest() for x in got] == [hashlib.md5(repr(x).encode()).hexdigest() for x in want]
    assert bpe_codec.bpe_round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_seams_split_long_texts():
    text = next(long_texts())
    n, c = -(-len(text) // bpe_codec.CHUNK), bpe_codec.CHUNK
    chunks = [text[i * c : (i + 1) * c + bpe_codec.OVERLAP] for i in range(n)]
    both = [bpe_codec.borders(x, P.PATTERN, bpe_codec.OVERLAP, c) for x in chunks]
    pieces = list(bpe_codec.stitch(chunks, [b[0] for b in both], [b[1] for b in both]))
    assert "".join(pieces) == text and len(pieces) == n > 2


def test_segments_give_whole_text_ids():
    for path, name in ((WORDS, "words"), (P.path("byte_bpe_50k.json"), "bytes")):
        whole = Tokenizer.from_file(path)
        texts = [t or "" for t in ODD]
        assert bpe.Segments(path, len).per_text(texts, sum) == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts], name


def test_segments_of_odd_texts():
    """Letters that change when folded, contractions, special strings, marks, and punctuation in every order."""
    r = random.Random(1)
    bits = ["a", "é", "Z", "9", "Σ", "ſ", "\u0301", "_", "'s", "don't", "<|endoftext|>", " ", "  ", "\n", "\xa0", ".", "#", "€", "×", "ǰ", "İ", "K", "中", "😀", "x1", "½", "ᵃ", "ß"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(5000)]
    for path in (WORDS, P.path("byte_bpe_50k.json")):
        whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
        assert bpe.Segments(path, tuple).per_text(texts, lambda parts: [i for p in parts for i in p]) == [e.ids for e in whole]


def test_cache_grows_by_distinct_misses_only(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, "a b c"), (51, "A  b\nC "), (None, "a b c"), (52, "fresh " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = token_counts.shared_dir(spark, "cache")
    whole = Tokenizer.from_file(WORDS)
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    first = token_counts.count_tokens(df, WORDS, path)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, first.collect())) == want
    n = spark.read.parquet(path).count()
    assert n == spark.read.parquet(path).select("digest").distinct().count()
    again = token_counts.count_tokens(df.union(spark.createDataFrame([(99, "new one")], df.schema)), WORDS, path)
    assert again.count() == len(rows) + 1 and spark.read.parquet(path).count() == n + 1
    assert token_counts.count_tokens(df.limit(0), WORDS, path).count() == 0


def test_a_cache_that_has_digests_twice_gives_each_row_once(spark):
    df = spark.createDataFrame([(1, "a b c", 7), (2, "d e", 8), (3, None, 9)], "doc_id long, text string, n_tokens long")
    path = token_counts.shared_dir(spark, "cache")
    want = sorted(map(tuple, token_counts.count_tokens(df, WORDS, path).collect()))
    spark.read.parquet(path).coalesce(1).write.mode("append").parquet(path)
    assert sorted(map(tuple, token_counts.count_tokens(df, WORDS, path).collect())) == want and len(want) == 3
    assert spark.read.parquet(path).count() == 6  # nothing was missing


def test_copies_of_long_texts(spark):
    long = "word and wörd " * 4000
    df = spark.createDataFrame([(None, long)] * 3 + [(7, long)] * 2 + [(8, long + "x")], "doc_id long, text string").repartition(2)
    ranks, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    got = sorted(((r["doc_id"] or 0, bytes(r["decoded"]).decode(), tuple(r["ids"])) for r in bpe_codec.bpe_round_trip(df, ranks, pattern).collect()))
    ids = tuple(bpe.rank_encoding(ranks, pattern).encode_ordinary(long))
    assert [(d, t == long, i == ids) for d, t, i in got] == [(0, True, True)] * 3 + [(7, True, True)] * 2 + [(8, False, False)]


def test_columns_of_texts_look_up_each_segment_once(monkeypatch):
    path = P.path("byte_bpe_50k.json")
    rng = random.Random(5)
    alphabet = [*" \n\t\xa0\x85  　ab1.,'<|>éàßİ×ǿȺ日́’\x1c"]
    texts = ["", "  ", "\xa0  b", "é, à  b", "<|endoftext|> a.b<|endoftext|>c", "ab×, ÷. İ, ǿ. Ⱥ, ɏ!", *("".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(4000))]
    want = [[*e.ids, 2] for e in bpe.library_tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    encode = bpe.segment_ids(path)
    column = pa.array(["x", *texts, None]).slice(1)  # an offset, and a null
    got = [encode.per_column(some, 2) for some in bpe.slices(column, 1000)]
    assert len(got) > 10
    assert [i for ids, _ in got for i in ids.tolist()] == [i for w in want for i in w] + [2]
    assert [n for _, sizes in got for n in sizes.tolist()] == [*map(len, want), 1]
    looked = []
    monkeypatch.setattr(bpe.Segments, "__getitem__", lambda self, x: (looked.append(x), dict.__getitem__(self, x))[1], raising=False)
    encode.per_column(pa.array(["x", " the same words", *[" the same words" * 50] * 40]), 2)
    assert sorted(looked) == [" same", " the", " words", "x"]
