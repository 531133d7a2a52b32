"""URL filters by a cascade of Bloom filters: exact membership without joins.

The first filter holds the listed keys. The second holds those keys of the corpus that are not listed but
pass the first, the third the listed keys that pass the second, and so on, until nothing passes wrongly.
As the cascade is built over every key of the corpus, the first filter that a key fails tells whether it
is listed: none of the corpus's keys is judged wrongly. The filters take about two bytes a listed key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, written
from .textkernel import U, mix

#: Bits a key in a filter, and the positions each key sets.
BITS, PROBES = 10, 4
#: Levels after which the build gives up; each lets about 1 % of the keys through.
MOST_LEVELS = 60
#: Bytes of a cascade that go to every task at most, some 400 million listed keys.
MOST_BYTES = 1 << 30


def _positions(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    """(keys, PROBES) bit positions of 64-bit hashes."""
    a = mix(h + U(level * 0x9E3779B97F4A7C15 % 2**64))
    b = mix(a + U(0xD1B54A32D192ED03)) | U(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % U(bits)


@dataclass
class Bloom:
    level: int
    bits: int
    words: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        at = _positions(h, self.level, self.bits)
        return ((self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)).all(axis=1)


@dataclass
class Cascade:
    levels: list[Bloom]

    def has(self, h: np.ndarray) -> np.ndarray:
        """Listed or not, for hashes of keys of the corpus that it was built over."""
        out = np.zeros(len(h), bool)
        left = np.arange(len(h))
        for k, level in enumerate(self.levels):
            passed = level.has(h[left])
            out[left[~passed]] = k % 2 == 1
            left = left[passed]
        out[left] = len(self.levels) % 2 == 1
        return out


def _words(level: int, bits: int):
    """Per task, the filter's words that its keys touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, int] = {}
        for batch in batches:
            at = _positions(batch.column(0).to_numpy().view(np.uint64), level, bits).ravel()
            for w, b in zip((at >> U(6)).tolist(), (at & U(63)).tolist()):
                words[w] = words.get(w, 0) | 1 << b
        yield pa.record_batch({"word": pa.array(list(words), pa.int64()), "set": pa.array(np.array(list(words.values()), np.uint64).view(np.int64))})

    return run


def _bloom(keys: DataFrame, n: int, level: int) -> Bloom:
    bits = max(64, n * BITS)
    words = np.zeros(-(-bits // 64), np.uint64)
    if words.nbytes > MOST_BYTES:
        raise ValueError(f"{n} listed keys need a filter of {words.nbytes} bytes, more than MOST_BYTES")
    found = keys.mapInArrow(tidy(_words(level, bits)), "word long, set long").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()  # no more than the filter has words
    words[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return Bloom(level, bits, words)


def _passing(f: Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(f.has(batch.column(0).to_numpy().view(np.uint64))))

    return run


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed and universe: 64-bit hashes of keys in a column h, and other hashes of the same keys in a column g.

    universe may hold listed keys too, and repeats. A key that is not listed but has the h of one that is
    shows by its g: the filters could not tell the two apart, so the build raises ValueError.
    """
    keys = lambda df: df.select("h", "g").where("h is not null").distinct()
    named = written(keys(listed), "cascade-listed")
    others = written(keys(universe).join(named, ["h", "g"], "left_anti"), "cascade-universe")
    if not others.join(named.select("h"), "h", "left_semi").isEmpty():
        raise ValueError("listed and unlisted keys share a hash")
    inside, outside = named.select("h"), others.select("h")
    levels: list[Bloom] = []
    n = inside.count()
    while n:
        if len(levels) >= MOST_LEVELS:
            raise ValueError(f"{n} keys still pass after {MOST_LEVELS} filters")
        level = _bloom(inside, n, len(levels))
        levels.append(level)
        inside, outside = written(outside.mapInArrow(tidy(_passing(level)), "h long"), "cascade-level"), inside
        n = inside.count()
    return Cascade(levels)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path from there up to
    ? # or the end. Both empty for a null or other url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key by which a rule could fit: each suffix of the host at a dot, with the path's first characters
    in each of the lengths that rules have; longest first, of equal ones the longer host."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    reach = F.filter(F.array(*(F.lit(x) for x in lengths)), lambda x: x <= F.length(path))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(reach, lambda x: F.struct((-F.length(h) - x).alias("o"), (-F.length(h)).alias("p"), F.concat(h, F.substring(path, F.lit(1), x)).alias("key")))))
    return F.transform(F.array_sort(keys), lambda k: k["key"])


def _judged(cascades: Broadcast[tuple[Cascade, Cascade]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, blocked = cascades.value
        for batch in batches:
            hashes = batch.column("hashes")
            sizes = hashes.value_lengths().to_numpy(zero_copy_only=False)
            flat = hashes.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            begin = np.cumsum(sizes) - sizes
            on = np.flatnonzero(listed.has(flat))
            first = np.full(len(sizes), -1, np.int64)
            first[row[on][::-1]] = on[::-1]  # the first of a row is written last
            fits = first >= 0
            bad = np.zeros(len(sizes), bool)
            bad[fits] = blocked.has(flat[first[fits]])
            which = np.where(fits, first - begin + 1, 0)
            yield batch.drop_columns(["hashes"]).append_column("which", pa.array(which.astype(np.int32))).append_column("blocked", pa.array(bad))

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The verdict on every row's url by the longest rule that fits it.

    rules: rule (host + path, like `example.org/es/`) and verdict (allow or block). A rule fits its host and
    all subdomains if the path starts with the rule's. Returns id, host, path, rule (null where none fits),
    verdict (then the default: the url is on no list). Null urls and those without :// have an empty host
    and path and fit no rule but one for them. Rows and repeats are kept; extra columns are left out; an
    empty table gives no rows. Of rules given twice with both verdicts, block holds.
    """
    rules = written(rules.select(F.col("rule").alias("key"), F.lower("verdict").alias("verdict")).where("key is not null").groupBy("key").agg(F.max("verdict").alias("verdict")), "url-rules")
    lengths = sorted(r[0] for r in rules.select(F.when(F.instr("key", "/") > 0, F.length("key") - F.instr("key", "/") + 1).otherwise(0)).distinct().collect())
    host, path = url_parts(F.col(url_col))
    d = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>"))
    hashes = F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g")
    universe = d.select(F.explode("keys").alias("key")).select(*hashes)
    hashed = rules.select(*hashes, "verdict")
    listed = build_cascade(hashed, universe)
    blocked = build_cascade(hashed.where("verdict = 'block'"), hashed)
    d = d.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    both = pages.sparkSession.sparkContext.broadcast((listed, blocked))  # within MOST_BYTES each
    out = d.mapInArrow(tidy(_judged(both)), f"id {dict(d.dtypes)['id']}, host string, path string, keys array<string>, which int, blocked boolean")
    fits = F.col("which") > 0
    return out.select(F.col("id").alias(id_col), "host", "path", F.when(fits, F.get("keys", F.col("which") - 1)).alias("rule"), F.when(fits, F.when(F.col("blocked"), "block").otherwise("allow")).otherwise(default).alias("verdict"))
