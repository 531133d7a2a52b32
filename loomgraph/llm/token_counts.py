"""Token counts through a digest cache: a Parquet table of (digest, n_tokens) that only grows.

A digest covers the tokenizer's version (a digest of its file) and the normalised text, so that one
cache serves many tokenizers and a changed file never meets stale counts. Each call joins the digests of
its texts to the cache, encodes every distinct text that is missing once, and appends the counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import groups, segment_counts
from .common import shared_dir, tidy

CACHE_SCHEMA = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> tuple[str, bool]:
    """(digest of the file, whether the tokenizer itself makes white space one space and then drops it)."""
    raw = open(path, "rb").read()
    spec = json.loads(raw)
    steps = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
    folds = any(x.get("type") == "Replace" and x.get("pattern", {}).get("Regex") == r"\s+" and x.get("content") == " " for x in steps)
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    drops = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and bool(pre[0].get("invert"))
    return hashlib.sha256(raw).hexdigest(), folds and drops


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A row a digest, however often runs at the same time or retried ones appended it; nothing where there is no cache yet."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(path)
        return found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task passes each digest on once, so that a text with very many copies stays small in the shuffle."""
    seen: set[bytes] = set()
    for batch in batches:
        at = []
        for i, x in enumerate(batch.column(0).to_pylist()):
            if x not in seen:
                seen.add(x)
                at.append(i)
        yield batch if len(at) == batch.num_rows else batch.take(pa.array(at, pa.int64()))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = segment_counts(path)
        for batch in _once(batches):
            n = [x for some in groups(batch.column(1)) for x in counts.per_text(some, sum)]
            yield pa.record_batch({"digest": batch.column(0), "n_tokens": pa.array(n, pa.int64())})

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many tokens each whole text has, as the tokenizers library gives them for tokenizer_path.

    No begin, end or padding tokens, no truncation; special strings inside texts as the library does by
    default. Returns one row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit. Null texts count
    as empty: 0 bytes, 0 tokens. Null doc_ids and repeated rows come out as they are; extra columns are
    left out; an empty table gives no rows. cache_path: a folder for the cache, in a store that driver and
    executors share; a new one in the shared folder where not given.
    """
    spark = docs.sparkSession
    cache_path = cache_path or shared_dir(spark, "token-counts")
    version, folds = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # texts alike up to white space have equal counts where the tokenizer folds it itself
    norm = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")) if folds else text
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(F.concat(F.lit(version + "\n"), norm), 256)).alias("digest"), norm.alias("norm"))
    cache = read_cache(spark, cache_path)
    missing = keyed.select("digest", "norm").mapInArrow(tidy(_once), "digest binary, norm string").join(cache, "digest", "left_anti")
    missing.repartition("digest").mapInArrow(tidy(_counted(tokenizer_path)), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return keyed.join(read_cache(spark, cache_path), "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
