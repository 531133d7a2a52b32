"""Cleaning documents for training: each stage reads what its predecessor wrote.

toxicity: rows that the factorization machine scores at 0.5 or more go. near_duplicates: of each group
linked by five-word shingles at a Jaccard similarity of 0.8 or more, the row of least doc_id stays.
decontamination: rows that hold a benchmark item, whole or re-parameterised, go. secrets: found secrets
are replaced in the text by their kind. byte_bpe: whole texts become ids of the rank file.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe_codec, common, decontaminate, ngram_join, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of sf_dir's documents that are not held out, and drops the rows that score 0.5 or more.

    Null and empty texts score by the machine's bias; repeated rows score alike; rows without id stay or go by
    their text; other columns are not looked at; an empty table stays empty.
    """
    common.bound_batches(spark)
    labels = common.table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.drop_toxic(docs, toxicity.fit(common.table(spark, sf_dir, "documents"), labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by five-word shingles at 0.8 or more the one of least doc_id stays, those without id last.

    Rows with no words are linked with nothing and all stay, null texts and repeats included; of other equal rows
    one stays; columns may have any names; an empty table stays empty.
    """
    common.bound_batches(spark)
    return ngram_join.keep_one(docs, width=5, num=80, den=100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every row, repeats included, whose text holds an item of sf_dir's benchmark, whole or re-parameterised.

    Null and empty texts hold nothing; rows without id are searched, too; columns may have any names; an empty
    table, or an empty benchmark, drops nothing.
    """
    return decontaminate.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; secrets in its text become their kind in brackets. Null texts stay null; n_chars follows the new
    text; all other columns stay; an empty table stays empty."""
    common.bound_batches(spark)
    return secrets.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, n_bytes (what the ids decode to) of every row, repeats and null ids included; null and empty texts
    have no ids; other columns are left out; an empty table gives no rows."""
    common.bound_batches(spark)
    out = bpe_codec.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.octet_length("decoded").cast("long").alias("n_bytes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]

#: A learned score and byte-pair merges are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
