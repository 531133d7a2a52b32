"""What the operators of this subpackage share: tables, the shared folder, an id-per-row view of a table."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The queries have Spark send texts to Python workers in batches of about so many bytes, however long single ones are.
ARROW_BYTES = 1 << 24
#: A table of keys is broadcast up to so many rows (some 30 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=8)
def _local_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder in the store that driver and executors share, which the cluster names in spark.checkpoint.dir.

    Only in local mode, where all tasks run in the driver's process, may it be unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends in files that survive lost executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string, never null); whatever else the table holds is pruned from the scan."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that keys (doc_id, key: xxhash64 of the text, a null one as empty) name.

    All columns stay. keys is counted first: only up to BROADCAST_ROWS rows go to every task.
    """
    mark, own = f"row_{uuid.uuid4().hex}", f"key_{uuid.uuid4().hex}"  # no column of docs
    k = keys.select(F.col("doc_id").alias(mark), F.col("key").alias(own))
    k = F.broadcast(k) if keys.count() <= BROADCAST_ROWS else k
    same = docs[id_col].cast("long").eqNullSafe(k[mark]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == k[own])
    return docs.join(k, same, "left_anti")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more.

    Its cleaner works off the driver's garbage collections, of which a driver that plans much and holds
    little may have none for long, while the files stay on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_memory() -> None:
    """Gives a Python worker's freed memory back: workers live on after their task and would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """run, an iterator over a task's batches, that gives memory back at the end."""

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def bound_batches(spark: SparkSession) -> SparkSession:
    """Sets the session's Arrow batches to ARROW_BYTES: what the queries of this package run with, not what the operators need."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark
