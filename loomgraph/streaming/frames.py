"""Streams: graphs over unbounded tables, frames at a steady rate, last frames per camera, windows over events.

One micro-batch row is one run of a graph, as one row of a table is in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.images import data_url

FRAME = "stream_id string, timestamp double, width long, height long, image string"


def read_folder(spark: SparkSession, path: str, schema: str, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files as they arrive; files_per_batch bounds what a batch takes."""
    reader = spark.readStream.schema(schema).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_frames(spark: SparkSession, path: str, stream_id: str, fps: int = 15, width: int = 704, height: int = 480) -> DataFrame:
    """Image files of a folder as frames of a camera, fps of them in a batch at most (with a trigger of a second: a second)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", fps).load(path)
    at = F.unix_micros("modificationTime") / 1e6
    return files.select(F.lit(stream_id).alias("stream_id"), at.alias("timestamp"), F.lit(width).cast("long").alias("width"), F.lit(height).cast("long").alias("height"), data_url(F.col("content"), F.col("path")).alias("image"))


def paced(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """A clock: timestamp and a running number."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def run_graph(stream: DataFrame, payload: dict[str, Any], options: dict[str, Any] | None = None) -> DataFrame:
    """The outputs of a graph for each row of a stream. Row-wise nodes stay built-in columns, so it runs in any output mode."""
    from ..plans.runtime import Engine

    return Engine(stream.sparkSession).table(payload, stream, options)


def show(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", available_now: bool = False, every: str = "100 milliseconds"):
    """Into a table of the session that can be queried by name; every is how often batches are cut."""
    out = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)).start()


def deliver(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, every: str = "100 milliseconds"):
    """Each micro-batch to a function, as client updates are batched."""
    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)).start()


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", time: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums by event time; rows later than the watermark are dropped by Spark."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def last_frames(frames: DataFrame, batch: int, late: str = "1 minute") -> DataFrame:
    """For each frame of a stream its place and the times of the last `batch` frames, itself included: a sliding buffer.

    State holds `batch` times per stream; an idle stream's goes after `late`.
    """

    def step(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, held = state.get if state.exists else (0, [])
        held = list(held)
        for part in parts:
            out = []
            for t in part.sort_values("timestamp")["timestamp"]:
                held = [*held, float(t)][-batch:]
                out.append((key[0], seen, float(t), list(held)))
                seen += 1
            yield pd.DataFrame(out, columns=["stream_id", "frame_idx", "timestamp", "buffer"])
        state.update((seen, held))
        state.setTimeoutDuration(int(late_ms))

    unit = {"second": 1000, "minute": 60_000, "hour": 3_600_000}
    count, name = late.split()
    late_ms = int(count) * unit[name.rstrip("s")]
    return frames.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, frame_idx long, timestamp double, buffer array<double>", "seen long, held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
