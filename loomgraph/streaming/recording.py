"""Frames of a recording that grows, as a streaming source.

A recording is a file of JPEG frames one after the other, as cameras and converters write them, in a folder that driver
and executors mount. An offset is a place in the file between two whole frames, with the number of frames before it, so
a query that starts again from its checkpoint goes on where it was: every frame comes once.

A reader holds no more than max(LEAST_BUFFER, fps * buffer_seconds) frames. With drop, what arrives while the buffer is
full is lost, as with a live camera: of a batch the first frames are kept, and which these are follows from the batch's
offsets alone, so that a batch that runs again keeps the same ones. Without drop the rest comes in later batches.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LEAST_BUFFER = 10
#: Frames that one task reads.
PER_TASK = 16
#: Bytes read at a time in search of frames.
CHUNK = 1 << 20
START, END = b"\xff\xd8", b"\xff\xd9"
SCHEMA = "stream_id string, frame long, timestamp double, width long, height long, image string"


def frame_ends(path: str, at: int, most: int | None = None) -> Iterator[int]:
    """Where each whole frame from a place in the file on ends. A frame that is still being written is none yet."""
    with open(path, "rb") as f:
        f.seek(at)
        held, n = b"", 0
        while most is None or n < most:
            if (end := held.find(END)) >= 0:
                at += end + len(END)
                held, n = held[end + len(END) :], n + 1
                yield at
            elif not (more := f.read(CHUNK)):
                return
            else:
                held += more


@dataclass
class Frames(InputPartition):
    at: int
    first: int
    count: int


class RecordingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")
        self.stream_id = options.get("stream_id", os.path.basename(self.path))
        self.fps = float(options.get("fps", 15))
        self.buffer = max(LEAST_BUFFER, int(self.fps * float(options.get("buffer_seconds", 4))))
        self.drop = options.get("drop", "false").lower() == "true"
        self.size = int(options.get("width", 704)), int(options.get("height", 480))
        self.began = float(options.get("began", 0))
        self.seen = {"byte": 0, "frame": 0}

    def initialOffset(self) -> dict[str, int]:
        return {"byte": 0, "frame": 0}

    def latestOffset(self) -> dict[str, int]:
        """Behind the last whole frame; without drop behind the last one that the buffer takes."""
        if os.path.exists(self.path):
            byte, frame = self.seen["byte"], self.seen["frame"]
            for byte in frame_ends(self.path, byte, None if self.drop else self.buffer):
                frame += 1
            self.seen = {"byte": byte, "frame": frame}
        return dict(self.seen)

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Frames]:
        # after a restart the query goes on from its checkpoint
        if end["frame"] > self.seen["frame"]:
            self.seen = dict(end)
        kept = min(end["frame"] - start["frame"], self.buffer)
        places = [start["byte"], *frame_ends(self.path, start["byte"], kept)]
        return [Frames(places[k], start["frame"] + k, min(PER_TASK, kept - k)) for k in range(0, kept, PER_TASK)]

    def read(self, partition: Frames) -> Iterator[tuple[Any, ...]]:
        at = partition.at
        with open(self.path, "rb") as f:
            for k, end in enumerate(frame_ends(self.path, at, partition.count)):
                f.seek(at)
                data = f.read(end - at)
                data, at = data[max(0, data.find(START)) :], end  # what stands before a frame's start belongs to none
                number = partition.first + k
                yield self.stream_id, number, self.began + number / self.fps, *self.size, "data:image/jpeg;base64," + base64.b64encode(data).decode()

    def commit(self, end: dict[str, int]) -> None:
        pass


class Recording(DataSource):
    """Options: path; stream_id (the file's name), fps (15), buffer_seconds (4), drop (false), width, height, began (seconds of the first frame)."""

    @classmethod
    def name(cls) -> str:
        return "loomgraph_recording"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> RecordingReader:
        return RecordingReader(dict(self.options))


def read_recording(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """The frames of a recording as a stream: stream_id, frame (its number), timestamp, width, height, image (a data URL)."""
    spark.dataSource.register(Recording)
    return spark.readStream.format(Recording.name()).options(path=path, **{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load()
