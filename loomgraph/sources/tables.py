"""Tables as sources and sinks of graphs, and a store of graphs."""

from __future__ import annotations

import json
import os
import time
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = "id string, owner_id string, name string, description string, data string, created_at timestamp, updated_at timestamp, version long, attempt int"
#: Seconds after which a claimed change that was never written may be made by another writer.
GRACE = 60.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder; Spark prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(frame: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    out = frame.write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def _sided(frame: DataFrame, condition: Column, on_true: tuple[str, ...] | None, on_false: tuple[str, ...] | None) -> DataFrame:
    names = [c for c in frame.columns if (on_true is None or c in on_true) or (on_false is None or c in on_false)]
    test = F.coalesce(condition, F.lit(False))

    def of(c: str) -> Column:
        held = F.col("`" + c.replace("`", "``") + "`")
        here = [k is None or c in k for k in (on_true, on_false)]
        return held if all(here) else F.when(test if here[0] else ~test, held).alias(c)

    return frame.select(*(of(c) for c in names), F.when(test, "true").otherwise("false").alias("side"))


def write_sides(frame: DataFrame, condition: Column, path: str, on_true: tuple[str, ...] | None = None, on_false: tuple[str, ...] | None = None, mode: str = "errorifexists") -> None:
    """The rows for which condition holds to path/side=true, all others (null, too) to path/side=false, in one pass over the frame.

    Both are committed together when the job ends: a task that fails or is lost leaves nothing of either side behind, and
    runs again for both. on_true and on_false: the columns that each side keeps (all); what only the other side has is null
    there, and `side` reads a side with its own columns.
    """
    _sided(frame, condition, on_true, on_false).write.mode(mode).partitionBy("side").parquet(path)


def stream_sides(stream: DataFrame, condition: Column, path: str, checkpoint: str, on_true: tuple[str, ...] | None = None, on_false: tuple[str, ...] | None = None, available_now: bool = False, every: str = "1 second"):
    """write_sides for a stream: each micro-batch adds to both sides or, where it fails, to neither, and its rows come once over restarts."""
    out = _sided(stream, condition, on_true, on_false).writeStream.format("parquet").partitionBy("side").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)).start()


def side(spark: SparkSession, path: str, taken: bool, columns: tuple[str, ...] | None = None) -> DataFrame:
    """What write_sides wrote for one side."""
    rows = spark.read.option("basePath", path).parquet(path).where(F.col("side") == str(taken).lower()).drop("side")
    return rows if columns is None else rows.select(*("`" + c.replace("`", "``") + "`" for c in columns))


class Conflict(RuntimeError):
    """Another writer changed the graph meanwhile."""


class Claims:
    """Names that one writer alone can take: files that the operating system creates only where there are none.

    The folder must be one that all writers mount. A store without such a folder has its own claims (a conditional put).
    """

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")
        os.makedirs(self.folder, exist_ok=True)

    def take(self, name: str) -> bool:
        try:
            os.close(os.open(os.path.join(self.folder, name), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True

    def age(self, name: str) -> float | None:
        """Seconds since a name was taken; None if it was not."""
        try:
            return time.time() - os.stat(os.path.join(self.folder, name)).st_mtime
        except FileNotFoundError:
            return None

    def taken(self, prefix: str) -> list[str]:
        return sorted(x for x in os.listdir(self.folder) if x.startswith(prefix))


class GraphStore:
    """Saved graphs as parquet tables: each change is a row with the version that it makes; of an id the highest version holds.

    A change is made by whoever claims its version first, so of two that begin from the same version one is refused with
    Conflict. A row without data says that the graph is gone. The rows stand in folders, one a generation; compact()
    begins a new one with what holds. Writers that were still adding to an old one find out and add to the new one, too.
    """

    def __init__(self, spark: SparkSession, path: str, claims: Claims | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.claims = claims or Claims(f"{self.path}/_claims")

    # --- generations: changes go to the last one begun; reading starts at the last one that is complete

    def _numbers(self, prefix: str) -> int:
        return max((int(x.removeprefix(prefix)) for x in self.claims.taken(prefix)), default=0)

    def _rows(self) -> DataFrame:
        out = self.spark.createDataFrame([], STORE)
        for g in range(self._numbers("complete-"), self._numbers("begun-") + 1):
            try:
                out = out.unionByName(self.spark.read.schema(STORE).parquet(f"{self.path}/generation-{g}"))
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return out

    def _last(self) -> DataFrame:
        columns = ("owner_id", "name", "description", "data", "created_at", "updated_at", "version", "attempt")
        return self._rows().groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("version", "attempt")).alias("g")).select("id", "g.*")

    def graphs(self, owner: str | None = None) -> DataFrame:
        """What holds, last changed first."""
        out = self._last().where("data is not null")
        return (out if owner is None else out.where(F.col("owner_id") == owner)).orderBy(F.desc("updated_at"), "id")

    def _append(self, row: tuple) -> None:
        generation = -1
        while generation != (now := self._numbers("begun-")):
            generation = now
            self.spark.createDataFrame([row], STORE).coalesce(1).write.mode("append").parquet(f"{self.path}/generation-{generation}")

    def _claim(self, id: str, version: int) -> int:
        """The attempt with which this writer may write the version. What another one claimed and did not write within GRACE is free again."""
        attempt = 0
        while not self.claims.take(f"{id}.{version}.{attempt}"):
            if (self.claims.age(f"{id}.{version}.{attempt}") or 0.0) < GRACE:
                raise Conflict(f"version {version} of graph {id} is another writer's")
            if not self._rows().where((F.col("id") == id) & (F.col("version") == version)).isEmpty():
                raise Conflict(f"graph {id} has a version {version} already")
            attempt += 1
        return attempt

    def get(self, id: str, owner: str) -> dict[str, Any] | None:
        """The graph, if it is the owner's; its version is what an update may ask for."""
        row = self.graphs(owner).where(F.col("id") == id).first()
        return None if row is None else row.asDict() | {"data": json.loads(row["data"])}

    def create(self, owner: str, name: str, data: dict[str, Any], description: str = "") -> str:
        id, now = str(uuid.uuid4()), datetime.now(timezone.utc)
        self._append((id, owner, name, description, json.dumps(data), now, now, 1, 0))
        return id

    def update(self, id: str, owner: str, version: int | None = None, **changes: Any) -> bool:
        """name, description and data as given; the rest stays. False where the owner has no such graph; Conflict if its
        version is not the given one, or another writer changes the same version."""
        g = self.get(id, owner)
        if g is None:
            return False
        if version is not None and g["version"] != version:
            raise Conflict(f"graph {id} has version {g['version']}, not {version}")
        attempt = self._claim(id, g["version"] + 1)
        g |= {k: v for k, v in changes.items() if k in ("name", "description", "data") and v is not None}
        self._append((id, owner, g["name"], g["description"], json.dumps(g["data"]), g["created_at"], datetime.now(timezone.utc), g["version"] + 1, attempt))
        return True

    def delete(self, id: str, owner: str, version: int | None = None) -> bool:
        g = self.get(id, owner)
        if g is None:
            return False
        if version is not None and g["version"] != version:
            raise Conflict(f"graph {id} has version {g['version']}, not {version}")
        attempt = self._claim(id, g["version"] + 1)
        self._append((id, owner, g["name"], g["description"], None, g["created_at"], datetime.now(timezone.utc), g["version"] + 1, attempt))
        return True

    def compact(self) -> int:
        """Begins a generation with the last row of each id, those of deleted ones included; gives its number. Conflict where another writer compacts.

        From its beginning on changes go there. The rows of the generations before are read after that, so that each
        is either among them or written again by its writer. Old folders stay for readers that began with them.
        """
        before = self._numbers("begun-")
        if before != self._numbers("complete-") and (self.claims.age(f"begun-{before}") or 0.0) < GRACE:
            raise Conflict("another writer compacts the store")
        if not self.claims.take(f"begun-{before + 1}"):
            raise Conflict("another writer compacts the store")
        self._last().repartitionByRange("id").write.mode("append").parquet(f"{self.path}/generation-{before + 1}")
        self.claims.take(f"complete-{before + 1}")
        return before + 1

    def search(self, owner: str, text: str) -> DataFrame:
        from ..plans.trace import search

        return search(self.graphs(owner), text, "name", "description")
