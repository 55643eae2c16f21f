"""Keeping a document table current from a stream of arriving versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.corpus_diff import diff_corpora, inherit_tombstones
from ..plans.workspace import Store

SCHEMA = "path string, content string, version long"


def read_versions(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of document versions (path, content, version) from JSON files that arrive in a folder; null content removes a document."""
    return spark.readStream.schema(SCHEMA).json(folder)


def latest(batch: DataFrame) -> DataFrame:
    """The last version of each path."""
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version")))
    return batch.withColumn("_place", place).where("_place = 1").drop("_place")


def merge(current: DataFrame, batch: DataFrame) -> DataFrame:
    """current (path, content, deleted) with a batch's last versions; tombstones stay with their paths."""
    last = latest(batch)
    rest = current.join(last.select("path"), "path", "left_anti")
    new = last.where("content is not null").select("path", "content", F.lit(False).alias("deleted"))
    return rest.unionByName(inherit_tombstones(current, new).drop("inherited"))


class Ingest:
    """The sink of a stream: `query(stream, checkpoint)` keeps `current` and the last batch's `changes` in the folder store.

    A batch counts once its tables are written and its state file stands, so a new sink over the same folder goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, store: str):
        self._spark, self._store = spark, Store(spark, store)
        self.current = spark.createDataFrame([], "path string, content string, deleted boolean")
        self.changes: DataFrame | None = None
        self.seen, self._at = -1, ""
        done = [int(p.rpartition("/")[2]) for p, _ in self._store.files("done") if p.rpartition("/")[2].isdigit()] if self._store.exists("done") else []
        if done:
            self._open(max(done), self._store.read(f"done/{max(done)}").decode())

    def _open(self, number: int, at: str) -> None:
        self.current, self.changes = (self._spark.read.parquet(f"{self._store.root}/{at}/{name}") for name in ("documents", "changes"))
        self.seen, self._at = number, at

    def _take(self, batch: DataFrame, number: int) -> None:
        if number <= self.seen:  # a batch that is played again
            return
        at, before = f"batches/{number}-{uuid.uuid4().hex}", (self.seen, self._at)
        merge(self.current, batch).write.parquet(f"{self._store.root}/{at}/documents")
        merged = self._spark.read.parquet(f"{self._store.root}/{at}/documents")
        diff_corpora(self.current, merged).write.parquet(f"{self._store.root}/{at}/changes")
        self._store.replace(f"done/{number}", at.encode())
        self._open(number, at)
        if before[1]:
            self._store.delete(f"done/{before[0]}")
            self._store.delete(before[1])

    def query(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self._take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
