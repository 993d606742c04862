"""Folder watching as Structured Streaming: new and changed files become chunks in the store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import Engine, IndexOptions
from ..sources.listing import LISTING, scan
from ..sources.readers import read_files


class FolderReader(SimpleDataSourceStreamReader):
    """Files below a folder by the time of their last change, in nanoseconds, which is the stream's offset.

    Unlike Spark's file stream it sees files that are changed in place, empty files and names with an underscore. The driver
    looks at every name once a trigger and keeps those that changed; contents are read by the executors.
    """

    def __init__(self, folder: str, extensions: list[str]):
        self.folder, self.extensions = folder, extensions

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def _since(self, low: int, high: int | None = None) -> tuple[list[tuple], int]:
        rows, last = [], low
        for row, changed in scan(self.folder, self.extensions):
            if changed > low and (high is None or changed <= high):
                rows.append(row)
                last = max(last, changed)
        return rows, last

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, last = self._since(start["changed"])
        return iter(rows), {"changed": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._since(start["changed"], end["changed"])[0])

    def commit(self, end: dict) -> None:
        pass


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarrylens_folder"

    def schema(self) -> str:
        return LISTING

    def simpleStreamReader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self.options["extensions"].split(","))


def watch_folder(engine: Engine, folder: str, options: IndexOptions | None = None, every: str = "5 seconds") -> StreamingQuery:
    """Index files of folder as they come or change; a batch replaces its files' chunks, so a repeated batch is harmless.

    The query runs until it is stopped; processAllAvailable() waits for what is there. Files that are removed keep their
    chunks.
    """
    spark = engine.spark
    spark.dataSource.register(FolderSource)
    wanted = (options or IndexOptions()).extensions()
    files = spark.readStream.format("quarrylens_folder").option("extensions", ",".join(wanted)).load(folder)

    def index(batch: DataFrame, _: int) -> None:
        engine.index_texts(read_files(batch.select("path")), replace=True, options=options)

    sink = files.writeStream.foreachBatch(index).option("checkpointLocation", f"{engine.store.path}/watch")
    return sink.trigger(processingTime=every).start()


def latest_visit_stream(spark: SparkSession, visits_path: str, schema, out: str) -> DataFrame:
    """The newest visit of each path from a stream of visits. State is one row a path, so a visit may come late by any time;
    each batch writes the paths it changed to a part of the table at out, and a repeated batch writes the same part again.
    """
    visits = spark.readStream.schema(schema).parquet(visits_path).where(F.col("seen_at").isNotNull())
    newest = visits.groupBy("path").agg(F.max(F.struct("seen_at", "modified_at", "length", "ext")).alias("v"))

    def merge(batch: DataFrame, epoch: int) -> None:
        batch.select("path", "v.*").withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = newest.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("path").agg(F.max_by(F.struct("length", "ext", "modified_at", "seen_at"), "epoch").alias("v")).select("path", "v.*")
