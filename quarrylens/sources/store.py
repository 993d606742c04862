"""The chunk store: tables of chunks under a log of writes, and one table of indexed folders."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "chunk_id long, file_path string, text string, norm_text string, chunk_offset int, is_boilerplate boolean, vector array<float>"
SINCE = "file_path string, since long"
DIRS = "dir string, seq int"


class Write(NamedTuple):
    """An entry of the log: its number, what it did (append, replace, compact), the folder it wrote."""

    epoch: int
    kind: str
    folder: str


class ChunkStore:
    """Chunks below a folder. Appending and replacing add files and rewrite nothing.

    A write fills a folder of its own and then adds an empty file to the log, which names it; the file appears at once or not
    at all, so readers see a write as a whole, and what a failed write left behind is never read. Replacing files writes their
    new rows and the names of the files; rows of those files from earlier writes are left out by readers. compact() writes
    what is left as one folder, from which readers then start; the folders it replaces stay for readers that have begun and
    are deleted by the next compact(). One writer at a time: a second one fails at the log and leaves the store as it is.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _whole_log(self) -> list[Write]:
        out = []
        for name in self._names("log"):
            epoch, kind, folder = name.split("-", 2)
            out.append(Write(int(epoch), kind, folder))
        return out

    def log(self) -> list[Write]:
        """The writes that count: the last compaction and what came after it."""
        entries = self._whole_log()
        last = max((i for i, w in enumerate(entries) if w.kind == "compact"), default=0)
        return entries[last:]

    def state(self) -> str:
        """A name of what the store holds now; it changes with every write."""
        entries = self.log()
        return entries[-1].folder if entries else "empty"

    def _write(self, kind: str, rows: DataFrame, paths: DataFrame | None = None) -> None:
        fs, path = self._fs()
        write = Write(max((w.epoch for w in self._whole_log()), default=0) + 1, kind, uuid.uuid4().hex)
        rows.withColumn("epoch", F.lit(write.epoch).cast("long")).write.parquet(f"{self.path}/chunks/{write.folder}")
        if paths is not None:
            paths.withColumn("since", F.lit(write.epoch).cast("long")).write.parquet(f"{self.path}/since/{write.folder}")
        if any(w.epoch >= write.epoch for w in self._whole_log()):
            raise RuntimeError("another writer came first; nothing was changed")
        fs.create(path(f"{self.path}/log/{write.epoch:012d}-{kind}-{write.folder}"), False).close()

    def _read(self, where: list[str], schema: str) -> DataFrame:
        if not where:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*where)

    def chunks(self) -> DataFrame:
        """All chunks; none where the store does not exist yet. A broken file is an error when it is read."""
        entries = self.log()
        rows = self._read([f"{self.path}/chunks/{w.folder}" for w in entries], CHUNKS + ", epoch long")
        replaced = [f"{self.path}/since/{w.folder}" for w in entries if w.kind == "replace"]
        if replaced:
            since = self._read(replaced, SINCE).groupBy("file_path").agg(F.max("since").alias("since"))
            rows = rows.join(since, "file_path", "left").where(F.col("since").isNull() | (F.col("epoch") >= F.col("since")))
        return rows.select(*self.spark.createDataFrame([], CHUNKS).columns)

    def has(self, where: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(where))

    def mark(self, where: str) -> None:
        """An empty file that says that what stands beside it is whole."""
        fs, path = self._fs()
        fs.create(path(where), True).close()

    def append(self, chunks: DataFrame) -> None:
        """Add chunks beside what is there, even of the same files."""
        self._write("append", self._shaped(chunks))

    def replace_files(self, chunks: DataFrame, paths: DataFrame | None = None) -> None:
        """Put chunks in place of all rows of their files (or of the files in paths): indexing twice changes nothing."""
        new = self._shaped(chunks)
        self._write("replace", new, (paths if paths is not None else new).select("file_path").distinct())

    def compact(self) -> None:
        """Write the rows that count as one folder; delete what the compaction before this one had replaced."""
        old = self.log()[0] if self.log() else None
        self._write("compact", self.chunks())
        fs, path = self._fs()
        for w in self._whole_log():
            if old and old.kind == "compact" and w.epoch < old.epoch:
                fs.delete(path(f"{self.path}/log/{w.epoch:012d}-{w.kind}-{w.folder}"), False)
                for what in ("chunks", "since"):
                    fs.delete(path(f"{self.path}/{what}/{w.folder}"), True)

    def _shaped(self, chunks: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], CHUNKS).schema
        have = set(chunks.columns)
        return chunks.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))

    def all_vectors(self) -> DataFrame:
        return self.chunks().select("chunk_id", "vector").where(F.size("vector") > 0)

    def get(self, ids: DataFrame) -> DataFrame:
        """The chunks of a table of ids."""
        return self.chunks().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def get_chunk(self, chunk_id: int):
        """One chunk; KeyError if it is not there."""
        row = self.chunks().where(F.col("chunk_id") == chunk_id).first()
        if row is None:
            raise KeyError(chunk_id)
        return row

    def counts(self) -> DataFrame:
        """One row (chunks, files, max_id); max_id is null for an empty store."""
        return self.chunks().agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_path").alias("files"), F.max("chunk_id").alias("max_id"))

    def count(self) -> int:
        return self.chunks().count()

    def max_id(self) -> int:
        return self.chunks().agg(F.max("chunk_id")).first()[0] or 0

    def clear(self) -> None:
        """Forget all chunks and folders."""
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def indexed_dirs(self) -> DataFrame:
        """(dir, seq) in the order in which folders were added first."""
        rows = self._read([f"{self.path}/dirs"] if self._names("dirs") else [], DIRS)
        return rows.groupBy("dir").agg(F.min("seq").alias("seq"))

    def add_indexed_dirs(self, dirs: DataFrame) -> None:
        """Add folders (dir, seq) that are not known yet, in the order of seq after those that are."""
        known = self.indexed_dirs()
        last = known.agg(F.max("seq")).first()[0] or 0
        new = dirs.groupBy("dir").agg(F.min("seq").alias("seq")).join(known.select("dir"), "dir", "left_anti")
        new.select("dir", (F.col("seq") + last).cast("int").alias("seq")).coalesce(1).write.mode("append").parquet(f"{self.path}/dirs")

    def add_indexed_dir(self, folder: str) -> None:
        self.add_indexed_dirs(self.spark.createDataFrame([(folder, 1)], DIRS))


