"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where it is unset a session on one machine gets a
    temporary folder (tests); on a cluster that is an error, as executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quarrylens-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrylens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that operators wrote to the shared folder. A result reads them until it is done, so this is for the
    caller to say: after a job's last action, or at the end of a session."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quarrylens")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A file of at most so many bytes is read by one task, as it is one row group as a rule; its rows are then dealt to all cores.
ONE_FILE = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. A folder of files keeps the partitions its files give; only one small file is spread."""
    where = f"{sf_dir}/{name}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    rows = spark.read.parquet(where)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if status.isFile() and (1 << 20) < status.getLen() <= ONE_FILE and cores > 1 else rows
