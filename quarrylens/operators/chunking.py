"""Greedy segmentation of whole documents into offset-tracked chunks.

Up to size characters are taken: all of the rest if it fits, else up to the furthest sentence end in the second half of the
window, else up to the furthest word boundary, else up to the first word boundary beyond it (a giant word stays whole).
One anchored regular expression does it inside the JVM. Chunks are trimmed of white space and empty ones dropped; offsets
count code points from the start of the document. Null, empty and blank texts give no chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import let, running_sum
from ..functions.text import LETTER_OR_DIGIT as LD

SIZE = 512


def chunk_pattern(size: int = SIZE) -> str:
    n = max(1, size)
    h = max(n // 2, 1)
    boundary = rf"(?:(?<!{LD})|(?!{LD}))"
    return rf"(?s)\G(?:.{{1,{n}}}\z|.{{{h - 1},{n - 1}}}(?:[\r\n]|[.!?](?!{LD}))|.{{1,{n}}}{boundary}|.{{{n},}}?(?:{boundary}|\z))"


def chunks_of(text: Column, size: int = SIZE) -> Column:
    """array<struct<text, chunk_offset>> of one document."""
    segments = F.regexp_extract_all(text, F.lit(chunk_pattern(size)), F.lit(0))

    def placed(segs: Column) -> Column:
        starts = running_sum(F.transform(segs, lambda s: F.length(s)))

        def one(st: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                left = F.regexp_replace(s, r"(?U)^\s+", "")
                return F.struct(F.regexp_replace(left, r"(?U)\s+$", "").alias("text"), (F.get(st, i) + F.length(s) - F.length(left)).alias("chunk_offset"))

            return F.filter(F.transform(segs, piece), lambda c: c["text"] != "")

        return let(starts, one)

    return let(segments, placed)


def chunk_documents(df: DataFrame, id_col: str, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id_col, chunk_offset, text): one row a chunk."""
    rows = df.select(F.col(id_col).alias("_id"), F.inline(chunks_of(F.col(text_col), size)))
    return rows.select(F.col("_id").alias(id_col), "chunk_offset", "text")


def assign_ids(chunks: DataFrame, path_col: str = "file_path", offset_col: str = "chunk_offset", base: int = 0) -> DataFrame:
    """Ids base + 1, base + 2, ... in the order of (path, offset), without sorting everything in one task.

    Rows are range-partitioned by path and offset, counted by partition, and numbered within their partition.
    """
    spark = chunks.sparkSession
    order = [F.col(path_col).asc_nulls_first(), F.col(offset_col).asc_nulls_first()]
    from ..session import materialize

    placed = materialize(chunks.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = placed.groupBy("_part").count().orderBy("_part").collect()  # one row a partition
    ahead, total = [], base
    for r in counts:
        ahead.append((r["_part"], total))
        total += r["count"]
    starts = spark.createDataFrame(ahead, "_part int, _ahead long")
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = placed.withColumn("_n", number).join(F.broadcast(starts), "_part")
    return numbered.withColumn("chunk_id", F.col("_ahead") + F.col("_n")).drop("_part", "_n", "_ahead")
