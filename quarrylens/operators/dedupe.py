"""Boilerplate by repeated segments, and what the vector index leaves out because of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint


def flag_boilerplate(
    df: DataFrame, text_col: str = "text", min_count: int = 2, distinct_files: bool = False, path_col: str = "file_path"
) -> DataFrame:
    """df with is_boilerplate: the segment's fingerprint occurs at least min_count times (or in so many files).

    Fingerprints are counted with map-side combining and only those that repeat are joined back, so a segment that is in
    a third of all rows is one row of the counts. A null text is never boilerplate.
    """
    rest = [c for c in df.columns if c != "is_boilerplate"]
    keyed = df.select(*rest, F.md5(fingerprint(F.col(text_col))).alias("_fp"))
    if distinct_files:
        counts = keyed.select("_fp", path_col).distinct().groupBy("_fp").agg(F.count(F.lit(1)).alias("_n"))
    else:
        counts = keyed.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n"))
    repeated = counts.where(F.col("_n") >= min_count).select("_fp", F.lit(True).alias("_hit"))
    joined = keyed.join(repeated, "_fp", "left")
    return joined.select(*rest, F.coalesce(F.col("_hit"), F.lit(False)).alias("is_boilerplate"))


def diff_embed(df: DataFrame) -> DataFrame:
    """Rows of the vector index: all but boilerplate. The keyword index keeps every row."""
    return df.where(~F.coalesce(F.col("is_boilerplate"), F.lit(False)))
