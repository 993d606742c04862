"""Lines repeated across the documents of one site, and texts without them.

Files with the same lines are collapsed to one cluster first, by a fingerprint added up from line hashes; a line is then
counted over distinct clusters and over the dates on which clusters were first published. That decides what is removed: an
article published again in many files is one cluster, so its lines stay. The number of files is counted beside it, by adding
up the files of the clusters. A cluster is exact: files whose sets of line forms (digits folded) are equal.

A file's line sets are summed with map-side combining, lines are aggregated by (site, line, cluster) before anything is
grouped by line, and lines that cannot be boilerplate are left out by a bit table before texts are cleaned.

Defined results: a null text or a path without site has no lines. Empty lines never count. A line counts once for a file.
Repeated rows change nothing. The cleaned text of a chunk without boilerplate is the stored text; a null text stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STABLE, outside, site_of

MIN_FILES = 5
#: What makes a line boilerplate: so many clusters of a site, first published on so many days (where a day is known).
MIN_CLUSTERS, MIN_DATES = 5, 2


_COMPOSABLE = outside(*STABLE)


def _composed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata as u

    for s in parts:
        yield s.map(lambda x: None if x is None else u.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Canonical composition; texts that have nothing to compose never leave the JVM."""
    return F.coalesce(F.pandas_udf(_composed, "string")(F.when(text.rlike(_COMPOSABLE), text)), text)


def line_form(line: Column) -> Column:
    """The form in which lines are compared, of a line already in NFC."""
    numbered = F.regexp_replace(F.lower(line), "[0-9]+", "#")
    return F.trim(F.regexp_replace(numbered, r"(?U)\s+", " "))


def site_lines(chunks: DataFrame, id_col: str = "chunk_id", path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """(site, file_path, line): the non-empty line forms, repeats included."""
    base = chunks.select(site_of(F.col(path_col)).alias("site"), F.col(path_col).alias("file_path"), F.col(text_col).alias("_text"))
    base = base.where(F.col("site").isNotNull() & F.col("file_path").isNotNull() & F.col("_text").isNotNull()).withColumn("_text", nfc(F.col("_text")))
    # the form is made inside the generator: a filter on its output is not pushed below it, where it would be made again
    return base.select("site", "file_path", F.explode(F.transform(F.split("_text", "\n"), line_form)).alias("line")).where("line <> ''")


def line_counts(chunks: DataFrame, dates: DataFrame | None = None, path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """(site, line, n_files, n_clusters, n_dates) of every line form. dates is (file_path, published); a cluster's date is its
    first; n_dates is 0 where no date is known."""
    lines = site_lines(chunks, path_col=path_col, text_col=text_col)
    once = lines.groupBy("site", "file_path", F.xxhash64("line").alias("h"), "line").agg(F.lit(1).alias("one")).drop("one")
    files = once.groupBy("site", "file_path").agg(
        F.expr("bit_xor(h)").alias("x"), F.sum(F.shiftrightunsigned(F.xxhash64(F.col("h")), 20)).alias("s"), F.count(F.lit(1)).alias("n")
    )
    if dates is not None:
        day = dates.groupBy("file_path").agg(F.min(F.to_date("published")).alias("day"))
        files = files.join(day, "file_path", "left")
    else:
        files = files.withColumn("day", F.lit(None).cast("date"))
    clusters = files.groupBy("site", "x", "s", "n").agg(
        F.min("file_path").alias("file_path"), F.count(F.lit(1)).alias("files"), F.min("day").alias("day")
    )
    kept = once.join(clusters.select("site", "file_path", "files", "day"), ["site", "file_path"])
    daily = kept.groupBy("site", "line", "day").agg(F.sum("files").alias("f"), F.count(F.lit(1)).alias("c"))
    return daily.groupBy("site", "line").agg(F.sum("f").alias("n_files"), F.sum("c").alias("n_clusters"), F.count("day").alias("n_dates"))


def repeated_lines(
    chunks: DataFrame, dates: DataFrame | None = None, min_files: int = MIN_FILES, path_col: str = "file_path", text_col: str = "text"
) -> DataFrame:
    """The counts of the lines in at least min_files files of a site, republished files included."""
    return line_counts(chunks, dates, path_col, text_col).where(F.col("n_files") >= min_files)


def boilerplate_lines(
    chunks: DataFrame,
    dates: DataFrame | None = None,
    min_clusters: int = MIN_CLUSTERS,
    min_dates: int = MIN_DATES,
    path_col: str = "file_path",
    text_col: str = "text",
) -> DataFrame:
    """The counts of the lines in at least min_clusters clusters of a site, first published on min_dates days at least."""
    spread = (F.col("n_dates") == 0) | (F.col("n_dates") >= min_dates)
    return line_counts(chunks, dates, path_col, text_col).where((F.col("n_clusters") >= min_clusters) & spread)


def without_repeated_lines(
    chunks: DataFrame,
    dates: DataFrame | None = None,
    min_clusters: int = MIN_CLUSTERS,
    min_dates: int = MIN_DATES,
    id_col: str = "chunk_id",
    path_col: str = "file_path",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, text, is_boilerplate, n_removed): every chunk without its site's boilerplate lines.

    is_boilerplate is true where lines were removed and no other line than blank ones is left. The remaining lines keep
    their order; a chunk from which nothing is removed keeps its text as stored.
    """
    from ..operators.prune import possibly_in
    from ..session import materialize

    text = F.col("_text")
    base = chunks.select(F.col(id_col).alias("_id"), site_of(F.col(path_col)).alias("site"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_h"))
    found = boilerplate_lines(chunks, dates, min_clusters, min_dates, path_col, text_col)
    found = materialize(found.select("site", "line", F.xxhash64("site", "line").alias("_key")), "boilerplate")
    forms = base.where(F.col("site").isNotNull()).select("_id", "_h", "site", F.posexplode(F.transform(F.split(nfc(text), "\n"), line_form)).alias("_at", "line"))
    maybe = possibly_in(forms.withColumn("_key", F.xxhash64("site", "line")), "_key", found)
    hit = maybe.join(found.select("site", "line"), ["site", "line"])
    gone = hit.groupBy("_id", "_h").agg(F.collect_set("_at").alias("_gone"))  # one chunk's own lines
    out = base.join(gone.withColumnsRenamed({"_id": "_i", "_h": "_g"}), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    out = out.select("_id", "_gone", F.when(F.col("_gone").isNull(), text).otherwise(left).alias("text"))
    return out.select(
        F.col("_id").alias(id_col),
        "text",
        (F.col("_gone").isNotNull() & ~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))).alias("is_boilerplate"),
        F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"),
    )
