"""Folder listings as DataFrames, and the sets of folders an index knows.

Spark's own file sources skip names that begin with an underscore and empty files, and match extensions by case; listing
here does not. Folders are walked by the driver, or by the executors, one row a folder of the first level, where they share
the file system.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".pdf", ".docx", ".xlsx", ".txt", ".md")
LISTING = "path string, length long, ext string, modified_at timestamp_ntz"
#: Folder names that are never part of a safe tree, besides hidden ones (fixed values).
UNSAFE = ("library", "system", "node_modules", "cache", "caches")


def scan(root: str, extensions: Iterable[str] = EXTENSIONS, deep: bool = True) -> Iterator[tuple[tuple, int]]:
    """((path, length, ext, modified_at), nanoseconds of the last change) below root: hidden folders (but the root) and hidden
    files are skipped. A missing root is an error, as is a folder that cannot be read.
    """
    import datetime

    if not os.path.exists(root):
        raise FileNotFoundError(root)
    wanted = {e.lower() for e in extensions}

    def stop(e: OSError):
        raise e

    for folder, folders, names in os.walk(root, onerror=stop):
        folders[:] = sorted(f for f in folders if not f.startswith(".")) if deep else []
        for name in sorted(names):
            ext = os.path.splitext(name)[1].lower()
            if not name.startswith(".") and ext in wanted:
                path = os.path.join(folder, name)
                stat = os.stat(path)
                when = datetime.datetime.fromtimestamp(stat.st_mtime, datetime.timezone.utc).replace(tzinfo=None)
                yield (path, stat.st_size, ext, when), max(stat.st_mtime_ns, stat.st_ctime_ns)


def walk(root: str, extensions: Iterable[str] = EXTENSIONS, deep: bool = True) -> Iterator[tuple]:
    """The rows of scan."""
    return (row for row, _ in scan(root, extensions, deep))


def list_files(spark: SparkSession, roots: str | list[str], extensions: Iterable[str] = EXTENSIONS, spread: bool = True) -> DataFrame:
    """The listing of one or more folders (path, length, ext, modified_at). The executors walk the folders of the first level,
    and the driver holds only their names and the files beside them; without spread the driver walks everything."""
    roots, wanted = [roots] if isinstance(roots, str) else list(roots), tuple(extensions)
    if not spread:
        return spark.createDataFrame([r for root in roots for r in walk(root, wanted)], LISTING)  # names only
    top, flat = [], []
    for root in roots:
        for e in sorted(os.scandir(root), key=lambda e: e.name):
            if e.is_dir() and not e.name.startswith("."):
                top.append((e.path,))
        flat += [r for r in walk(root, wanted, deep=False)]

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            rows = [r for folder in pdf["path"] for r in walk(folder, wanted)]
            yield pd.DataFrame(rows, columns=["path", "length", "ext", "modified_at"]).astype({"modified_at": "datetime64[us]"})

    below = spark.createDataFrame(top, "path string").repartition(max(1, len(top))).mapInPandas(run, LISTING)
    return spark.createDataFrame(flat, LISTING).unionByName(below)


def only_extensions(files: DataFrame, extensions: Iterable[str] | None, ext_col: str = "ext") -> DataFrame:
    """Files of the given extensions, with or without the dot, in any case; all files if none are given."""
    wanted = [e.lower() if e.startswith(".") else "." + e.lower() for e in extensions or []]
    return files.where(normal_extension(F.col(ext_col)).isin(wanted)) if wanted else files


def normal_extension(ext: Column) -> Column:
    """Lower case with a leading dot."""
    low = F.lower(ext)
    return F.when(low.startswith(".") | (low == ""), low).otherwise(F.concat(F.lit("."), low))


def max_bytes(files: DataFrame, limit: int) -> DataFrame:
    """Files of at most limit bytes; no limit if it is 0 or less. The test reaches the scan."""
    return files.where(F.col("length") <= limit) if limit > 0 else files


def visible(path: Column) -> Column:
    """True unless a component of the path begins with a dot."""
    return ~path.rlike(r"(?:^|[/\\])\.[^/\\]")


def latest_visits(visits: DataFrame) -> DataFrame:
    """One row for each path: the visit seen last, then modified last. Repeated rows and late visits change nothing."""
    newest = F.max(F.struct("seen_at", "modified_at", "length", "ext"))
    return visits.groupBy("path").agg(newest.alias("_v")).select("path", "_v.length", "_v.ext", "_v.modified_at", "_v.seen_at")


def clean_dir(path: Column) -> Column:
    """Without trailing separators and doubled ones."""
    return F.regexp_replace(F.regexp_replace(path, r"/{2,}", "/"), r"(.)/+$", "$1")


def unindexed_dirs(dirs: DataFrame, indexed: DataFrame, dir_col: str = "dir") -> DataFrame:
    """Cleaned folders of dirs that the index does not know yet."""
    known = indexed.select(clean_dir(F.col(dir_col)).alias(dir_col)).distinct()
    return dirs.select(clean_dir(F.col(dir_col)).alias(dir_col)).distinct().join(known, dir_col, "left_anti")


def safe_trees(home: str, exclude: str | None = None) -> list[str]:
    """The largest folders below home without a hidden or unsafe folder in them, but for the excluded one.

    A folder that cannot be read counts as safe. Files directly in an unsafe folder belong to no tree.
    """
    home, skip = os.path.abspath(home), os.path.abspath(exclude) if exclude else None

    def bad(name: str) -> bool:
        return name.startswith(".") or name.lower() in UNSAFE

    def children(folder: str) -> list[str]:
        try:
            return sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False))
        except OSError:
            return []

    def safe(folder: str) -> bool:
        return folder != skip and all(not bad(os.path.basename(c)) and safe(c) for c in children(folder))

    def gather(folder: str) -> list[str]:
        out = []
        for c in children(folder):
            if bad(os.path.basename(c)) or c == skip:
                continue
            out += [c] if safe(c) else gather(c)
        return out

    return gather(home)
