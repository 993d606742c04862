"""Soft routing: labels whose keywords a query contains push results whose path contains the label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, path_contains

STEP = 0.1


def keywords(routes: DataFrame) -> DataFrame:
    """(label, keyword): normalised keywords, one row each; empty lists give none."""
    return routes.select("label", F.explode("keywords").alias("keyword")).select("label", normalize(F.col("keyword")).alias("keyword"))


def query_boosts(routes: DataFrame, queries: DataFrame, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
    """(query_id, label, boost): STEP for each keyword the query contains; labels without one are left out.

    routes is a settings table; the containment test of every query against it is a broadcast nested loop when it is small
    enough for the session's broadcast limit, which Spark checks.
    """
    asked = queries.select(query_id, normalize(F.col(query_col)).alias("_nq"))
    hit = asked.join(keywords(routes), F.contains(F.col("_nq"), F.col("keyword")))
    return hit.groupBy(query_id, "label").agg(F.round(F.count(F.lit(1)) * STEP, 6).alias("boost"))


def boosts_of(routes: DataFrame, query: str) -> dict[str, float]:
    """label to boost for one query."""
    one = routes.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    return {r["label"]: r["boost"] for r in query_boosts(routes, one).collect()}


def apply_boosts(candidates: DataFrame, boosts: dict[str, float], path_col: str = "file_path", score_col: str = "score") -> DataFrame:
    """score plus the boosts of all labels the path contains (accents count, case doesn't)."""
    add = F.lit(0.0)
    for label, boost in boosts.items():
        add = add + F.when(path_contains(F.col(path_col), F.lit(label)), F.lit(float(boost))).otherwise(F.lit(0.0))
    return candidates.withColumn(score_col, F.col(score_col) + F.coalesce(add, F.lit(0.0)))
