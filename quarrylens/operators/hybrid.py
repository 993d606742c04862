"""Keyword and vector search merged, ranked, reduced to one chunk a file and split in two buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import sigmoid
from .bm25 import bm25_search
from .router import apply_boosts
from .vectors import vector_topk

#: Probability from which a result is exact; an uncertain one is a suggestion.
EXACT = 0.05


def merge_scores(keyword: DataFrame, vector: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id_col, score): all ids of both sides, each once; where both have one the vector's score holds."""
    none = F.lit(None).cast("double")
    both = keyword.select(id_col, F.col("score").cast("double").alias("_k"), none.alias("_v")).union(vector.select(id_col, none, F.col("score").cast("double")))
    return both.groupBy(id_col).agg(F.coalesce(F.max("_v"), F.max("_k")).alias("score"))


def candidate_ids(keyword: DataFrame, vector: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return keyword.select(id_col).union(vector.select(id_col)).distinct()


def hydrate(candidates: DataFrame, chunks: DataFrame, id_col: str = "chunk_id", keep: tuple[str, ...] = ("file_path", "text")) -> DataFrame:
    """The chunks of candidates (id[, score]) that a limit bounds to a few hundred, with the kept columns; ids that are gone drop
    out. Ids and scores become literals: nothing is joined, and the scan skips row groups without these ids."""
    found = candidates.collect()
    rows = chunks.where(F.col(id_col).isin([r[id_col] for r in found])) if found else chunks.where(F.lit(False))
    score = []
    if "score" in candidates.columns:
        by_id = F.create_map(*(F.lit(x) for r in found for x in (r[id_col], float(r["score"])))) if found else None
        score = [(F.element_at(by_id, F.col(id_col)) if found else F.lit(0.0)).alias("score")]
    return rows.select(id_col, *score, *keep)


def top(df: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    return df.orderBy(F.desc("score"), id_col).limit(max(k, 0))


def search(chunks: DataFrame, query: str, query_vector, k: int, id_col: str = "chunk_id", diff: bool = False) -> DataFrame:
    """(id, score, file_path, text): k best of the merged keyword and vector hits.

    The scales differ on purpose: a keyword-only hit keeps its unbounded score. With diff, boilerplate is left out of the
    vector side only.
    """
    from .dedupe import diff_embed

    words = bm25_search(chunks, query, k, id_col)
    vectors = vector_topk(diff_embed(chunks) if diff else chunks, query_vector, k, id_col)
    return merge_hits(words, vectors, chunks, k, id_col)


def merge_hits(words: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """(id, score, file_path, text) of the k best of both sides, of which each has a limit already."""
    return top(hydrate(top(merge_scores(words, vectors, id_col), k, id_col), chunks, id_col), k, id_col)


def best_per_file(scored: DataFrame, id_col: str = "chunk_id", path_col: str = "file_path") -> DataFrame:
    """The best chunk of each file: highest score, then smallest id."""
    rank = F.row_number().over(Window.partitionBy(path_col).orderBy(F.desc("score"), id_col))
    return scored.withColumn("_r", rank).where("_r = 1").drop("_r")


def buckets(scored: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """score becomes a probability, with bucket (exact, suggest) and rank within it."""
    prob = scored.withColumn("logit", F.col("score")).withColumn("score", sigmoid(F.col("logit")))
    cut = F.when(F.col("score") >= F.lit(EXACT).cast("float"), "exact").otherwise("suggest")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("logit"), id_col))
    return prob.withColumn("bucket", cut).withColumn("rank", rank).drop("logit")


def rank_candidates(candidates: DataFrame, boosts: dict[str, float], k: int, id_col: str = "chunk_id") -> DataFrame:
    """Boost raw logits, keep the best chunk a file, then the k best files, then split into buckets."""
    boosted = apply_boosts(candidates, boosts)
    return buckets(top(best_per_file(boosted, id_col), k, id_col), id_col)


def search_ranked(
    chunks: DataFrame, query: str, query_vector, k: int, reranker, boosts: dict[str, float] | None = None, rerank_k: int = 5, id_col: str = "chunk_id"
) -> DataFrame:
    """(id, file_path, text, score, bucket, rank) of the union of both sides' rerank_k best, scored by the reranker.

    The limit stands below the model: at most 2 * rerank_k rows reach it.
    """
    rerank_k = rerank_k if rerank_k > 0 else 20
    words, vectors = bm25_search(chunks, query, rerank_k, id_col), vector_topk(chunks, query_vector, rerank_k, id_col)
    return rank_hits(words, vectors, chunks, query, k, reranker, boosts, id_col)


def rank_hits(
    words: DataFrame, vectors: DataFrame, chunks: DataFrame, query: str, k: int, reranker, boosts: dict[str, float] | None = None, id_col: str = "chunk_id"
) -> DataFrame:
    """The union of both sides' hits, of which each has a limit already, reranked and split in buckets."""
    rows = hydrate(candidate_ids(words, vectors, id_col), chunks, id_col).coalesce(1)
    return rank_candidates(reranker.score_column(rows, query), boosts or {}, k, id_col)
