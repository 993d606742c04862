"""Flat vector scans: exact top-k by dot product or cosine, in float or int8, for one query or many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import select_once
from ..functions.vector import dot, int8_dot, literal, quantize_int8


def vector_topk(df: DataFrame, query, k: int, id_col: str = "chunk_id", vec_col: str = "vector", keep: list[str] | None = None) -> DataFrame:
    """(id_col, *keep, score): the k rows of largest dot product, best first, smaller id on ties; negatives count.

    query is a list of numbers. The products run over the common length. k <= 0 gives no rows; null and empty vectors
    take no part.
    """
    scored = select_once(df.where(F.size(vec_col) > 0), [id_col, *(keep or [])], F.struct(dot(F.col(vec_col), literal(query)).alias("score")))
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), id_col).limit(max(k, 0))


def quantized(df: DataFrame, id_col: str = "chunk_id", vec_col: str = "vector", keep: list[str] | None = None) -> DataFrame:
    """(id_col, *keep, qvec, scale): the int8 index."""
    return select_once(df.where(F.size(vec_col) > 0), [id_col, *(keep or [])], quantize_int8(F.col(vec_col)))


def int8_topk(index: DataFrame, query, k: int, id_col: str = "chunk_id") -> DataFrame:
    """(id_col, score): top k over an int8 index; the query is quantised the same way, once."""
    q = index.sparkSession.range(1).select(F.inline(F.array(quantize_int8(literal(query))))).first()
    codes = F.array(*(F.lit(x).cast("tinyint") for x in q["qvec"]))
    score = int8_dot(F.col("qvec"), codes, F.col("scale"), F.lit(q["scale"]).cast("float"))
    scored = select_once(index, [id_col], F.struct(score.alias("score")))
    return scored.orderBy(F.desc("score"), id_col).limit(max(k, 0))


#: Queries are scanned in blocks of at most so many, to bound what every task holds.
QUERY_BLOCK = 4096


def vector_topk_many(
    df: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "vector", query_id: str = "query_id", query_vec: str = "vector"
) -> DataFrame:
    """(query_id, id_col, score, rank) of a table of queries against all rows.

    Queries come in blocks of QUERY_BLOCK at most on average, by hash: one block is with the driver and the tasks at a time.
    Every task multiplies its rows with the block as matrices and passes on its own k best of each, so the shuffle holds k
    rows a query and task, whatever the table's size. All rows are read once a block; for very many queries an index is the
    better tool. Where there are several blocks the hits of each are written before the next begins.
    """
    from ..session import materialize

    spark, found = df.sparkSession, None
    rows = df.where(F.size(vec_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vec).alias("v")).where((F.size("v") > 0) & F.col("q").isNotNull())
    blocks = -(-asked.count() // QUERY_BLOCK)
    for b in range(blocks):
        block = [(r["q"], r["v"]) for r in asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()]  # about QUERY_BLOCK rows
        for width in sorted({len(v) for _, v in block}):
            own = [(q, v) for q, v in block if len(v) == width]
            shared = spark.sparkContext.broadcast((np.array([q for q, _ in own]), np.array([v for _, v in own], dtype=np.float64)))
            part = rows.mapInPandas(_scan(shared, k), "query_id long, id long, score double")
            if blocks > 1:
                part = materialize(part, "hits")
                shared.unpersist()
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id long, {id_col} long, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", id_col)


def _scan(shared, k: int):
    def run(batches: Iterator):
        import numpy as np
        import pandas as pd

        qid, q = shared.value
        best_s = np.full((len(qid), 0), 0.0)
        best_i = np.full((len(qid), 0), 0)
        for pdf in batches:
            same = pdf["v"].map(len) == q.shape[1]
            pdf = pdf[same]
            if not len(pdf):
                continue
            sim = q @ np.stack(pdf["v"].to_numpy()).astype(np.float64).T
            best_s = np.concatenate([best_s, sim], axis=1)
            best_i = np.concatenate([best_i, np.broadcast_to(pdf["id"].to_numpy(), sim.shape)], axis=1)
            if best_s.shape[1] > k:
                order = np.lexsort((best_i, -best_s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
        n = best_s.shape[1]
        yield pd.DataFrame({"query_id": np.repeat(qid, n), "id": best_i.reshape(-1), "score": best_s.reshape(-1)})

    return run
