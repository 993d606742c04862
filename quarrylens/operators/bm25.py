"""Okapi BM25 over a text column, as tables: postings (id, term, tf, dl), terms (term, df, idf), one row of statistics.

Term frequencies of a record come from its own sorted words, so building needs one shuffle, for document frequencies. A
search reads the terms of its queries only. Records without words count neither to n nor to avgdl.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import let, select_once
from ..functions.text import normalize, tokens

K1, B = 1.5, 0.75


def term_counts(words: Column) -> Column:
    """array<struct<term, tf, dl>> of an array of words: each word once with its count."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        entry = lambda s: F.transform(
            s,
            lambda at, i: F.struct(
                F.get(w, at).alias("term"), (F.coalesce(F.get(s, i + 1), F.size(w)) - at).alias("tf"), F.size(w).alias("dl")
            ),
        )
        return F.when(F.size(w) > 0, let(starts, entry))

    return let(F.sort_array(words), runs)


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log1p((n - df + 0.5) / (df + 0.5)))


def term_score(weight: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    f = tf.cast("double")
    return weight * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl))


@dataclass
class Bm25Index:
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    id_col: str

    @classmethod
    def build(cls, df: DataFrame, id_col: str = "chunk_id", text_col: str = "norm_text", words: DataFrame | None = None) -> Bm25Index:
        """The index of all records. With words (term) only their postings are made, and written, as they are read twice;
        what is known of the collection still counts every record."""
        split = df.select(F.col(id_col).alias("_id"), tokens(F.col(text_col)).alias("_w"))
        length = F.size("_w")
        size = [F.count_if(length > 0).alias("n"), F.avg(F.when(length > 0, length)).alias("avgdl")]
        seen = Observation()
        source = split if words is None else split.observe(seen, *size)
        postings = source.select("_id", F.inline(term_counts(F.col("_w")))).select(F.col("_id").alias(id_col), "term", "tf", "dl")
        stats = split.agg(*size)
        if words is not None:
            from ..session import materialize

            postings = materialize(postings.join(words.select("term").distinct(), "term", "left_semi"), "postings")
            counted = seen.get  # of the same pass
            stats = df.sparkSession.range(1).select(F.lit(counted.get("n", 0)).cast("long").alias("n"), F.lit(counted.get("avgdl")).cast("double").alias("avgdl"))
        counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        terms = counts.withColumn("_n", _scalar(stats, "n"))
        terms = terms.select("term", "df", idf(F.col("_n"), F.col("df")).alias("idf"))
        return cls(postings, terms, stats, id_col)

    def save(self, path: str) -> None:
        """Write the tables; postings in the order of (term, id), so a search reads only the row groups of its terms.

        The order is by range of both, so a term that very many records hold is spread over several files.
        """
        order = ["term", self.id_col]
        self.postings.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str, id_col: str = "chunk_id") -> Bm25Index:
        postings, terms, stats = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "stats"))
        return cls(postings, terms, stats, id_col)

    def search(self, query: str, k: int) -> DataFrame:
        """(id, score) of the k best records for one query, best first. Only postings of its words are read."""
        spark = self.postings.sparkSession
        asked = spark.range(1).select(tokens(normalize(F.lit(query))).alias("w")).first()["w"] or []
        known = {r["term"]: r["idf"] for r in self.terms.where(F.col("term").isin(asked)).collect()} if asked else {}
        if not known or k <= 0:
            return self.postings.where(F.lit(False)).select(self.id_col, F.lit(0.0).alias("score"))
        avgdl = self.stats.first()["avgdl"]
        weight, times = F.lit(0.0), F.lit(0)
        for term, value in known.items():
            weight = F.when(F.col("term") == term, F.lit(value)).otherwise(weight)
            times = F.when(F.col("term") == term, F.lit(asked.count(term))).otherwise(times)
        one = term_score(weight, F.col("tf"), F.col("dl"), F.lit(avgdl)).cast("float").cast("double")
        hits = self.postings.where(F.col("term").isin(list(known)))
        scored = hits.groupBy(self.id_col).agg(F.sum(one * times).alias("score")).where("score > 0")
        return scored.orderBy(F.desc("score"), self.id_col).limit(k)

    def search_many(self, queries: DataFrame, k: int, query_id: str = "query_id", query_col: str = "query", as_float: bool = True) -> DataFrame:
        """(query_id, id, score, rank): the k best records of every query; a repeated query word counts again.

        Scores are narrowed to single precision term by term unless as_float is false.
        """
        words = query_words(queries, query_id, query_col).withColumnRenamed(query_id, "_q")
        words = words.groupBy("_q", "term").agg(F.count(F.lit(1)).alias("times"))
        wanted = words.join(self.terms, "term")  # terms of the queries only
        hits = self.postings.join(wanted, "term").withColumn("_avgdl", _scalar(self.stats, "avgdl"))
        one = term_score(F.col("idf"), F.col("tf"), F.col("dl"), F.col("_avgdl"))
        one = one.cast("float").cast("double") if as_float else one
        scored = hits.groupBy("_q", self.id_col).agg(F.sum(one * F.col("times")).alias("score")).where("score > 0")
        rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), self.id_col))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("_q").alias(query_id), self.id_col, "score", "rank")


def query_words(queries: DataFrame, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
    """(query_id, term): the words of every query, repeats included."""
    return queries.select(query_id, F.explode(tokens(normalize(F.col(query_col)))).alias("term"))


def _scalar(one_row: DataFrame, column: str) -> Column:
    """A column of a one-row table as a scalar subquery."""
    return one_row.select(column).scalar()


def bm25_search(
    df: DataFrame, query: str, k: int, id_col: str = "chunk_id", text_col: str = "norm_text", keep: list[str] | None = None
) -> DataFrame:
    """(id_col, *keep, score) of the k best records for one query, best first, smaller id on ties.

    One query needs no postings: one pass counts its terms and the collection and keeps the records that hold a term.
    No words in the query, k <= 0 or an empty collection give no rows.
    """
    scored = bm25_scores(df, query, id_col, text_col, keep)
    return scored.where(F.col("score") > 0).orderBy(F.desc("score"), id_col).limit(max(k, 0))


def bm25_scores(df: DataFrame, query: str, id_col: str = "chunk_id", text_col: str = "norm_text", keep: list[str] | None = None) -> DataFrame:
    """(id_col, *keep, score) of every record that holds a word of the query.

    The records that do are written with their counts while the same pass observes the whole collection.
    """
    from ..session import materialize

    spark = df.sparkSession
    row = spark.range(1).select(tokens(normalize(F.lit(query))).alias("w")).first()
    asked = row["w"] or []
    terms = list(dict.fromkeys(asked))
    keep = list(keep or [])
    if not terms:
        return df.where(F.lit(False)).select(id_col, *keep, F.lit(0.0).alias("score"))

    def counts(w: Column) -> Column:
        tf = [(F.size(w) - F.size(F.array_remove(w, t))).alias(f"_tf{i}") for i, t in enumerate(terms)]
        return F.struct(F.size(w).alias("_dl"), *tf)

    counted = select_once(df, [id_col, *keep], let(tokens(F.col(text_col)), counts)).where("_dl > 0")
    seen = Observation()
    counted = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("avgdl"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    any_hit = F.greatest(*(F.col(f"_tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    counted = materialize(counted.where(any_hit), "hits")
    stats = seen.get
    if not stats.get("n"):
        return counted.select(id_col, *keep, F.lit(0.0).alias("score"))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        one = term_score(idf(F.lit(stats["n"]), F.lit(stats[f"df{i}"])), F.col(f"_tf{i}"), F.col("_dl"), F.lit(stats["avgdl"]))
        score = score + F.lit(float(asked.count(t))) * one.cast("float").cast("double")
    return counted.select(id_col, *keep, score.alias("score"))
