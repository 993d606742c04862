"""Mixing sources to target shares of tokens, by systematic sampling.

Every source gets a rate, the expected copies of each of its documents: target tokens over tokens at hand, at most its
max_repeats. The documents of a source stand in a line, their expected copies are summed along it, one random offset is
added, and a document is emitted once for each whole number its sum crosses. The line is made of blocks of about PER_BLOCK
documents, drawn by hash and counted first, so that no task holds a whole source; within a block documents stand by size,
so that the tokens come out as evenly as the documents.

The size of the mix, unless given, is the largest at which max_repeats lets every source that has tokens reach its target;
shares of sources without tokens are spread over the others in proportion. With a given size, sources short of documents
stay below their target. Documents without tokens (null, empty) or without an id take no part; sources without a target
neither. Texts are joined back to the documents drawn; of rows with one id the smallest text is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokenizing import DEFAULT_VOCABULARY, count_tokens

#: Documents of a block of the line, on average.
PER_BLOCK = 50_000


def plan_rates(targets: list[tuple[str, float, int]], sizes: dict[str, int], total_tokens: float | None = None) -> dict[str, float]:
    """Expected copies of each document by source."""
    alive = [(s, t, m) for s, t, m in targets if sizes.get(s, 0) > 0 and t and t > 0 and m and m > 0]
    if not alive:
        return {}
    whole = sum(t for _, t, _ in alive)
    size = total_tokens if total_tokens is not None else min(m * sizes[s] * whole / t for s, t, m in alive)
    return {s: min(float(m), size * t / whole / sizes[s]) for s, t, m in alive}


def with_texts(drawn: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents drawn with their texts, one row a document; the others are left out by a bit table before the join."""
    from ..operators.prune import possibly_in

    some = possibly_in(docs.select(F.col(id_col), F.col(text_col).alias("text")), id_col, drawn)
    texts = some.groupBy(id_col).agg(F.min("text").alias("text"))
    return drawn.join(texts, id_col).select(id_col, "source", "text", "n_tokens", "copies")


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    total_tokens: float | None = None,
    seed: int = 11,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """((id_col, source, n_tokens, copies) of the documents drawn, the report of shares by source).

    targets is (source, target_share, max_repeats), one row a source; a table of settings, read by the driver.
    """
    import random

    from ..session import materialize

    spark = docs.sparkSession
    wanted = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect()]
    names = [s for s, _, _ in wanted if s is not None]
    own = docs.where(F.col(source_col).isin(names)) if names else docs.where(F.lit(False))
    own = own.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    counted = count_tokens(own, "_id", "_text", vocabulary, by="_source").where("n_tokens > 0")
    counted = materialize(counted, "token-counts")  # a few bytes a document; tokenizing is not repeated
    sizes = {r["_source"]: (r["t"], r["n"]) for r in counted.groupBy("_source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    rates = plan_rates(wanted, {s: t for s, (t, _) in sizes.items()}, total_tokens)
    offsets = {s: random.Random(f"{seed}-{s}").random() for s in rates}
    parts = max([1, *(-(-n // PER_BLOCK) for _, n in sizes.values())])
    plan = spark.createDataFrame([(s, r, offsets[s]) for s, r in rates.items()], "_source string, rate double, offset double")
    line = counted.withColumn("part", F.pmod(F.xxhash64("_id"), F.lit(parts)))
    block = ["_source", "part"]
    before = Window.partitionBy("_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = line.groupBy(*block).agg(F.count(F.lit(1)).alias("m")).withColumn("ahead", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    place = F.row_number().over(Window.partitionBy(*block).orderBy("n_tokens", F.xxhash64("_id"), "_id"))
    placed = line.withColumn("place", place).join(heads, block)
    placed = placed.join(F.broadcast(plan), "_source")  # one row a source of the settings
    at = F.col("ahead") + F.col("place")
    copies = F.floor(F.col("offset") + F.col("rate") * at) - F.floor(F.col("offset") + F.col("rate") * (at - 1))
    drawn = placed.withColumn("copies", copies.cast("int")).where("copies > 0")
    drawn = drawn.select(F.col("_id").alias(id_col), F.col("_source").alias("source"), "n_tokens", "copies")
    reached = drawn.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("appearances"), F.max("copies").alias("most_repeats"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"),
    )
    at_hand = spark.createDataFrame([(s, t) for s, (t, _) in sizes.items()], "source string, tokens_at_hand long")
    report = targets.select("source", "target_share", "max_repeats").join(reached, "source", "left").join(at_hand, "source", "left")
    zero = {c: 0 for c in ("documents", "appearances", "most_repeats", "tokens", "tokens_at_hand")}
    report = report.fillna(zero).withColumn("share", F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(0.0)))
    return drawn, report
