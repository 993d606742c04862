from pyspark.sql import functions as F

from quarrylens.operators.prune import possibly_in


def test_members_stay_and_most_others_go(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4990, F.col("id")).alias("k"), F.lit("x").alias("_word"))
    few = spark.range(0, 5000, 50).select(F.col("id").alias("m"))
    found = possibly_in(rows, "k", few, "m").collect()
    kept = {r["k"] for r in found}
    assert {r["_word"] for r in found} == {"x"}
    assert {x for x in range(0, 5000, 50) if x < 4990} <= kept and None not in kept and len(kept) < 110
    assert possibly_in(rows, "k", few, "m", bits=7).select("k").columns == ["k"]  # a table that is full lets all through
    assert possibly_in(rows, "k", few.where("false"), "m").count() == 0
    assert possibly_in(rows.where("false"), "k", few, "m").count() == 0
