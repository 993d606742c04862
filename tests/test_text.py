import pytest
from pyspark.sql import functions as F

from quarrylens.functions import text as T

CASES = [("Đường Nguyễn Huệ", "duong nguyen hue"), ("BÁO CÁO", "bao cao"), ("plan Ω", "plan ω"), ("ho\u0300a", "hoa"), ("", ""), ("đĐ", "dd"), (None, None)]


def one(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i")
    return [r["r"] for r in rows.collect()]


def test_normalize(spark):
    assert one(spark, [a for a, _ in CASES], T.normalize) == [b for _, b in CASES]


def test_tokens_keep_punctuation_and_split_at_unicode_space(spark):
    got = one(spark, ["A\u00a0b, \u3000c.", "  ", "", None], T.tokens)
    assert got == [["a", "b,", "c."], [], [], None]


def test_fingerprint_keeps_accents(spark):
    assert one(spark, [" Lưu  HÀNH\n", "luu hanh", None], T.fingerprint) == ["lưu hành", "luu hanh", None]


def test_snippet_and_basename(spark):
    assert one(spark, ["a\nb" + "x" * 100, "kurz", None], T.snippet) == ["a b" + "x" * 77 + "...", "kurz", None]
    assert one(spark, ["/a/b.txt", "D:\\x\\y z.md", "solo"], T.basename) == ["b.txt", "y z.md", "solo"]


@pytest.mark.parametrize("query,keyword,hit", [("Nghiệm thu móng", "NGHIEM THU", True), ("đơn giá", "don gia", True), ("x", "y", False)])
def test_query_contains(spark, query, keyword, hit):
    row = spark.range(1).select(T.query_contains(F.lit(query), F.lit(keyword)).alias("r")).first()
    assert row["r"] is hit
