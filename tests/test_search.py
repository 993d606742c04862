import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.functions import vector as V
from quarrylens.functions.expr import running_sum
from quarrylens.operators import bm25, dedupe, hybrid, models, router, vectors

DOCS = [(1, "be tong mac cao"), (2, "be tong thuong"), (3, "cat xay"), (4, ""), (5, None), (6, "cat cat cat")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "chunk_id long, norm_text string")


def brute_bm25(query):
    words = {i: t.split() for i, t in DOCS if t and t.split()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    out = {}
    for i, w in words.items():
        s = 0.0
        for q in query.split():
            df = sum(q in x for x in words.values())
            if q in w:
                tf = w.count(q)
                s += max(0, math.log(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg))
        if s > 0:
            out[i] = s
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("query", ["be tong", "cat", "tong tong mac", "CÁT xây"])
def test_bm25_equals_brute_force(spark, docs, query):
    plain = {"CÁT xây": "cat xay"}.get(query, query)
    want = brute_bm25(plain)
    got = [(r["chunk_id"], r["score"]) for r in bm25.bm25_search(docs, query, 10).collect()]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-5)
    many = bm25.Bm25Index.build(docs).search_many(spark.createDataFrame([(7, query)], "query_id int, query string"), 10)
    assert [r["chunk_id"] for r in many.orderBy("rank").collect()] == [i for i, _ in want]


def test_saved_index(spark, docs, tmp_path, capsys):
    bm25.Bm25Index.build(docs).save(str(tmp_path))
    index = bm25.Bm25Index.load(spark, str(tmp_path))
    for query in ("be tong", "tong tong mac", "cat"):
        assert [r["chunk_id"] for r in index.search(query, 10).collect()] == [i for i, _ in brute_bm25(query)]
    assert index.search("", 5).count() == index.search("be", 0).count() == index.search("unknown", 5).count() == 0
    index.search("cat", 5).explain("formatted")
    assert "EqualTo(term,cat)" in capsys.readouterr().out


def test_bm25_empty_cases(spark, docs):
    assert bm25.bm25_search(docs, "  ", 5).count() == 0
    assert bm25.bm25_search(docs, "be", 0).count() == 0
    assert bm25.bm25_search(docs.where("false"), "be", 5).count() == 0


def test_vectors(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [-1.0, 0.0]), (5, []), (6, None)]
    df = spark.createDataFrame(rows, "chunk_id long, vector array<float>")
    assert [r["chunk_id"] for r in vectors.vector_topk(df, [1.0, 0.0], 9).collect()] == [1, 3, 2, 4]
    assert vectors.vector_topk(df, [1.0, 0.0], 0).count() == 0
    assert [r["chunk_id"] for r in vectors.int8_topk(vectors.quantized(df), [1.0, 0.0], 2).collect()] == [1, 3]
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 1.0]), (7, None), (6, []), (None, [1.0, 0.0]), (5, [1.0])], "query_id long, vector array<float>")
    want = [(8, 2), (8, 3), (9, 1), (9, 3)]
    for block in (4096, 1):  # one block of queries, and many
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        many = vectors.vector_topk_many(df, asked, 2).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["chunk_id"]) for r in many] == want
    assert vectors.vector_topk_many(df, asked.where("false"), 2).count() == 0


def test_quantisation(spark):
    rng = np.random.RandomState(42)
    rows = [(i, rng.randn(d).astype("float32")) for i, d in enumerate([3, 4, 64, 256] * 5)]
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in rows] + [(90, [0.0, 0.0]), (91, [])]
    df = spark.createDataFrame(rows, "i int, v array<float>").select("i", "v", V.quantize_int8(F.col("v")).alias("q"))
    for r in df.select("i", "v", "q.*", V.dequantize_int8(F.col("q.qvec"), F.col("q.scale")).alias("back")).collect():
        assert np.linalg.norm(np.array(r["v"]) - np.array(r["back"])) < 0.01 * max(1, len(r["v"]) / 64)
        assert r["scale"] >= 0 and all(-127 <= x <= 127 for x in r["qvec"])


def test_unequal_lengths_use_the_common_part(spark):
    row = spark.range(1).select(V.dot(V.literal([1, 2, 3]), V.literal([4, 5])).alias("d"), V.cosine(V.literal([0, 0]), V.literal([1, 1])).alias("c")).first()
    assert (row["d"], row["c"]) == (14.0, 0.0)


def test_single_precision(spark):
    rng = np.random.RandomState(1)
    rows = [(i, rng.randn(9).astype("float32").tolist(), rng.randn(9 - i % 3).astype("float32").tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, a array<float>, b array<float>").select("i", V.dot_f32(F.col("a"), F.col("b")).alias("d"))
    for (i, a, b), r in zip(rows, df.orderBy("i").collect()):
        s = np.float32(0)
        for x, y in zip(a, b):
            s = np.float32(s + np.float32(np.float32(x) * np.float32(y)))
        assert r["d"] == float(s)


def test_running_sum(spark):
    rows = [(i, [(i * 7 + k) % 5 for k in range(n)]) for i, n in enumerate((0, 1, 2, 3, 4, 6, 7, 20, 2500))] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, s array<int>")
    for block in (3, 1000):
        got = {r["i"]: r["r"] for r in df.select("i", running_sum(F.col("s"), block).alias("r")).collect()}
        assert got == {i: None if s is None else [sum(s[:k]) for k in range(len(s))] for i, s in rows}


def test_index_of_some_words(spark, docs):
    asked = spark.createDataFrame([(7, "be tong"), (8, "cat gạch")], "query_id int, query string")
    whole = bm25.Bm25Index.build(docs).search_many(asked, 10).orderBy("query_id", "rank").collect()
    index = bm25.Bm25Index.build(docs, words=bm25.query_words(asked))
    assert index.search_many(asked, 10).orderBy("query_id", "rank").collect() == whole
    assert {r["term"] for r in index.terms.collect()} == {"be", "tong", "cat"}


def test_boilerplate(spark):
    rows = [(1, "a", "Header  X"), (2, "b", "header x"), (3, "b", "body"), (4, "b", None), (5, "b", None), (6, "c", "twice"), (7, "c", "twice")]
    df = spark.createDataFrame(rows, "chunk_id int, file_path string, text string")
    flags = {r["chunk_id"]: r["is_boilerplate"] for r in dedupe.flag_boilerplate(df).collect()}
    assert flags == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: True}
    by_file = {r["chunk_id"]: r["is_boilerplate"] for r in dedupe.flag_boilerplate(df, distinct_files=True).collect()}
    assert by_file[1] and not by_file[6]
    assert dedupe.diff_embed(dedupe.flag_boilerplate(df)).count() == 3


def test_router(spark):
    routes = spark.createDataFrame([("bien-ban", ["biên bản", "nghiệm thu"]), ("hop-dong", ["hợp đồng"]), ("none", [])], "label string, keywords array<string>")
    assert router.boosts_of(routes, "BIEN BAN nghiệm thu") == {"bien-ban": 0.2}
    assert router.boosts_of(routes, "gì đó") == {}
    df = spark.createDataFrame([(1, "/kho/BIEN-BAN/x", 1.0), (2, "/kho/y", 1.0), (3, None, 1.0)], "chunk_id int, file_path string, score double")
    assert {r["chunk_id"]: round(r["score"], 3) for r in router.apply_boosts(df, {"bien-ban": 0.2}).collect()} == {1: 1.2, 2: 1.0, 3: 1.0}


def test_merge_and_buckets(spark):
    k = spark.createDataFrame([(1, 5.0), (2, 4.0)], "chunk_id int, score double")
    v = spark.createDataFrame([(2, 0.5), (3, 0.4)], "chunk_id int, score double")
    assert {r["chunk_id"]: r["score"] for r in hybrid.merge_scores(k, v).collect()} == {1: 5.0, 2: 0.5, 3: 0.4}
    assert hybrid.candidate_ids(k, v).count() == 3
    c = spark.createDataFrame([(1, "f", 1.0), (2, "f", 1.0), (3, "g", -4.0), (4, "h", 2.0)], "chunk_id int, file_path string, score double")
    got = [(r["chunk_id"], r["bucket"], r["rank"]) for r in hybrid.rank_candidates(c, {}, 10).orderBy("bucket", "rank").collect()]
    assert got == [(4, "exact", 1), (1, "exact", 2), (3, "suggest", 1)]


def test_recall(spark):
    pairs = spark.createDataFrame([(1, "mac be tong", "be tong mac cao", ["cat", "gach"]), (2, "cat", "gach", ["cat xay"])], "pair_id int, query string, positive string, hard_negatives array<string>")
    flat = models.expand_pairs(pairs)
    assert flat.count() == 5
    scored = flat.withColumn("score", (F.col("position") == 0).cast("double") * (F.col("pair_id") == 1).cast("double") + (F.col("position") > 0).cast("double") * 0.5)
    assert models.recall_at_1(scored).first().asDict() == {"pairs": 2, "hits": 1, "recall": 0.5}
    for reranker in (models.LexicalReranker(), models.DotReranker(models.HashingEmbedder(256))):
        timed = models.recall_at_1(models.score_pairs(reranker, flat)).first()
        assert (timed["pairs"], timed["hits"]) == (2, 1) and timed["mean_ms"] > 0
