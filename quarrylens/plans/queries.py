"""The driver's queries over the core operators, and the SQL they are compared with. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import bm25, chunking, dedupe, hybrid, models, router, vectors
from ..session import shared_dir, table
from ..sources import listing

Query = Callable[[SparkSession, str], DataFrame]
QUERY = "biên bản nghiệm thu móng"
K = 20
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- pieces of SQL ------------------------------------------------------------------------------------------------
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LD = r"\p{L}\p{Nd}"


def _norm(c: str) -> str:
    return f"lower(regexp_replace(strip_accents(replace(replace({c}, 'Đ', 'd'), 'đ', 'd')), '\\p{{Mn}}', '', 'g'))"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '{WS}+'), lambda x: x <> '')"


def _bm25(source: str, key: str, text: str, query: str = QUERY, extra: str = "") -> str:
    """CTEs down to bm(key, score)."""
    return f"""words AS (SELECT {key}, {_words(text)} AS w FROM {source} WHERE {text} IS NOT NULL),
dl AS (SELECT {key}, len(w) AS dl FROM words WHERE len(w) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT unnest({_words(_norm("'" + query + "'"))}) AS term),
tok AS (SELECT {key}, unnest(w) AS term FROM words),
tf AS (SELECT {key}, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT {key}, sum(CAST(CAST(greatest(0, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS FLOAT) AS DOUBLE)) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING ({key}), st GROUP BY {key})"""


_SEGMENTS = f"""seg AS (
  SELECT doc_id, text AS rest, 0 AS pos, '' AS s FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, substring(rest, take + 1), pos + take, substring(rest, 1, take) FROM (
    SELECT doc_id, rest, pos, CASE WHEN length(rest) <= 512 THEN length(rest) ELSE coalesce(
      nullif(greatest(length(regexp_extract(rest, '(?s)^(.{{255,511}}[\\r\\n])', 1)), length(regexp_extract(rest, '(?s)^(.{{255,511}}[.!?])[^{LD}]', 1))), 0),
      nullif(greatest(length(regexp_extract(rest, '(?s)^(.{{0,511}}[^{LD}])', 1)), length(regexp_extract(rest, '(?s)^(.{{1,512}})[^{LD}]', 1))), 0),
      length(regexp_extract(rest, '^[{LD}]+'))) END AS take
    FROM seg WHERE rest <> '') x),
cut AS (SELECT doc_id, pos - length(s) + length(s) - length(regexp_replace(s, '^{WS}+', '')) AS chunk_offset,
  regexp_replace(regexp_replace(s, '^{WS}+', ''), '{WS}+$', '') AS text FROM seg WHERE s <> ''),
chk AS (SELECT doc_id, chunk_offset, text FROM cut WHERE text <> '')"""

_VEC = "CAST(vector AS DOUBLE[])"
_USABLE = "vector IS NOT NULL AND len(vector) > 0"
_ASK = f"(SELECT {_VEC} AS q FROM chunks WHERE {_USABLE} AND list_dot_product({_VEC}, {_VEC}) > 0 ORDER BY chunk_id LIMIT 1)"


def _ask(chunks: DataFrame) -> list[float]:
    """The first usable vector, as the query vector."""
    v = F.col("vector")
    return chunks.where((F.size(v) > 0) & (V.dot(v, v) > 0)).orderBy("chunk_id").select(v).first()[0]


def _round(c, n: int = 6):
    return F.round(c, n)


# ---- text functions -----------------------------------------------------------------------------------------------
@_query(f"SELECT doc_id, {_norm('text')} AS norm FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


@_query(f"SELECT doc_id, {_words('text')} AS words FROM documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("words"))


@_query(f"SELECT chunk_id, trim(regexp_replace(lower(text), '{WS}+', ' ', 'g')) AS fp FROM chunks")
def fingerprints(spark, d):
    return table(spark, d, "chunks").select("chunk_id", T.fingerprint(F.col("text")).alias("fp"))


@_query(
    r"""SELECT chunk_id, CASE WHEN length(text) > 80 THEN replace(substring(text, 1, 80), chr(10), ' ') || '...' ELSE replace(text, chr(10), ' ') END AS snippet,
  list_last(string_split_regex(file_path, '[/\\]')) AS name, format('{:.4f}', CAST(coalesce(chunk_offset, 0) AS DOUBLE) / 8) AS shown FROM chunks"""
)
def snippets(spark, d):
    score = F.coalesce("chunk_offset", F.lit(0)).cast("double") / 8
    return table(spark, d, "chunks").select(
        "chunk_id", T.snippet(F.col("text")).alias("snippet"), T.basename(F.col("file_path")).alias("name"), T.format_score(score).alias("shown")
    )


# ---- chunking -----------------------------------------------------------------------------------------------------
@_query(f"WITH RECURSIVE {_SEGMENTS} SELECT doc_id, chunk_offset, text FROM chk")
def chunk_documents(spark, d):
    return chunking.chunk_documents(table(spark, d, "documents"), "doc_id")


@_query(f"WITH RECURSIVE {_SEGMENTS} SELECT doc_id AS file_id, chunk_offset, row_number() OVER (ORDER BY doc_id, chunk_offset) AS chunk_id FROM chk")
def chunk_ids(spark, d):
    chunks = chunking.chunk_documents(table(spark, d, "documents"), "doc_id")
    return chunking.assign_ids(chunks, "doc_id").select(F.col("doc_id").alias("file_id"), "chunk_offset", "chunk_id")


# ---- keyword index ------------------------------------------------------------------------------------------------
_TF = f"tok AS (SELECT chunk_id, unnest({_words('norm_text')}) AS term FROM chunks WHERE norm_text IS NOT NULL), tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL)"


@_query(f"WITH {_TF} SELECT chunk_id, term, tf FROM tf")
def term_frequencies(spark, d):
    return bm25.Bm25Index.build(table(spark, d, "chunks")).postings.select("chunk_id", "term", F.col("tf").cast("long").alias("tf"))


@_query(f"WITH {_TF}, n AS (SELECT count(DISTINCT chunk_id) AS n FROM tf) SELECT term, count(*) AS df, round(greatest(0, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5))), 6) AS idf FROM tf, n GROUP BY term")
def term_stats(spark, d):
    return bm25.Bm25Index.build(table(spark, d, "chunks")).terms.select("term", "df", _round(F.col("idf")).alias("idf"))


@_query(f"WITH {_TF} SELECT chunk_id, CAST(sum(tf) AS BIGINT) AS dl FROM tf GROUP BY chunk_id")
def doc_lengths(spark, d):
    n = F.size(T.tokens(F.col("norm_text")))
    return table(spark, d, "chunks").where(n > 0).select("chunk_id", n.cast("long").alias("dl"))


@_query(f"WITH {_TF}, dl AS (SELECT chunk_id, sum(tf) AS dl FROM tf GROUP BY chunk_id) SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM dl")
def collection_stats(spark, d):
    return bm25.Bm25Index.build(table(spark, d, "chunks")).stats.select("n", _round(F.col("avgdl")).alias("avgdl"))


@_query(f"WITH {_bm25('chunks', 'chunk_id', 'norm_text')} SELECT chunk_id, round(score, 5) AS score FROM bm ORDER BY bm.score DESC, chunk_id LIMIT {K}")
def bm25_topk(spark, d):
    return bm25.bm25_search(table(spark, d, "chunks"), QUERY, K).select("chunk_id", _round(F.col("score"), 5).alias("score"))


@_query(_SQL["bm25_topk"])
def bm25_saved_index(spark, d):
    """The same search over an index that was built once, written in the order of its terms and read back."""
    import uuid

    path = f"{shared_dir(spark)}/quarrylens/bm25-{uuid.uuid4().hex}"
    bm25.Bm25Index.build(table(spark, d, "chunks")).save(path)
    return bm25.Bm25Index.load(spark, path).search(QUERY, K).select("chunk_id", _round(F.col("score"), 5).alias("score"))


_BATCH = f"""words AS (SELECT chunk_id, {_words('norm_text')} AS w FROM chunks WHERE norm_text IS NOT NULL),
dl AS (SELECT chunk_id, len(w) AS dl FROM words WHERE len(w) > 0), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT pair_id, unnest({_words(_norm('query'))}) AS term FROM ranking_pairs WHERE query IS NOT NULL),
qt AS (SELECT pair_id, term, count(*) AS times FROM q GROUP BY ALL),
tok AS (SELECT chunk_id, unnest(w) AS term FROM words),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT pair_id, chunk_id, sum(times * greatest(0, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), st GROUP BY pair_id, chunk_id)"""


@_query(f"WITH {_BATCH} SELECT pair_id, chunk_id, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY round(score, 9) DESC, chunk_id) <= 5")
def bm25_batch(spark, d):
    pairs = table(spark, d, "ranking_pairs").where("query IS NOT NULL")
    index = bm25.Bm25Index.build(table(spark, d, "chunks"), words=bm25.query_words(pairs, "pair_id"))
    hits = index.search_many(pairs, 5, "pair_id", as_float=False)
    return hits.select("pair_id", "chunk_id", _round(F.col("score")).alias("score"))


def _chunked(spark, d):
    chunks = chunking.chunk_documents(table(spark, d, "documents"), "doc_id")
    return chunks.withColumn("norm_text", T.normalize(F.col("text"))).withColumn("key", F.col("doc_id") * 1000000 + F.col("chunk_offset"))


@_query(
    f"""WITH RECURSIVE {_SEGMENTS}, c AS (SELECT doc_id, text, doc_id * 1000000 + chunk_offset AS key, {_norm('text')} AS norm_text FROM chk),
{_bm25('c', 'key', 'norm_text')},
best AS (SELECT doc_id, key, score, text FROM bm JOIN c USING (key) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, key) = 1)
SELECT doc_id, key, round(score, 5) AS score, text FROM best ORDER BY best.score DESC, key LIMIT {K}"""
)
def bm25_best_chunk_per_doc(spark, d):
    """The flagship: documents are chunked, normalised, scored, reduced to one chunk each, and the best are kept."""
    scored = bm25.bm25_scores(_chunked(spark, d), QUERY, "key", keep=["doc_id", "text"]).where("score > 0")
    best = hybrid.top(hybrid.best_per_file(scored, "key", "doc_id"), K, "key")
    return best.select("doc_id", "key", _round(F.col("score"), 5).alias("score"), "text")


# ---- vectors ------------------------------------------------------------------------------------------------------
@_query(f"WITH a AS {_ASK} SELECT chunk_id, round(list_dot_product({_VEC}, q), 6) AS score FROM chunks, a WHERE {_USABLE} ORDER BY list_dot_product({_VEC}, q) DESC, chunk_id LIMIT {K}")
def vector_topk(spark, d):
    chunks = table(spark, d, "chunks")
    return vectors.vector_topk(chunks, _ask(chunks), K).select("chunk_id", _round(F.col("score")).alias("score"))


@_query(
    """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, q)
SELECT query_id, vec_id, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10"""
)
def vector_topk_many(spark, d):
    rows = table(spark, d, "embeddings")
    hits = vectors.vector_topk_many(rows, rows.where("vec_id % 50 = 0"), 10, "vec_id", "embedding", "vec_id", "embedding")
    return hits.select("query_id", "vec_id", _round(F.col("score")).alias("score"))


_UNIT = f"sqrt(list_dot_product({_VEC}, {_VEC}))"


@_query(f"SELECT chunk_id, round({_UNIT}, 5) AS norm, round(CASE WHEN {_UNIT} > 1e-12 THEN 1 ELSE {_UNIT} END, 5) AS unit_norm FROM chunks WHERE {_USABLE}")
def vector_l2_norms(spark, d):
    v = F.col("vector")
    rows = table(spark, d, "chunks").where(F.size(v) > 0)
    return rows.select("chunk_id", _round(V.norm(v), 5).alias("norm"), _round(V.norm(V.l2_normalize(v)), 5).alias("unit_norm"))


@_query(f"WITH a AS {_ASK} SELECT chunk_id, round(CASE WHEN {_UNIT} = 0 THEN 0 ELSE list_dot_product({_VEC}, q) / ({_UNIT} * sqrt(list_dot_product(q, q))) END, 6) AS cosine FROM chunks, a WHERE {_USABLE}")
def cosine_scores(spark, d):
    chunks = table(spark, d, "chunks")
    return chunks.where(F.size("vector") > 0).select("chunk_id", _round(V.cosine(F.col("vector"), V.literal(_ask(chunks)))).alias("cosine"))


def _quant(v: str) -> str:
    scale = f"CAST(list_max(list_transform({v}, lambda x: abs(x))) / 127::FLOAT AS FLOAT)"
    q = f"list_transform({v}, lambda x: CASE WHEN {scale} = 0 THEN 0 ELSE greatest(-127, least(127, round(CAST(CAST(x / {scale} AS FLOAT) AS DOUBLE)))) END::TINYINT)"
    return f"{q} AS qvec, {scale} AS scale"


@_query(f"SELECT chunk_id, qvec, round(scale::DOUBLE, 9) AS scale FROM (SELECT chunk_id, {_quant('vector')} FROM chunks WHERE {_USABLE})")
def quantize_int8(spark, d):
    return vectors.quantized(table(spark, d, "chunks")).select("chunk_id", "qvec", _round(F.col("scale").cast("double"), 9).alias("scale"))


@_query(f"SELECT chunk_id, round(sqrt(list_sum(list_transform(list_zip(v, qvec), lambda p: pow(p[1]::DOUBLE - (p[2]::FLOAT * scale)::FLOAT::DOUBLE, 2)))), 5) AS loss FROM (SELECT chunk_id, vector AS v, {_quant('vector')} FROM chunks WHERE {_USABLE})")
def quantize_loss(spark, d):
    rows = vectors.quantized(table(spark, d, "chunks"), keep=["vector"])
    gap = F.zip_with("vector", V.dequantize_int8(F.col("qvec"), F.col("scale")), lambda a, b: a.cast("double") - b.cast("double"))
    return rows.select("chunk_id", _round(V.norm(gap), 5).alias("loss"))


@_query(
    f"""WITH e AS (SELECT chunk_id, {_quant('vector')} FROM chunks WHERE {_USABLE}),
a AS (SELECT qvec AS aq, scale AS sa FROM (SELECT {_quant('q')} FROM (SELECT CAST(q AS FLOAT[]) AS q FROM {_ASK})))
SELECT chunk_id, round(s, 6) AS score FROM (SELECT chunk_id, list_dot_product(CAST(qvec AS DOUBLE[]), CAST(aq AS DOUBLE[])) * scale::DOUBLE * sa::DOUBLE AS s FROM e, a)
ORDER BY s DESC, chunk_id LIMIT {K}"""
)
def int8_topk(spark, d):
    chunks = table(spark, d, "chunks")
    return vectors.int8_topk(vectors.quantized(chunks), _ask(chunks), K).select("chunk_id", _round(F.col("score")).alias("score"))


# ---- hybrid search ------------------------------------------------------------------------------------------------
_BOTH = f"""a AS {_ASK}, {_bm25('chunks', 'chunk_id', 'norm_text')},
kw AS (SELECT chunk_id, score FROM bm ORDER BY score DESC, chunk_id LIMIT {K}),
ve AS (SELECT chunk_id, list_dot_product({_VEC}, q) AS score FROM chunks, a WHERE {_USABLE} ORDER BY list_dot_product({_VEC}, q) DESC, chunk_id LIMIT {K})"""


@_query(f"WITH {_BOTH}, m AS (SELECT chunk_id, coalesce(ve.score, kw.score) AS score FROM kw FULL JOIN ve USING (chunk_id)) SELECT chunk_id, file_path, round(score, 5) AS score FROM m JOIN chunks USING (chunk_id) ORDER BY m.score DESC, chunk_id LIMIT {K}")
def hybrid_search(spark, d):
    chunks = table(spark, d, "chunks")
    return hybrid.search(chunks, QUERY, _ask(chunks), K).select("chunk_id", "file_path", _round(F.col("score"), 5).alias("score"))


@_query(f"WITH {_BOTH} SELECT chunk_id FROM kw UNION SELECT chunk_id FROM ve")
def candidate_union(spark, d):
    chunks = table(spark, d, "chunks")
    return hybrid.candidate_ids(bm25.bm25_search(chunks, QUERY, K), vectors.vector_topk(chunks, _ask(chunks), K))


_FLAGS = f"""fl AS (SELECT chunk_id, file_path, vector, text IS NOT NULL AND count(*) OVER (PARTITION BY trim(regexp_replace(lower(text), '{WS}+', ' ', 'g'))) >= 2 AS is_boilerplate FROM chunks)"""


@_query(f"WITH {_FLAGS} SELECT chunk_id, is_boilerplate FROM fl")
def boilerplate_flags(spark, d):
    return dedupe.flag_boilerplate(table(spark, d, "chunks")).select("chunk_id", "is_boilerplate")


@_query(f"SELECT chunk_id, text IS NOT NULL AND n >= 2 AS is_boilerplate FROM chunks LEFT JOIN (SELECT trim(regexp_replace(lower(text), '{WS}+', ' ', 'g')) AS fp, count(DISTINCT file_path) AS n FROM chunks GROUP BY 1) ON fp IS NOT DISTINCT FROM trim(regexp_replace(lower(text), '{WS}+', ' ', 'g'))")
def boilerplate_by_files(spark, d):
    return dedupe.flag_boilerplate(table(spark, d, "chunks"), distinct_files=True).select("chunk_id", "is_boilerplate")


@_query(f"WITH {_FLAGS}, a AS {_ASK} SELECT chunk_id, round(list_dot_product({_VEC}, q), 6) AS score FROM fl, a WHERE {_USABLE} AND NOT is_boilerplate ORDER BY list_dot_product({_VEC}, q) DESC, chunk_id LIMIT {K}")
def diff_embed_topk(spark, d):
    chunks = table(spark, d, "chunks")
    kept = dedupe.diff_embed(dedupe.flag_boilerplate(chunks))
    return vectors.vector_topk(kept, _ask(chunks), K).select("chunk_id", _round(F.col("score")).alias("score"))


_KEYWORDS = f"kw_ AS (SELECT label, {_norm('keyword')} AS keyword FROM (SELECT label, unnest(keywords) AS keyword FROM routes))"


@_query(f"WITH {_KEYWORDS} SELECT pair_id, label, round(count(*) * 0.1::DOUBLE, 6) AS boost FROM ranking_pairs JOIN kw_ ON contains({_norm('query')}, keyword) GROUP BY pair_id, label")
def router_boosts(spark, d):
    return router.query_boosts(table(spark, d, "routes"), table(spark, d, "ranking_pairs"), "pair_id")


@_query(f"WITH {_KEYWORDS}, b AS (SELECT label, count(*) * 0.1::DOUBLE AS boost FROM kw_ WHERE contains({_norm(chr(39) + QUERY + chr(39))}, keyword) GROUP BY label) SELECT chunk_id, round(coalesce(sum(boost), 0::DOUBLE), 6) AS score FROM chunks LEFT JOIN b ON contains(lower(file_path), lower(label)) GROUP BY chunk_id")
def path_boosts(spark, d):
    chunks = table(spark, d, "chunks").select("chunk_id", "file_path", F.lit(0.0).alias("score"))
    boosted = router.apply_boosts(chunks, router.boosts_of(table(spark, d, "routes"), QUERY))
    return boosted.select("chunk_id", _round(F.col("score")).alias("score"))


@_query(f"WITH a AS {_ASK}, s AS (SELECT chunk_id, file_path, list_dot_product({_VEC}, q) AS score FROM chunks, a WHERE {_USABLE}) SELECT file_path, chunk_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY s.score DESC, chunk_id) = 1")
def best_chunk_per_file(spark, d):
    chunks = table(spark, d, "chunks")
    scored = chunks.where(F.size("vector") > 0).select("chunk_id", "file_path", V.dot(F.col("vector"), V.literal(_ask(chunks))).alias("score"))
    return hybrid.best_per_file(scored).select("file_path", "chunk_id", _round(F.col("score")).alias("score"))


#: A stand-in for a reranker's logit that both engines can compute: a spread of the offset around the bucket's edge.
_LOGIT = "(coalesce(chunk_offset, 0) % 997) / 100.0 - 6"


@_query(
    f"""WITH {_KEYWORDS}, {_BOTH}, b AS (SELECT label, count(*) * 0.1::DOUBLE AS boost FROM kw_ WHERE contains({_norm(chr(39) + QUERY + chr(39))}, keyword) GROUP BY label),
ids AS (SELECT chunk_id FROM kw UNION SELECT chunk_id FROM ve),
c AS (SELECT chunk_id, file_path, CAST({_LOGIT} AS DOUBLE) + coalesce((SELECT sum(boost) FROM b WHERE contains(lower(file_path), lower(label))), 0) AS score FROM ids JOIN chunks USING (chunk_id)),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY round(score, 9) DESC, chunk_id) = 1),
t AS (SELECT * FROM f ORDER BY round(score, 9) DESC, chunk_id LIMIT 10),
p AS (SELECT chunk_id, file_path, score, CAST(1 / (1 + exp(-score)) AS FLOAT) AS prob FROM t)
SELECT chunk_id, file_path, round(prob::DOUBLE, 5) AS score, CASE WHEN prob >= 0.05::FLOAT THEN 'exact' ELSE 'suggest' END AS bucket,
  row_number() OVER (PARTITION BY prob >= 0.05::FLOAT ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM p"""
)
def ranked_buckets(spark, d):
    chunks = table(spark, d, "chunks")
    ids = hybrid.candidate_ids(bm25.bm25_search(chunks, QUERY, K), vectors.vector_topk(chunks, _ask(chunks), K))
    scored = hybrid.hydrate(ids, chunks, keep=("file_path", "chunk_offset")).select("chunk_id", "file_path", F.expr(_LOGIT).cast("double").alias("score"))
    ranked = hybrid.rank_candidates(scored, router.boosts_of(table(spark, d, "routes"), QUERY), 10)
    return ranked.select("chunk_id", "file_path", _round(F.col("score").cast("double"), 5).alias("score"), "bucket", F.col("rank").cast("long").alias("rank"))


def _ranked(boosts: str) -> str:
    """The whole ranked search: both sides' five best, the lexical stand-in as reranker, boosts, best chunk a file, buckets."""
    asked = f"list_distinct({_words(chr(39) + QUERY + chr(39))})"
    share = f"(len(list_intersect(list_distinct({_words('text')}), {asked})) / len({asked}))"
    return f"""WITH {_KEYWORDS}, {_BOTH}, b AS ({boosts}),
ids AS ((SELECT chunk_id FROM bm ORDER BY score DESC, chunk_id LIMIT 5) UNION (SELECT chunk_id FROM ve ORDER BY score DESC, chunk_id LIMIT 5)),
c AS (SELECT chunk_id, file_path, text, CAST(ln(({share} + 0.01) / (1.01 - {share})) AS FLOAT)::DOUBLE + coalesce((SELECT sum(boost) FROM b WHERE contains(lower(file_path), lower(label))), 0) AS score FROM ids JOIN chunks USING (chunk_id)),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY round(score, 9) DESC, chunk_id) = 1),
t AS (SELECT *, CAST(1 / (1 + exp(-score)) AS FLOAT) AS prob FROM f ORDER BY round(score, 9) DESC, chunk_id LIMIT 10)
SELECT chunk_id, file_path, text, round(prob::DOUBLE, 5) AS score, CASE WHEN prob >= 0.05::FLOAT THEN 'exact' ELSE 'suggest' END AS bucket,
  row_number() OVER (PARTITION BY prob >= 0.05::FLOAT ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM t"""


_BOOSTS = f"SELECT label, count(*) * 0.1::DOUBLE AS boost FROM kw_ WHERE contains({_norm(chr(39) + QUERY + chr(39))}, keyword) GROUP BY label"


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("chunk_id", "file_path", "text", _round(F.col("score").cast("double"), 5).alias("score"), "bucket", F.col("rank").cast("long").alias("rank"))


@_query(_ranked(_BOOSTS))
def search_ranked(spark, d):
    chunks = table(spark, d, "chunks")
    return _shown(hybrid.search_ranked(chunks, QUERY, _ask(chunks), 10, models.LexicalReranker(), router.boosts_of(table(spark, d, "routes"), QUERY)))


class _Asked:
    """An embedder that knows one vector, so that SQL can say what a search finds."""

    def __init__(self, vector: list[float]):
        self.vector, self.dim = vector, len(vector)

    def embed(self, texts: list[str]):
        import numpy as np

        return np.array([self.vector] * len(texts), dtype=np.float32)


def _engine(spark, d):
    """An engine over a store of all chunks, with its index prepared."""
    import uuid

    from ..operators.engine import Config, Engine

    chunks = table(spark, d, "chunks")
    engine = Engine(spark, Config(f"{shared_dir(spark)}/quarrylens/engine-{uuid.uuid4().hex}"), embedder=_Asked(_ask(chunks)))
    engine.store.append(chunks)
    engine.prepare()
    return engine


@_query(_SQL["hybrid_search"])
def engine_search(spark, d):
    """The merged search over the saved keyword index and the narrow table of vectors."""
    return _engine(spark, d).search(QUERY, K).select("chunk_id", "file_path", _round(F.col("score"), 5).alias("score"))


@_query(_ranked(_BOOSTS))
def engine_search_ranked(spark, d):
    engine = _engine(spark, d)
    for r in table(spark, d, "routes").collect():  # a settings table
        engine.register(r["label"], r["keywords"])
    return _shown(engine.search_ranked(QUERY, 10))


# ---- evaluation ---------------------------------------------------------------------------------------------------
_PAIRS = f"""p AS (SELECT pair_id, query, unnest(list_prepend(positive, hard_negatives)) AS candidate, unnest(range(0, len(hard_negatives) + 1)) AS position FROM ranking_pairs),
o AS (SELECT pair_id, position, len(list_intersect({_words(_norm('query'))}, {_words(_norm('candidate'))})) AS score FROM p WHERE query IS NOT NULL)"""


@_query(f"WITH {_PAIRS} SELECT pair_id, CAST(position AS INT) AS position, candidate FROM p")
def pair_candidates(spark, d):
    return models.expand_pairs(table(spark, d, "ranking_pairs")).select("pair_id", "position", "candidate")


_LEXICAL = f"len(list_intersect(list_distinct({_words('candidate')}), list_distinct({_words('query')})))"


@_query(f"WITH {_PAIRS.replace(_PAIRS[_PAIRS.index('len(list_intersect'):_PAIRS.index(' AS score FROM p')], _LEXICAL)}, b AS (SELECT pair_id, max(score) FILTER (position = 0) AS p, coalesce(max(score) FILTER (position > 0), -1) AS n FROM o GROUP BY pair_id) SELECT count(*) AS pairs, CAST(count(*) FILTER (p >= n) AS BIGINT) AS hits, round(avg((p >= n)::INT), 6) AS recall FROM b")
def recall_at_1(spark, d):
    """How often a reranker (the lexical stand-in) puts the positive first; its mean time is left out, as it varies."""
    pairs = models.expand_pairs(table(spark, d, "ranking_pairs")).where("query IS NOT NULL")
    return models.recall_at_1(models.score_pairs(models.LexicalReranker(), pairs)).drop("mean_ms")


# ---- files and store ----------------------------------------------------------------------------------------------
_DIR = r"regexp_replace(path, '[/\\][^/\\]*$', '')"


@_query("SELECT path, max(v).length AS length, max(v).ext AS ext, max(v).modified_at AS modified_at FROM (SELECT path, CASE WHEN true THEN {'seen_at': seen_at, 'modified_at': modified_at, 'length': length, 'ext': ext} END AS v FROM files) GROUP BY path".replace("max(v)", "(list(v ORDER BY v.seen_at DESC NULLS LAST, v.modified_at DESC NULLS LAST, v.length DESC NULLS LAST, v.ext DESC NULLS LAST)[1])"))
def latest_files(spark, d):
    return listing.latest_visits(table(spark, d, "files")).select("path", "length", "ext", "modified_at")


@_query(r"SELECT DISTINCT path, ext FROM files WHERE CASE WHEN lower(ext) = '' OR starts_with(lower(ext), '.') THEN lower(ext) ELSE '.' || lower(ext) END IN ('.pdf', '.docx', '.xlsx', '.txt', '.md') AND length <= 1000000 AND NOT regexp_matches(path, '(^|[/\\])\.[^/\\]')")
def readable_files(spark, d):
    files = listing.only_extensions(table(spark, d, "files").withColumn("raw", F.col("ext")).withColumn("ext", listing.normal_extension(F.col("ext"))), listing.EXTENSIONS)
    return listing.max_bytes(files, 1000000).where(listing.visible(F.col("path"))).select("path", F.col("raw").alias("ext")).distinct()


@_query(f"SELECT DISTINCT dir FROM (SELECT regexp_extract(replace(path, chr(92), '/'), '^(?:[A-Z]:)?(/kho/[^/]+)', 1) AS dir FROM files) WHERE dir NOT IN (SELECT regexp_replace(dir, '(.)/+$', '\\1') FROM indexed_dirs)")
def unindexed_dirs(spark, d):
    path = F.translate("path", "\\", "/")
    dirs = table(spark, d, "files").select(F.regexp_extract(path, "^(?:[A-Z]:)?(/kho/[^/]+)", 1).alias("dir"))
    return listing.unindexed_dirs(dirs, table(spark, d, "indexed_dirs"))


def _store(spark, name: str, chunks: DataFrame | None = None):
    from ..sources.store import ChunkStore

    import uuid

    store = ChunkStore(spark, f"{shared_dir(spark)}/quarrylens/{name}-{uuid.uuid4().hex}")
    if chunks is not None:
        store.append(chunks)
    return store


@_query("SELECT count(*) AS chunks, count(DISTINCT file_path) AS files, max(chunk_id) AS max_id FROM chunks")
def index_counts(spark, d):
    return _store(spark, "counts", table(spark, d, "chunks")).counts()


@_query("SELECT chunk_id, len(vector) AS dim, round(list_sum(CAST(vector AS DOUBLE[])), 5) AS total FROM chunks WHERE vector IS NOT NULL AND len(vector) > 0")
def all_vectors(spark, d):
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _store(spark, "vectors", table(spark, d, "chunks")).all_vectors().select("chunk_id", F.size("vector").cast("long").alias("dim"), _round(total, 5).alias("total"))


@_query("SELECT chunk_id, file_path, chunk_offset, is_boilerplate FROM chunks")
def store_round_trip(spark, d):
    store = _store(spark, "store", table(spark, d, "chunks"))
    return store.chunks().select("chunk_id", "file_path", "chunk_offset", "is_boilerplate")


@_query("SELECT file_path, count(*) AS chunks FROM chunks GROUP BY file_path")
def store_replace_files(spark, d):
    """Every file is written twice; replacing keeps one set of chunks a file."""
    store, chunks = _store(spark, "store"), table(spark, d, "chunks")
    store.append(chunks)
    store.replace_files(chunks)
    return store.chunks().groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"))


@_query("SELECT c.chunk_id, c.text FROM chunks c SEMI JOIN (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_offset = 0) i ON c.chunk_id = i.chunk_id")
def get_chunks(spark, d):
    chunks = table(spark, d, "chunks")
    return _store(spark, "get", chunks).get(chunks.where("chunk_offset = 0")).select("chunk_id", "text")


@_query("SELECT dir, min(seq) AS seq FROM indexed_dirs GROUP BY dir")
def indexed_dirs(spark, d):
    store = _store(spark, "dirs")
    store.add_indexed_dirs(table(spark, d, "indexed_dirs"))
    store.add_indexed_dirs(table(spark, d, "indexed_dirs"))  # what is known is not added again
    return store.indexed_dirs()


@_query("SELECT path, max(seen_at) AS seen_at FROM files WHERE seen_at IS NOT NULL GROUP BY path")
def watch_visits(spark, d):
    """The newest visit of each path, kept up by a stream over the visits."""
    import uuid

    from ..streaming.watcher import latest_visit_stream

    files = table(spark, d, "files")
    source = f"{shared_dir(spark)}/quarrylens/visits-{uuid.uuid4().hex}"
    files.repartition(4).write.parquet(source)
    return latest_visit_stream(spark, source, files.schema, source + "-out").select("path", "seen_at")


@_query(f"WITH RECURSIVE {_SEGMENTS} SELECT lpad(doc_id::VARCHAR, 12, '0') || '.txt' AS name, chunk_offset, {_norm('text')} AS norm_text FROM chk")
def watch_documents(spark, d):
    """Documents become files of a folder that is watched: listed, read, chunked and stored by the stream."""
    import uuid

    from ..operators.engine import Config, Engine
    from ..streaming.watcher import watch_folder

    base = f"{shared_dir(spark)}/quarrylens/watched-{uuid.uuid4().hex}"
    folder = base.removeprefix("file://")

    def write(parts):
        import os

        import pandas as pd

        for pdf in parts:
            os.makedirs(folder, exist_ok=True)
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                with open(f"{folder}/{i:012d}.txt", "wb") as f:
                    f.write(text.encode("utf-8"))
            yield pd.DataFrame({"n": [len(pdf)]})

    table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    engine = Engine(spark, Config(base + "-index"))
    query = watch_folder(engine, folder)
    query.processAllAvailable()
    query.stop()
    return engine.store.chunks().select(T.basename(F.col("file_path")).alias("name"), "chunk_offset", "norm_text")


# ---- the whole pipeline -------------------------------------------------------------------------------------------
_FP = f"trim(regexp_replace(lower(text), '{WS}+', ' ', 'g'))"


@_query(
    f"""WITH RECURSIVE {_SEGMENTS} SELECT lpad(doc_id::VARCHAR, 12, '0') AS file_path, chunk_offset, {_norm('text')} AS norm_text,
  row_number() OVER (ORDER BY doc_id, chunk_offset) AS chunk_id, count(*) OVER (PARTITION BY {_FP}) >= 2 AS is_boilerplate FROM chk"""
)
def index_documents(spark, d):
    """Extracted texts through the engine: chunked, normalised, flagged, embedded by the stand-in, numbered, stored, read back."""
    import uuid

    from ..operators.engine import Config, Engine

    engine = Engine(spark, Config(f"{shared_dir(spark)}/quarrylens/index-{uuid.uuid4().hex}"))
    path = F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path")
    engine.index_texts(table(spark, d, "documents").select(path, "text", F.lit(None).cast("string").alias("error")))
    return engine.store.chunks().select("file_path", "chunk_offset", "norm_text", "chunk_id", "is_boilerplate")


@_query("SELECT chunk_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM chunks")
def escaped_texts(spark, d):
    return table(spark, d, "chunks").select("chunk_id", T.html_escape(F.col("text")).alias("html"))


@_query(
    f"""WITH e AS (SELECT vector AS v, {_quant('vector')} FROM chunks WHERE {_USABLE} AND list_dot_product({_VEC}, {_VEC}) > 0),
b AS (SELECT CAST(v AS DOUBLE[]) AS v, list_transform(qvec, lambda x: (x::FLOAT * scale)::FLOAT::DOUBLE) AS w FROM e)
SELECT count(*) AS n, round(min(list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w))), 5) AS worst FROM b"""
)
def worst_cosine(spark, d):
    """How far int8 vectors stray from their originals: the smallest cosine of any."""
    rows = vectors.quantized(table(spark, d, "chunks"), keep=["vector"]).where("scale > 0")
    same = V.cosine(F.col("vector"), V.dequantize_int8(F.col("qvec"), F.col("scale")))
    return rows.agg(F.count(F.lit(1)).alias("n"), _round(F.min(same), 5).alias("worst"))


@_query("SELECT count(*) AS total, count(*) - count(*) FILTER (is_boilerplate IS NOT TRUE) AS flagged, count(*) FILTER (chunk_id > (SELECT max(chunk_id) // 2 FROM chunks)) AS added FROM chunks")
def index_progress(spark, d):
    """Chunks in all, flagged, and added since a snapshot (half of the ids)."""
    chunks = table(spark, d, "chunks")
    since = chunks.agg(F.max("chunk_id")).first()[0] // 2
    return chunks.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("is_boilerplate", F.lit(False))).alias("flagged"), F.count_if(F.col("chunk_id") > since).alias("added")
    )
