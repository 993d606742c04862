"""The driver's queries over this folder's operators, and their SQL where it is quick on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from .encodings import garbled_records

    return garbled_records(table(spark, d, "chunks")).select("chunk_id")


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    from .encodings import garbled_records

    return garbled_records(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .boilerplate import repeated_lines

    return repeated_lines(table(spark, d, "chunks")).select("site", "line")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    from .boilerplate import without_repeated_lines

    dates = table(spark, d, "files").select(F.col("path").alias("file_path"), F.col("modified_at").alias("published"))
    return without_repeated_lines(table(spark, d, "chunks"), dates)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .splitting import split_oversized

    return split_oversized(table(spark, d, "chunks")).where("piece_no = 0").select("chunk_id", "cut_kind")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    from .splitting import split_oversized

    return split_oversized(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from .lookalikes import look_alike_pairs

    return look_alike_pairs(table(spark, d, "chunks"))


def p4_spelling(spark: SparkSession, d: str) -> DataFrame:
    from .lookalikes import normalize_spelling

    return normalize_spelling(table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .near_duplicates import near_duplicate_pairs

    return near_duplicate_pairs(table(spark, d, "chunks")).select("chunk_id_a", "chunk_id_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    from .near_duplicates import near_duplicate_groups

    return near_duplicate_groups(table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from .term_weights import distinctive_terms

    return distinctive_terms(table(spark, d, "chunks"))


def p6_weights(spark: SparkSession, d: str) -> DataFrame:
    from .term_weights import term_weights

    w = term_weights(table(spark, d, "chunks"))
    return w.select("chunk_id", "term", F.col("tf").cast("long").alias("tf"), "df", F.round("weight", 6).alias("weight"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from .vector_neighbours import mutual_neighbours

    return mutual_neighbours(table(spark, d, "chunks"))


def p7_knn(spark: SparkSession, d: str) -> DataFrame:
    from .vector_neighbours import nearest_neighbours

    near = nearest_neighbours(table(spark, d, "chunks"), queries=F.col("chunk_id") % 50 == 0, visit=600)
    return near.select(F.col("a").alias("chunk_id"), F.col("b").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from .tokenizing import encode_corpus

    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The combined documents with their texts, and how often each appears."""
    from .mixing import mix_sources, with_texts

    docs = table(spark, d, "documents")
    return with_texts(mix_sources(docs, table(spark, d, "mix_targets"))[0], docs)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    from .mixing import mix_sources

    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from .repetition import documents_failing

    return documents_failing(table(spark, d, "documents"), "repeated_runs")


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    from .repetition import repetition_report

    report = repetition_report(table(spark, d, "documents"))
    return report.select("doc_id", *(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in report.dtypes if c != "doc_id"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit() and callable(f)}


_FORM = f"trim(regexp_replace(regexp_replace(lower(part), '[0-9]+', '#', 'g'), '{_WS}+', ' ', 'g'))"

_TERMS = f"""tok AS (SELECT chunk_id, unnest(list_filter(string_split_regex(lower(norm_text), '{_WS}+'), lambda x: x <> '')) AS term
  FROM chunks WHERE norm_text IS NOT NULL),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT chunk_id, sum(tf) AS dl FROM tf GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)"""

#: u: the usable vectors; every pair of a chosen a with another b, ranked.
_NEAREST = """u AS (SELECT chunk_id, CAST(vector AS DOUBLE[]) AS v FROM chunks WHERE len(vector) = (SELECT len(vector) FROM chunks WHERE len(vector) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
w AS (SELECT chunk_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u WHERE list_dot_product(v, v) > 0 AND isfinite(list_dot_product(v, v))),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_dot_product(a.v, b.v), 12) AS s FROM w a JOIN w b ON a.chunk_id <> b.chunk_id {where}),
r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM s QUALIFY rank <= 10)"""

#: Every position of an oversized text with the highest kind of boundary there; then the cuts, one a round.
_PIECES = f"""long AS (SELECT chunk_id, chunk_offset, length(text) - length(regexp_replace(text, '^{_WS}+', '')) AS lead,
  regexp_replace(regexp_replace(text, '^{_WS}+', ''), '{_WS}+$', '') AS t FROM chunks WHERE length(text) > 512),
spots AS (SELECT chunk_id, t, length(t) AS n, unnest(range(1, length(t) + 1)) AS i FROM long WHERE length(t) > 512),
c AS (SELECT chunk_id, n, i, substring(t, i, 1) AS c0, substring(t, i + 1, 1) AS c1, substring(t, greatest(1, i - 9), least(i, 10)) AS tail FROM spots),
k AS (SELECT chunk_id, i, CASE WHEN i = n THEN 9
  WHEN regexp_matches(tail, '\n[ \t\r]{{0,8}}\n$') AND c1 <> chr(10) THEN 5 WHEN c0 IN (chr(10), chr(13)) THEN 4
  WHEN regexp_matches(tail, '[.!?…]["''”’»)]{{0,2}}$') AND regexp_matches(c1, '[ \t\n\x0B\f\r]') OR c0 IN ('。', '！', '？') THEN 3
  WHEN regexp_matches(c0, '[\\p{{L}}\\p{{Nd}}\\p{{M}}]') AND NOT regexp_matches(c1, '[\\p{{L}}\\p{{Nd}}\\p{{M}}]') OR regexp_matches(c0, '[^ \t\n\x0B\f\r]') AND regexp_matches(c1, '[ \t\n\x0B\f\r]') THEN 2
  ELSE 1 END AS kind FROM c),
cut AS (SELECT DISTINCT chunk_id, -1 AS piece_no, 0 AS start, 0 AS stop FROM k
  UNION ALL
  SELECT cut.chunk_id, any_value(piece_no) + 1, any_value(CASE WHEN piece_no < 0 THEN 0 ELSE stop - 64 END), CAST(max(kind * 1000000000::BIGINT + i) % 1000000000::BIGINT AS INT)
  FROM cut JOIN k ON k.chunk_id = cut.chunk_id AND i BETWEEN stop + CASE WHEN piece_no < 0 THEN 64 ELSE 1 END AND stop + CASE WHEN piece_no < 0 THEN 512 ELSE 448 END GROUP BY cut.chunk_id)"""


def _report_sql() -> str:
    from .repetition import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    runs = """g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) > 8),
q AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ') ORDER BY i) AS seen FROM g),
z AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS c FROM q WHERE seen > 1),
rs AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS hit FROM z GROUP BY doc_id)"""

    def copied(parts: str) -> str:
        kept = f"list_filter(list_transform({parts}, lambda x: trim(x)), lambda x: x <> '')"
        chars = lambda x: f"list_sum(list_transform({x}, lambda y: length(y)))"
        return f"coalesce(1 - {chars(f'list_distinct({kept})')} / {chars(kept)}, 0)"

    lines = "string_split(text, chr(10))"
    return f"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '{_WS}+'), lambda x: x <> '') AS w FROM documents),
{runs},
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) / len(w) AS mean_word_length,
  (length(text) - length(regexp_replace(text, '[\\p{{S}}#…•]+', '', 'g'))) / length(text) AS symbol_share,
  len(list_filter(w, lambda x: x IN ({stop}))) / len(w) AS stop_word_share,
  len(list_filter({lines}, lambda x: regexp_matches(x, '(?:…|\\.\\.\\.)[ \\t\\n\\x0B\\f\\r]*$'))) / len({lines}) AS ellipsis_line_share,
  {copied(lines)} AS repeated_line_share, {copied("string_split_regex(text, chr(10) || '[ \\t\\n\\x0B\\f\\r]*' || chr(10))")} AS repeated_paragraph_share,
  coalesce(hit, 0) / len(w) AS repeated_share FROM w LEFT JOIN rs USING (doc_id) WHERE len(w) > 0)
SELECT d.doc_id, CAST(n_words AS INT) AS n_words, round(mean_word_length, 6) AS mean_word_length, round(symbol_share, 6) AS symbol_share, round(stop_word_share, 6) AS stop_word_share,
  round(ellipsis_line_share, 6) AS ellipsis_line_share, round(repeated_line_share, 6) AS repeated_line_share, round(repeated_paragraph_share, 6) AS repeated_paragraph_share, round(repeated_share, 6) AS repeated_share,
  list_filter([CASE WHEN repeated_share >= 0.3 THEN 'repeated_runs' END, CASE WHEN repeated_line_share >= 0.3 THEN 'repeated_lines' END, CASE WHEN repeated_paragraph_share >= 0.3 THEN 'repeated_paragraphs' END,
    CASE WHEN n_words < 5 THEN 'too_short' END, CASE WHEN n_words > 100000 THEN 'too_long' END, CASE WHEN mean_word_length > 12 THEN 'word_length' END, CASE WHEN symbol_share > 0.1 THEN 'symbols' END,
    CASE WHEN stop_word_share <= 0 THEN 'no_stop_words' END, CASE WHEN ellipsis_line_share > 0.3 THEN 'ellipsis_lines' END], lambda x: x IS NOT NULL) AS failed
FROM documents d LEFT JOIN m USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""SELECT site, line FROM (
  SELECT lower(regexp_extract(file_path, '(?:^|[/\\\\])kho[/\\\\]+([^/\\\\]+)', 1)) AS site, file_path,
    trim(regexp_replace(regexp_replace(lower(unnest(string_split(nfc_normalize(text), chr(10)))), '[0-9]+', '#', 'g'), '{_WS}+', ' ', 'g')) AS line
  FROM chunks WHERE text IS NOT NULL)
WHERE line <> '' AND site <> '' GROUP BY ALL HAVING count(DISTINCT file_path) >= 5""".replace("GROUP BY ALL", "GROUP BY site, line"),
        "p2_clean": f"""WITH pos AS (SELECT chunk_id, file_path, lower(regexp_extract(file_path, '(?:^|[/\\\\])kho[/\\\\]+([^/\\\\]+)', 1)) AS site,
  unnest(string_split(text, chr(10))) AS raw, nfc_normalize(unnest(string_split(text, chr(10)))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM chunks WHERE text IS NOT NULL),
forms AS (SELECT *, {_FORM} AS line FROM pos),
fl AS (SELECT site, file_path, list_sort(list(DISTINCT line)) AS ls FROM forms WHERE site <> '' AND line <> '' GROUP BY site, file_path),
days AS (SELECT path AS file_path, min(CAST(modified_at AS DATE)) AS day FROM files GROUP BY path),
cl AS (SELECT site, ls, min(day) AS day FROM fl LEFT JOIN days USING (file_path) GROUP BY site, ls),
bad AS (SELECT site, line FROM (SELECT site, unnest(ls) AS line, day FROM cl) GROUP BY site, line HAVING count(*) >= 5 AND (count(day) = 0 OR count(DISTINCT day) >= 2)),
k AS (SELECT chunk_id, coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (WHERE bad.line IS NULL), '') AS rest, count(bad.line) AS n FROM forms LEFT JOIN bad ON forms.site = bad.site AND forms.line = bad.line GROUP BY chunk_id)
SELECT chunk_id, CASE WHEN n > 0 THEN rest ELSE text END AS text, coalesce(n > 0 AND regexp_replace(rest, '{_WS}+', '', 'g') = '', false) AS is_boilerplate, CAST(coalesce(n, 0) AS INT) AS n_removed
FROM chunks LEFT JOIN k USING (chunk_id)""",
        "p3_found": f"""SELECT chunk_id, CASE WHEN list_max(list_transform(string_split_regex(t, '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: length(x))) > 512 THEN 'forced' ELSE 'natural' END AS cut_kind
FROM (SELECT chunk_id, regexp_replace(regexp_replace(text, '^{_WS}+', ''), '{_WS}+$', '') AS t FROM chunks) WHERE length(t) > 512""",
        "p3_pieces": f"""WITH RECURSIVE {_PIECES}
SELECT chunk_id, piece_no, substring(t, start + 1, stop - start) AS piece, CAST(chunk_offset + lead + start AS INT) AS piece_offset, CAST(lead + start AS INT) AS text_offset,
  CASE WHEN list_max(list_transform(string_split_regex(t, '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: length(x))) > 512 THEN 'forced' ELSE 'natural' END AS cut_kind
FROM cut JOIN long USING (chunk_id) WHERE piece_no >= 0""",
        "p5_found": f"""WITH w AS (SELECT chunk_id, file_path, list_filter(string_split_regex(lower(text), '{_WS}+'), lambda x: x <> '') AS w FROM chunks WHERE text IS NOT NULL AND file_path IS NOT NULL),
g AS (SELECT DISTINCT chunk_id, file_path, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY chunk_id),
j AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id AND a.file_path <> b.file_path GROUP BY ALL)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM j JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE shared / (x.n + y.n - shared) >= 0.6""",
        "p5_groups": f"""WITH RECURSIVE w AS (SELECT chunk_id, file_path, text, list_filter(string_split_regex(lower(text), '{_WS}+'), lambda x: x <> '') AS w FROM chunks WHERE text IS NOT NULL AND file_path IS NOT NULL),
c AS (SELECT text, any_value(w) AS w, min(chunk_id) AS first, min(file_path) AS f0, max(file_path) AS f1 FROM w WHERE len(w) >= 3 GROUP BY text),
g AS (SELECT DISTINCT first, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM c),
n AS (SELECT first, count(*) AS n FROM g GROUP BY first),
j AS (SELECT a.first AS a, b.first AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.first < b.first GROUP BY ALL),
e AS (SELECT a, b FROM j JOIN n x ON x.first = a JOIN n y ON y.first = b JOIN c s ON s.first = a JOIN c t ON t.first = b
  WHERE shared / (x.n + y.n - shared) >= 0.6 AND NOT (s.f0 = s.f1 AND t.f0 = t.f1 AND s.f0 = t.f0)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS v, a AS r FROM ways UNION SELECT v, b FROM reach JOIN ways ON r = a),
l AS (SELECT v, min(r) AS label FROM reach GROUP BY v), k AS (SELECT a, count(*) AS links FROM ways GROUP BY a)
SELECT chunk_id, first AS text_class, coalesce(label, first) AS group_id, coalesce(links, 0) AS links
FROM w JOIN c USING (text) LEFT JOIN l ON v = first LEFT JOIN k ON a = first WHERE len(w.w) >= 3 AND (label IS NOT NULL OR f0 <> f1)""",
        "p7_found": f"WITH {_NEAREST.format(where='')} SELECT x.a AS chunk_id_a, x.b AS chunk_id_b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.s >= 0.9",
        "p7_knn": f"WITH {_NEAREST.format(where='AND a.chunk_id % 50 = 0')} SELECT a AS chunk_id, b AS neighbour_id, round(s, 6) AS similarity, rank FROM r",
        "p6_found": f"WITH {_TERMS} SELECT chunk_id, term FROM tf JOIN df USING (term), st WHERE df >= 2 AND (1 + ln(tf)) * ln(n / df) >= 1.75 * ln(n)",
        "p6_weights": f"""WITH {_TERMS} SELECT chunk_id, term, tf, df,
  round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6) AS weight
FROM tf JOIN df USING (term) JOIN dl USING (chunk_id), st""",
        "p10_report": _report_sql(),
        "p10_found": f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{_WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) > 8),
k AS (SELECT doc_id, n, i, array_to_string(w[i:i + 7], ' ') AS k FROM g),
r AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS seen FROM k),
s AS (SELECT doc_id, n, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS c FROM r WHERE seen > 1)
SELECT doc_id FROM s GROUP BY doc_id HAVING sum(c) / max(n) >= 0.3""",
    }
