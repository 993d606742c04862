"""Repetition inside single documents: a table of thresholds compiled into one projection.

Every measure is a built-in Column expression over the row's own text, all in one struct that is made once a row, so all
rules of the table are evaluated in one pass over the documents, without a shuffle and without user functions. The repeated share hashes each run of eight words once;
only documents in which a run returns go on to find the words that lie in returning runs.

Defined results: a document without words (null, empty, blank) has null measures and fails no rule. Very long texts are
measured whole. Repeated rows are measured one by one; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import select_once
from .common import let

RUN = 8
#: Common words of the collection's languages, for the stop-word ratio (fixed values).
STOP_WORDS = (
    "the and of to in for with by on at was is are that this from as it "
    "và của các cho có không là được trong với đã khi theo do tại một những để "
    "le la les de des du et en un une est pour dans sur par au à avec "
    "der die das und den von mit für auf ist im nicht ein eine zu dem "
    "el los las y que del se con una por para il di che non "
    "o os e da do em no na um uma os het een van dat "
    "и в не на что с по как это для из к"
).split()
#: rule, measure, comparison, threshold. A document that meets the comparison fails the rule.
RULES = (
    ("repeated_runs", "repeated_share", ">=", 0.3),
    ("repeated_lines", "repeated_line_share", ">=", 0.3),
    ("repeated_paragraphs", "repeated_paragraph_share", ">=", 0.3),
    ("too_short", "n_words", "<", 5.0),
    ("too_long", "n_words", ">", 100000.0),
    ("word_length", "mean_word_length", ">", 12.0),
    ("symbols", "symbol_share", ">", 0.1),
    ("no_stop_words", "stop_word_share", "<=", 0.0),
    ("ellipsis_lines", "ellipsis_line_share", ">", 0.3),
)
_WS = r"(?U)\s+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _WS), "")


def repeated_share(words: Column, run: int = RUN) -> Column:
    """Share of the words that lie in a run of so many words that also starts at an earlier word."""

    def covered(keys: Column) -> Column:
        order = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        again = let(order, lambda o: F.filter(o, lambda x, j: (j > 0) & (x["k"] == F.get(o, j - 1)["k"])))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        reach = let(starts, lambda s: F.transform(s, lambda x, j: F.least(F.lit(run), F.coalesce(F.get(s, j + 1) - x, F.lit(run)))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def share(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(1), F.size(w) - (run - 1)), lambda i: F.xxhash64(F.slice(w, i, run)))
        some = let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))
        return F.when(F.size(w) == 0, F.lit(None)).when(F.size(w) <= run, F.lit(0.0)).otherwise(some / F.size(w))

    return let(words, share)


def _repeated_parts(parts: Column) -> Column:
    """Share of the characters of parts that are copies of an earlier part."""
    chars = lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + F.length(x))
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return let(kept, lambda p: F.when(F.size(F.array_distinct(p)) == F.size(p), F.lit(0.0)).otherwise(1 - chars(F.array_distinct(p)) / chars(p)))


def _word_measures(w: Column) -> dict[str, Column]:
    n = F.nullif(F.size(w), F.lit(0))
    return {
        "n_words": F.size(w),
        "mean_word_length": F.length(F.array_join(w, "")) / n,
        "stop_word_share": F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))) / n,
        "repeated_share": repeated_share(w),
    }


def _text_measures(text: Column) -> dict[str, Column]:
    lines = F.split(text, "\n")
    ellipsis = F.size(F.filter(lines, lambda x: x.rlike(r"(?:…|\.\.\.)\s*$")))
    return {
        "symbol_share": (F.length(text) - F.length(F.regexp_replace(text, r"[\p{S}#…•]+", ""))) / F.nullif(F.length(text), F.lit(0)),
        "ellipsis_line_share": ellipsis / F.size(lines),
        "repeated_line_share": _repeated_parts(lines),
        "repeated_paragraph_share": _repeated_parts(F.split(text, r"\n\s*\n")),
    }


MEASURES = (
    "n_words", "mean_word_length", "symbol_share", "stop_word_share", "ellipsis_line_share", "repeated_line_share",
    "repeated_paragraph_share", "repeated_share",
)


def measure(text: Column, names) -> Column:
    """struct of the named measures; the words are split once."""

    def fields(w: Column) -> Column:
        values = _word_measures(w) | _text_measures(text)
        return F.struct(*(values[name].alias(name) for name in names))

    return let(F.coalesce(_words(text), F.array().cast("array<string>")), fields)


def compile_rules(rules, values: dict[str, Column]) -> dict[str, Column]:
    """One boolean Column for each row of the threshold table."""
    compare = {">=": "__ge__", ">": "__gt__", "<": "__lt__", "<=": "__le__"}
    return {name: getattr(values[measure], compare[op])(F.lit(limit)) for name, measure, op, limit in rules}


def repetition_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id_col, the measures the rules use, failed: the names of the rules the document fails), in one pass."""
    used = [m for m in MEASURES if any(m == r[1] for r in rules)]
    names = [m for m in MEASURES if m in used or m == "n_words"]
    shown = select_once(df, [F.col(id_col).alias("_id")], measure(F.col(text_col), names))
    hit = compile_rules(rules, {m: F.col(m) for m in used})
    failed = F.array_compact(F.array(*(F.when((F.col("n_words") > 0) & c, F.lit(name)) for name, c in hit.items())))
    return shown.select(F.col("_id").alias(id_col), *(F.when(F.col("n_words") > 0, F.col(m)).alias(m) for m in used), failed.alias("failed"))


def documents_failing(df: DataFrame, rule: str, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id_col) of the documents that fail one rule; only this rule's measure is computed."""
    own = [r for r in rules if r[0] == rule]
    value = measure(F.col(text_col), ["n_words", own[0][1]] if own[0][1] != "n_words" else ["n_words"])
    shown = select_once(df, [F.col(id_col).alias("_id")], value).where("n_words > 0")
    return shown.where(compile_rules(own, {own[0][1]: F.col(own[0][1])})[rule]).select(F.col("_id").alias(id_col))
