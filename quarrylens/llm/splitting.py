"""Pieces of oversized texts, cut at natural boundaries, with an overlap.

The separator hierarchy is section (blank line), paragraph (line end), sentence, word, character: a piece ends at the
furthest boundary of the highest kind within the limit, so pieces are packed greedily and only what has no boundary of one
kind falls to the next. The hierarchy is one anchored regular expression; rows of short texts never meet it.

Defined results: null, empty and blank texts and texts within the limit give no pieces. Texts are trimmed of white space
first. Offsets count code points; the offset in the file is null where the chunk's is. Repeated rows give repeated pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import running_sum
from .common import let

_TRIM_LEFT, _TRIM_RIGHT = r"(?U)^\s+", r"(?U)\s+$"
_LD, _LDM = r"[\p{L}\p{Nd}]", r"[\p{L}\p{Nd}\p{M}]"
#: Kinds of boundary from the highest down, as what stands before the cut and what must not follow it.
BOUNDARIES = (
    ("section", r"(?<=\n[ \t\r]{0,8}\n)(?!\n)"),
    ("paragraph", r"(?<=[\n\r])"),
    ("sentence", r"(?:(?<=[.!?…][\"'”’»)]{0,2})(?=\s)|(?<=[。！？]))"),
    ("word", rf"(?:(?<={_LDM})(?!{_LDM})|(?<=\S)(?=\s))"),
    ("character", ""),
)


def _pattern(limit: int, overlap: int) -> str:
    """All of the rest if it fits, else the most text before a boundary of the highest kind there is."""

    def options(low: int, high: int) -> str:
        return "|".join([rf".{{1,{high}}}\z", *(rf".{{{low},{high}}}{mark}" for _, mark in BOUNDARIES)])

    return rf"(?s)\A(?:{options(overlap, limit)})|(?!\A)\G(?:{options(1, limit - overlap)})"


def split_oversized(
    df: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    offset_col: str = "chunk_offset",
    limit: int = 512,
    overlap: int = 64,
) -> DataFrame:
    """(id_col, piece_no, piece, piece_offset, text_offset, cut_kind) of every text longer than limit when trimmed.

    A piece has at most limit characters; each but the first begins with the last overlap characters of the one before.
    cut_kind is `forced` for a text with an unbroken run of more than limit letters or digits, else `natural`.
    """
    if not 0 < overlap < limit:
        raise ValueError("overlap must lie between 0 and limit")
    text = F.col("_text")
    left = F.regexp_replace(text, _TRIM_LEFT, "")
    long = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(offset_col).alias("_offset")).where(
        F.length(text) > limit
    )
    trimmed = long.select(
        "_id",
        (F.length(text) - F.length(left)).alias("_lead"),
        F.regexp_replace(left, _TRIM_RIGHT, "").alias("_body"),
        "_offset",
    ).where(F.length("_body") > limit)
    body = F.col("_body")
    run = rf"{_LD}{{{limit + 1}}}"

    def spans(parts: Column) -> Column:
        def span(starts: Column) -> Column:
            first = lambda i: F.coalesce(F.when(i > 0, F.get(starts, i) - overlap), F.lit(0))
            return F.transform(parts, lambda p, i: F.struct(first(i).alias("start"), (F.get(starts, i) + F.length(p)).alias("stop")))

        return let(running_sum(F.transform(parts, lambda p: F.length(p))), span)

    made = trimmed.select(
        "_id", "_lead", "_offset", "_body",
        F.when(body.rlike(run), "forced").otherwise("natural").alias("cut_kind"),
        F.posexplode(let(F.regexp_extract_all(body, F.lit(_pattern(limit, overlap)), F.lit(0)), spans)).alias("piece_no", "_span"),
    )
    start = F.col("_span.start")
    at = F.col("_lead") + start
    return made.select(
        F.col("_id").alias(id_col),
        F.col("piece_no"),
        F.substring(body, start + 1, F.col("_span.stop") - start).alias("piece"),
        (F.col("_offset") + at).alias("piece_offset"),
        at.alias("text_offset"),
        "cut_kind",
    )
