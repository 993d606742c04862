"""Text functions as Column expressions: normalising, tokenising, fingerprints, snippets, paths.

All of them return null for null input unless stated otherwise, and none uses Python at run time.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \s with (?U) is the Unicode property White_Space.
WS = r"(?U)\s+"
LETTER_OR_DIGIT = r"[\p{L}\p{Nd}]"


def _fold_tables() -> tuple[str, str]:
    """Pairs (accented letter, base letter) of every code point that loses a mark and stays one character."""
    src, dst = ["Đ", "đ"], ["d", "d"]
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.category(ch) in ("Cn", "Co", "Cs") or not unicodedata.decomposition(ch):
            continue
        nfd = unicodedata.normalize("NFD", ch)
        bare = unicodedata.normalize("NFC", "".join(c for c in nfd if unicodedata.category(c) != "Mn"))
        if bare != ch and len(bare) == 1:
            src.append(ch)
            dst.append(bare)
    return "".join(src), "".join(dst)


_SRC, _DST = _fold_tables()


def normalize(c: Column) -> Column:
    """Lower case without diacritics: Đ and đ become d, marks (category Mn) disappear."""
    return F.lower(F.regexp_replace(F.translate(c, _SRC, _DST), r"\p{Mn}", ""))


def tokens(c: Column) -> Column:
    """Lower-case words split at Unicode white space; punctuation is kept. Null gives null, blank an empty array."""
    return F.array_remove(F.split(F.lower(c), WS), "")


def squeeze(c: Column) -> Column:
    """Each run of Unicode white space becomes one space, both ends are trimmed."""
    return F.trim(F.regexp_replace(c, WS, " "))


def fingerprint(c: Column) -> Column:
    """Key under which two segments count as the same boilerplate: lower case, white space collapsed, accents kept."""
    return squeeze(F.lower(c))


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def snippet(c: Column, width: int = 80) -> Column:
    """First width characters on one line; an ellipsis where something was cut."""
    flat = F.regexp_replace(F.substring(c, 1, width), "\n", " ")
    return F.when(F.length(c) > width, F.concat(flat, F.lit("..."))).otherwise(flat)


def format_score(c: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def path_contains(path: Column, label: Column) -> Column:
    """Case-insensitive containment; accents count."""
    return F.contains(F.lower(path), F.lower(label))


def query_contains(query: Column, keyword: Column) -> Column:
    """Substring containment after normalising both sides."""
    return F.contains(normalize(query), normalize(keyword))


def html_escape(c: Column) -> Column:
    """Text that can stand in a page; the ampersand goes first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c
