"""One consistent spelling for texts that look the same.

Full-width forms, styled letters and ligatures, decomposed accents, invisible characters and kinds of space are normalised.
Letters that look alike are settled by token: the resolved script set of a letter holds its own script and those in which it
has a twin; the sets of a token's letters are intersected. One script left: the token is spelled in it (a real Cyrillic or
Greek word with strays from another script). None left: each letter takes its Latin twin, if it has one. Several left: the
whole token could belong to each of them, and the script of the line decides, which is that of most letters in the tokens
with one script, else the script of the record, else Latin. Script sets are the same for all spellings of a token, so every
spelling of a text is settled alike. A digit never becomes a letter.

Only texts with a character that could change leave the JVM. Defined results: null stays null; blank texts keep their line
breaks and never pair; any length is processed whole; repeated rows give the same spelling.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STABLE, outside, without

#: Letters and the Latin letters they look like, by script (fixed values). The public table of confusables is far larger
#: and cannot be had here; styled forms and ligatures need no table.
TWINS = {
    "CYRILLIC": dict(zip("АВЕКМНОРСТУХЅІЈԚԜҮаеорсухѕіјԁһԛԝѵӏү", "ABEKMHOPCTYXSIJQWYaeopcyxsijdhqwvly")),
    "GREEK": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυϲϳ", "ABEZHIKMNOPTYXayikvopucj")),
    "ARMENIAN": dict(zip("ՕՍԼօսոհցզ", "OULounhgq")),
    "CHEROKEE": dict(zip("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᏀᏂᏃᏏᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ", "DRTiYAJEWMHGhZbWSVSLCPKdB")),
    "COPTIC": dict(zip("ⲎⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HKMNOPCTYXopc")),
    "LISU": dict(zip("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEOU")),
    "LATIN": dict(zip("ÐƉɑɡıɩ", "ĐĐagii")),
}
#: Code points nobody sees: default ignorable (fixed values, first and last of each range).
INVISIBLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
    (0xE0000, 0xE0FFF),
)
_HIDDEN = {cp: None for a, b in INVISIBLE for cp in range(a, b + 1)}
_SPACES = {cp: " " for cp in [9, 11, 12, *(c for c in range(0xA0, 0x3001) if unicodedata.category(chr(c)) == "Zs")]}
_WIDE = {
    cp: unicodedata.normalize("NFKC", chr(cp)) for cp in range(0xFF01, 0xFFEF) if unicodedata.decomposition(chr(cp)).startswith(("<wide>", "<narrow>"))
}


def _styled(c: str) -> bool:
    """A letter or digit in another style, or a Latin ligature or Roman numeral; the long s looks like an f and is neither."""
    kind, category = unicodedata.decomposition(c).partition(" ")[0], unicodedata.category(c)
    plain = unicodedata.normalize("NFKC", c)
    if kind == "<font>":
        return category[0] == "L" or category == "Nd"
    return kind == "<compat>" and (category[0] == "L" or category == "Nl") and plain.isascii() and plain.isalpha() and c != "\u017f"


_STYLES = {cp: unicodedata.normalize("NFKC", chr(cp)) for cp in range(0x100, 0x1FBFA) if _styled(chr(cp))}
_FORMS = {**_STYLES, **_WIDE, **_SPACES, **_HIDDEN, 0x85: "\n", 0x2028: "\n", 0x2029: "\n"}
_LINE_END = re.compile("\r\n?")
_TO_LATIN = {c: t for twins in TWINS.values() for c, t in twins.items()}
_FROM_LATIN = {s: {t: c for c, t in reversed(list(twins.items()))} for s, twins in TWINS.items() if s != "LATIN"}
_MAP = str.maketrans(_TO_LATIN)
#: Blocks of the scripts that have twins of Latin letters, and the Latin letters that have another form.
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f\u0530-\u058f\u13a0-\u13ff\u1f00-\u1fff\u2c80-\u2cff\ua4d0-\ua4ff" + "".join(TWINS["LATIN"]) + "]")


@lru_cache(4096)
def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return next((s for s in TWINS if name.startswith(s + " ")), "")


@lru_cache(4096)
def _resolved(c: str) -> frozenset[str] | None:
    """Scripts in which this letter, or one that looks like it, exists; None for what isn't a letter of these scripts."""
    own = _script(c)
    if not own:
        return None
    latin = c if own == "LATIN" and c not in _TO_LATIN else _TO_LATIN.get(c)
    sets = {own}
    if latin:
        sets |= {"LATIN"} | {s for s, back in _FROM_LATIN.items() if latin in back}
    return frozenset(sets)


@lru_cache(100_000)
def scripts_of(token: str) -> tuple[frozenset[str] | None, int]:
    """(the scripts in which the whole token could be spelled, its letters); None for a token without letters of these scripts."""
    left, n = None, 0
    for c in token:
        sets = _resolved(c)
        if sets is not None:
            left = sets if left is None else left & sets
            n += 1
    return left, n


def _spelled(token: str, script: str) -> str:
    if script == "LATIN":
        return token.translate(_MAP)
    back = _FROM_LATIN[script]
    return "".join(c if _script(c) in ("", script) else back.get(_TO_LATIN.get(c, c), c) for c in token)


def _choose(options: frozenset[str], *votes: Counter) -> str:
    """The option with most letters in the first count that knows one; Latin, then the alphabet, where they tie."""
    for count in votes:
        best = max((count[s] for s in options), default=0)
        if best:
            options = frozenset(s for s in options if count[s] == best)
            break
    return "LATIN" if not options or "LATIN" in options else min(options)


def consistent(text: str) -> str:
    """The consistent spelling of one text."""
    text = unicodedata.normalize("NFD", _LINE_END.sub("\n", text).translate(_FORMS))
    if _FOREIGN.search(text):
        lines = [line.split(" ") for line in text.split("\n")]
        votes = []
        for tokens in lines:
            count: Counter = Counter()
            for t in tokens:
                options, n = scripts_of(t)
                if options is not None and len(options) == 1:
                    count.update({s: n for s in options})
            votes.append(count)
        whole = sum(votes, Counter())
        out = []
        for tokens, count in zip(lines, votes):
            if len(count) == (count["LATIN"] > 0) and len(whole) == (whole["LATIN"] > 0):  # nothing but Latin about: the common case
                out.append(" ".join(t.translate(_MAP) for t in tokens))
            else:
                out.append(" ".join(t if (options := scripts_of(t)[0]) is None else _spelled(t, _choose(options, count, whole)) for t in tokens))
        text = "\n".join(out)
    return unicodedata.normalize("NFC", text)


_SUSPICIOUS = outside(*without(STABLE, {0x0D, *_FORMS, *map(ord, _TO_LATIN), *range(0x400, 0x482)}))


def _respelled(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else consistent(x))


def canonical(text: Column) -> Column:
    """The consistent spelling of a text column."""
    return F.coalesce(F.pandas_udf(_respelled, "string")(F.when(text.rlike(_SUSPICIOUS), text)), text)


def normalize_spelling(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, norm_text, changed): the consistent text, and the lower-case text without accents made from it."""
    from quarrylens.functions.text import normalize

    base = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_old")).withColumn("text", canonical(F.col("_old")))
    return base.select(
        F.col("_id").alias(id_col), "text", normalize(F.col("text")).alias("norm_text"), (~F.col("text").eqNullSafe(F.col("_old"))).alias("changed")
    )


def look_alike_pairs(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id_col_a, id_col_b), smaller id first: rows whose texts differ but have one consistent spelling.

    Texts travel as digests. Classes of equal texts are paired first, then expanded to their rows from either side, so a mass
    of exact copies costs its own rows only. Rows without an id don't pair.
    """
    from ..operators.prune import possibly_in
    from ..session import materialize

    text = F.col(text_col)
    rows = df.where(F.col(id_col).isNotNull() & text.rlike(r"(?U)[^\s\p{Cf}]")).select(F.col(id_col).alias("_id"), text.alias("_text"))
    digests = rows.select("_id", F.unhex(F.md5(canonical(F.col("_text")))).alias("k"), F.unhex(F.md5("_text")).alias("t"))
    keyed = materialize(digests, "spellings")  # 40 bytes a row; read three times
    classes = keyed.select("k", "t").distinct()
    a, b = (classes.select("k", F.col("t").alias(f"t{x}")) for x in "ab")
    pairs = materialize(a.join(b, "k").where(F.col("ta") < F.col("tb")).select("ta", "tb"), "spelling-pairs")
    members = possibly_in(keyed.select("_id", "t"), "t", pairs.select(F.explode(F.array("ta", "tb")).alias("t")))
    i, j = (members.select(F.col("t").alias(f"t{x}"), F.col("_id").alias(y)) for x, y in ("ai", "bj"))
    found = pairs.join(i, "ta").join(j, "tb")
    return found.select(F.least("i", "j").alias(f"{id_col}_a"), F.greatest("i", "j").alias(f"{id_col}_b"))
