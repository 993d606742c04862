"""Text that was decoded with the wrong character encoding: found, and restored where nothing was lost.

A word may have gone through one of several chains (written as UTF-8, read in a legacy encoding, perhaps twice; written in
the Vietnamese code page, read in the western one). Which chain is a latent variable. Expectation-maximization estimates,
over all records, how often each field of each source used each chain, and a character model of restored words; evidence
that is weak in one record is pooled that way. Then each word is restored by its most probable chain, given its source and, in a second
look, what the rest of its record shows.

The word counts are combined in the workers before they are shuffled, and written once for all rounds. What reaches the driver are parameters only: source
by chain, and pairs of characters (ideographs and other large alphabets count as one class each).

Defined results: null and blank texts are never garbled and stay as they are. Replacement characters and control characters
of the range 80-9F are garbled, but cannot be restored. White space between words is kept. Repeated rows are treated alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import site_of, worker_state

#: Encodings in which UTF-8 bytes may have been read (fixed values).
LEGACY = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "cp1258")
CHAINS = ("none", *(f"utf-8 read as {e}" for e in LEGACY), "utf-8 read as cp1252 twice", "cp1258 read as cp1252", "lost")
_NONE, _TWICE, _VIET, _LOST = 0, 1 + len(LEGACY), 2 + len(LEGACY), 3 + len(LEGACY)
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_GONE = re.compile("[�\x80-\x9f]")
_GAP = re.compile("([ \t\r\n]+)")
_PRIVATE = 0xF0000
SURE = 0.5


def _tables() -> list[tuple[dict[int, int], dict[int, int]]]:
    """For each legacy encoding: code point to byte (as a code point), and back."""
    out = []
    for name in LEGACY:
        to = {}
        for b in range(0x80, 0x100):
            try:
                c = bytes([b]).decode(name)
            except UnicodeDecodeError:
                c = chr(b)  # undefined bytes usually pass as control characters
            to[ord(c)] = b
        if name == "cp1252":
            to.update((b, b) for b in range(0x80, 0xA0))  # the same text read as latin-1
        for cp in range(0x80, 0x100):
            to.setdefault(cp, _PRIVATE + cp)  # not from a byte of this encoding
        back = {b: cp for cp, b in to.items() if b >= _PRIVATE}
        for cp, b in to.items():
            if b < _PRIVATE:
                back.setdefault(b, cp)
        out.append((to, back))
    return out


_VIETNAMESE = {ord(a): b for a, b in zip(bytes(range(0x80, 0x100)).decode("cp1252", "replace"), bytes(range(0x80, 0x100)).decode("cp1258", "replace")) if a != b and "�" not in (a, b)}
_VIET_HINT = re.compile("[" + "".join(map(chr, _VIETNAMESE)) + "]")


def _decode(m: re.Match) -> str:
    try:
        return m[0].encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def candidates(word: str, tables) -> list[tuple[int, str]]:
    """(chain, restored word) of every chain that may have made this word; the first is none."""
    out = [(_NONE, word)]
    if word.isascii():
        return out
    for k, (to, back) in enumerate(tables, 1):
        as_bytes = word.translate(to)
        decoded = _UTF8.sub(_decode, as_bytes)
        if decoded != as_bytes:
            # bytes that are no UTF-8 keep their characters; decoded ones don't pass the table again
            parts, at = [], 0
            for m in _UTF8.finditer(as_bytes):
                parts += [as_bytes[at : m.start()].translate(back), _decode(m)]
                at = m.end()
            restored = "".join([*parts, as_bytes[at:].translate(back)])
            if restored != word:
                out.append((k, restored))
                if k == 1 and not restored.isascii():
                    twice = [y for c, y in candidates(restored, tables[:1]) if c == 1]
                    out += [(_TWICE, y) for y in twice]
    if _VIET_HINT.search(word):
        try:
            word.encode("cp1252")
            out.append((_VIET, unicodedata.normalize("NFC", word.translate(_VIETNAMESE))))
        except UnicodeEncodeError:
            pass
    return out


def _symbol(c: str) -> str:
    """The character as the model counts it."""
    return c if c < "⺀" else "一" if c < "ꀀ" else "가" if c < "" else "\U0001f600" if c > "￿" else c


def _letters(word: str) -> str:
    return "^" + "".join(map(_symbol, unicodedata.normalize("NFC", word))) + "$"


class Model:
    """Parameters: chain weights by source, and counts of characters and pairs of characters."""

    def __init__(self, pairs: dict[str, float], weights: dict[str, list[float]]):
        self.pairs, self.weights = pairs, weights
        self.first: Counter = Counter()
        self.single: Counter = Counter()
        for ab, n in pairs.items():
            self.first[ab[0]] += n
            self.single[ab[1]] += n
        self.total = sum(self.single.values()) + 1.0
        whole = [sum(w[k] for w in weights.values()) for k in range(len(CHAINS))] if weights else [1.0] * len(CHAINS)
        start = [0.97, *[0.03 / (len(CHAINS) - 1)] * (len(CHAINS) - 1)]
        all_ = sum(whole)
        self.overall = [(w + 50 * s) / (all_ + 50) for w, s in zip(whole, start)] if weights else start
        self.cache: dict[str, float] = {}

    def prior(self, source: str) -> list[float]:
        own = self.weights.get(source)
        if not own:
            return self.overall
        n = sum(own)
        return [(w + 200 * p) / (n + 200) for w, p in zip(own, self.overall)]  # shrunk to what all sources show

    def likelihood(self, word: str) -> float:
        score, a = 0.0, "^"
        for b in _letters(word)[1:]:
            ab = a + b
            p = self.cache.get(ab)
            if p is None:
                seen = self.single.get(b, 0.0)
                single = seen / self.total if seen else 1e-13
                p = self.cache[ab] = math.log((self.pairs.get(ab, 0.0) + 4 * single) / (self.first.get(a, 0.0) + 4))
            score += p
            a = b
        return score

    def posterior(self, options: list[tuple[int, str]], prior: list[float]) -> list[float]:
        logs = [math.log(prior[k]) + self.likelihood(y) for k, y in options]
        top = max(logs)
        odds = [math.exp(x - top) for x in logs]
        whole = sum(odds)
        return [x / whole for x in odds]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, word, n) of the words with a character beyond ASCII, combined as far as memory is bounded."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        made = pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["source", "word", "n"],
        )
        counts.clear()
        return made

    for batch in batches:
        for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update([(source, w) for w in text.split() if not w.isascii()] if "\xa0" not in text and "\x85" not in text else [(source, w) for w in _GAP.split(text)[::2] if not w.isascii()])
        if len(counts) > 200_000:
            yield flush()
    yield flush()


def _expect(shared, first: bool):
    """Sums of the expectation step over a part of the words: (kind, key, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, model = _tables(), shared.value
        pairs: Counter = Counter()
        chains: Counter = Counter()
        known: dict[str, list[tuple[int, str]]] = {}
        for batch in batches:
            for source, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                options = known.get(word)
                if options is None:
                    options = known[word] = candidates(word, tables)
                    if len(known) > 200_000:
                        known.clear()
                if first:  # words that only the weak chain touches count as they are; others wait for a model
                    if _GONE.search(word) or any(k not in (_NONE, _VIET) for k, _ in options):
                        continue
                    share = [1.0] + [0.0] * (len(options) - 1)
                else:
                    if "�" in word:
                        chains[source, _LOST] += n
                        continue
                    share = model.posterior(options, model.prior(source))
                for (k, y), p in zip(options, share):
                    if p > 1e-6:
                        chains[source, k] += n * p
                        if "�" not in y:
                            x = _letters(y)
                            for i in range(len(x) - 1):
                                pairs[x[i : i + 2]] += n * p
        kinds = [0] * len(pairs) + [1] * len(chains)
        keys = [*pairs, *(f"{k}|{s}" for s, k in chains)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(keys, pa.string()), pa.array([*pairs.values(), *chains.values()], pa.float64())], names=["kind", "key", "value"]
        )

    return run


def fit(texts: DataFrame, source_col: str = "source", text_col: str = "text", rounds: int = 3) -> Model:
    """The model of a table (source, text), by expectation-maximization over all its words."""
    from ..session import materialize

    base = texts.select(F.coalesce(F.col(source_col), F.lit("")).alias("s"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]"))
    counted = base.mapInArrow(_count_words, "source string, word string, n bigint").groupBy("source", "word").agg(F.sum("n").alias("n"))
    words = materialize(counted, "words")
    model = Model({}, {})
    for k in range(rounds + 1):
        shared = texts.sparkSession.sparkContext.broadcast(model)
        sums = words.mapInArrow(_expect(shared, k == 0), "kind int, key string, value double").groupBy("kind", "key").agg(F.sum("value").alias("value"))
        pairs: dict[str, float] = {}
        weights: dict[str, list[float]] = {}
        for r in sums.collect():  # parameters: pairs of characters, chains of sources
            if r["kind"] == 0:
                pairs[r["key"]] = r["value"]
            else:
                chain, source = r["key"].split("|", 1)
                weights.setdefault(source, [0.0] * len(CHAINS))[int(chain)] = r["value"]
        model = Model(pairs, weights if k else {})
    return model


class Repairer:
    """Restores texts with a fitted model, remembering words."""

    def __init__(self, model: Model):
        self.model, self.tables = model, _tables()
        self.words: dict[tuple[str, str], tuple[list[tuple[int, str]], list[float]] | None] = {}

    def _word(self, source: str, word: str):
        """None for a word that is surely right, else its options and their posterior."""
        options = candidates(word, self.tables)
        if len(options) == 1:
            return ([(_LOST, word)], [1.0]) if _GONE.search(word) else None
        return options, self.model.posterior(options, self.model.prior(source))

    def repair(self, source: str, text: str) -> tuple[str, list[int], bool]:
        """(restored text, chains used, whether nothing was lost)."""
        if text.isascii():
            return text, [], True
        parts, found, evidence = _GAP.split(text), [], [0.0] * len(CHAINS)
        words = self.words
        if len(words) > 300_000:
            words.clear()
        for i in range(0, len(parts), 2):
            w = parts[i]
            if w.isascii():
                continue
            key = (source, w)
            if key not in words:
                words[key] = self._word(source, w)
            if (x := words[key]) is not None:
                found.append((i, x))
        if not found:
            return text, [], True
        strong = False
        for i, (options, share) in found:
            for (k, y), p in zip(options, share):
                # a chain that moves single letters only is no proof; one that composes accents is
                if k == _VIET and len(y) == len(unicodedata.normalize("NFC", parts[i])):
                    p = 0.0
                elif k == _VIET and p > SURE:
                    strong = True
                if k:
                    evidence[k] += p
        if max(evidence) <= SURE and not any(_GONE.search(parts[i]) for i, _ in found):
            return text, [], True
        n, prior = len(parts) / 2, self.model.prior(source)
        local = [(e + 3 * p) / (n + 3) for e, p in zip(evidence, prior)]
        local[0] = max(local[0], 0.05)
        used: Counter = Counter()
        for i, (options, _) in found:
            if not strong:
                options = [o for o in options if o[0] != _VIET]
            share = self.model.posterior(options, [max(x, 1e-12) for x in local]) if len(options) > 1 else [1.0]
            best = max(range(len(options)), key=share.__getitem__)
            k, y = options[best]
            if k == _NONE and _GONE.search(parts[i]):
                k = _LOST
            if k:
                used[k] += 1
                parts[i] = y
        if not used:
            return text, [], True
        new = "".join(parts)
        return new, sorted(used), not _GONE.search(new)


def _repair(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = worker_state(f"encodings-{shared.value[0]}", lambda: Repairer(shared.value[1]))
        for batch in batches:
            rows = []
            for key, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                new, used, whole = repairer.repair(source, text)
                if used:
                    rows.append((key, new, [CHAINS[k] for k in used], whole))
            ids, new, used, whole = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(new, pa.string()), pa.array(used, pa.list_(pa.string())), pa.array(whole, pa.bool_())],
                names=["id", "text", "chains", "restored"],
            )

    return run


def garbled_records(
    df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", path_col: str = "file_path", rounds: int = 3
) -> DataFrame:
    """(id_col, text, chains, restored) of the garbled rows: the text as far as it can be restored, the chains that were
    undone, and whether nothing was lost. The source of a row is the site of its path."""
    return garbled_fields(df, [text_col], id_col, path_col, rounds).drop("field")


def garbled_fields(
    df: DataFrame, fields: list[str], id_col: str = "chunk_id", path_col: str = "file_path", rounds: int = 3
) -> DataFrame:
    """(id_col, field, text, chains, restored) of the garbled values of several text columns. Each field of each source has
    chain weights of its own; all share the model of characters."""
    import uuid

    site = F.coalesce(site_of(F.col(path_col)), F.lit(""))
    values = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in fields))
    base = df.select(F.col(id_col).alias("id"), site.alias("site"), F.explode(values).alias("v"))
    base = base.select(F.struct("id", "v.field").alias("id"), F.concat_ws(" ", "site", "v.field").alias("source"), F.col("v.text").alias("text"))
    base = base.where(F.col("text").rlike(r"[^\x00-\x7F]"))
    model = fit(base, rounds=rounds)
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))
    kind = base.schema["id"].dataType.simpleString()
    found = base.mapInArrow(_repair(shared), f"id {kind}, text string, chains array<string>, restored boolean")
    return found.select(F.col("id.id").alias(id_col), "id.field", "text", "chains", "restored")
