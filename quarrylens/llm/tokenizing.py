"""Token ids of a public byte-level BPE for whole corpora.

Pieces are cut by the tokenizer's pattern and merged with a segment tree over their byte positions: each leaf holds the
key (rank of the pair that starts here, position), each inner node the smallest key below it, so the root is the leftmost
pair of lowest rank. A merge rewrites three leaves (the pair, its right half, its live left neighbour) and their paths to
the root. Trees of many pieces are one array and advance together; few pieces of a size, such as a very long one, run one by
one, where an update stops at the first node it does not change. No shuffle; a worker remembers pieces between batches.

Null and empty texts give an empty list. Nothing is cut: very long texts and pieces are encoded whole. Strings that look
like special tokens are ordinary text. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker forgets its words and pieces beyond so many, or so many ids of them, to bound its memory.
REMEMBERED, REMEMBERED_IDS = 300_000, 16_000_000
#: Up to so many pieces of a size are merged one by one.
FEW = 24
_NONE = np.int64(2**62)


class BytePairEncoder:
    """Encodes pieces of bytes by ranks (the lines `base64 rank` of a vocabulary file)."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, vocabulary.splitlines()))}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        # open addressing, filled so that every key is found within self.probes steps
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        self.mask = (1 << max(4, int(len(keys) * 4).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=np.int64)
        self.values = np.full(self.mask + 1, -1, dtype=np.int64)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] == -1
            take = left[free]
            _, first = np.unique(at[take], return_index=True)
            take = take[first]
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(29)) & np.uint64(self.mask)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, which is also the id of the merged token; -1 where a pair never merges."""
        keys = a << 32 | b
        at = self._slot(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            here = self.keys[at[left]]
            hit = here == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (here != -1)]
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
        return out

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p:
                groups.setdefault(max(1, (len(p) - 1).bit_length()), []).append(i)
        for bits, members in groups.items():
            step = max(1, (1 << 21) >> bits)
            for s in range(0, len(members), step):
                part = members[s : s + step]
                made = map(self._one, (pieces[i] for i in part)) if len(part) <= FEW else self._group([pieces[i] for i in part], 1 << bits)
                for i, ids in zip(part, made):
                    out[i] = ids
        return out

    def _one(self, piece: bytes) -> np.ndarray:
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none, symbol = int(_NONE), self.byte_id[np.frombuffer(piece, dtype=np.uint8)]
        leaves = np.full(2 * width, _NONE, dtype=np.int64)
        if n > 1:
            ranks = self.rank(symbol[:-1], symbol[1:])
            leaves[width : width + n - 1] = np.where(ranks >= 0, ranks * width + np.arange(n - 1), _NONE)
        level = width
        while level > 1:
            leaves[level // 2 : level] = np.minimum(leaves[level : 2 * level : 2], leaves[level + 1 : 2 * level : 2])
            level //= 2
        tree, symbol = array("q", leaves.tobytes()), array("q", symbol.tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        rank = self.pairs.get

        def put(leaf: int, key: int) -> None:
            node = width + leaf
            tree[node] = key
            while node > 1:
                other = tree[node ^ 1]
                if other < key:
                    key = other
                node >>= 1
                if tree[node] == key:
                    return
                tree[node] = key

        while (root := tree[1]) < none:
            at, token = root % width, root // width
            right = after[at]
            beyond, left = after[right], before[at]
            symbol[at], symbol[right], after[at] = token, -1, beyond
            put(right, none)
            key = none
            if beyond < n:
                before[beyond] = at
                got = rank(token << 32 | symbol[beyond])
                if got is not None:
                    key = got * width + at
            put(at, key)
            if left >= 0:
                got = rank(symbol[left] << 32 | token)
                put(left, none if got is None else got * width + left)
        made = np.frombuffer(symbol, dtype=np.int64)
        return made[made >= 0].astype(np.int32)

    def _group(self, pieces: list[bytes], width: int) -> Iterator[np.ndarray]:
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        symbol = self.byte_id[raw]
        place = np.arange(width)
        symbol[place[None, :] >= lengths[:, None]] = -1
        after = np.tile(place + 1, (n, 1))  # the next live position; len(piece) is the end
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        r, p = np.nonzero(place[None, :-1] < lengths[:, None] - 1) if width > 1 else (np.empty(0, int), np.empty(0, int))
        ranks = self.rank(symbol[r, p], symbol[r, p + 1])
        ok = ranks >= 0
        tree[r[ok], width + p[ok]] = ranks[ok] * width + p[ok]
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.nonzero(tree[:, 1] < _NONE)[0]
        while len(live):
            root = tree[live, 1]
            at, token = root % width, root // width
            right = after[live, at]
            beyond = after[live, right]
            left = before[live, at]
            symbol[live, at] = token
            symbol[live, right] = -1
            after[live, at] = beyond
            inside = beyond < lengths[live]
            before[live[inside], beyond[inside]] = at[inside]
            self._put(tree, width, live, right, np.full(len(live), _NONE))
            key = np.full(len(live), _NONE)
            if inside.any():
                got = self.rank(token[inside], symbol[live[inside], beyond[inside]])
                key[inside] = np.where(got >= 0, got * width + at[inside], _NONE)
            self._put(tree, width, live, at, key)
            has = left >= 0
            if has.any():
                rows, spot = live[has], left[has]
                got = self.rank(symbol[rows, spot], token[has])
                self._put(tree, width, rows, spot, np.where(got >= 0, got * width + spot, _NONE))
            live = live[tree[live, 1] < _NONE]
        flat = symbol[symbol >= 0].astype(np.int32)
        ends = np.cumsum((symbol >= 0).sum(axis=1))
        return iter(np.split(flat, ends[:-1]))

    @staticmethod
    def _put(tree: np.ndarray, width: int, rows: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
        node = width + leaf
        tree[rows, node] = key
        node = node >> 1
        while node[0] >= 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1


class CorpusEncoder:
    """Encodes batches of texts, remembering words (text between single spaces) and pieces."""

    def __init__(self, vocabulary: bytes):
        import regex

        self.bpe, self.pattern, self.gap = BytePairEncoder(vocabulary), regex.compile(PATTERN), regex.compile(r"\s\s|^\s|\s$|\A\Z")
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.pieces: dict[str, np.ndarray] = {}
        self.ids: list[np.ndarray] = []
        self.flat, self.start, self.size = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        cut = [self.pattern.findall(w) for w in words]
        new = list(dict.fromkeys(p for ps in cut for p in ps if p not in self.pieces))
        self.pieces.update(zip(new, self.bpe.encode([p.encode("utf-8", "replace") for p in new])))
        found = [np.concatenate([self.pieces[p] for p in ps]) if ps else np.empty(0, dtype=np.int32) for ps in cut]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, *found])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.words) > REMEMBERED or len(self.pieces) > REMEMBERED or len(self.flat) > REMEMBERED_IDS:
            self.forget()
        words, known, missing = self.words, len(self.start), []
        lone, rows, counts = self.gap.search, [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            if lone(text):  # runs of white space: the pattern looks across them
                parts = self.pattern.findall(text)
            else:  # between single white spaces no piece can cross a space, so words may be cut off first
                first, *rest = text.split(" ")
                parts = [first, *[" " + w for w in rest]]
            try:
                at = [words[w] for w in parts]
            except KeyError:
                for w in parts:
                    if w not in words:
                        words[w] = known + len(missing)
                        missing.append(w)
                at = [words[w] for w in parts]
            rows.extend(at)
            counts[i] = len(at)
        if missing:
            self._learn(missing)
        index = np.array(rows, dtype=np.int64)
        size = self.size[index]
        total = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[index] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        ends = np.cumsum(counts)
        upto = np.concatenate([[0], total])
        return ids, upto[ends] - upto[ends - counts]


def _encoder(vocabulary) -> CorpusEncoder:
    return worker_state(f"bpe-{hash(vocabulary.value)}", lambda: CorpusEncoder(vocabulary.value))


def _batches(vocabulary, lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            ids, sizes = encoder.encode(batch.column(1).to_pylist())
            if lists:
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                made = pa.ListArray.from_arrays(offsets, pa.array(ids, type=pa.int32()))
            else:
                made = pa.array(sizes, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["id", "made"])

    return run


def _load(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one file of fixed size


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id_col, ids): the token ids of every text."""
    kind = df.schema[id_col].dataType.simpleString()
    ids = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _batches(_load(df, vocabulary), True), f"id {kind}, made array<int>"
    )
    return ids.select(F.col("id").alias(id_col), F.col("made").alias("ids"))


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY, by: str | None = None) -> DataFrame:
    """(id_col, [by,] n_tokens) of every text; the lists never leave the workers. by is one more column to keep."""
    key = F.struct(F.col(id_col).alias("id"), (F.col(by) if by else F.lit(None).cast("string")).alias("by")).alias("id")
    keyed = df.select(key, F.col(text_col).alias("text"))
    counts = keyed.mapInArrow(_batches(_load(df, vocabulary), False), f"id {keyed.schema['id'].dataType.simpleString()}, made bigint")
    kept = [F.col("id.by").alias(by)] if by else []
    return counts.select(F.col("id.id").alias(id_col), *kept, F.col("made").alias("n_tokens"))
