"""Near-duplicate records by deletion-variant signatures.

Each distinct text becomes a vector of 48 minimum hashes of 16 bits over its word shingles; two texts of similarity s differ
in each position with probability 1 - s. The vector is cut into segments, so few that similar vectors have one that differs
in at most one position: with m segments that is certain for fewer than 2m differing positions. A segment of four positions
is one long. Of every segment the variants with one position replaced by a wildcard are indexed: the wildcard's place holds
the number of segment and place. Equal variants are joined, by 32 bits of their hash. A variant carries 160 one-bit minimum
hashes of its text, its sketch, which the join compares, so that pairs far below the threshold are never shuffled; what passes
is compared by 256 of them and verified by the similarity of the two shingle sets. No bucket or partner is capped.

Variants are most of what is shuffled, 48 a text, so a row of them is three longs: half a long of the variant's hash, and the
sketch. A pair is one long: 32 bits of the hash of each sketch, its label. All texts of a label are taken for the pair, and
texts of one label are compared whether or not they share a variant. So what agrees in 32 bits by chance is compared for
nothing, and no pair is lost by it.

With segments of four positions a pair of similarity s is missed with probability (1 - 4 s^3 (1 - s) - s^4)^12: 0.0004 at
s = 0.6, 0.00004 at 0.65 and 3e-9 at 0.8. A sketch bit differs with probability (1 - s) / 2; pairs at the threshold that
differ in 4 deviations more are left out, 0.00015 of them at most by both comparisons, and fewer above it.

A text is known by its 64-bit hash. Workers drop copies before anything is shuffled, and one table of signatures (one row a
distinct text) serves the variants and the sketches. Texts are read again for pairs that pass only: a bit table of bounded
size keeps the others out of the shuffle.

Defined results: null texts and texts of fewer words than a shingle never pair, nor do rows without a file or id; repeated rows
are rows of their own; an empty table gives no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Segments of the vector; a segment is WIDTH positions of 16 bits, which fill a long.
SEGMENTS, WIDTH = 12, 4
#: Longs of the sketch that candidates are compared by, and the deviations allowed. The join compares two and a half of them.
SKETCH, SLACK = 4, 4.0
CARRIED_BITS = 160
_WS = r"(?U)\s+"


def shingles(text: Column, size: int) -> Column:
    """Distinct hashes of the runs of size lower-case words; null for texts of fewer words."""
    from .common import let

    words = F.array_remove(F.split(F.lower(text), _WS), "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
    return let(words, lambda w: F.when(F.size(w) >= size, F.array_distinct(grams(w))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _minima(lists: pa.Array, count: int, seed: int) -> np.ndarray:
    """(count, rows) minimum hashes of each row's shingles, by count functions."""
    odd = np.random.RandomState(seed).randint(1, 2**62, size=(2, count)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
    starts = (offsets[:-1] - offsets[0]).astype(np.int64)
    low = (_mix(flat) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((count, len(starts)), dtype=np.uint64)
    for k in range(count):  # multiply-shift in 32 bits is enough to order the few shingles of one text
        h = low * np.uint32(odd[0, k] & np.uint64(0xFFFFFFFF))
        h ^= h >> np.uint32(15)
        h *= np.uint32(odd[1, k] & np.uint64(0xFFFFFFFF))
        least[k] = np.minimum.reduceat(h, starts)
    return least


def _columns(segments: int) -> list[str]:
    return [f"g{i}" for i in range(segments)] + [f"k{i}" for i in range(SKETCH)]


def _signer(segments: int):
    """(t, g0.., k0..): segments and sketch of every text, each text once a task."""
    places = np.uint64(1) << np.arange(64, dtype=np.uint64)[:, None]
    shifts = (np.uint64(16) * np.arange(WIDTH, dtype=np.uint64))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                new = []
                for i, t in enumerate(part.column(0).to_pylist()):
                    if t not in seen:
                        seen.add(t)
                        new.append(i)
                if len(seen) > 1_000_000:  # memory is bounded; a copy that comes later is only signed again
                    seen.clear()
                if not new:
                    continue
                part = part.take(pa.array(new))
                minima = _minima(part.column(1), segments * WIDTH + 64 * SKETCH, 20)
                short = _mix(minima[: segments * WIDTH] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
                packed = (short.reshape(segments, WIDTH, -1) << shifts).sum(axis=1, dtype=np.uint64)
                bits = (minima[segments * WIDTH :] >> np.uint64(7)) & np.uint64(1)
                sketch = (bits.reshape(SKETCH, 64, -1) * places).sum(axis=1, dtype=np.uint64)
                longs = [pa.array(row.view(np.int64)) for row in (*packed, *sketch)]
                yield pa.RecordBatch.from_arrays([part.column(0), *longs], names=["t", *_columns(segments)])

    return run


def signatures(texts: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(t, g0.., k0..): one row for each distinct text of (t, sh)."""
    names = _columns(segments)
    signed = texts.select("t", "sh").mapInArrow(_signer(segments), "t bigint, " + ", ".join(f"{c} bigint" for c in names))
    return signed.repartition("t").dropDuplicates(["t"])  # tasks have dropped their copies; states of an aggregation are longer


def variants(signed: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(v, k0, k1): every segment with one position replaced by a wildcard; v is half of its hash, then half of k2."""

    def variant(i: int, p: int) -> Column:
        kept = np.uint64(0xFFFFFFFFFFFFFFFF) ^ (np.uint64(0xFFFF) << np.uint64(16 * p))
        tag = np.uint64(i * WIDTH + p + 1) << np.uint64(16 * p)
        return F.col(f"g{i}").bitwiseAND(F.lit(int(kept.astype(np.int64)))).bitwiseOR(F.lit(int(tag.astype(np.int64))))

    sigs = signed.select(F.explode(F.array(*(variant(i, p) for i in range(segments) for p in range(WIDTH)))).alias("sig"), "k0", "k1", "k2")
    return sigs.select(F.shiftleft(F.xxhash64("sig"), 32).bitwiseOR(_half(F.col("k2"))).alias("v"), "k0", "k1")


def _half(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0xFFFFFFFF))


def most_bits(bits: int, threshold: float) -> int:
    """Bits in which two sketches may differ: what is expected at the threshold and SLACK deviations more."""
    p = (1 - threshold) / 2
    return math.floor(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def candidate_pairs(signed: DataFrame, threshold: float, segments: int = SEGMENTS) -> DataFrame:
    """(a, b) with a < b of the signatures that share a variant, or their label, and whose sketches are near enough."""

    def ends(df: DataFrame) -> list[DataFrame]:
        return [df.select(*(F.col(c).alias(f"{x}_{c}") for c in df.columns)) for x in "ab"]

    def carried(x: str, third: str = "k2") -> list[Column]:
        return [F.col(f"{x}_k0"), F.col(f"{x}_k1"), _half(F.col(f"{x}_{third}"))]

    def near(bits: int, p: list[Column], q: list[Column]) -> Column:
        return sum((F.bit_count(i.bitwiseXOR(j)) for i, j in zip(p, q, strict=True)), F.lit(0)) <= most_bits(bits, threshold)

    def label(x: str, third: str = "k2") -> Column:
        return F.shiftrightunsigned(F.xxhash64(*carried(x, third)), 32)

    left, right = ends(variants(signed, segments))
    p, q = label("a", "v"), label("b", "v")
    met = left.join(right, F.shiftright("a_v", 32) == F.shiftright("b_v", 32))
    met = met.where(near(CARRIED_BITS, carried("a", "v"), carried("b", "v"))).where(p < q)
    pairs = met.select(F.shiftleft(p, 32).bitwiseOR(q).alias("pair")).distinct()
    longs = [f"k{i}" for i in range(SKETCH)]
    a, b = ends(signed.where("t IS NOT NULL").select("t", *longs))  # one exchange serves all four sides
    p, q = label("a"), label("b")
    of_two = pairs.join(a, F.shiftrightunsigned("pair", 32) == p).join(b, _half(F.col("pair")) == q)
    of_one = a.join(b, p == q).where("a_t < b_t")
    whole = near(64 * SKETCH, *([F.col(f"{x}_{k}") for k in longs] for x in "ab"))
    found = of_two.drop("pair").unionByName(of_one).where(whole)
    return found.select(F.least("a_t", "b_t").alias("a"), F.greatest("a_t", "b_t").alias("b"))


def _linked_texts(rows: DataFrame, size: int, threshold: float, segments: int) -> DataFrame:
    """(a, b, similarity) with a < b of the distinct texts of rows (text, t) that reach the threshold."""
    from ..operators.prune import possibly_in
    from ..session import materialize

    sets = rows.select("t", shingles(F.col("text"), size).alias("sh")).where("sh IS NOT NULL")
    signed = materialize(signatures(sets, segments), "signatures")
    pairs = materialize(candidate_pairs(signed, threshold, segments), "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("t"))
    texts = possibly_in(rows.select("t", "text"), "t", ends).groupBy("t").agg(F.first("text").alias("text"))
    held = materialize(texts.select("t", shingles(F.col("text"), size).alias("sh")), "shingles")
    both = F.size(F.array_intersect("sa", "sb"))
    compared = pairs.join(held.select(F.col("t").alias("a"), F.col("sh").alias("sa")), "a").join(held.select(F.col("t").alias("b"), F.col("sh").alias("sb")), "b")
    similar = compared.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))
    return similar.where(F.col("similarity") >= threshold)


def _rows(df: DataFrame, id_col: str, text_col: str, file_col: str, size: int) -> DataFrame:
    """(id, f, text, t) of the rows with words enough for a shingle; f is the hash of the file, null without one."""
    file = F.col(file_col)
    rows = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.when(file.isNotNull(), F.xxhash64(file)).alias("f"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t")
    )
    return rows.where(F.col("text").rlike(r"(?U)\S" + (r"\s+\S+" * (size - 2) + r"\s+\S" if size > 1 else "")))


def near_duplicate_pairs(
    df: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    file_col: str = "file_path",
    size: int = 3,
    threshold: float = 0.6,
    segments: int = SEGMENTS,
) -> DataFrame:
    """(id_col_a, id_col_b, similarity), smaller id first: rows of different files whose similarity reaches the threshold.

    Pairs are found between distinct texts, then between the files that hold them, then expanded to rows, so copies within
    one file are never compared. Where copies are so many that their pairs cannot be listed, near_duplicate_groups says the
    same in one row a record.
    """
    from ..operators.prune import possibly_in
    from ..session import materialize

    rows = _rows(df, id_col, text_col, file_col, size)
    keyed = materialize(rows.where("f IS NOT NULL").select("id", "f", "t"), "keys")
    copies = keyed.groupBy("t").agg(F.min("f").alias("f0"), F.max("f").alias("f1")).where("f0 <> f1")
    same = copies.select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("similarity"))
    linked = materialize(_linked_texts(rows, size, threshold, segments).unionByName(same), "linked")
    members = materialize(possibly_in(keyed, "t", linked.select(F.explode(F.array("a", "b")).alias("t"))), "members")
    places = members.select("t", "f").distinct()
    x, y = places.select(F.col("t").alias("a"), F.col("f").alias("fa")), places.select(F.col("t").alias("b"), F.col("f").alias("fb"))
    apart = (F.col("fa") != F.col("fb")) & ((F.col("a") != F.col("b")) | (F.col("fa") < F.col("fb")))
    files = linked.join(x, "a").join(y, "b").where(apart)
    i = members.select(F.col("t").alias("a"), F.col("f").alias("fa"), F.col("id").alias("i"))
    j = members.select(F.col("t").alias("b"), F.col("f").alias("fb"), F.col("id").alias("j"))
    found = files.join(i, ["a", "fa"]).join(j, ["b", "fb"])
    return found.select(F.least("i", "j").alias(f"{id_col}_a"), F.greatest("i", "j").alias(f"{id_col}_b"), "similarity")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(v, label) of every end of the edges (a, b): the smallest id of its connected component.

    Each round a vertex takes the smallest label around it, then its label's label; every round is written, so lineage
    stays short and lost executors cost one round. Rounds grow with the logarithm of a component's width.
    """
    from ..session import materialize

    both = materialize(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("v").agg(F.least("v", F.min("w")).alias("label")), "labels")
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("v").alias("w"), F.col("label").alias("l")), "w").groupBy("v").agg(F.min("l").alias("l"))
        lower = labels.join(seen, "v").select("v", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        jump = lower.join(labels.select(F.col("v").alias("label"), F.col("label").alias("far")), "label", "left")
        new = materialize(jump.select("v", F.least("label", F.coalesce("far", "label")).alias("label"), "old"), "labels")
        labels = new.select("v", "label")
        if new.where("label <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def near_duplicate_groups(
    df: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    file_col: str = "file_path",
    size: int = 3,
    threshold: float = 0.6,
    segments: int = SEGMENTS,
) -> DataFrame:
    """(id_col, text_class, group_id, links): one row for each record with a near duplicate in another file.

    text_class is the smallest id with exactly this text, group_id the smallest of the group, links the number of other
    texts this one is linked to. Copies of a text are one class and never expanded into pairs.
    """
    from ..session import materialize

    rows = _rows(df, id_col, text_col, file_col, size).where("f IS NOT NULL")
    texts = rows.groupBy("t").agg(F.min("id").alias("first"), F.min("f").alias("f0"), F.max("f").alias("f1"))
    texts = materialize(texts, "texts")
    a, b = (texts.select(F.col("t").alias(x), F.col("first").alias(f"{x}_id"), F.col("f0").alias(f"{x}0"), F.col("f1").alias(f"{x}1")) for x in "ab")
    linked = _linked_texts(rows, size, threshold, segments).join(a, "a").join(b, "b")
    one_file = (F.col("a0") == F.col("a1")) & (F.col("b0") == F.col("b1")) & (F.col("a0") == F.col("b0"))
    edges = materialize(linked.where(~one_file).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "edges")
    labels = components(edges)
    links = edges.select("a").union(edges.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    classes = texts.join(labels.withColumnRenamed("v", "first"), "first", "left").join(links.withColumnRenamed("a", "first"), "first", "left")
    classes = classes.where(F.col("label").isNotNull() | (F.col("f0") != F.col("f1")))
    classes = classes.select("t", F.col("first").alias("text_class"), F.coalesce("label", "first").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return rows.select("id", "t").join(classes, "t").select(F.col("id").alias(id_col), "text_class", "group_id", "links")
