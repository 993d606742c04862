"""The most similar vectors of every vector, by an inverted multi-index.

Both halves of a unit vector are quantised separately, so a cell is a pair of centroids. A query walks the pairs in order of
their summed distance with a heap and visits the nearest `visit` cells; the entries of those cells are ranked by exact
cosine similarity. The number of centroids follows the data (PER_CELL entries a cell on average). The codebooks are fitted on
a sample chosen by hash, SAMPLE vectors or SAMPLE_CENTROID for each centroid, SAMPLE_MOST at most (64 MB of 64 floats; that
holds for cells of PER_CELL up to 69 billion vectors); every vector is indexed.

Second centroids that are near each other form groups; a first centroid with a group is a block of cells. Queries meet cells
by an equality join on the block: a vector is sent once as an entry and once for each block its query visits. What a block gets is
estimated from the sample; a block of more than BLOCK entries or QUERIES queries is split by both, so that every group a task
holds is bounded. The estimate decides how work is divided, never the result.

Of more than k + 1 equal vectors only the k + 1 with the smallest ids can be among the k nearest of anything (ties go to
the smaller id), so the others are not indexed; as queries they get the first k of their group, which is exact.

Defined results: vectors that are null, empty, all zero, of another length than most, or hold a null, NaN or infinity, and
rows without an id, take part in nothing. Repeated rows are neighbours of similarity 1. Similarities that agree in 12 digits
tie. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, SAMPLE_CENTROID, SAMPLE_MOST = 20_000, 16, 262_144
#: Mean entries of a cell and of a block; entries and queries of a group beyond which a block is split.
PER_CELL, PER_BLOCK, BLOCK, QUERIES = 64, 8_192, 16_384, 131_072
#: Bytes of a shuffle partition, and of crowds beyond which they are joined instead of broadcast.
PARTITION, FEW_CROWDS = 4 << 20, 100_000


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that can be compared."""
    v = F.col(vec_col).cast("array<float>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where((F.size("v") > 0) & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = sizes["d"] if sizes else 0
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.where((F.size("v") == dim) & (norm > 0) & (norm < F.lit(float("inf"))))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.RandomState(7)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def _unit(flat: np.ndarray) -> np.ndarray:
    v = flat.astype(np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(-1, dim)


def _smallest(d: np.ndarray, top: int) -> np.ndarray:
    """Columns of the top smallest of each row, in order."""
    if top < d.shape[1]:
        some = np.argpartition(d, top - 1, axis=1)[:, :top]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
    return np.argsort(d, axis=1, kind="stable")


def nearest_cells(d1: np.ndarray, d2: np.ndarray, visit: int) -> Iterator[list[tuple[int, int]]]:
    """For each row the visit centroid pairs of smallest summed distance, in order: the multi-sequence walk with a heap."""
    k = d1.shape[1]
    top = min(k, visit)  # a pair that needs a later centroid has at least visit nearer ones
    first, second = (_smallest(d, top) for d in (d1, d2))
    s1, s2 = (np.take_along_axis(d, o, 1).tolist() for d, o in ((d1, first), (d2, second)))
    visit = min(visit, top * top)
    for a, b, oa, ob in zip(s1, s2, first.tolist(), second.tolist()):
        heap, out = [(a[0] + b[0], 0, 0)], []
        while len(out) < visit and heap:
            _, r, c = heapq.heappop(heap)
            out.append((oa[r], ob[c]))
            if c + 1 < top:
                heapq.heappush(heap, (a[r] + b[c + 1], r, c + 1))
            if c == 0 and r + 1 < top:
                heapq.heappush(heap, (a[r + 1] + b[0], r + 1, 0))
        yield out


class Books:
    """The codebooks of both halves, the groups of their centroids, and how blocks are split."""

    def __init__(self, sample: np.ndarray, n: int, dim: int):
        self.half = max(1, dim // 2)
        self.cells = int(max(2, min(round((n / PER_CELL) ** 0.5), len(sample) // 8)))
        parts = sample[:, : self.half], sample[:, self.half :]
        self.books = [_kmeans(x, self.cells) if x.shape[1] else np.zeros((1, 0)) for x in parts]
        self.group = _nearest(self.books[1], _kmeans(self.books[1], max(1, round(self.cells * PER_CELL / PER_BLOCK))))
        self.groups = int(self.group.max()) + 1
        self.split: dict[int, tuple[int, int]] = {}

    def distances(self, unit: np.ndarray) -> list[np.ndarray]:
        return [_distances(x, c) for x, c in zip((unit[:, : self.half], unit[:, self.half :]), self.books)]

    def block(self, i, j):
        return i * self.groups + self.group[j]

    def divide(self, sample: np.ndarray, asks: np.ndarray, n: int, visit: int, looks: int = 4096) -> float:
        """Splits the blocks that the sample shows to be large; the mean number of blocks a query visits."""
        homes = (_nearest(x, c) for x, c in zip((sample[:, : self.half], sample[:, self.half :]), self.books))
        own = Counter(self.block(*homes).tolist())
        look = np.nonzero(asks)[0][:looks]
        visits: Counter = Counter()
        for cells in nearest_cells(*self.distances(sample[look]), visit):
            visits.update({i * self.groups + int(self.group[j]) for i, j in cells})
        up, more = n / len(sample), n * asks.mean() / max(1, len(look))
        for b in own.keys() | visits.keys():
            split = math.ceil(own[b] * up / BLOCK) or 1, math.ceil(visits[b] * more / QUERIES) or 1
            if split != (1, 1):
                self.split[b] = split
        return sum(visits.values()) / max(1, len(look))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances less the squared norm of x, which doesn't change the order."""
    return (c**2).sum(1) - 2 * x @ c.T


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(64, 8_000_000 // len(c))
    return np.concatenate([_distances(x[s : s + step], c).argmin(1) for s in range(0, len(x), step)])


_ROUTED = "b int, s int, id bigint, cell bigint, visits array<bigint>, v binary"


def _router(shared, visit: int):
    """Rows (id, v, q) as entries of their cell, and those with q also as queries of the blocks they visit; one row where
    both meet in an undivided block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        dim = books.half + books.books[1].shape[1]
        step = max(64, min(4096, 4_000_000 // books.cells))
        group, groups, width = books.group.tolist(), books.groups, books.cells
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                raw = _floats(part.column(1), dim)
                d1, d2 = books.distances(_unit(raw))
                ids = part.column(0).to_numpy()
                asks = part.column(2).to_numpy(zero_copy_only=False)
                bytes_ = np.ascontiguousarray(raw, dtype=np.float32)
                home1, home2 = d1.argmin(1), d2.argmin(1)
                home = (home1 * books.cells + home2).tolist()
                blocks = books.block(home1, home2).tolist()
                salt = (ids * 2654435761 % 4294967296).tolist()
                rows = []
                alone = set(range(len(home)))
                which = np.nonzero(asks)[0]
                for r, cells in zip(which.tolist(), nearest_cells(d1[which], d2[which], visit)):
                    seen: dict[int, list[int]] = {}
                    for i, j in cells:
                        seen.setdefault(i * groups + group[j], []).append(i * width + j)
                    for b, visited in seen.items():
                        n, m = books.split.get(b, (1, 1))
                        if b == blocks[r] and n == m == 1:
                            rows.append((b, 0, r, home[r], visited))
                            alone.discard(r)
                        else:
                            rows.extend((b, e * m + salt[r] % m, r, -1, visited) for e in range(n))
                for r in alone:
                    n, m = books.split.get(blocks[r], (1, 1))
                    rows.extend((blocks[r], salt[r] % n * m + q, r, home[r], []) for q in range(m))
                b, z, at, cell, visits = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b, pa.int32()), pa.array(z, pa.int32()), pa.array(ids[list(at)]), pa.array(cell, pa.int64()),
                        pa.array(visits, pa.list_(pa.int64())), pa.array([bytes_[r].tobytes() for r in at], pa.binary()),
                    ],
                    names=["b", "s", "id", "cell", "visits", "v"],
                )

    return run


def _ranker(dim: int, k: int, least: float | None):
    """Exact similarities of the queries of one block with the entries of the cells they visit."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, cell = table["id"].to_numpy(), table["cell"].to_numpy()
        v = _unit(np.frombuffer(b"".join(table["v"].to_pylist()), dtype=np.float32).reshape(-1, dim))
        visits = table["visits"].combine_chunks()
        if isinstance(visits, pa.ChunkedArray):
            visits = visits.chunk(0)
        eo = np.nonzero(cell >= 0)[0]
        eo = eo[np.lexsort((ids[eo], cell[eo]))]
        ej = cell[eo]
        qj, qo = visits.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(visits.offsets.to_numpy()))
        order = np.argsort(qj, kind="stable")
        qj, qo = qj[order], qo[order]
        out_a, out_b, out_s = [], [], []
        for j in np.unique(ej):
            e = eo[slice(*np.searchsorted(ej, [j, j + 1]))]
            asks = qo[slice(*np.searchsorted(qj, [j, j + 1]))]
            for s in range(0, len(asks), 1024):
                a = asks[s : s + 1024]
                sim = v[a] @ v[e].T
                sim[ids[a][:, None] == ids[e][None, :]] = -2
                if least is not None:
                    r, c = np.nonzero(sim >= least - 1e-12)
                elif len(e) > k:
                    c = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                    edge = np.take_along_axis(sim, c, 1).min(1)
                    r, c = np.nonzero(sim >= edge[:, None] - 1e-12)  # ties at the edge stay; the final rank settles them
                else:
                    r, c = np.nonzero(sim > -1.5)
                out_a.append(ids[a][r])
                out_b.append(ids[e][c])
                out_s.append(np.round(sim[r, c], 12))
        a, b, s = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((out_a, np.int64), (out_b, np.int64), (out_s, np.float64)))
        if len(a):
            order = np.lexsort((b, -s, a))
            a, b, s = a[order], b[order], s[order]
            start = np.concatenate([[True], a[1:] != a[:-1]])
            rank = np.arange(len(a)) - np.maximum.accumulate(np.where(start, np.arange(len(a)), 0))
            keep = (rank < k) & (s >= (-1.5 if least is None else least))
            a, b, s = a[keep], b[keep], s[keep]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})

    return run


def nearest_neighbours(
    df: DataFrame,
    id_col: str = "chunk_id",
    vec_col: str = "vector",
    k: int = 10,
    visit: int = 24,
    queries: Column | None = None,
    min_similarity: float | None = None,
) -> DataFrame:
    """(a, b, similarity, rank): the k nearest of each query vector found in the cells it visits.

    queries tells which rows ask (all if None; a condition on id_col only); every usable vector is an entry. With
    min_similarity only neighbours that similar are returned.
    """
    from ..session import materialize

    spark = df.sparkSession
    usable = usable_vectors(df, id_col, vec_col)
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = usable.select(F.col("id").alias(id_col), "v").select(F.col(id_col).alias("id"), "v", asks.alias("q"))
    copies = rows.select("id", "q", F.xxhash64("v").alias("h"), F.hash("v").alias("h2"))
    crowds = copies.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("m"))
    large = F.col("m") > k + 1
    stats = crowds.agg(F.sum("m").alias("n"), F.count_if(large).alias("crowds"), F.sum(F.when(large, F.col("m") - k - 1)).alias("late")).first()
    n = (stats["n"] or 0) - (stats["late"] or 0)
    if not n:
        return spark.createDataFrame([], "a bigint, b bigint, similarity double, rank int")
    entries, extra = rows, None
    if stats["crowds"]:
        some = crowds.where(large).select("h", "h2")
        some = F.broadcast(some) if stats["crowds"] <= FEW_CROWDS else some
        # the first k + 1 of a crowd: every task keeps so many of its own before anything is shuffled
        place = F.row_number().over(Window.partitionBy("h", "h2").orderBy("id"))
        heads = materialize(copies.join(some, ["h", "h2"]).withColumn("r", place).where(F.col("r") <= k + 1).select("h", "h2", "id", "r"), "crowds")
        last = heads.where(F.col("r") == k + 1).select("h", "h2", F.col("id").alias("last"))
        last = F.broadcast(last) if stats["crowds"] <= FEW_CROWDS else last
        known = rows.withColumns({"h": F.xxhash64("v"), "h2": F.hash("v")}).join(last, ["h", "h2"], "left")
        entries = known.where(F.col("last").isNull() | (F.col("id") <= F.col("last"))).select("id", "v", "q")
        late = copies.join(last, ["h", "h2"]).where(F.col("q") & (F.col("id") > F.col("last"))).select("h", "h2", F.col("id").alias("a"))
        first = heads.where(F.col("r") <= k).select("h", "h2", F.col("id").alias("b"), F.col("r").alias("rank"))
        extra = late.join(first, ["h", "h2"]).select("a", "b", F.lit(1.0).alias("similarity"), F.col("rank").cast("int").alias("rank"))
    # by hash, a few more than wanted; each task sends its own part only
    wanted = min(max(SAMPLE, SAMPLE_CENTROID * round((n / PER_CELL) ** 0.5)), SAMPLE_MOST)
    share = entries if n <= wanted else entries.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < math.ceil(wanted / n * (1 << 40)))
    drawn = share.select("v", "q").limit(2 * wanted).collect() or entries.select("v", "q").limit(1).collect()
    unit = _unit(np.array([r["v"] for r in drawn], dtype=np.float32))
    dim = unit.shape[1]
    books = Books(unit, n, dim)
    asking = np.array([r["q"] for r in drawn])
    blocks = books.divide(unit, asking, n, visit)
    shared = spark.sparkContext.broadcast(books)
    parts = math.ceil(n * (1 + blocks * asking.mean()) * (4 * dim + 64) / PARTITION)
    routed = entries.mapInArrow(_router(shared, visit), _ROUTED).repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "b", "s")
    near = routed.groupBy("b", "s").applyInArrow(_ranker(dim, k, min_similarity), "a bigint, b bigint, similarity double")
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    found = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if extra is not None:
        if min_similarity is not None:
            extra = extra.where(F.col("similarity") >= min_similarity)
        found = found.unionByName(extra)
    return found


def mutual_neighbours(
    df: DataFrame, id_col: str = "chunk_id", vec_col: str = "vector", k: int = 10, min_similarity: float = 0.9, visit: int = 24
) -> DataFrame:
    """(id_col_a, id_col_b), smaller id first: vectors at least that similar, each among the k nearest of the other."""
    near = nearest_neighbours(df, id_col, vec_col, k, visit, None, min_similarity).select("a", "b")
    ordered = near.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b"))
    return ordered.groupBy(*ordered.columns).count().where("count = 2").drop("count")
