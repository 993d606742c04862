"""The engine: folders in, chunks stored, queries answered."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.listing import EXTENSIONS, LISTING, list_files, max_bytes, only_extensions, safe_trees, unindexed_dirs
from ..sources.readers import read_files
from ..sources.store import ChunkStore
from .bm25 import Bm25Index, bm25_search
from .chunking import SIZE, assign_ids, chunks_of
from .dedupe import diff_embed, flag_boilerplate
from .hybrid import merge_hits, rank_hits
from .models import Embedder, HashingEmbedder, LexicalReranker, Reranker, embed_column
from .router import boosts_of
from .vectors import int8_topk, quantized, vector_topk


@dataclass
class Config:
    index_path: str
    rerank_k: int = 5
    diff_embed: bool = False
    chunk_size: int = SIZE
    #: Score vectors by their int8 form, a quarter of the bytes, as soon as the index is prepared.
    int8: bool = False


@dataclass
class IndexOptions:
    """workers bounds the tasks that read and embed at once (0: as many as there are); a model gets batch_size texts at a time
    and rests for pause_seconds after each batch."""

    workers: int = 0
    batch_size: int = 32
    pause_seconds: float = 0.0
    only_extensions: list[str] = field(default_factory=list)
    max_file_bytes: int = 0
    replace: bool = False

    @classmethod
    def fast(cls) -> IndexOptions:
        return cls()

    @classmethod
    def background(cls) -> IndexOptions:
        return cls(workers=1, batch_size=8, pause_seconds=0.4, only_extensions=["pdf", "docx", "xlsx", "txt"])

    def extensions(self) -> tuple[str, ...]:
        return tuple(e.lower() if e.startswith(".") else "." + e.lower() for e in self.only_extensions) or EXTENSIONS


class Engine:
    def __init__(self, spark: SparkSession, config: Config, embedder: Embedder | None = None, reranker: Reranker | None = None):
        self.spark, self.config = spark, config
        self.store = ChunkStore(spark, config.index_path)
        self.embedder, self.reranker = embedder or HashingEmbedder(), reranker or LexicalReranker()
        self._routes: list[tuple[str, list[str]]] = []

    def register(self, label: str, keywords: list[str]) -> None:
        """Add a route: queries with a keyword favour paths that contain the label."""
        self._routes.append((label, keywords))

    @property
    def routes(self) -> DataFrame:
        return self.spark.createDataFrame(self._routes, "label string, keywords array<string>")

    def index(self, folder: str, options: IndexOptions | None = None) -> dict[str, int]:
        """Index a folder: {files, skipped, chunks}. A missing folder is an error, an unreadable file is skipped."""
        options = options or IndexOptions()
        files = max_bytes(only_extensions(list_files(self.spark, folder), options.only_extensions), options.max_file_bytes)
        texts = read_files(files.repartition(options.workers or 4 * self.spark.sparkContext.defaultParallelism))
        counts = self.index_texts(texts, options.replace, options)
        self.store.add_indexed_dir(folder)
        return counts

    def index_texts(self, texts: DataFrame, replace: bool = False, options: IndexOptions | None = None) -> dict[str, int]:
        """Index (path, text, error) rows. Boilerplate is judged within the call; ids follow (path, offset)."""
        from ..session import materialize

        options = options or IndexOptions()
        texts = materialize(texts, "texts")
        read = texts.where("error IS NULL")
        chunks = read.select(F.col("path").alias("file_path"), F.inline(chunks_of(F.col("text"), self.config.chunk_size)))
        chunks = materialize(chunks.withColumn("norm_text", normalize(F.col("text"))), "chunks")  # counted, then joined
        flagged = flag_boilerplate(chunks)
        spread = flagged.repartition(options.workers) if options.workers else flagged
        vectors = embed_column(self.embedder, spread, batch_size=options.batch_size, pause=options.pause_seconds)
        numbered = assign_ids(vectors, base=self.store.max_id())
        if replace:
            self.store.replace_files(numbered, read.select(F.col("path").alias("file_path")))
        else:
            self.store.append(numbered)
        n = texts.agg(F.count(F.lit(1)).alias("files"), F.count("error").alias("skipped")).first()
        return {"files": n["files"] - n["skipped"], "skipped": n["skipped"], "chunks": chunks.count()}

    def refresh(self, folder: str, since: DataFrame, options: IndexOptions | None = None) -> dict[str, int]:
        """Index again the files of folder that are new or changed against a listing (path, modified_at, ...)."""
        now = list_files(self.spark, folder)
        old = since.select("path", F.col("modified_at").alias("_m"), F.col("length").alias("_l"))
        changed = now.join(old, "path", "left").where(~(F.col("modified_at").eqNullSafe(F.col("_m")) & F.col("length").eqNullSafe(F.col("_l"))))
        return self.index_texts(read_files(changed.select("path")), True, options)

    def prepare(self) -> str:
        """Write the keyword index and the vectors of the store as it is now; searches read them until the store changes.

        A search then reads the postings of its words and one narrow table of vectors instead of all texts. Returns the folder.
        """
        where = self._index_of(self.store.state())
        if not self.store.has(f"{where}/ready"):
            chunks = self.store.chunks()
            Bm25Index.build(chunks).save(f"{where}/bm25")
            rows = diff_embed(chunks) if self.config.diff_embed else chunks
            quantized(rows, keep=["vector"]).write.mode("overwrite").parquet(f"{where}/vectors")
            self.store.mark(f"{where}/ready")
        return where

    def _index_of(self, state: str) -> str:
        return f"{self.store.path}/index/{state}{'-diff' if self.config.diff_embed else ''}"

    def hits(self, query: str, k: int) -> tuple[DataFrame, DataFrame]:
        """The k best of the keyword and of the vector side, from the prepared index if it is of the store as it is now."""
        asked, where = self._query_vector(query), self._index_of(self.store.state())
        if not self.store.has(f"{where}/ready"):
            chunks = self.store.chunks()
            return bm25_search(chunks, query, k), vector_topk(diff_embed(chunks) if self.config.diff_embed else chunks, asked, k)
        vectors = self.spark.read.parquet(f"{where}/vectors")
        near = int8_topk(vectors, asked, k) if self.config.int8 else vector_topk(vectors, asked, k)
        return Bm25Index.load(self.spark, f"{where}/bm25").search(query, k), near

    def search(self, query: str, k: int = 10) -> DataFrame:
        return merge_hits(*self.hits(query, k), self.store.chunks(), k)

    def search_ranked(self, query: str, k: int = 10) -> DataFrame:
        """(chunk_id, file_path, text, score, bucket, rank)."""
        words, vectors = self.hits(query, self.config.rerank_k if self.config.rerank_k > 0 else 20)
        return rank_hits(words, vectors, self.store.chunks(), query, k, self.reranker, boosts_of(self.routes, query) if self._routes else {})

    def _query_vector(self, query: str) -> list[float]:
        return self.embedder.embed([query])[0].tolist()

    def answer(self, query: str, k: int = 10) -> dict[str, list[dict]]:
        """{exact: [...], suggest: [...]} of filePath, text, score; an empty query gives empty lists."""
        out: dict[str, list[dict]] = {"exact": [], "suggest": []}
        if query:
            for r in self.search_ranked(query, k).orderBy("bucket", "rank").collect():  # at most k rows
                out[r["bucket"]].append({"filePath": r["file_path"], "text": r["text"], "score": r["score"]})
        return out

    def status(self) -> dict[str, int]:
        return self.store.counts().select("chunks", "files").first().asDict()

    def reset(self) -> None:
        self.store.clear()

    def reindex_all(self, folders: list[str], options: IndexOptions | None = None) -> dict[str, int]:
        self.reset()
        total = {"files": 0, "skipped": 0, "chunks": 0}
        for f in folders:
            for key, n in self.index(f, options).items():
                total[key] += n
        return total

    def onboard(self, primary: str, home: str | None = None) -> dict[str, int]:
        """The primary folder at full speed, then the safe trees of home that are not indexed yet, throttled."""
        total = self.index(primary, IndexOptions.fast())
        trees = safe_trees(home, primary) if home else []
        if trees:
            rows = self.spark.createDataFrame([(t,) for t in trees], "dir string")
            for r in unindexed_dirs(rows, self.store.indexed_dirs()).orderBy("dir").collect():  # folders, not files
                for key, n in self.index(r["dir"], IndexOptions.background()).items():
                    total[key] += n
        return total


__all__ = ["Config", "Engine", "IndexOptions", "LISTING"]
