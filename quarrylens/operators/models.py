"""Embedding and reranking providers.

No model weights are shipped. The ONNX providers run weights that the user supplies; the hashing providers are
deterministic stand-ins for tests and must not be read as model quality. Executors build a session once a worker.
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> np.ndarray: ...


def resolve_model_path(name: str, env: str = "QUARRYLENS_MODELS") -> Path | None:
    """The folder of a model by name: in the folder of models that the environment names, beside the program, in the home
    folder, in the working folder."""
    places = [os.environ.get(env), Path(__file__).resolve().parents[2] / "models", Path.home() / ".quarrylens" / "models", Path.cwd() / "models"]
    return next((Path(p) / name for p in places if p and (Path(p) / name).exists()), None)


class HashingEmbedder:
    """Stand-in: signed feature hashing of lower-case words, unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            raise ValueError("nothing to embed")
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for r, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[r, h % self.dim] += 1 if h >> 31 else -1
        norm = np.sqrt((out.astype(np.float64) ** 2).sum(1, keepdims=True))
        return np.where(norm > 1e-12, out / np.maximum(norm, 1e-12), out).astype(np.float32)


class OnnxEmbedder:
    """Transformer with inputs input_ids, attention_mask; the first token's vector, unit length."""

    PAD = 1

    def __init__(self, folder: str, dim: int = 1024):
        self.folder, self.dim, self._run = folder, dim, None

    def _load(self):
        if self._run is None:
            import onnxruntime
            from tokenizers import Tokenizer

            session = onnxruntime.InferenceSession(str(Path(self.folder) / "model.onnx"), providers=["CPUExecutionProvider"])
            self._run = session, Tokenizer.from_file(str(Path(self.folder) / "tokenizer.json"))
        return self._run

    def __getstate__(self):
        return {**self.__dict__, "_run": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            raise ValueError("nothing to embed")
        session, tokenizer = self._load()
        ids = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts])]
        width = max(map(len, ids))
        padded = np.array([i + [self.PAD] * (width - len(i)) for i in ids], dtype=np.int64)
        mask = np.array([[1] * len(i) + [0] * (width - len(i)) for i in ids], dtype=np.int64)
        first = session.run(None, {"input_ids": padded, "attention_mask": mask})[0][:, 0, :].astype(np.float64)
        return (first / np.maximum(np.sqrt((first**2).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


class DotReranker:
    """Scores by the dot product of an embedder's vectors."""

    def __init__(self, embedder: Embedder):
        self.embedder = embedder

    def score(self, query: str, texts: list[str]) -> np.ndarray:
        return self.embedder.embed(texts) @ self.embedder.embed([query])[0]

    def score_column(self, df: DataFrame, query: str, text_col: str = "text") -> DataFrame:
        return score_with(self, df, query, text_col)


class OnnxReranker(OnnxEmbedder):
    """Cross-encoder: start, query, end, end, text, end; the text is cut to the window, the query never."""

    START, END, WINDOW = 0, 2, 256

    def score(self, query: str, texts: list[str]) -> np.ndarray:
        session, tokenizer = self._load()
        q = tokenizer.encode(query, add_special_tokens=False).ids
        room = max(0, self.WINDOW - len(q) - 4)
        rows = []
        for e in tokenizer.encode_batch(list(texts), add_special_tokens=False):
            rows.append([self.START, *q, self.END, self.END, *e.ids[:room], self.END])
        width = max(map(len, rows))
        ids = np.array([r + [self.PAD] * (width - len(r)) for r in rows], dtype=np.int64)
        mask = np.array([[1] * len(r) + [0] * (width - len(r)) for r in rows], dtype=np.int64)
        return session.run(None, {"input_ids": ids, "attention_mask": mask})[0].reshape(-1).astype(np.float32)

    def score_column(self, df: DataFrame, query: str, text_col: str = "text") -> DataFrame:
        return score_with(self, df, query, text_col)


class LexicalReranker:
    """Stand-in: log-odds of the share of query words a text holds."""

    def score(self, query: str, texts: list[str]) -> np.ndarray:
        asked = set(query.lower().split())
        share = np.array([len(asked & set((t or "").lower().split())) / max(1, len(asked)) for t in texts])
        return np.log((share + 0.01) / (1.01 - share)).astype(np.float32)

    def score_column(self, df: DataFrame, query: str, text_col: str = "text") -> DataFrame:
        return score_with(self, df, query, text_col)


def score_with(reranker: Reranker, df: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """df with score, the reranker's logit."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(reranker.score(query, s.tolist()) if len(s) else [], dtype="float64")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("score", F.pandas_udf(run, "double")(F.col(text_col)))


def embed_column(
    embedder: Embedder, df: DataFrame, text_col: str = "text", out: str = "vector", batch_size: int = 32, pause: float = 0.0
) -> DataFrame:
    """df with a vector column. The model gets batch_size texts at a time, of similar length to save padding, and rests for
    pause seconds after each."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = [t or "" for t in s]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            vectors: list = [None] * len(texts)
            for at in range(0, len(order), max(1, batch_size)):
                some = order[at : at + max(1, batch_size)]
                for i, v in zip(some, embedder.embed([texts[i] for i in some])):
                    vectors[i] = v
                if pause:
                    time.sleep(pause)
            yield pd.Series(vectors)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text_col)))


def score_pairs(reranker: Reranker, pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, query, position, candidate) with score and ms, the time of the whole query's call; the candidates of a
    query are scored together, as a search would."""
    shown = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        started = time.perf_counter()
        scores = reranker.score(pdf["query"].iloc[0], pdf["candidate"].tolist())
        return pdf.assign(score=np.asarray(scores, dtype=np.float64), ms=(time.perf_counter() - started) * 1000)

    return pairs.groupBy("pair_id").applyInPandas(run, ", ".join([*shown, "score double", "ms double"]))


def expand_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, query, position, candidate): the positive at position 0, then the hard negatives."""
    all_ = F.concat(F.array("positive"), F.coalesce("hard_negatives", F.array().cast("array<string>")))
    return pairs.select("pair_id", "query", F.posexplode(all_).alias("position", "candidate"))


def recall_at_1(scored: DataFrame) -> DataFrame:
    """One row (pairs, hits, recall[, mean_ms]) of (pair_id, position, score[, ms]): how often the positive has the best score,
    and the mean time of a query."""
    time_ = [F.max("ms").alias("ms")] if "ms" in scored.columns else []
    best = scored.groupBy("pair_id").agg(F.max(F.when(F.col("position") == 0, F.col("score"))).alias("p"), F.max(F.when(F.col("position") > 0, F.col("score"))).alias("n"), *time_)
    hit = (F.coalesce(F.col("p"), F.lit(float("-inf"))) >= F.coalesce(F.col("n"), F.lit(float("-inf")))).cast("int")
    return best.agg(F.count(F.lit(1)).alias("pairs"), F.sum(hit).alias("hits"), F.round(F.avg(hit), 6).alias("recall"), *([F.avg("ms").alias("mean_ms")] if time_ else []))
