"""Providers against a session that records what it is given."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens import __main__ as cli
from quarrylens.operators import models


class Encoding:
    def __init__(self, ids):
        self.ids = ids


class Tokenizer:
    """A word is its length; a whole text gets 0 in front and 2 behind."""

    def encode(self, text, add_special_tokens=True):
        ids = [len(w) for w in text.split()]
        return Encoding([0, *ids, 2] if add_special_tokens else ids)

    def encode_batch(self, texts, add_special_tokens=True):
        return [self.encode(t, add_special_tokens) for t in texts]


class Session:
    def __init__(self, output):
        self.fed, self.output = [], output

    def run(self, _, feed):
        self.fed.append(feed)
        return [self.output(feed["input_ids"], feed["attention_mask"])]


def test_embedder_pads_masks_and_takes_the_first_token():
    def output(ids, mask):  # (rows, width, 2): only the first token's vector counts
        out = np.full((*ids.shape, 2), 99.0, dtype=np.float32)
        out[:, 0, :] = np.stack([mask.sum(1), np.zeros(len(ids))], axis=1) + [0, 3]
        return out

    e = models.OnnxEmbedder("nowhere", dim=2)
    session = Session(output)
    e._run = session, Tokenizer()
    got = e.embed(["một hai ba bốn", "x", None])
    assert session.fed[0]["input_ids"].tolist() == [[0, 3, 3, 2, 3, 2], [0, 1, 2, 1, 1, 1], [0, 2, 1, 1, 1, 1]]
    assert session.fed[0]["attention_mask"].sum(1).tolist() == [6, 3, 2]
    assert got.dtype == np.float32 and np.allclose(np.linalg.norm(got, axis=1), 1) and np.allclose(got[1], np.array([3, 3]) / 18**0.5)
    with pytest.raises(ValueError):
        e.embed([])


def test_reranker_cuts_the_text_but_not_the_query():
    r = models.OnnxReranker("nowhere")
    session = Session(lambda ids, mask: mask.sum(1, keepdims=True).astype(np.float32))
    r._run = session, Tokenizer()
    scores = r.score("aa bb", ["ccc", "d " * 400])
    first, second = session.fed[0]["input_ids"].tolist()
    assert first[:9] == [0, 2, 2, 2, 2, 3, 2, 1, 1] and len(second) == 256 and second[-1] == 2
    assert scores.tolist() == [7.0, 256.0]
    r.score("q " * 300, ["ccc"])
    assert len(session.fed[1]["input_ids"][0]) == 304  # a query longer than the window leaves no room for the text


def test_batches_are_small_whatever_the_options(spark):
    class Counting:  # local, so that it travels by value
        dim = 1

        def embed(self, texts):
            assert 0 < len(texts) <= 32
            return np.array([[len(t) * 1000 + len(texts)] for t in texts], dtype=np.float32)

    df = spark.range(500).select("id", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text")).coalesce(1)
    got = models.embed_column(Counting(), df).collect()
    assert all(r["vector"][0] // 1000 == r["id"] % 7 for r in got) and max(r["vector"][0] % 1000 for r in got) == 32
    assert models.embed_column(Counting(), df, batch_size=5).agg(F.max(F.col("vector")[0] % 1000)).first()[0] == 5


def test_models_from_the_command_line(tmp_path, monkeypatch):
    for name in ("embedder", "reranker"):
        (tmp_path / "m" / name).mkdir(parents=True)
    both = cli.providers(str(tmp_path / "m"))
    assert type(both["embedder"]) is models.OnnxEmbedder and type(both["reranker"]) is models.OnnxReranker
    monkeypatch.setenv("QUARRYLENS_MODELS", str(tmp_path / "m"))
    assert cli.providers()["embedder"].folder == str(tmp_path / "m" / "embedder")
    (tmp_path / "m" / "reranker").rmdir()
    assert type(cli.providers()["reranker"]) is models.DotReranker  # no cross-encoder: vectors rerank
    with pytest.raises(FileNotFoundError):
        cli.providers(str(tmp_path / "none"))


def test_dot_reranker():
    r = models.DotReranker(models.HashingEmbedder(64))
    scores = r.score("cat xay", ["cat xay", "gach", ""])
    assert abs(scores[0] - 1) < 1e-6 and scores[0] > scores[1] and scores[2] == 0
