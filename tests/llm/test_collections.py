"""Near duplicates, term weights, vector neighbours, tokenizing and mixing, against brute force."""

import base64
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import mixing, near_duplicates, term_weights, tokenizing, vector_neighbours


def shingle_set(text, k=3):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def edited(rng, words):
    w = list(words)
    for _ in range(rng.randint(1, 6)):
        i = rng.randrange(len(w))
        if rng.random() < 0.5:
            w[i] = f"x{rng.random()}"
        else:
            del w[i]
    return w


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for g in range(60):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 90))]
        rows += [" ".join(edited(rng, base)) for _ in range(3)] + [" ".join(base)]
    rows = [(i, f"f{i % 7}", t) for i, t in enumerate(rows)]
    rows += [(1000, "f1", rows[3][2]), (1001, "g", rows[3][2]), (1002, "g", "một hai"), (1003, "h", "một hai"), (1004, "h", None), (1005, "i", ""), (1006, "j", "một hai ba"), (1007, "k", "MỘT  hai ba")]
    nulls = [(None, "z", rows[3][2], "x"), (2000, None, rows[3][2], "x"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + nulls, "chunk_id long, file_path string, text string, sig string")
    sets = {i: (f, shingle_set(t)) for i, f, t in rows if t and len(t.split()) >= 3}
    truth = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a][0] != sets[b][0]:
                x, y = sets[a][1], sets[b][1]
                if len(x & y) / len(x | y) >= 0.6:
                    truth.add((a, b))
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(df).select("chunk_id_a", "chunk_id_b").collect()]
    assert len(got) == len(set(got)) and set(got) == truth and (1006, 1007) in truth
    assert near_duplicates.near_duplicate_pairs(df.where("false")).count() == 0
    parent = {i: i for p in truth for i in p}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in sorted(truth):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    groups = {r["chunk_id"]: r for r in near_duplicates.near_duplicate_groups(df).collect()}
    assert set(groups) >= set(parent)
    for i in parent:
        for j in parent:
            if root(i) == root(j):
                assert groups[i]["group_id"] == groups[j]["group_id"]
    assert groups[1000]["text_class"] == 3 and groups[1001]["text_class"] == 3
    assert near_duplicates.near_duplicate_groups(df.where("false")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r["v"]: r["label"] for r in near_duplicates.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_a_mass_of_copies_gives_one_row_each(spark):
    text = " ".join(f"w{i}" for i in range(30))
    files = F.concat(F.lit("f"), F.col("id").cast("string"))
    df = spark.range(3000).select(F.col("id").alias("chunk_id"), files.alias("file_path"), F.lit(text).alias("text"))
    groups = near_duplicates.near_duplicate_groups(df)
    assert groups.count() == 3000 and groups.select("group_id", "text_class").distinct().count() == 1


def test_a_mass_of_copies_is_one_text(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.range(300).select(F.col("id").alias("chunk_id"), F.lit("one file").alias("file_path"), F.lit(text).alias("text")).coalesce(1)
    sets = df.select(F.xxhash64("text").alias("t"), near_duplicates.shingles(F.col("text"), 3).alias("sh"))
    signed = near_duplicates.signatures(sets)
    assert signed.count() == 1 and near_duplicates.variants(signed).distinct().count() == 48
    assert near_duplicates.near_duplicate_pairs(df).count() == 0  # one file only


def test_the_join_shuffles_three_longs_a_variant(spark):
    """They hold more of the sketch than two longs beside the variant and the text; texts of one sketch are still paired."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(40)) for _ in range(50)]
    texts += [f"{t[:40].upper()}{t[40:]}" for t in texts] + [t.replace(" ", "  ", k) for k, t in enumerate(texts[:20], 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "t long, text string")
    signed = near_duplicates.signatures(df.select("t", near_duplicates.shingles(F.col("text"), 3).alias("sh")))
    assert [kind for _, kind in near_duplicates.variants(signed).dtypes] == ["bigint"] * 3
    got = [tuple(r) for r in near_duplicates.candidate_pairs(signed, 0.6).collect()]
    same = [" ".join(t.lower().split()) for t in texts]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert set(got) == {(a, b) for a in range(120) for b in range(a + 1, 120) if same[a] == same[b]}


def test_term_weights_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c d e. f, G".split()) for _ in range(rng.randint(0, 12))) for _ in range(80)] + [None, "", "  \u00a0", "rare rare rare rare rare", "rare b"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "chunk_id int, norm_text string, df int")
    words = {i: Counter(t.lower().split()) for i, t in enumerate(texts) if t and t.split()}
    n, avg = len(words), sum(sum(w.values()) for w in words.values()) / len(words)
    freq = Counter(t for w in words.values() for t in w)
    got = {(r["chunk_id"], r["term"]): r for r in term_weights.term_weights(df).collect()}
    assert set(got) == {(i, t) for i, w in words.items() for t in w}
    for (i, t), r in got.items():
        tf, dl = words[i][t], sum(words[i].values())
        want = math.log1p((n - freq[t] + 0.5) / (freq[t] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
        assert (r["tf"], r["df"], r["n"]) == (tf, freq[t], n) and abs(r["weight"] - want) < 1e-9
    cases = {tuple(r) for r in term_weights.distinctive_terms(df).collect()}
    assert cases == {(i, t) for i, w in words.items() for t in w if freq[t] >= 2 and (1 + math.log(w[t])) * math.log(n / freq[t]) >= 1.75 * math.log(n)}
    assert cases and term_weights.distinctive_terms(df.where("false")).count() == 0


def vectors(n=600, dim=16):
    rng = np.random.RandomState(5)
    v = rng.randn(n, dim)
    v[n // 2 :] = v[: n - n // 2] + 0.05 * rng.randn(n - n // 2, dim)
    rows = [(i, (x * (1 + i % 3)).astype("float32").tolist()) for i, x in enumerate(v)]
    return rows + [(n + i, rows[0][1]) for i in range(30)] + [(n + 50, None), (n + 51, []), (n + 52, [0.0] * dim), (n + 53, [1.0]), (n + 54, [float("nan")] * dim)]


def brute_top(rows, k=10):
    use = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    ids, m = np.array([i for i, _ in use]), np.array([v / np.linalg.norm(v) for _, v in use])
    s = np.round(m @ m.T, 12)
    return {int(i): sorted(((-s[r, c], int(ids[c])) for c in range(len(ids)) if c != r))[:k] for r, i in enumerate(ids)}


def test_neighbours(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, rows[1][1], "x"), (None, None, None)], "chunk_id long, vector array<float>, rank string")
    top = brute_top(rows)
    near = vector_neighbours.nearest_neighbours(df, visit=10_000).collect()
    got = {}
    for r in near:
        got.setdefault(r["a"], []).append((r["rank"], r["b"]))
    assert set(got) == set(top)
    hits = sum(len({b for _, b in got[a]} & {b for _, b in top[a]}) for a in top)
    assert hits >= 0.999 * 10 * len(top)
    truth = {(a, b) for a in top for s, b in top[a] if a < b and -s >= 0.9 and a in {x for _, x in top[b]}}
    pairs = [tuple(r) for r in vector_neighbours.mutual_neighbours(df).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= truth and len(pairs) >= 0.99 * len(truth)
    some = vector_neighbours.nearest_neighbours(df, queries=F.col("chunk_id") % 50 == 0, visit=200)
    asked = {r["a"] for r in some.collect()}
    assert asked == {a for a in top if a % 50 == 0}
    assert vector_neighbours.nearest_neighbours(df.where("false")).count() == 0


def test_divided_blocks_give_the_same(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "chunk_id long, vector array<float>")
    whole = {tuple(r) for r in vector_neighbours.nearest_neighbours(df, visit=40).collect()}
    monkeypatch.setattr(vector_neighbours, "BLOCK", 20)
    monkeypatch.setattr(vector_neighbours, "QUERIES", 50)
    monkeypatch.setattr(vector_neighbours, "FEW_CROWDS", 0)
    assert {tuple(r) for r in vector_neighbours.nearest_neighbours(df, visit=40).collect()} == whole
    crowd = {(r[0], r[1]) for r in whole if r[0] >= 600}
    assert {b for a, b in crowd if a == 629} == {0, *range(600, 609)}


def test_cells_come_in_order_of_distance():
    rng = np.random.RandomState(1)
    d1, d2 = rng.rand(5, 7), rng.rand(5, 7)
    for r, cells in enumerate(vector_neighbours.nearest_cells(d1, d2, 49)):
        sums = [d1[r, i] + d2[r, j] for i, j in cells]
        assert sums == sorted(sums) and len(set(cells)) == 49


VOCABULARY = Path(tokenizing.DEFAULT_VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary file here")


@needs_vocabulary
def test_ids_equal_a_public_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.read_bytes().splitlines())}
    public = tiktoken.Encoding("own", pat_str=tokenizing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    alphabet = "ab đế 1.!?\n\t\u00a0😀混'sll  \r<|endoftext|>Ω\u0301"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["", None, " ", "  ", "x" * 3000, "<|endoftext|>", "a  b", " a", "a ", "it's we'll", "\n\n\na", "thi công " * 500]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id int, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in tokenizing.encode_corpus(df, "doc_id", "text").collect()}
    want = {i: public.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert got == want
    assert {r["doc_id"]: r["n_tokens"] for r in tokenizing.count_tokens(df, "doc_id", "text").collect()} == {i: len(x) for i, x in want.items()}
    assert tokenizing.encode_corpus(df.where("false"), "doc_id", "text").count() == 0


@needs_vocabulary
def test_a_very_long_piece():
    """A megabyte without a break takes seconds, and gives the ids that merging many at once gives."""
    import time

    encoder = tokenizing.BytePairEncoder(VOCABULARY.read_bytes())
    rng = random.Random(3)
    piece = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    started = time.time()
    ids = encoder.encode([piece])[0]
    assert time.time() - started < 60
    size = {rank: len(base64.b64decode(a)) for a, rank in ((x.split()[0], int(x.split()[1])) for x in VOCABULARY.read_bytes().splitlines())}
    assert sum(size[i] for i in ids.tolist()) == len(piece)
    short = [piece[k * 700 : k * 700 + n] for k, n in enumerate((1, 2, 3, 5, 64, 65, 700))] * 5
    one = [encoder._one(p).tolist() for p in short]
    assert one == [x.tolist() for x in (next(iter(encoder._group([p], 1 << max(1, (len(p) - 1).bit_length())))) for p in short)]


def test_rates():
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 5), ("gone", 0.1, 3)]
    rates = mixing.plan_rates(targets, {"a": 1000, "b": 100, "c": 100})
    assert rates["b"] == 2.0 and "gone" not in rates
    tokens = {"a": 1000 * rates["a"], "b": 100 * rates["b"], "c": 100 * rates["c"]}
    assert all(abs(tokens[s] / sum(tokens.values()) - t / 0.9) < 1e-9 for s, t, _ in targets[:3])
    assert mixing.plan_rates(targets, {"a": 10, "b": 10}, 10**9) == {"a": 1.0, "b": 2.0}
    assert mixing.plan_rates(targets, {}) == {}


@needs_vocabulary
def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("từ" for _ in range(rng.randint(1, 60))), "ab"[i % 5 == 0]) for i in range(1500)]
    rows += [(2000, None, "a"), (2001, "", "b"), (2002, "x", "other"), (2003, "x", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, source string, copies int")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mix_sources(docs, targets)
    shares = {r["source"]: r for r in report.collect()}
    assert abs(shares["a"]["share"] - 1 / 3) < 0.01 and abs(shares["b"]["share"] - 2 / 3) < 0.01 and shares["gone"]["share"] == 0
    assert shares["b"]["most_repeats"] <= 4 and shares["a"]["most_repeats"] <= 1
    ids = [r["doc_id"] for r in drawn.collect()]
    assert len(ids) == len(set(ids)) and not set(ids) & {2000, 2001, 2002, 2003}
    texts = mixing.with_texts(drawn, docs.unionByName(docs.where("doc_id < 9"))).collect()
    text = dict((r[0], r[1]) for r in rows)
    assert sorted(r["doc_id"] for r in texts) == sorted(ids) and all(r["text"] == text[r["doc_id"]] for r in texts)
    again = {tuple(r) for r in mixing.mix_sources(docs, targets)[0].collect()}
    assert again == {tuple(r) for r in drawn.collect()}  # the same offset gives the same draw
    assert mixing.mix_sources(docs.where("false"), targets)[1].count() == 3
