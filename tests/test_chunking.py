import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarrylens.operators import chunking


def ld(c):
    return unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"


def brute(text, size):
    """Segmentation by looking at every position."""
    size, out, start = max(1, size), [], 0

    def word(i):
        return i in (0, len(text)) or not (ld(text[i - 1]) and ld(text[i]))

    def sentence(i):
        return text[i - 1] in "\r\n" or (text[i - 1] in ".!?" and (i == len(text) or not ld(text[i])))

    while start < len(text):
        end = len(text)
        if end - start > size:
            stop = start + size
            ends = [i for i in range(start + max(size // 2, 1), stop + 1) if sentence(i)]
            ends = ends or [i for i in range(start + 1, stop + 1) if word(i)]
            end = ends[-1] if ends else next(i for i in range(stop, len(text) + 1) if word(i))
        seg = text[start:end]
        body = re.sub(r"^\s+|\s+$", "", seg)
        if body:
            out.append((start + len(seg) - len(seg.lstrip()), body))
        start = end
    return out


def run(spark, texts, size):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {i: [] for i in range(len(texts))}
    for r in chunking.chunk_documents(df, "id", size=size).collect():
        got[r["id"]].append((r["chunk_offset"], r["text"]))
    return [sorted(v) for v in got.values()]


TEXTS = ["", "   ", "short", "One. Two! Three? " * 50, "x" * 1300, "a b\nc\n\n" * 90, "Ở lần kiểm tra. 😀 " * 60, "1.200 kg, 3.5 m. " * 40, "e\u0301tude " * 100]


@pytest.mark.parametrize("size", [0, 1, 2, 7, 64, 512])
def test_equals_brute_force(spark, size):
    assert run(spark, TEXTS, size) == [brute(t, size) for t in TEXTS]


def test_null_gives_nothing(spark):
    assert chunking.chunk_documents(spark.createDataFrame([(1, None)], "id int, text string"), "id").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab đ1.!?\n\u00a0,", max_size=300), min_size=1, max_size=10))
def test_random_texts(spark, texts):
    assert run(spark, texts, 20) == [brute(t, 20) for t in texts]


def test_ids_follow_path_and_offset(spark):
    rows = [(p, o) for p in ("b", "a", "c") for o in (5, 0, 9)]
    df = spark.createDataFrame(rows, "file_path string, chunk_offset int").repartition(3)
    got = {(r["file_path"], r["chunk_offset"]): r["chunk_id"] for r in chunking.assign_ids(df, base=10).collect()}
    assert got == {x: 11 + i for i, x in enumerate(sorted(rows))}


def test_running_text_is_kept(spark):
    text = "Sentence number one. " * 200
    whole = run(spark, [text], 512)[0]
    assert all(text[o : o + len(t)] == t and len(t) <= 512 for o, t in whole) and len(whole) > 2
