"""Encoding repair, look-alikes, repeated lines, splitting, repetition, against brute force and hand-made cases."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from quarrylens.llm import boilerplate, common, encodings, lookalikes, repetition, splitting

SCHEMA = "chunk_id long, file_path string, text string, extra string, site string"
SENTENCES = [
    "Bộ phận hồ sơ lưu trữ bản vẽ hoàn công tầng hầm.",
    "Đội thi công nền tháo dỡ kế hoạch đổ bê tông sàn.",
    "Ở lần kiểm tra thứ ba, phòng vật tư gửi trả chứng từ.",
    "Le géomètre a vérifié le procès-verbal de réception – voir annexe.",
    "The crew's remark: it’s “final” – don’t reopen.",
    "ĐÃ KÝ, MÃ HÀNG SÃI, Größe über Maß, São Paulo, § 11 Â.",
    "Поставка арматуры перенесена, €1.200 ± 5%, ống Ø36.",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, p, t, "x", "clash") for i, p, t in rows], SCHEMA)


def clean_rows(n=300):
    rng = random.Random(1)
    return [(i, f"/kho/s{i % 3}/f{i}", " ".join(rng.choice(SENTENCES) for _ in range(3))) for i in range(1, n + 1)]


def test_encodings(spark):
    rows = clean_rows()
    good = {i: t for i, _, t in rows}
    broken = {}
    for i, how in ((5, "cp1252"), (6, "mac_roman"), (7, "cp437"), (8, "cp1251"), (9, "cp850"), (10, "latin-1")):
        broken[i] = SENTENCES[1].encode().decode(how, "replace" if how == "cp1252" else "strict")
        good[i] = SENTENCES[1]
    part = SENTENCES[0] + " " + SENTENCES[1].encode().decode("latin-1")
    broken[11], good[11] = part, SENTENCES[0] + " " + SENTENCES[1]
    twice = SENTENCES[3].encode().decode("cp1252").encode().decode("cp1252")
    broken[12], good[12] = twice, SENTENCES[3]
    broken[13], good[13] = "mất ch\ufffd cái", None
    df = frame(spark, [(i, p, broken.get(i, t)) for i, p, t in rows] + [(900, None, None), (901, "/kho/s0/x", ""), (902, "x", " \n")])
    got = {r["chunk_id"]: r for r in encodings.garbled_records(df).collect()}
    assert set(got) == set(broken)
    for i in broken:
        if "\ufffd" in broken[i]:
            assert not got[i]["restored"]
        else:
            assert got[i]["restored"] and unicodedata.normalize("NFC", got[i]["text"]) == good[i], i
    assert encodings.garbled_records(df.where("false")).count() == 0


def test_fields_of_a_source_have_weights_of_their_own(spark):
    rows = clean_rows(120)
    bad = {i: SENTENCES[i % 4].encode().decode("cp1252", "replace") for i in range(1, 40)}
    df = spark.createDataFrame([(i, p, t, bad.get(i, t)) for i, p, t in rows], "chunk_id long, file_path string, title string, text string")
    got = encodings.garbled_fields(df, ["title", "text"]).collect()
    assert {(r["chunk_id"], r["field"]) for r in got} == {(i, "text") for i in bad}


def test_spelling():
    assert lookalikes.consistent("ｃôｎｇ　ty\u200b Ｎ０") == "công ty N0"
    assert lookalikes.consistent("nha\u0302\u0301t") == "nhất"
    assert lookalikes.consistent("сông tу phοng") == "công ty phong"  # mixed scripts
    assert lookalikes.consistent("Тор") == "Top"  # whole-script look-alike
    assert lookalikes.consistent("Пocтавка арматуры") == "Поставка арматуры"  # strays in a real word
    assert lookalikes.consistent("Ðội 0 O l 1 Ωm") == "Đội 0 O l 1 Ωm"
    assert lookalikes.consistent("a\r\nb\u00a0c\u2028d") == "a\nb c\nd"
    assert lookalikes.consistent("") == ""
    assert lookalikes.consistent("𝐇𝐞𝐥𝐥𝐨 ﬁle Ⅳ 𝟓 ᏢᎪᏢᎬᎡ ſ m² ①") == "Hello file IV 5 PAPER ſ m² ①"


def test_real_words_of_other_scripts_stay():
    for text in ("мой хор", "оса сосна", "Рост сосны: оса и кот", "ο Θεός", "ένα νησί", "Поставка\nхор оса"):
        assert lookalikes.consistent(text) == text
    assert lookalikes.consistent("мой xop") == "мой хор"  # Latin letters among Russian words
    assert lookalikes.consistent("công ty хор móng") == "công ty xop móng"  # and the reverse
    assert lookalikes.consistent("Поставка\nxop") == "Поставка\nхор"  # the record decides where the line cannot
    rng = random.Random(12)
    swap = {}
    for twins in lookalikes.TWINS.values():
        for c, latin in twins.items():
            swap.setdefault(latin, []).append(c)
    for text in ("Biên bản nghiệm thu móng", "мой хор и сосна", "Top cao", "ο Θεός και", "PAPER co"):
        for _ in range(200):  # every spelling of a text is settled alike
            other = "".join(rng.choice([c, *swap.get(lookalikes._TO_LATIN.get(c, c), [])]) for c in text)
            assert lookalikes.consistent(other) == lookalikes.consistent(text), other


def test_stable_blocks_need_no_normalising():
    for a, b in common.STABLE:
        for cp in range(a, b + 1):
            c = chr(cp)
            assert unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c)


def test_pairs_of_look_alikes(spark):
    rows = [(1, "a", "tên một"), (2, "b", "te\u0302n một"), (3, "c", "tên một"), (4, "d", "tên\u00a0một"), (5, "e", "Tên một"), (6, "f", None), (7, "g", " "), (8, "h", "\u00a0"), (9, "i", "tên\nmột"), (None, "j", "tên\u00a0một"), (None, None, None)]
    pairs = {tuple(r) for r in lookalikes.look_alike_pairs(frame(spark, rows)).collect()}
    assert pairs == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    out = {r["chunk_id"]: r for r in lookalikes.normalize_spelling(frame(spark, rows)).collect()}
    assert out[2]["text"] == "tên một" and out[2]["norm_text"] == "ten mot" and out[2]["changed"] and not out[1]["changed"]
    assert out[6]["text"] is None and lookalikes.look_alike_pairs(frame(spark, rows).where("false")).count() == 0


def test_many_copies_of_one_spelling(spark):
    text = F.when(F.col("id") < 50_000, "một hai").when(F.col("id") < 50_003, "một\u00a0hai").otherwise("khác")
    df = spark.range(50_010).select(F.col("id").alias("chunk_id"), text.alias("text"))
    assert lookalikes.look_alike_pairs(df).count() == 150_000


def brute_lines(rows):
    seen = {}
    for _, path, text in rows:
        m = re.search(r"(?:^|[/\\])kho[/\\]+([^/\\]+)", path or "")
        if not m or text is None:
            continue
        for line in text.split("\n"):
            form = re.sub(r"\s+", " ", re.sub("[0-9]+", "#", unicodedata.normalize("NFC", line).lower())).strip(" ")
            if form:
                seen.setdefault((m[1].lower(), form), set()).add(path)
    return {k for k, v in seen.items() if len(v) >= 5}


def test_repeated_lines(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        path = rng.choice(["/kho/CO-dien/", "D:\\kho\\co-dien\\", "/kho/b/", "/tmp/"]) + f"f{i % 60}"
        own = "riêng " + "".join(rng.choice("abcdefgh") for _ in range(8))
        text = "\n".join([own, *(rng.choice(["Trang 1/2", "Trang  7/9", "Lu\u031bu hành", "Lưu hành", "", " "]) for _ in range(4))])
        rows.append((i, path, text))
    article = "\n".join(f"bài {k}" for k in "abc")  # one article in six files is one cluster
    rows += [(300 + i, f"/kho/b/copy{i}", article) for i in range(6)] + [(400, None, "x"), (401, "/kho/b/n", None), (402, "/kho/b/f1", "Trang 3\n\u00a0"), (None, "/kho/b/f1", "Trang 4/1\ny")]
    df = frame(spark, rows + rows[:1])
    found = boilerplate.repeated_lines(df).collect()
    assert {(r["site"], r["line"]) for r in found} == brute_lines(rows)
    counts = {r["line"]: r for r in found if r["site"] == "b"}
    assert (counts["bài a"]["n_files"], counts["bài a"]["n_clusters"]) == (6, 1) and counts["trang #/#"]["n_clusters"] > 5
    cleaned = boilerplate.without_repeated_lines(df).collect()
    clean = {r["chunk_id"]: r for r in cleaned}
    assert len(cleaned) == len(rows) + 1 and clean[300]["text"] == article and not clean[300]["is_boilerplate"]  # republished, not boilerplate
    assert clean[401]["text"] is None and clean[400]["text"] == "x" and clean[None]["text"] == "y"
    for i, path, text in rows[:200]:
        keep = [x for x in text.split("\n") if "/tmp/" in path or not re.match("Trang|Lu|Lư", x)]
        assert clean[i]["text"] == "\n".join(keep) and clean[i]["n_removed"] == text.count("\n") + 1 - len(keep)
    assert boilerplate.repeated_lines(df.where("false")).count() == boilerplate.without_repeated_lines(df.where("false")).count() == 0


def test_lines_of_one_day_stay(spark):
    texts = [(i, f"/kho/{'ab'[i % 2]}/f{i}", f"thân bài {chr(97 + i)}\nChung") for i in range(12)] + [(20, "/kho/a/g", "Chung"), (21, "/kho/b/g", "Chung\n")]
    dates = spark.createDataFrame([(p, f"2024-01-0{1 + (i // 2) % 3 if '/a/' in p else 1} 10:00:00") for i, p, _ in texts] + [("/kho/a/f0", None)], "file_path string, published string")
    clean = {r["chunk_id"]: r for r in boilerplate.without_repeated_lines(frame(spark, texts), dates).collect()}
    assert clean[0]["text"] == "thân bài a" and clean[1]["text"] == "thân bài b\nChung"  # of one day only: an article of many parts
    assert clean[20]["is_boilerplate"] and clean[20]["text"] == "" and not clean[21]["is_boilerplate"]
    unknown = {r["chunk_id"]: r for r in boilerplate.without_repeated_lines(frame(spark, texts), dates.where("false")).collect()}
    assert unknown[1]["text"] == "thân bài b" and unknown[21]["is_boilerplate"]


def test_splitting(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join("từ" * rng.randint(1, 4) for _ in range(rng.randint(3, 20))).capitalize() + ". "
    texts = ["".join(sentence() for _ in range(40)), "x" * 1500, " \u00a0" + "a b" * 300 + "\n", "đoạn. " * 60 + "\n\n" + "câu " * 200, "e\u0301" * 700, "│ ─ " * 300, "short", "", None, "y" * 512, "z" * 513, "😀" * 600]
    df = spark.createDataFrame([(i, t, None if i == 3 else 100 * i, "c") for i, t in enumerate(texts)], "chunk_id int, text string, chunk_offset int, piece string")
    got = {}
    for r in splitting.split_oversized(df).orderBy("chunk_id", "piece_no").collect():
        got.setdefault(r["chunk_id"], []).append(r)
    assert set(got) == {i for i, t in enumerate(texts) if t and len(t.strip()) > 512}
    for i, pieces in got.items():
        body = texts[i].strip()
        lead = len(texts[i]) - len(texts[i].lstrip())
        whole = pieces[0]["piece"]
        for a, b in zip(pieces, pieces[1:]):
            assert b["piece"].startswith(a["piece"][-64:])
            whole += b["piece"][64:]
        assert whole == body
        for p in pieces:
            assert len(p["piece"]) <= 512
            assert texts[i][p["text_offset"] : p["text_offset"] + len(p["piece"])] == p["piece"]
            assert p["piece_offset"] == (None if i == 3 else 100 * i + p["text_offset"])
        assert pieces[0]["text_offset"] == lead
        assert {p["cut_kind"] for p in pieces} == {"forced" if re.search(r"[^\W_]{513}", body) else "natural"}
    assert all(p["piece"].rstrip()[-1] == "." for p in got[0][:-1])
    assert got[3][0]["piece"].endswith("\n\n")


def brute_share(text):
    w = text.lower().split()
    if not w:
        return None
    first, hit = {}, set()
    for i in range(len(w) - 7):
        k = tuple(w[i : i + 8])
        if k in first:
            hit.update(range(i, i + 8))
        first.setdefault(k, i)
    return len(hit) / len(w)


def test_repetition(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 7, 8, 9, 20, 40, 80)] + ["w " * 50, "Một hai ba bốn năm sáu bảy tám. " * 5, "", "  ", "a\u00a0b\u3000" * 20]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(99, None, "x")], "doc_id int, text string, n_words string")
    got = {r["doc_id"]: r for r in repetition.repetition_report(df).collect()}
    for i, t in enumerate(texts):
        want = brute_share(t)
        assert (got[i]["repeated_share"] is None) if want is None else abs(got[i]["repeated_share"] - want) < 1e-12
    assert got[99]["repeated_share"] is None and got[99]["failed"] == []
    bad = {r["doc_id"] for r in repetition.documents_failing(df, "repeated_runs").collect()}
    assert bad == {i for i, t in enumerate(texts) if (brute_share(t) or 0) >= 0.3}
    assert "repeated_runs" in got[8]["failed"]


def test_nothing_leaves_the_projection(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    plan = repetition.repetition_report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
