import io
import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quarrylens.__main__ import main, serve
from quarrylens.operators.engine import Config, Engine, IndexOptions
from quarrylens.sources import listing, readers
from quarrylens.sources.store import ChunkStore
from quarrylens.streaming.watcher import watch_folder

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def docx(*paragraphs):
    b = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return b.getvalue()


def xlsx():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="A" r:id="r1"/><sheet name="B" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/gone.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{S}"><si><t>thép</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{S}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>12</v></c></row><row/></sheetData></worksheet>')
    return b.getvalue()


def test_office_files():
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in ("ab", "cd")) + "</w:tbl>"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>một</w:t><w:tab/><w:t>&amp; hai</w:t></w:r></w:p><w:p/>{table}<w:sectPr/></w:body></w:document>')
    assert readers.extract("x.DOCX", b.getvalue()) == ("một\t& hai\n\na\tb\nc\td\n", None)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        sheets = "".join(f'<sheet name="S{i}" r:id="r{i}"/>' for i in range(4))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" * (i == 3)}worksheets/s{i}.xml"/>' for i in range(4)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{S}"><si><r><t>xi </t></r><r><t>măng</t></r></si></sst>')
        row = lambda cells: f'<worksheet xmlns="{S}"><sheetData><row>{cells}</row></sheetData></worksheet>'
        z.writestr("xl/worksheets/s0.xml", row('<c r="B1" t="s"><v>0</v></c><c r="D1" t="inlineStr"><is><t>bao</t></is></c>'))
        z.writestr("xl/worksheets/s1.xml", "not xml")
        z.writestr("xl/worksheets/s2.xml", row('<c r="A1" t="s"><v>7</v></c>'))  # no such string: a bad sheet
        z.writestr("xl/worksheets/s3.xml", row('<c r="A1"><v>1.5</v></c><c r="AB1"><v>2</v></c>'))
    assert readers.extract("x.xlsx", b.getvalue()) == ("\txi măng\t\tbao\n1.5" + "\t" * 27 + "2\n", None)


def test_office_files_become_chunks(spark, tmp_path):
    (tmp_path / "kho").mkdir()
    (tmp_path / "kho" / "a.docx").write_bytes(docx("Biên bản", "nghiệm thu"))
    (tmp_path / "kho" / "b.XLSX").write_bytes(xlsx())
    engine = Engine(spark, Config(str(tmp_path / "index")))
    assert engine.index(str(tmp_path / "kho")) == {"files": 2, "skipped": 0, "chunks": 2}
    assert sorted(r["text"] for r in engine.store.chunks().collect()) == ["Biên bản\nnghiệm thu", "thép\t\t12"]
    binary = spark.read.format("binaryFile").load(str(tmp_path / "kho" / "a.docx"))
    assert [tuple(r) for r in readers.read_binary(binary).collect()] == [(str(tmp_path / "kho" / "a.docx"), "Biên bản\nnghiệm thu\n", None)]


def test_npy(tmp_path):
    import numpy as np

    np.save(tmp_path / "v.npy", np.arange(6, dtype="<f4").reshape(2, 3))
    np.save(tmp_path / "w.npy", np.arange(3))
    assert readers.load_npy(str(tmp_path / "v.npy")).tolist() == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(ValueError):
        readers.load_npy(str(tmp_path / "w.npy"))


def test_readers():
    assert readers.extract("a.TXT", "chào".encode()) == ("chào", None)
    assert readers.extract("a.docx", docx("một", "hai")) == ("một\nhai\n", None)
    assert readers.extract("a.xlsx", xlsx()) == ("thép\t\t12\n", None)
    for name, content in (("a.pdf", b"no pdf"), ("a.docx", b"x"), ("a.exe", b"")):
        text, error = readers.extract(name, content)
        assert text is None and error


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "kho"
    (root / "bien-ban").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "bien-ban" / "nghiệm thu (1).txt").write_text("Biên bản nghiệm thu móng khối nhà A.")
    (root / "_báo giá.md").write_text("Báo giá vật tư điện nước tầng hai.")
    (root / "empty.txt").write_text("")
    (root / "bad.docx").write_bytes(b"\0\1")
    (root / "x.bin").write_bytes(b"1")
    (root / ".dot.txt").write_text("hidden")
    (root / ".hidden" / "y.txt").write_text("hidden")
    return root


def test_listing(spark, tree):
    names = {r["path"].rsplit("/", 1)[1] for r in listing.list_files(spark, str(tree)).collect()}
    assert names == {"nghiệm thu (1).txt", "_báo giá.md", "empty.txt", "bad.docx"}
    spread = listing.list_files(spark, str(tree), spread=True).select("path", "length", "modified_at").collect()
    assert sorted(spread) == sorted(listing.list_files(spark, str(tree)).select("path", "length", "modified_at").collect())
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, str(tree / "gone"))
    files = listing.list_files(spark, str(tree))
    assert listing.only_extensions(files, ["MD"]).count() == 1
    assert listing.max_bytes(files, 1).count() == 1


def test_safe_trees(tmp_path):
    for p in ("a/b", "a/node_modules", "c/d", "e/.git", "primary"):
        (tmp_path / p).mkdir(parents=True)
    assert listing.safe_trees(str(tmp_path), str(tmp_path / "primary")) == [str(tmp_path / "a/b"), str(tmp_path / "c")]


def test_index_search_and_replace(spark, tree, tmp_path):
    engine = Engine(spark, Config(str(tmp_path / "index")))
    assert engine.answer("gì") == {"exact": [], "suggest": []}
    counts = engine.index(str(tree))
    assert counts == {"files": 3, "skipped": 1, "chunks": 2}
    assert [r["chunk_id"] for r in engine.store.chunks().orderBy("chunk_id").collect()] == [1, 2]
    found = engine.answer("biên bản nghiệm thu")
    assert found["exact"][0]["filePath"].endswith("nghiệm thu (1).txt")
    assert engine.search("báo giá", 1).first()["file_path"].endswith("_báo giá.md")
    engine.index(str(tree))
    assert engine.store.count() == 4  # appending keeps the old rows
    engine.index(str(tree), IndexOptions(replace=True))
    assert engine.store.count() == 2
    engine.store.compact()
    assert engine.store.count() == 2
    engine.index(str(tree))
    engine.index(str(tree), IndexOptions(replace=True))
    engine.store.compact()
    assert engine.status() == {"chunks": 2, "files": 2}
    assert [r["dir"] for r in engine.store.indexed_dirs().collect()] == [str(tree)]
    assert engine.store.get_chunk(engine.store.max_id())["text"]
    with pytest.raises(KeyError):
        engine.store.get_chunk(10**9)
    engine.register("bien-ban", ["nghiệm thu"])
    assert engine.search_ranked("nghiệm thu").count() == 2
    assert engine.reindex_all([str(tree)])["chunks"] == 2
    engine.reset()
    assert engine.store.count() == 0


def test_a_prepared_index_finds_the_same(spark, tree, tmp_path):
    for diff in (False, True):
        engine = Engine(spark, Config(str(tmp_path / f"index{diff}"), diff_embed=diff))
        engine.index(str(tree))
        queries = ("biên bản nghiệm thu", "báo giá", "gì", "")
        plain = [(engine.search(q, 3).collect(), engine.search_ranked(q).collect()) for q in queries]
        where = engine.prepare()
        assert where == engine.prepare() and [(engine.search(q, 3).collect(), engine.search_ranked(q).collect()) for q in queries] == plain
        (tree / f"später{diff}.txt").write_text("Mới: biên bản.")
        engine.index(str(tree), IndexOptions(replace=True))  # an index of an older store is not used
        assert any("Mới" in r["text"] for r in engine.search("biên bản", 5).collect())
        assert engine.prepare() != where and any("Mới" in r["text"] for r in engine.search("biên bản", 5).collect())
        engine.config.int8 = True
        assert engine.search("báo giá", 1).first()["file_path"].endswith("_báo giá.md")


def test_the_right_file_heads_the_exact_bucket(spark, tmp_path):
    folder = tmp_path / "kho"
    folder.mkdir()
    (folder / "a.txt").write_text("Biên bản nghiệm thu công việc đổ bê tông móng nhà kho")
    (folder / "b.txt").write_text("Bảng giá thép và xi măng tháng này cho nhà kho")
    (folder / "c.txt").write_text("Hợp đồng thuê cẩu tháp giữa hai bên")
    engine = Engine(spark, Config(str(tmp_path / "index")))
    engine.index(str(folder))
    found = engine.answer("biên bản nghiệm thu bê tông")
    assert found["exact"][0]["filePath"].endswith("a.txt")
    assert not any(r["filePath"].endswith("c.txt") for r in found["exact"])


def test_a_failed_write_changes_nothing(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "chunk_id long, file_path string, text string")
    store.append(rows)
    before, state = store.chunks().collect(), store.state()
    broken = rows.select(F.raise_error(F.lit("broken")).cast("long").alias("chunk_id"), "file_path", "text")
    for write in (lambda: store.append(broken), lambda: store.replace_files(broken), lambda: store.replace_files(rows, broken.select(F.col("chunk_id").cast("string").alias("file_path")))):
        with pytest.raises(Exception, match="broken"):
            write()
        assert store.state() == state and store.chunks().collect() == before
    late = store.log()
    store.append(rows)
    monkeypatch.setattr(store, "_whole_log", iter([late, late + [store.log()[-1]]]).__next__)
    with pytest.raises(RuntimeError, match="another writer"):
        store.append(rows)
    assert ChunkStore(spark, store.path).count() == 4


def test_readers_of_a_store_outlive_a_compaction(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "chunk_id long, file_path string, text string")
    store.append(rows)
    store.replace_files(rows.where("chunk_id = 2").withColumn("text", F.lit("z")))
    reader = store.chunks().select("chunk_id", "text").orderBy("chunk_id")
    store.compact()
    assert [tuple(r) for r in reader.collect()] == [(1, "x"), (2, "z")] == [tuple(r) for r in store.chunks().select("chunk_id", "text").orderBy("chunk_id").collect()]
    store.append(rows)
    store.compact()
    assert store.count() == 4 and len(store.log()) == 1


def test_throttle(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}.txt").write_text(f"Tài liệu mẫu số {i} của công trường")

    def took(options):
        started = time.time()
        assert Engine(spark, Config(str(tmp_path / f".index{options.pause_seconds}"))).index(str(tmp_path), options)["chunks"] == 6
        return time.time() - started

    took(IndexOptions(workers=1))
    assert took(IndexOptions(workers=1, batch_size=2, pause_seconds=1.5)) > took(IndexOptions(workers=1, batch_size=2)) + 0.5


def test_searches_at_once_and_a_large_file(spark, tree, tmp_path):
    (tree / "large.txt").write_text("Nhật ký đổ bê tông sàn tầng bốn. " * 5000)
    for i in range(15):
        (tree / f"same{i}.txt").write_text("Mười lăm tệp giống nhau.")
    engine = Engine(spark, Config(str(tmp_path / "index")))
    engine.index(str(tree))
    engine.prepare()
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda i: engine.answer("nhật ký bê tông" if i % 2 else "mười lăm tệp"), range(8)))
    assert all(x["exact"] for x in found) and found[0]["exact"] == found[2]["exact"]


def test_odd_queries(spark, tree, tmp_path):
    engine = Engine(spark, Config(str(tmp_path / "index")))
    engine.index(str(tree))
    for q in (" ", "x" * 4500, "!@#$%", "混凝土", "\t\n", "è à ü"):
        assert set(engine.answer(q)) == {"exact", "suggest"}


def test_watcher(spark, tree, tmp_path):
    engine = Engine(spark, Config(str(tmp_path / "index")))

    def watch():
        query = watch_folder(engine, str(tree), every="1 second")
        query.processAllAvailable()
        query.stop()
        return sorted(r["text"] for r in engine.store.chunks().collect())

    assert len(watch()) == 2
    (tree / "new.txt").write_text("Nhật ký thi công.")
    (tree / "_báo giá.md").write_text("Báo giá mới.")
    assert watch() == ["Biên bản nghiệm thu móng khối nhà A.", "Báo giá mới.", "Nhật ký thi công."]


def test_http(spark, tree, tmp_path):
    engine = Engine(spark, Config(str(tmp_path / "index")))
    engine.index(str(tree))
    server = serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda p: json.load(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}", timeout=60))
    assert get("/api/health") == {"ok": True}
    assert get("/api/search?q=") == {"exact": [], "suggest": []}
    assert get("/api/search?q=" + urllib.parse.quote("báo giá"))["exact"]
    assert get("/api/folders") == [str(tree)]

    def post(path, **body):
        url = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode(), method="POST")
        try:
            return json.load(urllib.request.urlopen(url, timeout=60))["status"]
        except urllib.error.HTTPError as e:
            return e.code

    def settled():
        for _ in range(600):
            status = get("/api/status")
            if not status["indexing"]:
                return status
            time.sleep(0.2)

    (tmp_path / "home" / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "home" / "cache").mkdir()
    (tmp_path / "home" / "docs" / "sub" / "n.txt").write_text("Nhật ký công trường.")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "m.txt").write_text("Biên bản họp.")
    assert post("/api/index", dir=str(tmp_path / "more")) == "started"
    assert post("/api/index", dir=str(tmp_path / "more")) == 409  # one at a time
    assert settled() == {"chunks": 3, "files": 3, "indexing": False}
    assert post("/api/onboard", dir=str(tmp_path / "more"), home=str(tmp_path / "home")) == "started"
    assert settled()["files"] == 4 and str(tmp_path / "home" / "docs") in get("/api/folders")
    assert post("/api/nothing") == 404
    server.shutdown()


def test_command_line(spark, tree, tmp_path, capsys):
    def run(*args):
        main(["--index", str(tmp_path / "index"), *args])
        return capsys.readouterr().out

    assert json.loads(run("index", str(tree))) == {"files": 3, "skipped": 1, "chunks": 2}
    assert json.loads(run("status")) == {"chunks": 2, "files": 2} and run("folders").strip() == str(tree)
    shown = run("search", "biên bản nghiệm thu")
    assert shown.startswith("exact\n") and "nghiệm thu (1).txt" in shown.split("suggest")[0]
    run("reset")
    assert json.loads(run("status")) == {"chunks": 0, "files": 0}
