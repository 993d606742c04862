"""Text extraction: one reader for each extension, run by the executors over file contents.

A file that cannot be read gives a null text and an error message, never a failed job.
"""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PDF_SECONDS = 30
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_text(content: bytes) -> str:
    """The whole file; invalid UTF-8 becomes replacement characters."""
    return content.decode("utf-8", "replace")


def read_docx(content: bytes) -> str:
    """Each block of the body (paragraphs, and the cells of tables in reading order) and a line end."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            out.append(_paragraph(block) + "\n")
        elif block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                cells = ["\n".join(_paragraph(p) for p in c.iter(f"{_W}p")) for c in row.iter(f"{_W}tc")]
                out.append("\t".join(cells) + "\n")
    return "".join(out)


def _paragraph(p) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(e.text or "" if e.tag == f"{_W}t" else marks.get(e.tag, "") for e in p.iter())


def read_xlsx(content: bytes) -> str:
    """Sheet by sheet, each row that is not empty: its cells joined by tabs and a line end. A bad sheet is skipped."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = (targets.get(sheet.get(f"{_R}id")) or "").lstrip("/")
            try:
                root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else "xl/" + target))
                rows = [_row(row, shared) for row in root.iter(f"{_S}row")]
            except (KeyError, IndexError, ValueError, ElementTree.ParseError):
                continue
            out += ["\t".join(cells) + "\n" for cells in rows if cells]
    return "".join(out)


def _row(row, shared: list[str]) -> list[str]:
    cells: list[str] = []
    for c in row.iter(f"{_S}c"):
        letters = "".join(x for x in c.get("r", "") if x.isalpha())
        column = 0
        for x in letters:
            column = column * 26 + ord(x) - 64
        cells += [""] * (column - 1 - len(cells))
        value = c.findtext(f"{_S}v") or ""
        if c.get("t") == "s":
            value = shared[int(value)]
        elif c.get("t") == "inlineStr":
            value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
        cells.append(value)
    while cells and not cells[-1]:
        cells.pop()
    return cells


def read_pdf(content: bytes) -> str:
    """Through pdftotext; where it is not installed, through pypdf if that is. A failure of pdftotext is an error."""
    if shutil.which("pdftotext"):
        with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
            f.write(content)
            f.flush()
            run = subprocess.run(["pdftotext", "-enc", "UTF-8", f.name, "-"], capture_output=True, timeout=PDF_SECONDS)
        if run.returncode:
            raise ValueError(run.stderr.decode("utf-8", "replace").strip() or "pdftotext failed")
        return run.stdout.decode("utf-8", "replace")
    try:
        import pypdf
    except ImportError:
        raise ValueError("no PDF reader is installed") from None
    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages)


READERS: dict[str, Callable[[bytes], str]] = {".txt": read_text, ".md": read_text, ".docx": read_docx, ".xlsx": read_xlsx, ".pdf": read_pdf}


def extract(path: str, content: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file, by its extension in any case."""
    reader = READERS.get(os.path.splitext(path)[1].lower())
    if reader is None:
        return None, "no reader for this extension"
    try:
        return reader(content), None
    except Exception as e:  # a file may be broken in any way
        return None, f"{type(e).__name__}: {e}"


def read_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, text, error) of every file of a listing, read where the executors run (a shared file system)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    with open(path, "rb") as f:
                        rows.append((path, *extract(path, f.read())))
                except OSError as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select(F.col(path_col).alias("path")).mapInPandas(run, "path string, text string, error string")


def read_binary(binary: DataFrame) -> DataFrame:
    """(path, text, error) of Spark's binaryFile rows (path, content), on any file system Spark can reach."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [(p, *extract(p, bytes(c))) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    clean = F.regexp_replace("path", "^file:/+", "/")
    return binary.select(clean.alias("path"), "content").mapInPandas(run, "path string, text string, error string")


def load_npy(path: str):
    """Vectors of an .npy file of little-endian float32, one or two dimensions."""
    import numpy as np

    a = np.load(path, allow_pickle=False)
    if a.dtype != np.dtype("<f4") or a.ndim not in (1, 2):
        raise ValueError("float32 of one or two dimensions expected")
    return a
