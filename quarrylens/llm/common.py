"""Helpers of the operators in this folder."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import let

__all__ = ["STABLE", "let", "outside", "site_of", "without", "worker_state"]


def site_of(path: Column) -> Column:
    """Lower-case path component after `kho`; null where a path has none."""
    found = F.lower(F.regexp_extract(path, r"(?:^|[/\\])kho[/\\]+([^/\\]+)", 1))
    return F.when(found != "", found)


def worker_state(key: str, make: Callable[[], object]) -> object:
    """An object kept by a Python worker between its tasks."""
    home = sys.modules.setdefault("_quarrylens_worker", types.ModuleType("_quarrylens_worker")).__dict__
    if key not in home:
        home[key] = make()
    return home[key]


def outside(*ranges: tuple[int, int]) -> str:
    """A Java regex class of all code points but these ranges; short, as Java tries range after range."""
    return "[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


#: Blocks that are the same in NFC and in which nothing combines, but for what a user of them leaves out.
STABLE = (
    (0x00, 0x2FF), (0x1E00, 0x1EFF), (0x2002, 0x2069), (0x20A0, 0x20BF), (0x2100, 0x2125), (0x2500, 0x27BF),
    (0x3000, 0x3029), (0x4E00, 0x9FFF), (0x400, 0x481), (0xFF01, 0xFF9D), (0x1F000, 0x1FAFF),
)


def without(ranges, cut) -> list[tuple[int, int]]:
    """The ranges without the code points of cut."""
    out = []
    for a, b in ranges:
        for c in sorted(x for x in cut if a <= x <= b):
            if a < c:
                out.append((a, c - 1))
            a = c + 1
        if a <= b:
            out.append((a, b))
    return out
