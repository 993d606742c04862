"""Binding a value within an expression.

Catalyst may copy an expression to every place that refers to its alias: into filters it pushes down, and into lambdas,
where the copy runs once an element. A lambda's variable is evaluated once, and the output of a generator is never copied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once a row and use it in body, within one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sum(sizes: Column, block: int = 1000) -> Column:
    """array of the sums of all entries before each entry. An array grows by copying, so long ones are summed by blocks."""

    def heads(values: Column, size: Callable[[Column], Column]) -> Column:
        add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + size(x)))
        return F.aggregate(values, F.array(F.lit(0)), add)

    def inner(parts: Column) -> Column:
        starts = lambda at: F.transform(parts, lambda p, i: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + F.get(at, i)))
        return F.flatten(let(heads(parts, lambda p: F.element_at(p, -1)), starts))

    parts = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int")), lambda i: heads(F.slice(s, i * block + 1, block), lambda x: x))
    return F.when(F.size(sizes) > 0, let(sizes, lambda s: let(parts(s), inner))).when(F.size(sizes) == 0, F.array().cast("array<int>"))


def select_once(df: DataFrame, keep: list, made: Column) -> DataFrame:
    """The kept columns and the fields of a struct, which is built once a row whatever refers to its fields later."""
    return df.select(*keep, F.inline(F.array(made)))
