"""Rows thinned out before a join, by a bit table of bounded size.

The keys of the smaller side become bits of a table of 2**bits places, made by an aggregation with map-side combining. The
table has at most 2**bits / 64 rows whatever the data, so it may be broadcast; rows whose bit is not set cannot join and are
left out before the other side is shuffled. Beyond about 2**bits keys the table fills up and lets everything through: the
join behind it then shuffles all rows, and stays right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**24 places are 262,144 rows of two numbers.
BITS = 24


def possibly_in(df: DataFrame, key: str, members: DataFrame, member_key: str | None = None, bits: int = BITS) -> DataFrame:
    """The rows of df whose key is among the members, and a few others (a share of members / 2**bits). Null keys drop out."""
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    bit = members.where(F.col(member_key or key).isNotNull()).select(place(member_key or key).alias("__place"))
    words = bit.groupBy(F.shiftright("__place", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__place & 63 as int)))").alias("__bits"))
    placed = df.where(F.col(key).isNotNull()).withColumn("__place", place(key))
    hit = placed.withColumn("__word", F.shiftright("__place", 6)).join(F.broadcast(words), "__word")
    return hit.where(F.expr("getbit(__bits, cast(__place & 63 as int)) = 1")).select(*df.columns)
