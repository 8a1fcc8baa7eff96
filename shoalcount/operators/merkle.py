"""Digests of ordered or unordered tables as trees of hashes.

A node is the SHA-256 of its children's numbers and digests in order; it has at most 1024
children. Four levels hold 2^40 leaves, so no array grows with the table, and nothing but
digests is shuffled above the first level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.functions.hashing import hash32

FAN_BITS = 10


def _node() -> Column:
    children = F.array_sort(F.collect_list(F.struct("at", "digest")))
    return F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws("=", c["at"].cast("string"), c["digest"])), ","), 256).alias("digest")


def ordered_digest(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, digest) over leaves (keys, at, digest), numbered by ``at`` (a whole number, unique per key).

    One shuffle serves the two lower levels.
    """
    up = lambda c: F.shiftright(c, FAN_BITS)
    low = leaves.withColumns({"b1": up(F.col("at")), "b2": up(up(F.col("at")))}).repartition(*keys, "b2")
    low = low.groupBy(*keys, "b2", "b1").agg(_node()).withColumnRenamed("b1", "at")
    high = low.groupBy(*keys, "b2").agg(_node()).withColumnRenamed("b2", "at")
    high = high.groupBy(*keys, up(F.col("at")).alias("b3")).agg(_node()).withColumnRenamed("b3", "at")
    return high.groupBy(*keys).agg(_node())


def table_digest(rows: DataFrame, key: Column) -> DataFrame:
    """One row (content_sha256, rows) for the rows of a table in any order.

    Rows are numbered by the top 30 bits of their key's hash; rows of one number, hardly ever
    more than a few, go by key and content. Repeated rows are counted before they meet.
    """
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    counted = rows.select(F.coalesce(key, F.lit("")).alias("k"), F.sha2(text, 256).alias("h")).groupBy("k", "h").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("k", "h", "n")))
    line = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["h"], e["n"].cast("string"))), ",")
    leaves = counted.groupBy(F.shiftright(hash32(F.col("k")), 2).alias("at")).agg(F.sha2(line, 256).alias("digest"), F.sum("n").alias("n"))
    whole = ordered_digest(leaves.select(F.lit(0).alias("t"), "at", "digest"), ["t"]).select(F.col("digest").alias("content_sha256"))
    total = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    empty = F.coalesce(F.first("content_sha256"), F.sha2(F.lit(""), 256)).alias("content_sha256")
    return whole.agg(empty).join(F.broadcast(total))  # one row by one row
