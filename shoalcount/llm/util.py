"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.session import materialize

#: A side of a join is broadcast only when it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """The text with A-Z lower-cased and everything else untouched; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def hinted(stored: DataFrame) -> DataFrame:
    """The stored table, marked for broadcast if it was counted to be small; else as it is."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def without(rows: DataFrame, marks: DataFrame, **keys: Column) -> DataFrame:
    """Rows whose key is not among the ``marks`` (a stored table with one column per key).

    Keys are compared null-safe, so a null is a value like any other.
    """
    marks = hinted(marks).select(*[F.col(k).alias(f"__mark_{k}") for k in keys])
    on = [value.eqNullSafe(F.col(f"__mark_{k}")) for k, value in keys.items()]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return rows.join(marks, cond, "left_anti")


def blocked(docs: DataFrame, columns: dict[str, Column], rows: int) -> DataFrame:
    """``columns`` of the documents and ``block``, a number shared by up to ``rows`` neighbours in a file.

    The block follows from a row's place in its file, so each scan gives the same, however
    the files are split. Documents that do not come straight from files are stored first.
    """
    place = (F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / rows))
    wanted = [c.alias(name) for name, c in columns.items()]
    if "_metadata" not in docs.columns:
        try:
            return docs.select(*wanted, F.xxhash64(*place).alias("block"))
        except AnalysisException:  # not a file scan
            pass
    stored = materialize(docs.select(*wanted))
    return stored.select(*columns, F.xxhash64(*place).alias("block"))
