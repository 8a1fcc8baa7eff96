"""Ranks, running totals and look-backs that survive one huge group.

A plain window puts a whole group into one task. Here the order is cut into ``bucket``s that
never decrease along it: the window runs inside (keys, bucket), and a second, much smaller
window carries bucket summaries across. The result is the same as the plain window's.

Each helper evaluates its input twice (rows and bucket summaries), so pass a scan or a stored
table, not the end of a long plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalcount.session import materialize

_B = "__bucket"


def _inner(keys: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*keys, _B).orderBy(*order)


def _outer(keys: Sequence[str]):
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy(_B)


def _attach(df: DataFrame, keys: Sequence[str], summary: DataFrame) -> DataFrame:
    return df.join(summary, [*keys, _B], "left")


def position(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """0-based position inside each key group."""
    df = df.withColumn(_B, bucket)
    sizes = df.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(_outer(keys).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, _B, F.coalesce(before, F.lit(0)).alias("__offset"))
    ranked = df.withColumn("__r", F.row_number().over(_inner(keys, order)))
    out = _attach(ranked, keys, offsets)
    return out.withColumn(name, F.col("__offset") + F.col("__r") - 1).drop("__offset", "__r", _B)


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    value: Column,
    name: str,
    fn: str = "sum",
    exclusive: bool = False,
) -> DataFrame:
    """Running sum or maximum in order; ``exclusive`` leaves the row itself out."""
    agg = {"sum": F.sum, "max": F.max}[fn]
    df = df.withColumn(_B, bucket).withColumn("__v", value)
    frame = (Window.unboundedPreceding, -1 if exclusive else 0)
    totals = df.groupBy(*keys, _B).agg(agg("__v").alias("__t"))
    prior = agg("__t").over(_outer(keys).rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(*keys, _B, prior.alias("__c"))
    local = df.withColumn("__l", agg("__v").over(_inner(keys, order).rowsBetween(*frame)))
    out = _attach(local, keys, carried)
    if fn == "sum":
        both = F.when(F.col("__l").isNull(), F.col("__c")).when(
            F.col("__c").isNull(), F.col("__l")
        ).otherwise(F.col("__l") + F.col("__c"))
    else:
        both = F.greatest("__l", "__c")
    return out.withColumn(name, both).drop(_B, "__v", "__l", "__c")


def previous(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    values: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """The preceding row's ``values`` (null on the first row of a key group)."""
    df = df.withColumn(_B, bucket)
    packed = F.struct(*values)
    last = df.groupBy(*keys, _B).agg(F.max_by(packed, F.struct(*order)).alias("__last"))
    carried = last.select(*keys, _B, F.lag("__last").over(_outer(keys)).alias("__c"))
    local = df.withColumn("__l", F.lag(packed).over(_inner(keys, order)))
    out = _attach(local, keys, carried).withColumn("__p", F.coalesce("__l", "__c"))
    for v in values:
        out = out.withColumn(prefix + v, F.col(f"__p.{v}"))
    return out.drop(_B, "__l", "__c", "__p")


def islands(
    df: DataFrame, keys: Sequence[str], index: str, bucket_size: int = 1024, gap: int = 1
) -> DataFrame:
    """Runs of integers at most ``gap`` apart: one row (keys, start, stop inclusive, n) per run.

    Rows must be distinct per (keys, index).
    """
    bucket = F.floor(F.col(index) / F.lit(bucket_size))
    order = [F.col(index)]
    marked = previous(df.select(*keys, index), keys, bucket, order, [index]).withColumn(
        "__new",
        F.when(F.col(f"prev_{index}").isNull() | (F.col(index) - F.col(f"prev_{index}") > gap), 1).otherwise(0),
    )
    tagged = running(marked, keys, bucket, order, F.col("__new"), "__run")
    return tagged.groupBy(*keys, "__run").agg(
        F.min(index).alias("start"), F.max(index).alias("stop"), F.count(F.lit(1)).alias("n")
    ).drop("__run")


def global_running_sum(
    df: DataFrame, order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Running sum over one total order of the whole table.

    The rows are range-partitioned on the (unique) order, so ties cannot pile up in one task.
    The checkpoint fixes the partition of every row before the offsets are computed.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__v", value).repartitionByRange(n, *order)
    fixed = materialize(ranged.withColumn(_B, F.spark_partition_id()))
    return running(fixed, [], F.col(_B), order, F.col("__v"), name).drop("__v")


def segment_starts(df: DataFrame, keys: Sequence[str], index: str, gap: Column | int, bucket_size: int = 1024) -> DataFrame:
    """Distinct (keys, index) with ``segment``: the first index of its run of gaps <= ``gap``."""
    points = materialize(df.select(*keys, index).distinct())
    bucket, order = F.floor(F.col(index) / bucket_size), [F.col(index)]
    p = previous(points, keys, bucket, order, [index])
    fresh = F.col(f"prev_{index}").isNull() | (F.col(index) - F.col(f"prev_{index}") > F.lit(gap))
    return running(p, keys, bucket, order, F.when(fresh, F.col(index)), "segment", fn="max").select(*keys, index, "segment")
