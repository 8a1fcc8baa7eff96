"""Exact quantiles per group, without holding a group.

A wanted rank lies in a range of values, at first the group's smallest to largest. The rows of
the range are counted in 1024 equal parts, and the part that holds the rank, shrunk to the
values in it, is the next range. Small ranges are sorted, ranges of one value need no more.
Groups of any size and shape end after few rounds; all groups go through them together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalcount.session import materialize, materialize_counted

#: Parts a range is counted in; rows of a range that are sorted.
PARTS, SORTED = 1024, 4096


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """(keys, one column per wanted fraction), interpolated linearly between ranks. Nulls and NaN are left out."""
    keys = list(keys)
    v = F.col(value).cast("double")
    held = materialize(rows.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("v")))
    sizes = materialize(held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    places = {name: F.lit(float(f)) * (F.col("n") - 1) for name, f in wanted.items()}
    ranks = F.array_distinct(F.array(*[r(p).cast("bigint") for p in places.values() for r in (F.floor, F.ceil)]))
    live = sizes.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("bigint").alias("before"), F.col("n").alias("m"))
    live, large = materialize_counted(live, _large())
    while large:
        spans = live.where(_large()).select(*keys, "lo", "hi", "before").distinct()
        inside = held.join(spans, keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
        # halves first: the distance of two doubles may not be a double
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS), F.lit(PARTS - 1))
        found = inside.groupBy(*keys, "lo", "hi", "before", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = Window.partitionBy(*keys, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS rows
        found = found.withColumn("start", F.col("before") + F.coalesce(F.sum("c").over(w), F.lit(0))).drop("before", "part")
        next_ = live.where(_large()).join(found, [*keys, "lo", "hi"]).where((F.col("start") <= F.col("rank")) & (F.col("rank") < F.col("start") + F.col("c")))
        next_ = next_.select(*keys, "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("start").alias("before"), F.col("c").alias("m"))
        live, large = materialize_counted(live.where(~_large()).unionByName(next_), _large())
    single = live.where("lo = hi").select(*keys, "rank", F.col("lo").alias("x"))
    several = live.where("lo < hi")
    spans = several.select(*keys, "lo", "hi").distinct()
    sorted_ = held.join(spans, keys).where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    picked = several.join(sorted_, [*keys, "lo", "hi"]).select(*keys, "rank", F.col("vs")[(F.col("rank") - F.col("before")).cast("int")].alias("x"))
    at = single.unionByName(picked).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))  # two ranks per fraction
    out = sizes.join(at, keys)

    def between(place):
        low, high = (F.element_at("at", r(place).cast("bigint")) for r in (F.floor, F.ceil))
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return out.select(*keys, *[between(p).alias(name) for name, p in places.items()])


def _large():
    return (F.col("lo") < F.col("hi")) & (F.col("m") > SORTED)
