"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in hash order, form blocks. Weights are whole slots of a cycle; block j
of a source with w of T slots is released at floor(j T / w) and due at ceil((j + 1) T / w).
Earliest deadline first fills every slot in time, so after any number of slots each source is
less than one block from its share. The pattern of a cycle depends on the weights alone and
repeats; the documents are placed on it by joins and ranks.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalcount.llm.util import hinted
from shoalcount.operators import ordered
from shoalcount.session import materialize

#: Documents in a block, slots in a cycle (about: every source has one at least).
BLOCK_ROWS, SLOTS = 32, 1000


def cycle(weights: Mapping[str, int]) -> list[tuple[str, int]]:
    """(source, its block) of each slot of one cycle: earliest deadline first among the released."""
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: list[tuple[str, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j))
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
    return out


def tempered(sizes: Mapping[str, int], power: float = 0.5, slots: int = SLOTS) -> dict[str, int]:
    """Whole weights in proportion to size ** power, about ``slots`` in all, 1 at least."""
    whole = math.fsum(n**power for n in sizes.values())
    return {s: max(1, math.floor(slots * n**power / whole + 0.5)) for s, n in sizes.items() if n > 0}


def _stored(spark: SparkSession, slots: list[dict], at_once: int = 20_000) -> DataFrame:
    """One cycle as a stored table, from literals of bounded size."""
    kind = "array<struct<source: string, turn: int, place: int, weight: int>>"
    parts = [slots[i : i + at_once] for i in range(0, len(slots), at_once)] or [[]]
    return materialize(reduce(DataFrame.unionByName, [spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(p)), kind))) for p in parts]))


def schedule(docs: DataFrame, weights: Mapping[str, int] | None = None, power: float = 0.5, block_rows: int = BLOCK_ROWS, slots: int = SLOTS) -> DataFrame:
    """One row per document: doc_id, text_key, source, weight, block, slot, position.

    ``weights`` (slots per cycle) must name every source; by default they are :func:`tempered`
    sizes. slot is the place of the document's block in the endless schedule; position is the
    document's place, without gaps, among all: when a source has run out, its slots are passed
    over and the others go on in their proportions. A null source is the source ''. Documents
    of a source follow the hash of doc_id, then doc_id and text; rows equal in these are
    interchangeable, and all stay. With more sources than ``slots`` the cycle has about twice as
    many slots as there are sources; sources and one cycle pass through the driver, documents
    never do. An empty table gives no rows.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("mix"), key).cast("binary")), 1, 8), 16, 10).cast("bigint")
    rows = materialize(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), source.alias("source"), h.alias("h")))
    sizes = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}  # a name and a number a source
    chosen = dict(weights) if weights is not None else tempered(sizes, power, max(slots, len(sizes)))
    if missing := sorted(s for s in sizes if chosen.get(s, 0) < 1):
        raise ValueError(f"sources without a weight: {missing}")
    chosen = {s: chosen[s] for s in sizes}
    total = sum(chosen.values())
    spark = docs.sparkSession
    pattern = _stored(spark, [{"source": s, "turn": j, "place": i, "weight": chosen[s]} for i, (s, j) in enumerate(cycle(chosen))])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) for c in ("h", "doc_id", "text_key")]
    ranked = ordered.position(rows, ["source"], F.floor(F.col("h") * parts / float(2**32)), order, "__rank")
    block = F.floor(F.col("__rank") / block_rows)
    blocks = ranked.withColumn("block", block).join(hinted(materialize(pattern.select("source", "weight").distinct())), "source")  # one row per source
    blocks = blocks.withColumn("turn", (F.col("block") % F.col("weight")).cast("int"))
    placed = blocks.join(hinted(pattern).drop("weight"), ["source", "turn"])  # one row per slot of a cycle
    placed = materialize(placed.withColumn("slot", F.floor(F.col("block") / F.col("weight")) * total + F.col("place")))
    used = materialize(placed.groupBy("slot").agg(F.count(F.lit(1)).alias("n")))
    before = ordered.running(used, [], F.floor(F.col("slot") / 4096), [F.col("slot")], F.col("n"), "before", exclusive=True)
    met = placed.join(before.select("slot", F.coalesce("before", F.lit(0)).alias("before")), "slot")
    position = F.col("before") + F.col("__rank") % block_rows
    return met.select("doc_id", "text_key", "source", "weight", "block", "slot", position.cast("bigint").alias("position"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents in the order of the schedule, with their columns as they were.

    Partitions and the rows in them follow position, so files written from it are the mix.
    """
    plan = schedule(docs, **options)
    where = plan.groupBy("doc_id", "text_key").agg(F.min("position").alias("__position")).withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    placed = docs.join(where, docs["doc_id"].eqNullSafe(F.col("__id")) & (key == F.col("__key")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "__position").sortWithinPartitions("__position").select(*[docs[c] for c in docs.columns])
