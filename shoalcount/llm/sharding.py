"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each node every child draws an exponential
variable from the hash of (seed, child, key), divided by the child's weight; the smallest
wins, so children are hit in proportion to weight, and raising one child's weight moves
documents only into that child. What happens inside a subtree whose weights stay is unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.llm.util import materialize
from shoalcount.operators import ordered


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float


def uniform_tree(regions: int = 2, racks: int = 3, shards: int = 4) -> list[Leaf]:
    """Equal shards numbered from 0, ``shards`` to a rack and ``racks`` to a region."""
    return [
        Leaf(f"r{s // (racks * shards)}", f"r{s // (racks * shards)}k{s // shards % racks}", s, 1.0)
        for s in range(regions * racks * shards)
    ]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, as a region of its own.

    Only the root's weights change, so documents move from anywhere into the new shard and
    nowhere else. (A shard added inside a rack would also draw documents into its siblings.)
    """
    n = 1 + max(leaf.shard for leaf in tree)
    return [*tree, Leaf(f"r+{n}", f"r+{n}k0", n, weight)]


def _children(tree: Sequence[Leaf]) -> list[dict[str, dict[str, float]]]:
    """Per level: parent -> child -> summed weight."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for leaf in tree:
        if leaf.weight <= 0:
            continue
        for level, (parent, child) in enumerate((("", leaf.region), (leaf.region, leaf.rack), (leaf.rack, f"s{leaf.shard}"))):
            held = levels[level].setdefault(parent, {})
            held[child] = held.get(child, 0.0) + leaf.weight
    return levels


def _draw(key: Column, seed: int, child: Column) -> Column:
    """Uniform in (0, 1): 48 bits of a portable hash."""
    text = F.concat_ws(":", F.lit(str(seed)), child, key)
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(2**48)


def place(key: Column, tree: Sequence[Leaf], seed: int = 0) -> Column:
    """The shard of a key (a string column; null is the key ''). The tree is part of the plan."""
    key = F.coalesce(key, F.lit(""))
    node: Column | None = None
    for level in _children(tree):
        arrays = {
            parent: F.array(*[F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in sorted(held.items())])
            for parent, held in level.items()
        }
        if node is None:
            options = arrays[""]
        else:
            options = F.element_at(F.create_map(*[x for p, a in arrays.items() for x in (F.lit(p), a)]), node)
        scored = F.transform(options, lambda o: F.struct((-F.log(_draw(key, seed, o["child"])) / o["weight"]).alias("s"), o["child"].alias("c")))
        node = F.array_min(scored)["c"]
    return F.substring(node, 2, 18).cast("int")


def assign(docs: DataFrame, tree: Sequence[Leaf], seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8; a null text has none and the CRC of nothing (0).
    slot numbers a shard's rows from 0 without gaps, by the hash of doc_id, then doc_id, CRC
    and size; rows equal in all of them are interchangeable. grown_shard is the shard under
    :func:`grown`. Null doc_ids share the key ''. An empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("slot"), key).cast("binary")), 1, 8), 16, 10).cast("bigint")
    narrow = docs.select(
        F.col("doc_id"), (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        hashed.alias("h"), key.alias("key"),
    )
    placed = materialize(narrow.withColumns({"shard": place(F.col("key"), tree, seed), "grown_shard": place(F.col("key"), grown(tree), seed)}).drop("key"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.floor(F.col("h") * parts / float(2**32))
    order = [F.col(c) for c in ("h", "doc_id", "text_crc32", "size")]
    return ordered.position(placed, ["shard"], bucket, order, "slot").drop("h")
