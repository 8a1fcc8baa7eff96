"""SimHash near-duplicates through deletion-variant signatures.

Two 64-bit fingerprints at most two bits apart, cut into two halves, have a half that differs
in at most one bit. Each half is therefore indexed whole and with each single bit left out;
fingerprints meet in equi joins on these keys and are verified. In a one-wildcard key the left
out bit tells the sides apart (0 meets 1), so no pair of equal halves is found again.

Keys held by very many fingerprints are refined instead of paired: the other half's variants
are added to the key until every member of a key is within the distance of every other, and
such a group becomes a star on its smallest member. No pair is lost and none is enumerated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.llm.util import hinted, without
from shoalcount.session import materialize

#: Halves shared by more distinct fingerprints than this are refined, not paired.
HEAVY = 256

_STEP = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles, as a signed integer."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII blanks
    if not tokens:
        return 0
    line = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        spans = zip(starts[at : min(n, at + _STEP)].tolist(), last[at : at + _STEP].tolist())
        h = np.array([hashed(line[a:b], 42) for a, b in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def _batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fp)], names=["doc_id", "text_key", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_key (a hash of the exact text) and fp per document; null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_batches(words), "doc_id bigint, text_key bigint, fp bigint")


def _half(seg: Column) -> Column:
    return F.when(seg == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))).otherwise(F.shiftrightunsigned("fp", 32))


def _bit(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), pos)


def _cleared(value: Column, pos: Column) -> Column:
    return value.bitwiseAND(F.bitwise_not(_bit(pos)))


def _stars(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Members of a key linked to its smallest; keys are narrow enough to be cliques."""
    least = groups.groupBy(*keys).agg(F.min("fp").alias("a"), F.max("fp").alias("__most")).where("a < __most")
    return groups.join(least, keys).where("fp <> a").select("a", F.col("fp").alias("b"))


def links(prints: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all at most two bits apart.

    Every edge is a verified link. ``prints`` has one row per fingerprint, ``fp``, and is stored.
    """
    whole = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg")).withColumn("val", _half(F.col("seg")))
    wild = (
        prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
        .withColumns({"seg": (F.col("bit") >= 32).cast("int"), "pos": F.col("bit") % 32})
        .withColumn("val", _half(F.col("seg")))
        .select("fp", "seg", "pos", _cleared(F.col("val"), F.col("pos")).alias("val"), F.getbit("fp", F.col("bit")).cast("int").alias("side"))
    )
    crowded = materialize(whole.groupBy("seg", "val").count().where(F.col("count") > heavy).select("seg", "val"))
    busy = materialize(crowded.select("seg", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("pos"), "val").select("seg", "pos", _cleared(F.col("val"), F.col("pos")).alias("val")).distinct())

    def close(a: str, b: str):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2

    calm = without(whole, crowded, seg=F.col("seg"), val=F.col("val"))
    x = calm.select("seg", "val", F.col("fp").alias("a"))
    y = calm.select(F.col("seg").alias("s2"), F.col("val").alias("v2"), F.col("fp").alias("b"))
    # opened rows are many times what the plan takes them for: never broadcast
    same = x.join(y.hint("merge"), (x.seg == y.s2) & (x.val == y.v2) & (F.col("a") < F.col("b")) & close("a", "b")).select("a", "b")

    key = (F.col("seg") * 32 + F.col("pos")).cast("bigint") * 2**32 + F.col("val")
    calm = without(wild, busy, seg=F.col("seg"), pos=F.col("pos"), val=F.col("val"))
    zero = calm.where("side = 0").select(key.alias("k0"), F.col("fp").alias("a"))
    one = calm.where("side = 1").select(key.alias("k1"), F.col("fp").alias("b"))
    near = zero.join(one.hint("merge"), (F.col("k0") == F.col("k1")) & close("a", "b")).select("a", "b")

    # the refined path: what stands in a crowded key gets the other half's variants as well
    other = _half(1 - F.col("seg"))
    bits = F.sequence(F.lit(0), F.lit(31))
    hot = whole.join(hinted(crowded), ["seg", "val"]).withColumn("other", other)
    around = hot.withColumn("q", F.explode(F.array_append(bits, F.lit(-1)))).withColumn("o", F.when(F.col("q") < 0, F.col("other")).otherwise(F.col("other").bitwiseXOR(_bit(F.col("q")))))
    wide = wild.join(hinted(busy), ["seg", "pos", "val"]).withColumn("q", F.explode(bits)).withColumn("o", _cleared(other, F.col("q")))
    return same.unionByName(near).unionByName(_stars(around.select("seg", "val", "o", "fp"), ["seg", "val", "o"])).unionByName(_stars(wide.select("seg", "pos", "val", "q", "o", "fp"), ["seg", "pos", "val", "q", "o"]))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for every node of the stored edges (a, b).

    Alternates large-star and small-star steps until nothing changes; each step is a map-side
    combined minimum and a join that adaptive execution may split, so a hub is never gathered.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))


def classify(docs: DataFrame, words: int = 3, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, text_key, fp, component_id, label.

    label is the smallest fingerprint of the component. Fingerprints at most two bits apart are linked; component_id is the smallest doc_id
    reachable (null doc_ids are passed over; null if there is no other). Texts without words,
    null ones too, have fingerprint 0 and are linked like any other. Repeated rows stay.
    """
    rows = materialize(fingerprints(docs, words))
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(materialize(links(prints.select("fp"), heavy)))
    grouped = prints.join(labels, prints.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    grouped = materialize(grouped)
    ids = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows.join(grouped.join(ids, "label").select("fp", "component_id", "label"), "fp").select("doc_id", "text_key", "fp", "component_id", "label")


def survivors(docs: DataFrame, words: int = 3, heavy: int = HEAVY) -> DataFrame:
    """The documents with one of each component left: the smallest doc_id, then the smallest text_key.

    Rows that repeat both go through as one.
    """
    rows = materialize(classify(docs, words, heavy))
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_key")).alias("best"))
    chosen = rows.groupBy("label", "doc_id", "text_key").count().join(best, "label")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    marked = materialize(chosen.where(~stays | (F.col("count") > 1)).select("doc_id", "text_key", stays.alias("stays")))
    key = {"doc_id": F.col("doc_id").cast("bigint"), "text_key": F.xxhash64(F.coalesce("text", F.lit("")))}
    out = without(docs, marked, **key)
    again = marked.where("stays")
    if again.isEmpty():
        return out
    named = again.select(*[F.col(k).alias(f"__k_{k}") for k in key])
    cond = key["doc_id"].eqNullSafe(F.col("__k_doc_id")) & (key["text_key"] == F.col("__k_text_key"))
    return out.unionByName(docs.join(named, cond).dropDuplicates(["__k_doc_id", "__k_text_key"]).select(*docs.columns))
