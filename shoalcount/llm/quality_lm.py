"""Quality classification by an interpolated modified Kneser-Ney model over UTF-8 bytes.

A model per language is counted on all trusted texts. Each document gets the perplexity of its
bytes under its language's model, and is judged against quantiles of the perplexities that
trusted texts outside the counts have in that language.

Counts live in tables sharded by n-gram, and texts never meet the whole model. Documents are
taken in blocks (neighbours in a file); a block asks once for each n-gram it holds, the
requests join the count tables, and the answers travel back to the block. So the traffic is
the text once plus a small share of it, and a task holds the answers of one block.

An n-gram is an integer: its bytes, the last one lowest. Zero bytes pad the start of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalcount.llm.util import blocked, hinted, without
from shoalcount.session import materialize

ORDER = 5

#: Documents in a block, and text bytes handled at a time inside a task.
BLOCK_ROWS, STEP = 16_384, 1 << 18

#: Text bytes that travel compressed together.
PARCEL = 1 << 18

#: No discount is smaller, so that every byte keeps some probability.
LEAST_DISCOUNT = 0.05

#: One trusted document in so many is kept from the counts to set the thresholds.
HELD_OUT = 4


class Limits(NamedTuple):
    """How far above its language's median log perplexity a text may stand.

    The mean over n bytes scatters the more the fewer they are, so distances are divided by
    sqrt(1 + ``scatter`` / n). Accepted is ``slack`` times the distance of the trusted texts'
    ``quantile``, and ``least`` (nats per byte) in any case. Texts below the median stay.
    """

    quantile: float = 0.98
    slack: float = 1.6
    least: float = 0.05
    scatter: float = 800.0


def _span(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and where each value starts (one more at the end)."""
    offsets, data = column.buffers()[1:]
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _grams(raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per stretch of the bytes: the n-gram that ends at each, and the value it belongs to."""
    for a in range(0, len(raw), STEP):
        b = min(len(raw), a + STEP)
        from_ = max(0, a - ORDER + 1)
        part = raw[from_:b].astype(np.int64)
        grams = part.copy()
        for k in range(1, ORDER):
            grams[k:] |= part[: len(part) - k] << 8 * k
        grams = grams[a - from_ :]
        owner = np.searchsorted(starts, np.arange(a, b), "right") - 1 if len(starts) < 3 else _owners(starts, a, b)
        for k in range(ORDER - 1):  # nothing of the text before
            at = starts[:-1] + k
            at = at[(at < starts[1:]) & (at >= a) & (at < b)] - a
            grams[at] &= (1 << 8 * (k + 1)) - 1
        yield grams, owner


def _owners(starts: np.ndarray, a: int, b: int) -> np.ndarray:
    sizes = np.minimum(starts[1:], b) - np.maximum(starts[:-1], a)
    return np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lang, gram, n) per batch: each n-gram once, n its count in trusted texts."""
    for batch in batches:
        frame = pd.DataFrame({"block": batch.column("block").to_numpy(), "lang": batch.column("lang").to_pylist()})
        groups = frame.groupby(["block", "lang"], sort=False)
        group = groups.ngroup().to_numpy().astype(np.int64) << 8 * ORDER
        names = [tuple(r) for r in frame.drop_duplicates().itertuples(index=False)]  # ngroup counts by first appearance
        trusted = batch.column("trusted").to_numpy(zero_copy_only=False)
        seen, counts = [], []
        for grams, owner in _grams(*_span(batch.column("text"))):
            keys = grams | group[owner]
            seen.append(pd.unique(keys))
            if trusted.any():
                counts.append(pd.Series(keys[trusted[owner]]).value_counts(sort=False))
        if not seen:
            continue
        keys = pd.unique(np.concatenate(seen))
        n = np.zeros(len(keys), np.int64)
        if counts:
            total = pd.concat(counts).groupby(level=0).sum()
            n = total.reindex(keys, fill_value=0).to_numpy(np.int64)
        which = keys >> 8 * ORDER
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array([b for b, _ in names], np.int64)[which]), pa.array([g for _, g in names], pa.string()).take(pa.array(which)),
                pa.array(keys & ((1 << 8 * ORDER) - 1)), pa.array(n),
            ],
            names=["block", "lang", "gram", "n"],
        )


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a block, some hundred KB of text to a row, compressed."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        raw, starts = _span(batch.column("text"))
        blocks = batch.column("block").to_numpy()
        ids, langs = batch.column("doc_id"), batch.column("lang")
        cuts, at = [0], 0
        for i in range(1, len(blocks) + 1):
            if i == len(blocks) or blocks[i] != blocks[at] or starts[i + 1] - starts[at] > PARCEL:
                cuts.append(i)
                at = i
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            data = [int(blocks[a]), ids[a:b].to_pylist(), langs[a:b].to_pylist(), np.diff(starts[a : b + 1]).tolist(), squeeze(raw[starts[a] : starts[b]].tobytes())]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(data, kinds)], names=["block", "doc_ids", "langs", "sizes", "data"])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, answers before parcels: sums of log probabilities per document."""
    block, codes, grams, values, index, held = None, {}, [], [], None, None
    open_up = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i, (at, kind) in enumerate(zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist())):
            if at != block:
                block, codes, grams, values, index = at, {}, [], [], None
            if kind == 0:
                code = codes.setdefault(batch.column("lang")[i].as_py(), len(codes))
                grams.append(batch.column("grams")[i].values.to_numpy() | code << 8 * ORDER)
                values.append(batch.column("values")[i].values.to_numpy())
                continue
            if index is None and grams:
                index, held = pd.Index(np.concatenate(grams)), np.concatenate(values)
            langs, sizes = batch.column("langs")[i].as_py(), batch.column("sizes")[i].values.to_numpy()
            raw = np.frombuffer(open_up(batch.column("data")[i].as_py()), np.uint8) if sizes.any() else np.zeros(0, np.uint8)
            high = np.array([codes.get(x, -1) for x in langs], np.int64) << 8 * ORDER
            ends = np.concatenate([[0], np.cumsum(sizes)])
            keys_of = [xxhash.xxh64_intdigest(raw[a:e].tobytes(), 42) for a, e in zip(ends[:-1], ends[1:])]  # as Spark's xxhash64
            sums = np.zeros(len(langs))
            for keys, owner in _grams(raw, ends):
                found = index.get_indexer(keys | high[owner])
                if (found < 0).any():
                    raise ValueError("a block's answers lack an n-gram of its texts")
                sums += np.bincount(owner, held[found], len(langs))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_ids")[i].values), pa.array(langs, pa.string()), pa.array(sizes), pa.array(sums), pa.array(np.array(keys_of, np.uint64).view(np.int64))], names=["doc_id", "lang", "n_bytes", "log_prob", "text_key"])


def model_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms (lang, n, gram, term) and contexts (lang, n, context, weight) of stored counts (lang, gram, c).

    p_n = term of the n-gram (0 if unseen) + weight of its context (1 if unseen) x p_(n-1);
    p_0 is uniform over bytes. The highest order has raw counts, the lower ones the number of
    different bytes seen before the n-gram. Discounts follow the counts of counts; where these
    are too thin to define one, half of the count it applies to is taken; LEAST_DISCOUNT at least.
    """
    level = counts.select("lang", "gram", "c")
    levels = []
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            level = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1).cast("bigint")).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        levels.append(level.select("lang", F.lit(n).alias("n"), "gram", "c"))
    types = levels[0]
    for more in levels[1:]:
        types = types.unionByName(more)
    types = materialize(types)
    of = [F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    discounts = types.groupBy("lang", "n").agg(*of).select(
        "lang", "n",
        *[F.coalesce(F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0), F.greatest(F.lit(LEAST_DISCOUNT), k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")))), F.lit(k / 2)).alias(f"d{k}") for k in (1, 2, 3)],
    )
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    # ORDER rows a language: with them the model's rows stay where they are, not dealt by these few keys
    cut = types.join(hinted(materialize(discounts)), ["lang", "n"]).select("lang", "n", "gram", F.shiftright("gram", 8).alias("context"), "c", d.alias("d"))
    contexts = materialize(cut.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("weight")))
    terms = cut.join(contexts, ["lang", "n", "context"]).select("lang", "n", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("term"))
    return terms, contexts.select("lang", "n", "context", "weight")


def log_probabilities(grams: DataFrame, terms: DataFrame, contexts: DataFrame) -> DataFrame:
    """lang, gram, value: the log probability of each n-gram's last byte given those before."""
    n = F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("n")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("n") * 8) - 1
    asked = grams.select("lang", F.col("gram").alias("whole"), n).withColumn("gram", F.col("whole").bitwiseAND(mask)).withColumn("context", F.shiftright("gram", 8))
    met = asked.join(terms, ["lang", "n", "gram"], "left").join(contexts, ["lang", "n", "context"], "left")
    step = F.struct("n", F.coalesce("term", F.lit(0.0)).alias("t"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    folded = met.groupBy("lang", F.col("whole").alias("gram")).agg(F.sort_array(F.collect_list(step)).alias("steps"))  # ORDER entries
    p = F.aggregate("steps", F.lit(1.0 / 256), lambda acc, s: s["t"] + s["w"] * acc)
    return folded.select("lang", "gram", F.log(p).alias("value"))


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, log_prob, text_key (the text's xxhash64) per document; ``trusted`` (doc_id, stored) names the texts to count.

    Null and empty texts have 0 bytes. A null lang is the language ''.
    """
    doc_id, text = F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = blocked(docs, {"doc_id": doc_id, "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "text": text}, BLOCK_ROWS)
    # with a trusted list beyond the broadcast bound this join shuffles the texts instead
    marked = rows.join(hinted(trusted).select(F.col("doc_id").alias("__id"), F.lit(True).alias("__t")), F.col("doc_id") == F.col("__id"), "left")
    asked = marked.select("block", "lang", F.coalesce("__t", F.lit(False)).alias("trusted"), "text").mapInArrow(_requests, "block bigint, lang string, gram bigint, n bigint")
    requests = materialize(asked.groupBy("block", "lang", "gram").agg(F.sum("n").alias("n")))
    both = materialize(requests.groupBy("lang", "gram").agg(F.sum("n").alias("c")))
    values = materialize(log_probabilities(both.select("lang", "gram"), *model_tables(both.where("c > 0"))))
    packed = requests.join(values, ["lang", "gram"]).groupBy("block", "lang").agg(F.collect_list(F.struct("gram", "value")).alias("g"))  # no more than a block's bytes
    kinds = "block bigint, doc_ids array<bigint>, langs array<string>, sizes array<bigint>, data binary"
    parcels = rows.select("block", "doc_id", "lang", "text").mapInArrow(_parcels, kinds).withColumn("kind", F.lit(1))
    answers = packed.select("block", F.lit(0).alias("kind"), "lang", F.col("g.gram").alias("grams"), F.col("g.value").alias("values"))
    met = answers.unionByName(parcels, allowMissingColumns=True)
    return met.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_scores, "doc_id bigint, lang string, n_bytes bigint, log_prob double, text_key bigint")


def _quantiles(rows: DataFrame, value: str, wanted: dict[str, float]) -> DataFrame:
    """lang and quantiles of a value, exact on a grid of 0.0001: counts per grid cell, then running sums."""
    cells = rows.groupBy("lang", F.round(F.col(value) * 10_000).cast("bigint").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang")
    upto = cells.select("lang", "cell", F.sum("n").over(w.orderBy("cell")).alias("upto"), F.sum("n").over(w).alias("all"))
    at = [F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("cell") / 10_000)).alias(name) for name, q in wanted.items()]
    return upto.groupBy("lang").agg(*at)


def classify(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, perplexity, threshold, kept, text_key.

    Trusted are the documents that ``labels`` (doc_id, quality) gives quality 1 and never 0;
    a quarter of them (by CRC of doc_id) sets the thresholds, the others are counted. A document
    goes if its perplexity per byte exceeds its language's threshold. Without bytes there is
    no perplexity (null), without trusted text in a language no threshold (null): such documents
    stay. Null langs count as one language ''. Repeated rows are judged alike; labels without a
    document, null labels and other columns are ignored.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("q"))
    trusted = materialize(marks.where("q = 1").select("doc_id"))
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0
    scored = materialize(perplexities(docs, materialize(trusted.where(~aside))).withColumn("nats", F.try_divide(-F.col("log_prob"), F.col("n_bytes"))))
    known = materialize(scored.where("n_bytes > 0").join(trusted.where(aside), "doc_id"))
    scale = F.sqrt(1 + limits.scatter / F.greatest("n_bytes", F.lit(1)))
    middle = materialize(_quantiles(known, "nats", {"mid": 0.5}))
    distances = known.join(middle, "lang").withColumn("away", (F.col("nats") - F.col("mid")) / scale)
    ranges = middle.join(_quantiles(distances, "away", {"reach": limits.quantile}), "lang")
    limit = F.exp(F.col("mid") + scale * F.greatest(F.lit(limits.least), limits.slack * F.col("reach")))
    perplexity = F.exp("nats")
    judged = scored.join(ranges, "lang", "left")
    return judged.select("doc_id", "lang", "n_bytes", perplexity.alias("perplexity"), limit.alias("threshold"), F.coalesce(perplexity <= limit, F.lit(True)).alias("kept"), "text_key")


def survivors(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that are not rejected, with their columns as they were.

    A document goes if a rejected row has its doc_id, lang and text (by hash and length).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = {"doc_id": F.col("doc_id").cast("bigint"), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "n_bytes": F.octet_length(text).cast("bigint"), "text_key": F.xxhash64(text)}
    rejected = materialize(classify(docs, labels, limits).where(~F.col("kept")).select(*key).distinct())
    return without(docs, rejected, **key)
