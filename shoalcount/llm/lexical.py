"""Ranked lexical search of many items at once, with shared partial sums.

Documents become rows of (item term, occurrences) once. Items that share terms share work:
pairs of terms that recur in several items become nodes, nodes that recur together become
larger nodes, and what is left of an item combines nodes. This is a graph without cycles. For each batch of documents every node's accumulators are worked out
once, children before parents, and every item adds up the nodes it is left with.

Scores are whole numbers, so the order of addition does not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalcount.session import materialize

#: Items are answered in blocks of so many distinct (item, term) pairs; a larger item is a block of its own.
BLOCK_TERMS = 200_000

#: Pairs of terms looked at in one round of mining.
PAIRS = 1 << 22

#: Bytes of a text cut into terms at a time; cells of the accumulator matrix; candidates held before they are thinned.
SLICE, CELLS, HELD = 1 << 20, 2 << 20, 1 << 17

#: The UTF-8 bytes of digits, letters and everything beyond ASCII, lower-cased: the terms [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+.
TERM, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")


# --- the sharing graph --------------------------------------------------------------------


class Sharing:
    """Which sums of terms are worked out once and which of them make up each item.

    ``terms`` are the leaves 0..T-1. Nodes T.. are sums of at least two nodes below them and are
    used at least twice. ``levels`` lists nodes in an order in which children come first, as
    (nodes, children of all, start of each node's children); ``items`` likewise.
    """

    def __init__(self, items: list[set[bytes]]):
        holders: dict[bytes, list[int]] = defaultdict(list)
        for i, held in enumerate(items):
            for t in held:
                holders[t].append(i)
        # terms of the same items stand together, the widespread first
        self.terms = sorted(holders, key=lambda t: (-len(holders[t]), holders[t], t))
        place = {t: n for n, t in enumerate(self.terms)}
        sequences = [sorted(place[t] for t in held) for held in items]
        self.children: dict[int, list[int]] = {}
        self._pair_up(sequences)
        self._inline(sequences)
        self._order(sequences)

    def _pair_up(self, sequences: list[list[int]]) -> None:
        """Pairs that recur in several items become one node, the most frequent first, again and again."""
        nodes: dict[tuple[int, int], int] = {}
        reach = max(1, PAIRS // max(1, sum(map(len, sequences))))  # all pairs of an item, or neighbours if that is too much

        def pairs(s: list[int]):
            return ((a, b) for i, a in enumerate(s) for b in s[i + 1 : i + 1 + reach])

        while True:
            seen = Counter(p for s in sequences for p in pairs(s))
            shared = {p: n for p, n in seen.items() if n > 1}
            if not shared:
                return
            for at, s in enumerate(sequences):
                taken: set[int] = set()
                new: list[int] = []
                for p in sorted((p for p in pairs(s) if p in shared), key=lambda p: (-shared[p], p)):
                    if taken.isdisjoint(p):
                        taken.update(p)
                        new.append(nodes.setdefault(p, len(self.terms) + len(nodes)))
                        self.children[new[-1]] = list(p)
                if taken:
                    sequences[at] = sorted([c for c in s if c not in taken] + new)

    def _inline(self, sequences: list[list[int]]) -> None:
        """A node used once is no shared sum: its user takes its children instead."""
        uses = Counter(c for s in [*sequences, *self.children.values()] for c in s)

        def opened(row: list[int]) -> list[int]:
            out: list[int] = []
            todo = row[::-1]
            while todo:
                c = todo.pop()
                if c in self.children and uses[c] == 1:
                    todo.extend(self.children[c][::-1])
                else:
                    out.append(c)
            return out

        sequences[:] = [opened(s) for s in sequences]
        self.children = {n: opened(c) for n, c in self.children.items() if uses[n] > 1}

    def _order(self, sequences: list[list[int]]) -> None:
        depth: dict[int, int] = {}
        by_depth: dict[int, list[int]] = defaultdict(list)
        number = {n: len(self.terms) + k for k, n in enumerate(self.children)}  # without gaps
        for n, below in self.children.items():  # children are older than their parents
            depth[n] = 1 + max(depth.get(c, 0) for c in below)
            by_depth[depth[n]].append(n)
        self.size = len(self.terms) + len(number)

        def packed(ids: list[int], rows: list[list[int]]):
            flat = np.array([number.get(c, c) for r in rows for c in r], np.int64)
            return np.array(ids, np.int64), flat, np.cumsum([0, *map(len, rows)])[:-1]

        self.levels = [packed([number[n] for n in by_depth[d]], [self.children[n] for n in by_depth[d]]) for d in sorted(by_depth)]
        filled = [i for i, s in enumerate(sequences) if s]
        self.items = packed(filled, [sequences[i] for i in filled])

    def totals(self, leaves: np.ndarray) -> np.ndarray:
        """(items with terms) x documents: sums of the leaves' rows, each node summed once."""
        acc = np.zeros((self.size, leaves.shape[1]), np.int64)
        acc[: len(self.terms)] = leaves
        for ids, below, starts in self.levels:
            acc[ids] = np.add.reduceat(acc[below], starts, axis=0)
        _, below, starts = self.items
        return np.add.reduceat(acc[below], starts, axis=0)


# --- documents ----------------------------------------------------------------------------


def term_counts(raw: bytes) -> Counter:
    """Occurrences of each term in UTF-8 bytes of any length, a slice at a time."""
    counts: Counter = Counter()
    at = 0
    while at < len(raw):
        cut = GAP.search(raw, min(at + SLICE, len(raw)))
        end = cut.start() if cut else len(raw)
        counts.update(TERM.findall(raw[at:end].lower()))
        at = max(end, at + 1)
    return counts


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, text in zip(b.column("item_id"), b.column("text")):
            found = list(term_counts(text.as_buffer().to_pybytes())) if text.is_valid else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.repeat(item, len(found)), pa.array(found, pa.binary())], names=["item_id", "term"])


def _postings(held):
    """Per document: its number of terms, and the item terms it holds with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: n for n, t in enumerate(held.value)}
        for b in batches:
            lengths, ends, terms, times = [], [0], [], []
            for text in b.column("text"):
                counts = term_counts(text.as_buffer().to_pybytes()) if text.is_valid else {}
                lengths.append(sum(counts.values()))
                for t in counts.keys() & place.keys():
                    terms.append(place[t])
                    times.append(counts[t])
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return run


def weights(holding: Iterable[int], documents: int) -> np.ndarray:
    """The weight of terms that so many documents hold."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding], np.int64)


class _Best:
    """The k best documents of each item met so far, ties to the smaller doc_id, nulls last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 4  # item, score, doc_id, whether that is null

    def add(self, totals: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        if totals.shape[1] >= self.k:
            np.maximum(self.floor, np.partition(totals, -self.k, axis=1)[:, -self.k], out=self.floor)
        item, at = np.nonzero(totals >= self.floor[:, None])
        new = (item, totals[item, at], docs[at], null[at])
        self.rows = [np.concatenate(x) for x in zip(self.rows, new)]
        if len(self.rows[0]) > HELD:
            self.thin()

    def thin(self) -> None:
        item, score, docs, null = self.rows
        order = np.lexsort((docs, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.rows = [x[order[place < self.k]] for x in self.rows]
        full = place == self.k - 1
        self.floor[item[full]] = score[order[full]]


def _scored(plan, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sharing, weight, documents, length, item_ids = plan.value
        best = _Best(len(sharing.items[0]), k)
        step = max(1, CELLS // (sharing.size + len(sharing.items[1])))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                m = np.array([10 + 90 * n * documents // length for n in b.column("n").to_pylist()], np.int64)
                terms, times = b.column("terms"), b.column("times")
                doc = np.repeat(np.arange(b.num_rows), terms.value_lengths().to_numpy())
                term, tf = (x.flatten().to_numpy() for x in (terms, times))
                leaves = np.zeros((len(sharing.terms), b.num_rows), np.int64)
                leaves[term, doc] = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                ids = b.column("doc_id")
                best.add(sharing.totals(leaves), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
        best.thin()
        item, score, docs, null = best.rows
        owner = [item_ids[i] for i in sharing.items[0][item].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(owner, pa.int64()), pa.array(docs, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"]
        )

    return run


def _answered(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The k best documents of the items of one block of (item_id, term) pairs."""
    sc = docs.sparkSession.sparkContext
    items: dict[int | None, set[bytes]] = defaultdict(set)
    for batch in pairs.toArrow().to_batches():
        for item, term in zip(batch.column("item_id").to_pylist(), batch.column("term").to_pylist()):
            items[item].add(term)
    sharing = Sharing(list(items.values()))
    counted = docs.mapInArrow(_postings(sc.broadcast(sharing.terms)), "doc_id bigint, n bigint, terms array<int>, times array<bigint>")
    stored = materialize(counted.where(F.col("n") > 0))
    documents, length = stored.agg(F.count("*"), F.sum("n")).first()
    holding = dict(stored.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weight = weights([holding.get(t, 0) for t in range(len(sharing.terms))], documents)
    plan = sc.broadcast((sharing, weight, documents, length, list(items)))
    found = stored.where(F.size("terms") > 0).mapInArrow(_scored(plan, k), "item_id bigint, doc_id bigint, score bigint")
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text. Terms are runs of digits, letters and
    characters beyond ASCII in the whole text, only A-Z lower-cased. A term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))) over the N documents with a term; a document of n terms adds
    weight * (10^9 tf div (1000 tf + 8 (10 + 90 n N div L))), L being all documents' terms.

    Null and empty texts have no terms: such documents count nowhere, such items get no rows. Rows
    with one item_id (null is one like any other) are one item with the terms of all of them. Rows
    of one doc_id are documents of their own; equal scores go by ascending doc_id, null last. Other
    columns are ignored. Items are answered in blocks (one for up to about 200,000 terms): a block's
    terms go to all tasks, and the documents are read once for each block.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    pairs = materialize(items.mapInArrow(_item_terms, "item_id bigint, term binary").distinct())
    blocks = -(-pairs.count() // BLOCK_TERMS)
    if not blocks:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = [_answered(docs, pairs.where(block == i), k) for i in range(blocks)]
    out = found[0] if blocks == 1 else reduce(DataFrame.unionByName, [materialize(f) for f in found])
    return out.select("item_id", "rank", "doc_id", "score")
