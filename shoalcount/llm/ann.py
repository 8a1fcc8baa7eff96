"""Nearest neighbours by a block matrix join.

Vectors are packed into blocks. A block of queries meets every block of candidates as a tile:
int8 products give all cosines of the tile, each within a bound that follows from what
rounding took from the two vectors. A pair survives if its best possible cosine reaches the
k-th best certain one; survivors are recomputed in double precision and merged in heaps.
The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalcount.session import materialize

#: Vectors in a block; pairs recomputed at a time.
BLOCK, PAIRS = 2048, 1 << 15

_PARTS = ("block", "size", "ids", "copies", "vectors", "codes", "steps", "losses")
_BLOCK_SCHEMA = "dim int, block int, size int, ids binary, copies binary, vectors binary, codes binary, steps binary, losses binary"


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, the step of each, and the norm of what rounding took."""
    steps = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / steps[:, None]).astype(np.int8)
    losses = np.linalg.norm(unit - codes * steps[:, None], axis=1)
    return codes, steps, losses


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (dim, block) into one row per block."""
    held: list[tuple[int, int, np.ndarray]] = []
    key = None

    def row():
        ids, copies = (np.array([r[k] for r in held], np.int64) for k in range(2))
        vectors = np.stack([r[2] for r in held])
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        codes, steps, losses = quantised(unit)
        data = [key[0], key[1], len(held), *(x.tobytes() for x in (ids, copies, vectors, codes, steps, losses))]
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(data, kinds)], names=["dim", *_PARTS])

    for b in batches:
        for d, block, i, n, v in zip(*[b.column(c).to_pylist() for c in ("dim", "block", "vec_id", "copies")], b.column("vector")):
            if (d, block) != key or len(held) == BLOCK:
                if held:
                    yield row()
                held, key = [], (d, block)
            held.append((i, n, np.asarray(v.values, np.float64)))
    if held:
        yield row()


def _packed(rows: DataFrame, n: int, side: str) -> DataFrame:
    """n vectors (vec_id, vector, copies) in rows of up to BLOCK, by dimension and hash of both."""
    into = max(1, -(-2 * n // BLOCK))
    dealt = rows.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(into)).cast("int").alias("block"), "vec_id", "copies", "vector")
    packed = dealt.repartition("dim", "block").sortWithinPartitions("dim", "block", "vec_id").mapInArrow(_pack, _BLOCK_SCHEMA)
    return packed.select("dim", *[F.col(name).alias(f"{side}_{name}") for name in _PARTS])


def _tile(row: dict, side: str) -> tuple[np.ndarray, ...]:
    n, d = row[f"{side}_size"], row["dim"]
    ids = np.frombuffer(row[f"{side}_ids"], np.int64)
    return (
        ids, np.frombuffer(row[f"{side}_vectors"], np.float64).reshape(n, d), np.frombuffer(row[f"{side}_codes"], np.int8).reshape(n, d),
        np.frombuffer(row[f"{side}_steps"], np.float64), np.frombuffer(row[f"{side}_losses"], np.float64), np.frombuffer(row[f"{side}_copies"], np.int64),
    )


def survivors(q: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...], k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row) of a tile that may be among the query's k nearest.

    ``floor`` holds a cosine per query that k others are known to reach. A query's own row, of
    the same id and vector and without further copies, is left out.
    """
    # products of int8 codes are whole numbers below 2^24 up to 1,040 dimensions: exact in float32
    kind = np.float32 if q[2].shape[1] <= 1000 else np.float64
    about = (q[2].astype(kind) @ c[2].astype(kind).T).astype(np.float64) * (q[3][:, None] * c[3])
    # cos = (q' + dq)(c' + dc); |q'| and |c'| are at most 1 + loss
    room = q[4][:, None] * (1 + c[4]) + c[4] * (1 + q[4][:, None]) + q[4][:, None] * c[4] + 1e-12
    own = q[0][:, None] == c[0]
    qi, ci = np.nonzero(own)
    own[qi, ci] = (q[1][qi] == c[1][ci]).all(axis=1) & (c[5][ci] == 1)
    low = np.where(own, -np.inf, about - room)
    kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
    return np.nonzero(~own & (about + room >= np.maximum(kth, floor)[:, None]))


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, in one order of summation: equal vectors score equal."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each query, ties to the smaller vec_id."""
    order = np.lexsort((vec, -score, query))
    ordered = query[order]
    first = np.searchsorted(ordered, ordered, "left")
    return order[np.arange(len(order)) - first < k]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, q, floor = None, None, None
        heaps: dict[int, list[tuple[float, int]]] = {}

        def found() -> pa.RecordBatch:
            rows = [(at[1], i, int(q[0][i]), int(q[5][i]), -v, s) for i, heap in heaps.items() for s, v in heap]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            names = ["block", "at", "query_id", "copies", "vec_id", "score"]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if at != (key := (row["dim"], row["q_block"], row["q_ids"])):  # tiles of one query block usually come in a row
                    if heaps:
                        yield found()
                    at, q, heaps = key, _tile(row, "q"), {}
                    floor = np.full(len(q[0]), -np.inf)
                c = _tile(row, "c")
                qi, ci = survivors(q, c, k, floor)
                for s in range(0, len(qi), PAIRS):
                    a, e = qi[s : s + PAIRS], ci[s : s + PAIRS]
                    score = exact_cosines(q[1][a], c[1][e])
                    top = _best(a, score, c[0][e], k)
                    same = (q[0][a[top]] == c[0][e[top]]) & (q[1][a[top]] == c[1][e[top]]).all(axis=1)
                    times = np.minimum(c[5][e[top]] - same, k)  # of a row's own copies one is the query itself
                    for i, x, v, n in zip(a[top].tolist(), score[top].tolist(), c[0][e[top]].tolist(), times.tolist()):
                        heap = heaps.setdefault(i, [])
                        for _ in range(n):
                            if len(heap) < k:
                                heapq.heappush(heap, (x, -v))
                            elif (x, -v) > heap[0]:
                                heapq.heapreplace(heap, (x, -v))
                for i, heap in heaps.items():
                    if len(heap) == k:
                        floor[i] = heap[0][0] - 1e-12
        if heaps:
            yield found()

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest others by cosine, ties to the smaller vec_id.

    ``vectors`` has vec_id and embedding; rows for which ``is_query`` (over vec_id) holds are
    the queries, all rows the candidates. Vectors that are null, empty, all zero, or hold null
    or non-finite components take no part, nor do rows without a vec_id; vectors of different
    lengths are not compared. A query with fewer than k candidates gets them all. Every row is a
    candidate but the query's own: rows that repeat a vec_id, with the same vector or another, are
    rows of their own, as queries too. Other columns are ignored.
    """
    x = F.col("vector")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fit = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = materialize(rows.where(fit).groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("copies")))
    asking = rows.where(is_query)
    everyone = materialize(_packed(rows, rows.count(), "c"))
    queries = materialize(_packed(asking, asking.count(), "q"))
    # every block of one side names the blocks of the other, so that tiles are keys of an equi join
    last = {side: frame.agg(F.max(f"{side}_block")).first()[0] or 0 for side, frame in (("c", everyone), ("q", queries))}
    c = everyone.withColumn("q_at", F.explode(F.sequence(F.lit(0), F.lit(last["q"]))))
    q = queries.withColumnRenamed("dim", "q_dim").withColumn("c_at", F.explode(F.sequence(F.lit(0), F.lit(last["c"]))))
    tiles = q.join(c.hint("merge"), (F.col("q_dim") == F.col("dim")) & (F.col("q_block") == F.col("q_at")) & (F.col("c_block") == F.col("c_at")))
    found = tiles.select("dim", *[f"{side}_{name}" for side in "qc" for name in _PARTS]).mapInArrow(
        _search(k), "block int, at int, query_id bigint, copies bigint, vec_id bigint, score double"
    )
    w = Window.partitionBy("query_id", "block", "at").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("query_id", "rank", "vec_id", "score")
