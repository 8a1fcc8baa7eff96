"""Hard-negative mining with angular triangle bounds.

Vectors become whole numbers. A few reference directions are fitted on a bounded sample; every
row's angle to each is stored with its block. For an anchor and a row the angles to one
direction differ by no more than the angle between the two, and add up to no less; over all
directions that gives an interval of cosines, times both norms an interval of scores, wide
enough for rounding. A block's smallest and largest angles and norms bound all its rows at
once. Positives: only rows whose bound reaches the anchor's k-th best score are scored.
Negatives: only rows whose interval meets a window below one of the anchor's positives are.
Scores are inner products of whole numbers, exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalcount.session import materialize

#: Rows of a block, and its numbers at most; cells of a tile bounded at a time; pairs scored at a time.
BLOCK, BLOCK_NUMBERS, CELLS, PAIRS = 2048, 1 << 20, 1 << 20, 1 << 15

#: Reference directions; rows they are fitted on (those of the smallest hashes); rounds of fitting.
DIRECTIONS, SAMPLE, ROUNDS = 8, 4096, 4

#: Scores beyond a long count as the nearest long.
LARGEST = 2**63 - 1

_BLOCK = (
    "dim int, block bigint, labels array<bigint>, n int, kind string, ids binary, label binary, copies binary, codes binary, "
    "norms binary, angles binary, near array<double>, far array<double>, least double, most double"
)
_PARTS = ("n", "kind", "ids", "label", "copies", "codes", "norms", "angles")


# --- directions and bounds ----------------------------------------------------------------


def fitted(vectors: np.ndarray) -> np.ndarray:
    """Unit directions: each next one is farthest from those before, then each moves to the mean of its rows."""
    length = np.linalg.norm(vectors, axis=1)
    unit = vectors[length > 0] / length[length > 0][:, None]
    if not len(unit):
        return np.zeros((0, vectors.shape[1]))
    picked = [unit[0]]
    nearest = unit @ unit[0]
    while len(picked) < min(DIRECTIONS, len(unit)):
        picked.append(unit[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, unit @ picked[-1])
    centres = np.stack(picked)
    for _ in range(ROUNDS):
        owner = np.argmax(unit @ centres.T, axis=1)
        for k in range(len(centres)):
            mean = unit[owner == k].sum(axis=0)
            if (size := np.linalg.norm(mean)) > 0:
                centres[k] = mean / size
    return centres


def slack(dim: int) -> float:
    """Radians that rounding may take from an angle: of arccos near one, and of keeping four bytes."""
    return 1e-6 + 4 * math.sqrt((dim + 8) * 2.0**-52)


def angles_to(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of every row with every direction; a right angle for zero rows."""
    safe = np.where((norms > 0) & np.isfinite(norms), norms, 1.0)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.arccos(np.clip(np.nan_to_num((vectors / safe[:, None]) @ directions.T), -1, 1)).astype(np.float32)


def score_bounds(a: np.ndarray, b: np.ndarray, a_norms: np.ndarray, b_norms: np.ndarray, room: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of every row of one side with every row of the other."""
    apart = np.zeros((len(a), len(b)), np.float32)
    within = np.full((len(a), len(b)), np.pi, np.float32)
    for r in range(a.shape[1]):
        x, y = a[:, r, None], b[None, :, r]
        np.maximum(apart, np.abs(x - y), out=apart)
        both = x + y
        np.minimum(within, np.minimum(both, 2 * np.pi - both), out=within)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = a_norms[:, None] * b_norms[None, :]
        free = ~np.isfinite(norms)
        margin = 1e-6 * norms + 1
        low = norms * np.cos(np.minimum(within + room, np.pi)) - margin
        high = norms * np.cos(np.maximum(apart - room, 0)) + margin
    low[free], high[free] = -np.inf, np.inf
    return low, high


def exact_scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Inner products row by row. ``largest`` bounds norm times norm: below 2^52 doubles add up whole numbers exactly."""
    if largest < 2.0**52:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    sums = (sum(int(x) * int(y) for x, y in zip(u, v)) for u, v in zip(a.tolist(), b.tolist()))
    return np.array([max(-LARGEST - 1, min(LARGEST, s)) for s in sums], np.int64)


def in_window(positive: np.ndarray, negative: np.ndarray, low: int, high: int) -> np.ndarray:
    """low * positive <= 100 * negative <= high * positive."""
    if len(positive) and max(abs(int(positive.min())), abs(int(positive.max())), abs(int(negative.min())), abs(int(negative.max()))) > 2**55:
        positive, negative = positive.astype(object), negative.astype(object)
    return ((low * positive <= 100 * negative) & (100 * negative <= high * positive)).astype(bool)


# --- blocks -------------------------------------------------------------------------------


def _placed(directions):
    """Nearest direction and the angle to it, by which neighbours are packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, angle = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.float32)
            dims, codes = b.column("dim").to_numpy(), b.column("codes")
            flat, starts = codes.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *codes.value_lengths().to_pylist()])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                to = directions.value.get(int(d))
                if to is not None and len(to):
                    x = np.stack([flat[starts[i] : starts[i + 1]] for i in at])
                    found = angles_to(x, np.linalg.norm(x, axis=1), to)
                    cell[at], angle[at] = found.argmin(axis=1), found.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    return run


def _pack(directions):
    """Rows in order of (dim, label, cell, angle) as one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key = TaskContext.get().partitionId() << 40, None
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            nonlocal number
            dim = key[0]
            ids, label, copies = (np.array([r[k] for r in held], np.int64) for k in range(3))
            x = np.stack([r[3] for r in held])
            with np.errstate(over="ignore"):
                norms = np.linalg.norm(x, axis=1)
            top = np.abs(x).max(initial=0)
            kind = "int16" if top < 2**15 else "int32" if top < 2**31 else "float64"
            to = directions.value.get(dim)
            angles = angles_to(x, norms, to if to is not None else np.zeros((0, dim)))
            parts = [x.tobytes() for x in (ids, label, copies, x.astype(kind), norms, angles)]
            number += 1
            row = (dim, number, np.unique(label).tolist(), len(held), kind, *parts, angles.min(axis=0).tolist(), angles.max(axis=0).tolist(), float(norms.min()), float(norms.max()))
            names = [c.split(" ")[0] for c in _BLOCK.split(", ")]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.string(), *[pa.binary()] * 6, *[pa.list_(pa.float64())] * 2, *[pa.float64()] * 2]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("dim", "label", "cell", "vec_id", "copies")]
            for dim, label, cell, i, n, codes in zip(*columns, b.column("codes")):
                if held and (dim != key[0] or len(held) >= min(BLOCK, max(1, BLOCK_NUMBERS // max(1, dim))) or (len(held) >= BLOCK // 4 and (dim, label, cell) != key)):
                    yield row()
                    held.clear()
                key = (dim, label, cell)
                held.append((i, label, n, codes.values.to_numpy(zero_copy_only=False)))
        if held:
            yield row()

    return run


def _packed(rows: DataFrame, directions) -> DataFrame:
    placed = rows.mapInArrow(_placed(directions), "vec_id bigint, label bigint, dim int, codes array<double>, copies bigint, cell int, angle float")
    order = ("dim", "label", "cell", "angle", "vec_id")
    return materialize(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack(directions), _BLOCK))


class _Side:
    """One block of a tile."""

    def __init__(self, row: dict, side: str):
        n, d = row[f"{side}_n"], row["dim"]
        part = lambda name, kind: np.frombuffer(row[f"{side}_{name}"], kind)
        self.ids, self.label, self.copies, self.norms = part("ids", np.int64), part("label", np.int64), part("copies", np.int64), part("norms", np.float64)
        self.codes = part("codes", row[f"{side}_kind"]).reshape(n, d).astype(np.float64)
        self.angles = part("angles", np.float32).reshape(n, -1)
        self.room = slack(d)


def surviving(q: _Side, c: _Side, wanted, meets) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a tile as (row of q, row of c, score), scored only where their bounds meet what is looked for.

    ``wanted(rows)`` says which pairs matter at all, ``meets(rows, low, high)`` which bounds do.
    """
    step = max(1, CELLS // len(c.ids))
    for at in range(0, len(q.ids), step):
        rows = np.arange(at, min(at + step, len(q.ids)))
        mask = wanted(rows)
        if not mask.any():
            continue
        mask &= meets(rows, *score_bounds(q.angles[rows], c.angles, q.norms[rows], c.norms, q.room))
        a, b = np.nonzero(mask)
        if not len(a):
            continue
        with np.errstate(over="ignore"):
            largest = float(q.norms[rows].max() * c.norms.max())
        whole = 4 * len(a) > mask.size and largest < 2.0**52  # one product of matrices is then the faster way
        product = (q.codes[rows] @ c.codes.T).astype(np.int64) if whole else None
        for s in range(0, len(a), PAIRS):
            i, j = a[s : s + PAIRS], b[s : s + PAIRS]
            yield rows[i], j, product[i, j] if whole else exact_scores(q.codes[rows[i]], c.codes[j], largest)


class _Best:
    """The k first rows of each key, highest score first, ties to the smaller id."""

    def __init__(self, keys: int, k: int):
        self.k, self.floor, self.rows = k, np.full(keys, -np.inf), [np.zeros(0, np.int64)] * 4  # key, score, id, copies

    def add(self, *new: np.ndarray) -> None:
        self.rows = [np.concatenate(x) for x in zip(self.rows, new)]
        if len(self.rows[0]) > 4 * self.k * len(self.floor):
            self.thin()

    def thin(self) -> None:
        key, score, ids, _ = self.rows
        order = np.lexsort((ids, -score, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        self.rows = [x[order[place < self.k]] for x in self.rows]
        full = place == self.k - 1
        self.floor[key[full]] = score[order[full]]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, _Side, _Side]]:
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            yield row, _Side(row, "q"), _Side(row, "c")


def _found(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, q = None, None, None

        def found() -> pa.RecordBatch:
            best.thin()
            key, score, ids, copies = best.rows
            return _found(["q_block", "q_at", "anchor_id", "anchors", "vec_id", "score", "copies"], [np.full(len(key), at), key, q.ids[key], q.copies[key], ids, score, copies])

        for row, asking, c in _tiles(batches):
            if at != row["q_block"]:
                if best is not None:
                    yield found()
                at, q = row["q_block"], asking
                best = _Best(len(q.ids), k)
            same = lambda rows, c=c: q.label[rows, None] == c.label[None, :]
            for i, j, score in surviving(q, c, same, lambda rows, low, high: high >= best.floor[rows, None]):
                copies = c.copies[j].copy()
                twin = np.flatnonzero(q.ids[i] == c.ids[j])
                copies[twin[(q.codes[i[twin]] == c.codes[j[twin]]).all(axis=1)]] -= 1  # the anchor itself
                left = copies > 0
                best.add(i[left], score[left], c.ids[j][left], copies[left])
            best.thin()
        if best is not None:
            yield found()

    return run


def _negatives(k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, q, told = None, None, None, None

        def found() -> pa.RecordBatch:
            best.thin()
            key, score, ids, copies = best.rows
            return _found(["q_block", "q_at", "positive_score", "vec_id", "score", "copies"], [np.full(len(key), at), key // told.shape[1], told.ravel()[key], ids, score, copies])

        for row, asking, c in _tiles(batches):
            if at != row["q_block"]:
                if best is not None:
                    yield found()
                at, q = row["q_block"], asking
                most = max(len(w["scores"]) for w in row["windows"])
                told, there = np.zeros((len(q.ids), most), np.int64), np.zeros((len(q.ids), most), bool)
                for w in row["windows"]:
                    told[w["q_at"], : len(w["scores"])], there[w["q_at"], : len(w["scores"])] = w["scores"], True
                best = _Best(told.size, k)
                # windows of real numbers, as wide as rounding asks for
                bottom, top = (told * (edge / 100.0) + sign * (1 + np.abs(told) * 1e-9) for edge, sign in ((low, -1), (high, 1)))
            other = lambda rows, c=c: there[rows].any(axis=1)[:, None] & (q.label[rows, None] != c.label[None, :])

            def meets(rows: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
                out = np.zeros(least.shape, bool)
                floor = best.floor.reshape(told.shape)
                for w in range(told.shape[1]):
                    begin = np.where(there[rows, w], np.maximum(bottom[rows, w], floor[rows, w]), np.inf)
                    out |= (greatest >= begin[:, None]) & (least <= top[rows, w, None])
                return out

            for i, j, score in surviving(q, c, other, meets):
                for w in range(told.shape[1]):
                    fits = np.flatnonzero(there[i, w])
                    fits = fits[in_window(told[i[fits], w], score[fits], low, high)]
                    best.add(i[fits] * told.shape[1] + w, score[fits], c.ids[j[fits]], c.copies[j[fits]])
            best.thin()
        if best is not None:
            yield found()

    return run


def _with_contents(tiles: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """Tiles (q_block, c_block) with both blocks' contents, tiles of one q_block in a row."""
    asked = q.select("dim", F.col("block").alias("q_block"), *[c for c in q.columns if c == "windows"], *[F.col(p).alias(f"q_{p}") for p in _PARTS])
    met = c.select(F.col("block").alias("c_block"), *[F.col(p).alias(f"c_{p}") for p in _PARTS])
    return tiles.join(asked, "q_block").join(met.hint("merge"), "c_block").sortWithinPartitions("q_block")


def _first(found: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """``place`` (from 1) of each key's k first rows, a row of several copies taking as many places."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    near = found.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k)
    before = F.sum("copies").over(w.rowsBetween(Window.unboundedPreceding, -1))
    counted = near.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k)
    return counted.withColumn("place", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k))))).drop("at", "before", "copies")


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding; rows for which ``is_anchor`` (over vec_id) holds
    are anchors, all rows candidates. Components become floor(scale * x); a score is the inner
    product with the anchor, higher first, ties by smaller vec_id. An anchor's positives are its
    first rows of its own label; for each, its first rows of other labels are returned whose
    score is between ``low`` and ``high`` hundredths of the positive's (both included).

    Rows without vec_id, label or vector take no part, nor those with a null or non-finite
    component (as it is, or times ``scale``). Vectors of different lengths are not compared; zero
    and empty ones score 0. A repeated row is as many rows, each one other than the next; so is
    a repeated vec_id. Scores beyond a long count as the nearest long. Anchors without a positive,
    and positives without a negative, have no rows. Other columns are ignored.
    """
    x, size = F.col("vector"), F.lit(float(scale))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v * size) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.when(F.abs(v * size) < F.lit(2.0**53), F.floor(v * size).cast("double")).otherwise(v * size))
    rows = rows.where(fit).select("vec_id", "label", F.size(x).alias("dim"), whole.alias("codes"))
    rows = materialize(rows.groupBy("vec_id", "label", "dim", "codes").agg(F.count("*").alias("copies")))

    sample = rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label").limit(SAMPLE).select("dim", "codes").collect()
    by_dim = {d: np.array([r["codes"] for r in sample if r["dim"] == d]) for d in sorted({r["dim"] for r in sample})}
    directions = rows.sparkSession.sparkContext.broadcast({d: fitted(v) for d, v in by_dim.items()})
    c, q = _packed(rows, directions), _packed(rows.where(is_anchor), directions)

    # positives: blocks that share a label
    held = [b.select("dim", F.explode("labels").alias("label"), F.col("block").alias(name)) for b, name in ((q, "q_block"), (c, "c_block"))]
    tiles = held[0].join(held[1], ["dim", "label"]).select("q_block", "c_block").distinct()
    schema = "q_block bigint, q_at bigint, anchor_id bigint, anchors bigint, vec_id bigint, score bigint, copies bigint"
    near = _with_contents(tiles, q, c).mapInArrow(_positives(positives), schema)
    near = materialize(_first(near, ("q_block", "q_at"), positives).withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}))

    # negatives: blocks whose bounds meet a window of the anchors' block
    asked = near.groupBy("q_block", "q_at").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    edges = [F.col("positive_score") * (edge / 100.0) for edge in (low, high)]
    reach = near.groupBy("q_block").agg(F.min(F.least(*edges)).alias("bottom"), F.max(F.greatest(*edges)).alias("top"))
    windows = asked.groupBy("q_block").agg(F.collect_list(F.struct("q_at", "scores")).alias("windows"))  # one entry per anchor of a block
    asking = materialize(q.join(windows, F.col("block") == F.col("q_block")).drop("q_block"))
    tiles = _meeting(asking.join(reach, F.col("block") == F.col("q_block")), c)
    schema = "q_block bigint, q_at bigint, positive_score bigint, vec_id bigint, score bigint, copies bigint"
    far = _with_contents(tiles, asking, c).mapInArrow(_negatives(negatives, low, high), schema)
    far = _first(far, ("q_block", "q_at", "positive_score"), negatives).select(
        "q_block", "q_at", "positive_score", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    every = near.withColumn("anchor", F.explode(F.sequence(F.lit(1), F.col("anchors"))))  # a repeated anchor row asks as often
    return every.join(far, ["q_block", "q_at", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _meeting(q: DataFrame, c: DataFrame) -> DataFrame:
    """(q_block, c_block): pairs of blocks of which some rows' scores may lie between ``bottom`` and ``top``."""
    names = ("block", "near", "far", "least", "most")
    a = q.select("dim", "bottom", "top", *[F.col(n).alias(f"q_{n}") for n in names])
    b = c.select("dim", *[F.col(n).alias(f"c_{n}") for n in names])
    # every block of one side meets every one of the other: dealt out by parts, so that one dimension is many keys
    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = a.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(b.withColumn("part", F.pmod(F.xxhash64("c_block"), F.lit(parts)).cast("int")), ["dim", "part"])
    room = F.lit(1e-6) + 4 * F.sqrt((F.col("dim") + 8) * F.lit(2.0**-52))
    apart = F.array_max(F.zip_with(F.zip_with("q_near", "c_far", lambda x, y: x - y), F.zip_with("c_near", "q_far", lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    most = F.zip_with("q_far", "c_far", lambda x, y: x + y)  # the largest sum of angles, and what is left of a full turn
    least = F.zip_with("q_near", "c_near", lambda x, y: 2 * math.pi - (x + y))
    within = F.least(F.array_min(most), F.array_min(least))
    greatest, smallest = F.cos(F.greatest(F.coalesce(apart, F.lit(0.0)) - room, F.lit(0.0))), F.cos(F.least(F.coalesce(within, F.lit(math.pi)) + room, F.lit(math.pi)))
    small, large = F.col("q_least") * F.col("c_least"), F.col("q_most") * F.col("c_most")
    margin = large * 1e-6 + 2
    high = F.when(greatest >= 0, large * greatest).otherwise(small * greatest) + margin
    low = F.when(smallest >= 0, small * smallest).otherwise(large * smallest) - margin
    spread = F.abs(F.col("bottom")) * 1e-9 + F.abs(F.col("top")) * 1e-9
    return pairs.where((high >= F.col("bottom") - spread) & (low <= F.col("top") + spread)).select("q_block", "c_block")
