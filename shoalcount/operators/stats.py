"""Bootstrap intervals, agreement and selection statistics.

Resampling draws with a portable integer mixer of (stream, resample, slot), so any engine can
replay it. A group's values are packed into blocks of arrays by a dense index; a draw reads
what it takes from an array, and only sums per (group, draw) travel. A piece of work streams a
span of blocks into arrays of the narrowest type and draws all its slots from them; each range of
slots meets each span of its group, so a group of any size is many bounded pieces of work.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalcount.functions.hashing import draw_keys, hash32, hash_bucket, mix32_array
from shoalcount.operators.counting import ratio
from shoalcount.operators.ordered import position
from shoalcount.session import materialize, materialize_counted


def dense_index(df: DataFrame, keys: Sequence[str], item: str, name: str = "j") -> DataFrame:
    """0-based index per key group in hash order of ``item`` (even buckets, no hot task)."""
    hashed = df.withColumn("__h", hash32(F.col(item)))
    order = [F.col("__h"), F.col(item)]
    return position(hashed, keys, hash_bucket(F.col("__h"), df.sparkSession), order, name).drop("__h")


def numbered(rows: DataFrame, name: str, n: int, step: int = 100) -> DataFrame:
    """Each row n times, numbered from 0. A stretch of numbers is dealt out before it opens up,
    so that few rows with many copies each still spread over all tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = rows.withColumn("__first", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(step))))
    dealt = first.repartition(parts, *rows.columns, "__first")
    return dealt.withColumn(name, F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + step - 1, F.lit(n - 1))))).drop("__first")


#: Values in a block; resamples in one piece of work; cells (resample x slot) drawn at a time.
BLOCK, DRAWS, CELLS = 1 << 18, 250, 1 << 18
#: Blocks (of values, and of slots) that one piece of work holds or walks.
SPAN = 32


def packed(df: DataFrame, keys: Sequence[str], item: str, values: Sequence[str]) -> DataFrame:
    """Blocks of a group's values as arrays: keys, n (of the group), block, values; stored.
    Whole numbers are stored as short ones where all of them fit."""
    chosen = df.select(*keys, item, *values)
    whole = [v for v, kind in chosen.dtypes if v in values and kind in ("bigint", "int", "smallint", "tinyint")]
    wide = reduce(lambda a, b: a | b, [~F.col(v).between(-(2**15), 2**15 - 1) for v in whole], F.lit(False))
    indexed, large = materialize_counted(dense_index(chosen, keys, item), wide)
    sizes = indexed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = F.sort_array(F.collect_list(F.struct("j", *values)))
    blocks = indexed.groupBy(*keys, F.floor(F.col("j") / BLOCK).alias("block")).agg(rows.alias("rows"))  # at most BLOCK rows
    short = [] if large else whole
    arrays = [(F.col(f"rows.{v}").cast("array<smallint>") if v in short else F.col(f"rows.{v}")).alias(v) for v in values]
    return materialize(blocks.join(sizes, list(keys)).select(*keys, "n", "block", *arrays))


def _narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest signed type that holds them."""
    if a.dtype.kind != "i" or not len(a):
        return a
    low, high = int(a.min()), int(a.max())
    return a.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _spans(batches: Iterator[pa.RecordBatch], keys: Sequence[str], values: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """Per piece of work: its last row, the index of its first value, and its values."""
    held, before, b, low = [], None, None, 0
    for whole in batches:
        for i in range(whole.num_rows):
            one = whole.slice(i, 1)
            block, slots, draws = (one.column(c)[0] for c in ("block", "slots", "draws"))
            piece = (*[one.column(k)[0].as_py() for k in keys], block.as_py() // SPAN, slots.as_py(), draws.values[0].as_py())
            if piece != before:
                if held:
                    yield b, low, [np.concatenate(a) for a in zip(*held)]
                held, before, low = [], piece, block.as_py() * BLOCK
            held.append([_narrow(one.column(v)[0].values.to_numpy(zero_copy_only=False)) for v in values])
            b = one
    if held:
        yield b, low, [np.concatenate(a) for a in zip(*held)]


def _sums(keys: Sequence[str], values: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, low, arrays in _spans(batches, keys, values):
            n, slots_of, stream = (b.column(c)[0].as_py() for c in ("n", "slots", "stream"))
            draws, size = b.column("draws")[0].values.to_numpy(), len(arrays[0])
            held, taken = draw_keys(stream, draws), [np.zeros(len(draws), np.float64 if a.dtype.kind == "f" else np.int64) for a in arrays]
            count = np.zeros(len(draws), np.int64)
            end = min(n, (slots_of + 1) * SPAN * BLOCK)
            for at in range(slots_of * SPAN * BLOCK, end, CELLS):
                slots = mix32_array(np.arange(at, min(end, at + CELLS), dtype=np.int64).astype(np.uint32))
                step = max(1, CELLS // len(slots))
                for d in range(0, len(draws), step):
                    pick = mix32_array(held[d : d + step, None] ^ slots[None, :])
                    if n < 2**32:
                        pick -= pick // np.uint32(n) * np.uint32(n)
                    pick = pick.astype(np.int64)
                    if size == n:
                        count[d : d + step] += len(slots)
                        for out, a in zip(taken, arrays):
                            out[d : d + step] += a.take(pick).sum(axis=1)
                        continue
                    for row, p in enumerate(pick, d):
                        p = p[(p >= low) & (p < low + size)] - low
                        count[row] += len(p)
                        for out, a in zip(taken, arrays):
                            out[row] += a.take(p).sum()
            same = [b.column(k).take(pa.array(np.zeros(len(draws), np.int64))) for k in keys]
            yield pa.RecordBatch.from_arrays([*same, pa.array(draws), *map(pa.array, taken), pa.array(count)], names=[*keys, "draw", *values, "drawn"])

    return run


def draw_sums(work: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums of ``values`` and rows ``drawn`` per (keys, draw).

    ``work``: blocks of :func:`packed` with ``stream`` and ``draws`` (array of numbers); every
    (keys, draw) must meet all blocks of its keys.
    """
    parts = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = work.withColumn("slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / (SPAN * BLOCK)).cast("int"))))
    piece = [*keys, F.floor(F.col("block") / SPAN), "slots", F.col("draws")[0]]
    kinds = dict(work.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["draw bigint"] + [f"`{v}` {'double' if 'double' in kinds[v] else 'bigint'}" for v in values] + ["drawn bigint"])
    whole = ("array<bigint>", "array<int>", "array<smallint>", "array<tinyint>", "array<double>")
    arrays = [F.col(v) if kinds[v] in whole else F.col(v).cast("array<bigint>").alias(v) for v in values]
    dealt = pieces.select(*keys, "n", "block", "slots", "stream", "draws", *arrays).repartition(parts, *piece)
    found = dealt.sortWithinPartitions(*piece, "block").mapInArrow(_sums(keys, values), schema)
    return found.groupBy(*keys, "draw").agg(*[F.sum(v).alias(v) for v in values], F.sum("drawn").alias("drawn"))


def resample(
    df: DataFrame, keys: Sequence[str], item: str, values: Sequence[str], resamples: int, seed: int, salt: Sequence[str] = ()
) -> DataFrame:
    """Sums of ``values`` per (keys, draw) over as many draws with replacement as the group has rows.

    ``salt`` names columns that go into the stream, so groups draw differently. Null values count as zero.
    """
    keys = list(keys)
    blocks = packed(df.withColumns({v: F.coalesce(F.col(v), F.lit(0)) for v in values}), keys, item, values)
    first = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(DRAWS)))
    work = blocks.withColumn("stream", hash32(seed, *[F.col(c) for c in salt])).withColumn("first", first)
    last = F.least(F.col("first") + DRAWS - 1, F.lit(resamples - 1))
    return draw_sums(work.withColumn("draws", F.sequence(F.col("first").cast("bigint"), last.cast("bigint"))).drop("first"), keys, values)


def interval(value: str, name: str, confidence: float = 0.95, digits: int = 9) -> list[Column]:
    """Percentile bounds with linear interpolation."""
    tail = (1 - confidence) / 2
    return [
        F.round(F.percentile(value, F.lit(tail)), digits).alias(f"{name}_low"),
        F.round(F.percentile(value, F.lit(1 - tail)), digits).alias(f"{name}_high"),
    ]


def paired_bootstrap(
    pairs: DataFrame, item: str = "clip_name", resamples: int = 10_000, confidence: float = 0.95, seed: int = 0
) -> DataFrame:
    """Intervals for the nMAE of systems a and b and of b - a; one row.

    ``pairs`` has ``passages``, ``err_a``, ``err_b`` per clip. Resamples without reference
    passages are skipped; P(b better) is the share with a strictly negative difference.
    """
    data = pairs.select(F.lit("all").alias("g"), item, "passages", "err_a", "err_b")
    sums = resample(data, ["g"], item, ["passages", "err_a", "err_b"], resamples, seed)
    per = sums.select(
        "g",
        ratio(F.col("err_a"), F.col("passages")).alias("a"),
        ratio(F.col("err_b"), F.col("passages")).alias("b_"),
    ).withColumn("diff", F.col("b_") - F.col("a"))
    bounds = per.groupBy("g").agg(
        *interval("a", "a", confidence), *interval("b_", "b", confidence), *interval("diff", "difference", confidence),
        F.round(F.avg((F.col("diff") < 0).cast("double")), 9).alias("probability_b_better"),
        F.count("a").alias("resamples"),
        F.count(F.when(F.col("a").isNull(), 1)).alias("skipped"),
    )
    points = data.groupBy("g").agg(
        F.round(ratio(F.sum("err_a"), F.sum("passages")), 9).alias("a_estimate"),
        F.round(ratio(F.sum("err_b"), F.sum("passages")), 9).alias("b_estimate"),
        F.round(ratio(F.sum("err_b") - F.sum("err_a"), F.sum("passages")), 9).alias("difference_estimate"),
        F.count(F.lit(1)).alias("clips"),
    )
    return points.join(bounds, "g").drop("g")


def location_bootstrap(
    counts: DataFrame, systems: Sequence[str], item: str = "clip_name", resamples: int = 10_000, seed: int = 0
) -> DataFrame:
    """Per (location, draw): every system's nMAE under a resample stratified by location.

    ``counts`` has location, ``passages`` and ``err_<system>`` per clip.
    """
    values = ["passages", *[f"err_{s}" for s in systems]]
    sums = resample(counts, ["location"], item, values, resamples, seed, salt=["location"])
    return sums.select("location", "draw", *[ratio(F.col(f"err_{s}"), F.col("passages")).alias(s) for s in systems])


def location_intervals(samples: DataFrame, systems: Sequence[str]) -> DataFrame:
    return samples.groupBy("location").agg(*[c for s in systems for c in interval(s, s)])


def macro_intervals(samples: DataFrame, systems: Sequence[str], baseline: str) -> DataFrame:
    """Intervals of the macro average and of ``baseline`` minus each other system; one row."""
    macro = samples.groupBy("draw").agg(*[F.avg(s).alias(s) for s in systems])
    others = [s for s in systems if s != baseline]
    macro = macro.withColumns({f"d_{s}": F.col(baseline) - F.col(s) for s in others})
    return macro.agg(
        *[c for s in systems for c in interval(s, s)],
        *[c for s in others for c in interval(f"d_{s}", f"minus_{s}")],
        *[F.round(F.avg((F.col(f"d_{s}") < 0).cast("double")), 9).alias(f"better_than_{s}") for s in others],
    )


def cohen_kappa(pairs: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Items, agreement share and Cohen's kappa per group (null when undefined).

    The label pairs are counted first; everything after works on that small table.
    """
    keys = list(keys)
    cells = pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(*keys).agg(
        F.sum("n").alias("items"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same")
    )
    sides = cells.select(*keys, F.col(a).alias("label"), F.col("n").alias("na"), F.lit(0).alias("nb")).unionByName(
        cells.select(*keys, F.col(b).alias("label"), F.lit(0).alias("na"), F.col("n").alias("nb"))
    )
    margins = sides.groupBy(*keys, "label").agg((F.sum("na") * F.sum("nb")).alias("p")).groupBy(*keys).agg(F.sum("p").alias("p"))
    joined = totals.join(margins, keys) if keys else totals.crossJoin(margins)  # one row by one row
    share = F.col("same") / F.col("items")
    expected = F.col("p") / (F.col("items") * F.col("items"))
    return joined.select(
        *keys, "items", "same", F.round(share, 9).alias("share"),
        F.round(F.when(F.col("p") != F.col("items") * F.col("items"), (share - expected) / (1 - expected)), 9).alias("kappa"),
    )


def select_best(results: DataFrame, name: str, *order: Column, keys: Sequence[str] = ()) -> DataFrame:
    """The row name with the lexicographically smallest ``order``."""
    return results.groupBy(*keys).agg(F.min_by(name, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias(name))


def count_parity(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("clip_name",)) -> DataFrame:
    """Clips both systems cover, clips with different counts, and clips only one covers."""
    pair = lambda df, p: df.select(*keys, F.struct("pred_right", "pred_left").alias(p))
    both = pair(a, "pa").join(pair(b, "pb"), list(keys), "full")
    return both.agg(
        F.count(F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull(), 1)).alias("clips"),
        F.count(F.when(F.col("pa") != F.col("pb"), 1)).alias("clips_with_different_counts"),
        F.count(F.when(F.col("pa").isNull() | F.col("pb").isNull(), 1)).alias("unpaired_clips"),
    )


def pair_systems(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("clip_name",)) -> DataFrame:
    """Two systems' counts per clip. Raises if the clip sets or the reference counts differ."""
    side = lambda df, p: df.select(
        *keys, F.struct("ref_right", "ref_left").alias(f"ref_{p}"), F.col("pred_right").alias(f"{p}_right"), F.col("pred_left").alias(f"{p}_left")
    )
    both = side(a, "a").join(side(b, "b"), list(keys), "full")
    problem = F.when(F.col("ref_a").isNull() | F.col("ref_b").isNull(), "the systems cover different clips").when(
        F.col("ref_a") != F.col("ref_b"), "the systems disagree on reference counts"
    )
    ref = F.when(problem.isNotNull(), F.raise_error(problem).cast("bigint"))
    err = lambda p: F.abs(F.col(f"{p}_right") - F.col("ref_right")) + F.abs(F.col(f"{p}_left") - F.col("ref_left"))
    out = both.withColumns(
        {"ref_right": F.coalesce(ref, F.col("ref_a.ref_right")), "ref_left": F.coalesce(ref, F.col("ref_a.ref_left"))}
    ).drop("ref_a", "ref_b")
    return out.withColumns({"passages": F.col("ref_right") + F.col("ref_left"), "err_a": err("a"), "err_b": err("b")})
