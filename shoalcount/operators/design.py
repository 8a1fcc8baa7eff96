"""Study design: eligibility, stratified samples, matched sets, orders and codes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalcount.functions.hashing import hash32, hash_bucket
from shoalcount.functions.names import camera
from shoalcount.operators.ordered import position, running
from shoalcount.session import materialize

# Passage bins of the review sample and of the usability study.
SAMPLE_BINS = ((0, 0), (1, 2), (3, 4), (5, 10_000))
STUDY_BINS = ((1, 2), (3, 4), (5, 8))
MIN_FRAMES, MAX_FRAMES = 150, 450
MIN_SECONDS, MAX_SECONDS = 15.0, 45.0


def passage_bin(passages: Column, bins: Sequence[tuple[int, int]]) -> Column:
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(bins))):
        out = F.when(passages.between(lo, hi), i).otherwise(out)
    return out


def documented_names(documents: DataFrame, names: DataFrame, pattern: str) -> DataFrame:
    """Names that occur in any document.

    Names follow ``pattern`` (a regular expression with one group), so they are extracted from
    the whole texts and met with an equi join rather than searched for one by one.
    """
    found = documents.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("name")).distinct()
    return names.join(found, "name", "left_semi")


def eligible(candidates: DataFrame, documented: DataFrame) -> DataFrame:
    """Study clips: length, duration and passages within range, and not shown in documentation."""
    passages = F.col("ref_right") + F.col("ref_left")
    ok = candidates.where(
        F.col("num_frames").between(MIN_FRAMES, MAX_FRAMES)
        & (F.col("num_frames") / F.col("framerate")).between(MIN_SECONDS, MAX_SECONDS)
        & passages.between(STUDY_BINS[0][0], STUDY_BINS[-1][1])
    )
    return ok.join(documented.select(F.col("name").alias("clip_name")), "clip_name", "left_anti")


def allocate(sizes: DataFrame, n: int) -> DataFrame:
    """Proportional allocation of ``n`` over strata (stratum, size): floor, at least one each,
    largest remainder, then removals where the minimum overshot.

    Works on the stratum table (cameras x bins), which does not grow with the clips.
    """
    every = Window.partitionBy(F.lit(0))
    t = sizes.withColumn("pool", F.sum("size").over(every)).withColumn("exact", n * F.col("size") / F.col("pool"))
    t = t.withColumn("take", F.greatest(F.lit(1), F.floor("exact"))).withColumn("rest", F.col("exact") - F.floor("exact"))
    t = t.withColumn("missing", F.lit(n) - F.sum("take").over(every))
    room = F.col("take") < F.col("size")
    by_rest = Window.partitionBy(F.lit(0)).orderBy(room.desc(), F.col("rest").desc(), "stratum")
    t = t.withColumn("turn", F.row_number().over(by_rest))
    t = t.withColumn("take", F.col("take") + F.when(room & (F.col("turn") <= F.col("missing")), 1).otherwise(0))
    # Each removable unit of a stratum weighs take - exact at the time it would be removed.
    units = t.where("missing < 0 and take > 1").withColumn("u", F.explode(F.sequence(F.lit(0), (F.col("take") - 2).cast("int"))))
    weight = F.col("take") - F.col("u") - F.col("exact")
    ranked = units.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(weight.desc(), "stratum", "u")))
    removed = ranked.where(F.col("r") <= -F.col("missing")).groupBy("stratum").agg(F.count(F.lit(1)).alias("gone"))
    out = t.join(removed, "stratum", "left").withColumn("take", F.col("take") - F.coalesce("gone", F.lit(0)))
    return out.select("stratum", "size", "take")


def hash_order(df: DataFrame, keys: Sequence[str], item: str, seed: int, name: str) -> DataFrame:
    """0-based position per key group in a replayable random order."""
    h = df.withColumn("__h", hash32(F.lit(seed), F.col(item)))
    return position(h, keys, hash_bucket(F.col("__h"), df.sparkSession), [F.col("__h"), F.col(item)], name).drop("__h")


def stratified_sample(pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` clips, proportional over (camera, passage bin), in a fixed random order."""
    passages = F.col("ref_right") + F.col("ref_left")
    s = pool.withColumn(
        "stratum", F.concat_ws(":", camera(F.col("clip_name")), passage_bin(passages, SAMPLE_BINS).cast("string"))
    )
    take = allocate(s.groupBy("stratum").agg(F.count(F.lit(1)).alias("size")), n)
    placed = hash_order(s, ["stratum"], "clip_name", seed, "place")
    chosen = placed.join(take.select("stratum", "take"), "stratum").where(F.col("place") < F.col("take"))
    return hash_order(chosen.drop("place", "take"), [], "clip_name", seed + 1, "presentation")


def neutral_codes(items: DataFrame, item: str, seed: int, prefix: str = "t") -> DataFrame:
    """Codes t01, t02, ... in a seeded order."""
    placed = hash_order(items, [], item, seed, "place")
    code = F.concat(F.lit(prefix), F.lpad((F.col("place") + 1).cast("string"), 2, "0"))
    wide = F.concat(F.lit(prefix), (F.col("place") + 1).cast("string"))
    return placed.withColumn("code", F.when(F.col("place") < 99, code).otherwise(wide)).drop("place")


def epoch_order(samples: DataFrame, item: str, seed: int, epoch: int, start: int = 0) -> DataFrame:
    """The epoch's permutation from position ``start`` on."""
    placed = hash_order(samples, [], item, seed * 100_003 + epoch, "place")
    return placed.where(F.col("place") >= start)


def latin_square(participants: DataFrame) -> DataFrame:
    """Two blocks per participant in the four-row counterbalanced order."""
    ranked = participants.withColumn("row", F.pmod(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("participant")) - 1, F.lit(4)))
    # Condition and set of the two blocks in each row of the square.
    square = [
        (0, 1, "manual", "S1"), (0, 2, "assisted", "S2"), (1, 1, "assisted", "S1"), (1, 2, "manual", "S2"),
        (2, 1, "manual", "S2"), (2, 2, "assisted", "S1"), (3, 1, "assisted", "S2"), (3, 2, "manual", "S1"),
    ]
    table = participants.sparkSession.createDataFrame(square, "row int, block int, condition string, clip_set string")
    return ranked.join(F.broadcast(table), "row").drop("row")  # eight fixed rows


def stratum_pairs(pool: DataFrame, seed: int, automatic: tuple[str, str] = ("a_right", "a_left")) -> DataFrame:
    """The first two clips of every stratum (camera and passage bin) in a seeded order, as :func:`match_sets` takes them."""
    passages = F.col("ref_right") + F.col("ref_left")
    c = pool.withColumn("bin", passage_bin(passages, STUDY_BINS)).where("bin is not null")
    c = c.withColumn("key", F.concat_ws(":", camera(F.col("clip_name")), F.col("bin").cast("string")))
    placed = hash_order(c, ["key"], "clip_name", seed, "place")
    err = F.abs(F.col(automatic[0]) - F.col("ref_right")) + F.abs(F.col(automatic[1]) - F.col("ref_left"))
    item = F.struct(F.col("clip_name").alias("name"), passages.alias("passages"), (F.col("num_frames") / F.col("framerate")).alias("seconds"), err.alias("error"))
    first = lambda n: F.max(F.when(F.col("place") == n, item)).alias(f"x{n}")
    return placed.groupBy("key").agg(first(0), first(1))


def match_sets(pairs: DataFrame) -> DataFrame:
    """The most balanced split of stratum pairs into two sets: names of both sets and the gaps left.

    ``pairs`` has one row per stratum: key, and for its clips ``x0``/``x1`` a struct (name,
    passages, seconds, error). The first stratum's first clip is in set 1; equal scores go by
    set 1's names. Without a stratum, with a stratum that lacks a clip, or when no split meets
    the tolerances, it raises.

    Of n strata the 2^(n-1) splits are never opened up: the 2^(n/2) splits of either half meet
    in the middle. What a half leaves of passages and errors is an equi join key, and for the
    seconds only the nearest partner matters, a running maximum from either side.
    """
    strata = sorted((r for r in pairs.select("key", "x0", "x1").collect()), key=lambda r: r["key"])  # cameras x bins
    whole = [r for r in strata if r["x0"] is not None and r["x1"] is not None]
    if not strata or len(whole) < len(strata):
        raise ValueError(f"{len(whole)} of {len(strata)} strata have two clips")
    spark, half = pairs.sparkSession, (len(strata) + 1) // 2
    limit = sum(x["seconds"] for r in strata for x in (r["x0"], r["x1"])) * 0.1 / 2
    # bit 1 takes the clip of the larger name, so that codes are ordered as the names are
    ordered = [(r["x0"], r["x1"]) if not i or r["x0"]["name"] < r["x1"]["name"] else (r["x1"], r["x0"]) for i, r in enumerate(strata)]

    def splits(part: list, fixed: int) -> DataFrame:
        """One row per split of a half: its code and what set 1 has more than set 2."""
        sign = [F.lit(1)] * fixed + [1 - 2 * F.getbit("id", F.lit(len(part) - 1 - i)).cast("int") for i in range(fixed, len(part))]
        more = lambda f: [x[f] - y[f] for x, y in part]
        total = lambda f, zero: reduce(lambda t, c: t + c, [s_ * F.lit(d) for s_, d in zip(sign, more(f))], F.lit(zero))
        rows = spark.range(2 ** (len(part) - fixed))
        return rows.select(F.col("id").alias("code"), total("passages", 0).cast("bigint").alias("p"), total("error", 0).cast("bigint").alias("e"), total("seconds", 0.0).cast("double").alias("s"))

    left, right = materialize(splits(ordered[:half], 1)), materialize(splits(ordered[half:], 0))
    best: tuple[float, int, int, int, float] | None = None
    for off in range(5):
        # gaps of passages and errors that together are worth off / 2; seconds are worth up to 1 more
        if best is not None and best[0] < off / 2:
            break
        gaps = [(p, e) for p in range(-2, 3) for e in range(-2, 3) if abs(p) + abs(e) == off]
        wanted = left.withColumn("g", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(e).alias("e")) for p, e in gaps])))
        asks = wanted.select((F.col("g.p") - F.col("p")).alias("p"), (F.col("g.e") - F.col("e")).alias("e"), (-F.col("s")).alias("s"), "code")
        offers = right.select("p", "e", "s", F.lit(None).cast("bigint").alias("code")).distinct()
        both = materialize(asks.unionByName(offers))
        there = F.when(F.col("code").isNull(), F.col("s"))
        below = running(both, ["p", "e"], F.floor(F.col("s") / 16), [F.col("s"), F.col("code").isNotNull()], there, "below", fn="max")
        above = running(both, ["p", "e"], F.floor(-F.col("s") / 16), [-F.col("s"), F.col("code").isNotNull()], -there, "above", fn="max")
        near = [d.where("code is not null").select("code", gap.alias("gap")) for d, gap in ((below, F.col("s") - F.col("below")), (above, -F.col("above") - F.col("s")))]
        scored = near[0].unionByName(near[1]).where(F.col("gap") <= limit).select("code", F.round(F.lit(off / 2) + F.col("gap") / limit, 9).alias("score"))
        first = scored.agg(F.min(F.struct("score", "code")).alias("b")).first()["b"]
        if first is not None and (best is None or tuple(first) < best[:2]):
            best = (first["score"], first["code"])
    if best is None:
        raise ValueError("no split keeps the sets within the tolerances")
    mine = left.where(F.col("code") == best[1]).first()
    gap = lambda c: F.abs(F.lit(mine[c]) + F.col(c))
    fits = (gap("p") <= 2) & (gap("e") <= 2) & (gap("s") <= limit)
    score = F.round(gap("p") / 2 + gap("e") / 2 + gap("s") / limit, 9)
    other = right.where(fits & (score == best[0])).agg(F.min("code").alias("c")).first()["c"]
    bits = [best[1] >> (half - 1 - i) & 1 for i in range(half)] + [other >> (len(strata) - 1 - i) & 1 for i in range(half, len(strata))]
    set_1, set_2 = [x[b] for x, b in zip(ordered, bits)], [x[1 - b] for x, b in zip(ordered, bits)]
    d_pass, d_sec, d_err = (abs(sum(x[f] for x in set_1) - sum(x[f] for x in set_2)) for f in ("passages", "seconds", "error"))
    row = ([x["name"] for x in set_1], [x["name"] for x in set_2], best[0], d_pass, d_sec, d_err)
    return spark.createDataFrame([row], "names array<string>, names_2 array<string>, score double, d_pass bigint, d_sec double, d_err bigint")


def practice_clips(pool: DataFrame, trial: DataFrame, seed: int) -> DataFrame:
    """One clip per camera that is in neither set, drawn by seed: camera, clip_name."""
    rest = pool.join(trial.select("clip_name"), "clip_name", "left_anti").withColumn("h", hash32(F.lit(seed), F.col("clip_name")))
    return rest.groupBy("camera").agg(F.min_by("clip_name", F.struct("h", "clip_name")).alias("clip_name"))


def assign_codes(practice: DataFrame, trial: DataFrame, seed: int) -> DataFrame:
    """Neutral codes and orders: code, clip_name, role, clip_set, place (from 0, within practice or the set).

    Practice clips are p01, p02, ... by camera; trial clips (clip_name, clip_set) are c01, c02, ...
    in one seeded order over both sets, so that a code says nothing of set or stratum. Each set
    is shown in a seeded order of its own.
    """
    row = lambda w: F.row_number().over(w)
    p = practice.withColumn("n", row(Window.partitionBy(F.lit(0)).orderBy("camera")))  # a clip per camera
    p = p.select(F.format_string("p%02d", "n").alias("code"), "clip_name", F.lit("practice").alias("role"), F.lit(None).cast("string").alias("clip_set"), (F.col("n") - 1).cast("bigint").alias("place"))
    coded = hash_order(trial.select("clip_name", "clip_set"), [], "clip_name", seed, "n").withColumn("code", F.format_string("c%02d", F.col("n") + 1))
    shown = hash_order(coded.drop("n"), ["clip_set"], "code", seed + 1, "place")
    return p.unionByName(shown.select("code", "clip_name", F.lit("trial").alias("role"), "clip_set", "place"))


def plan_day_chunks(days: DataFrame, bytes_per_frame: float, budget_bytes: float, key: str = "location") -> DataFrame:
    """Recording days in order, grouped so each group's frames fit the budget.

    ``days`` has (key, day, frames), one row per calendar day, so the folded array is bounded
    by the length of the calendar. A day over the budget gets a group of its own.
    """
    per = days.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("day", "frames"))).alias("d"))
    size = lambda x: x["frames"].cast("double") * bytes_per_frame
    start = F.struct(
        F.lit(0).alias("chunk"), F.lit(0.0).alias("used"), F.lit(0).alias("n"),
        F.expr("array() :: array<struct<day:date,chunk:int>>").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] > 0) & (acc["used"] + size(x) > budget_bytes)
        chunk = F.when(full, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(
            chunk.alias("chunk"),
            F.when(full, size(x)).otherwise(acc["used"] + size(x)).alias("used"),
            F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
            F.concat(acc["out"], F.array(F.struct(x["day"].alias("day"), chunk.alias("chunk")))).alias("out"),
        )

    folded = per.withColumn("o", F.aggregate("d", start, step, lambda acc: acc["out"]))
    return folded.select(key, F.explode("o").alias("o")).select(key, "o.day", "o.chunk")


def undercounted(clips: DataFrame, k: int, after: str = "") -> DataFrame:
    """The first ``k`` clip codes, in order, whose automatic counts are short in a direction.

    Raises if there are fewer than ``k``: the sample size is part of the design.
    """
    short = (F.col("auto_right") < F.col("ref_right")) | (F.col("auto_left") < F.col("ref_left"))
    found = clips.where(short & (F.col("code") >= after)).orderBy("code").limit(k)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    guard = F.when(n < k, F.raise_error(F.concat(F.lit("only "), n.cast("string"), F.lit(" undercounted clips"))).cast("string"))
    return found.withColumn("code", F.coalesce(guard, F.col("code")))
