"""Image-like operators on a cell grid: rows (clip_id, frame_index, y, x, value).

Pixels are rows, so a frame is spread over tasks and neighbourhoods are equi joins on shifted
coordinates. Medians are per cell or per row band; their inputs are bounded by the sampling
window or the frame size. Pixels opened from arrays are many more bytes than the files they
come from, so joins of whole pixel tables are told to sort (``merge``) and never broadcast one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalcount.session import materialize, materialize_counted

FRAME = ["clip_id", "frame_index"]
PIXEL = ["clip_id", "frame_index", "y", "x"]
# The scale of a median deviation and the detector's defaults.
MAD_SCALE = 1.4826


@dataclass(frozen=True)
class DetectorConfig:
    background_window: int = 61
    background_stride: int = 4
    background_update_every: int = 15
    noise_bands: int = 4
    fan_threshold: float = 2.0
    fan_erode: int = 5
    threshold_sigma: float = 4.0
    min_contrast: float = 8.0
    open_px: int = 3
    close_px: int = 5
    min_area: float = 1.0
    max_area: float = 1e9


def clip_background(cells: DataFrame) -> DataFrame:
    """Mean of a clip's frames per cell."""
    return cells.groupBy("clip_id", "y", "x").agg(F.avg("value").alias("background"))


def temporal_channels(cells: DataFrame, offset: float = 128.0) -> DataFrame:
    """Per cell: the value, its difference from the background, and the change to the next
    frame (the previous one for the last frame; 0 in a one-frame clip), rounded into 0..255."""
    w = Window.partitionBy("clip_id", "y", "x").orderBy("frame_index")
    other = F.coalesce(F.lead("value").over(w), F.lag("value").over(w), F.col("value"))
    byte = lambda c: F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(255.0)).cast("int")
    moved = cells.withColumn("other", other).hint("merge").join(clip_background(cells), ["clip_id", "y", "x"])
    return moved.select(
        *PIXEL, byte(F.col("value").cast("double")).alias("c0"),
        byte(F.lit(offset) + (F.col("value") - F.col("background"))).alias("c1"), byte(F.abs(F.col("other") - F.col("value"))).alias("c2"),
    )


def background_blocks(frames: DataFrame, c: DetectorConfig) -> DataFrame:
    """(clip, start, stop, sample frame): the frames whose median is the background of
    [start, stop). The window is centred on the block and shifted inward at the clip's ends.

    ``frames`` has (clip_id, n).
    """
    step, half, size = c.background_update_every, c.background_window // 2, c.background_window
    b = frames.withColumn("start", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"), F.lit(step))))
    b = b.withColumn("stop", F.least("n", F.col("start") + step))
    center = F.floor((F.col("start") + F.col("stop") - 1) / 2)
    b = b.withColumn("lo", F.greatest(F.lit(0), center - half)).withColumn("hi", F.least("n", center + half + 1))
    short = F.col("hi") - F.col("lo") < size
    lo = F.when(short & (F.col("lo") != 0), F.greatest(F.lit(0), F.col("n") - size)).otherwise(F.col("lo"))
    hi = F.when(short & (F.col("lo") == 0), F.least("n", F.lit(size))).otherwise(F.col("hi"))
    b = b.withColumn("__lo", lo).withColumn("__hi", hi)
    samples = F.sequence(F.col("__lo").cast("bigint"), (F.col("__hi") - 1).cast("bigint"), F.lit(c.background_stride).cast("bigint"))
    return b.select("clip_id", "start", "stop", F.explode(samples).alias("frame_index"))


def rolling_background(cells: DataFrame, c: DetectorConfig) -> DataFrame:
    """Median background per (clip, block, cell)."""
    n = cells.groupBy("clip_id").agg((F.max("frame_index") + 1).alias("n"))
    blocks = background_blocks(n, c)
    return cells.hint("merge").join(blocks, FRAME).groupBy("clip_id", "start", "y", "x").agg(F.percentile("value", F.lit(0.5)).alias("background"))


def differences(cells: DataFrame, c: DetectorConfig) -> DataFrame:
    """value - rolling background per cell and frame."""
    start = (F.floor(F.col("frame_index") / c.background_update_every) * c.background_update_every).cast("int")
    bg = rolling_background(cells, c)
    return cells.withColumn("start", start).hint("merge").join(bg, ["clip_id", "start", "y", "x"]).select(
        *PIXEL, (F.col("value") - F.col("background")).alias("diff")
    )


def square(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of the elliptic structuring element of an odd size."""
    r = size // 2
    out = []
    for dy in range(-r, r + 1):
        reach = round(r * math.sqrt((r * r - dy * dy) / (r * r))) if r else 0
        out += [(dy, dx) for dx in range(-reach, reach + 1)]
    return out


def _shifted(mask: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])).alias("m")
    keys = [c for c in mask.columns if c not in ("y", "x")]
    return mask.select(*keys, "y", "x", moves).select(*keys, (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"))


def dilate(mask: DataFrame, offsets: Sequence[tuple[int, int]], height: int, width: int) -> DataFrame:
    """Set cells and their neighbours, inside the grid."""
    grown = _shifted(mask, offsets).where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    return grown.distinct()


def erode(mask: DataFrame, offsets: Sequence[tuple[int, int]], height: int, width: int) -> DataFrame:
    """Cells whose every in-grid neighbour is set: as many votes as neighbours."""
    votes = _shifted(mask, [(-dy, -dx) for dy, dx in offsets])
    votes = votes.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    need = F.lit(0)
    for dy, dx in offsets:
        y, x = F.col("y") + dy, F.col("x") + dx
        need = need + ((y >= 0) & (y < height) & (x >= 0) & (x < width)).cast("int")
    counted = votes.groupBy(*mask.columns).agg(F.count(F.lit(1)).alias("__n"))
    return counted.where(F.col("__n") == need).drop("__n")


def open_close(mask: DataFrame, c: DetectorConfig, height: int, width: int) -> DataFrame:
    for size, first, second in ((c.open_px, erode, dilate), (c.close_px, dilate, erode)):
        if size > 1:
            k = ellipse(size)
            mask = second(first(mask, k, height, width), k, height, width)
    return mask


def active_area(cells: DataFrame, c: DetectorConfig, height: int, width: int) -> DataFrame:
    """Cells (clip, y, x) inside the active area: a bright temporal median, shrunk at its edge."""
    n = cells.groupBy("clip_id").agg((F.max("frame_index") + 1).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 32))
    sampled = cells.join(n, "clip_id").where(F.col("frame_index") % step == 0)
    lit = sampled.groupBy("clip_id", "y", "x").agg(F.percentile("value", F.lit(0.5)).alias("m")).where(F.col("m") > c.fan_threshold)
    return erode(lit.select("clip_id", "y", "x"), square(c.fan_erode), height, width)


def row_bands(area: DataFrame, count: int) -> DataFrame:
    """(clip, band, lo, hi, a, b): rows [a, b) estimate the band, rows [lo, hi) use it.

    Edges split the active rows evenly; the first and last band extend to the grid's ends.
    """
    ends = area.groupBy("clip_id").agg(F.min("y").alias("r0"), (F.max("y") + 1).alias("r1"))
    edge = lambda i: F.bround(F.col("r0") + (F.col("r1") - F.col("r0")) * F.lit(i) / F.lit(count)).cast("int")
    bands = F.array(*[F.struct(F.lit(i).alias("i"), edge(i).alias("a"), edge(i + 1).alias("b")) for i in range(count)])
    b = ends.withColumn("s", F.filter(bands, lambda s: s["b"] > s["a"]))
    b = b.select("clip_id", F.size("s").alias("k"), F.posexplode("s").alias("band", "s"))
    return b.select(
        "clip_id", "band", F.when(F.col("band") == 0, F.lit(-1)).otherwise(F.col("s.a")).alias("lo"),
        F.when(F.col("band") == F.col("k") - 1, F.lit(2**30)).otherwise(F.col("s.b")).alias("hi"), F.col("s.a").alias("a"), F.col("s.b").alias("b"),
    )


def band_rows(bands: DataFrame, height: int) -> DataFrame:
    """(clip, y, band, estimates): which band a row uses, and whether it feeds the estimate."""
    rows = bands.withColumn("y", F.explode(F.sequence(F.greatest("lo", F.lit(0)), F.least(F.col("hi"), F.lit(height)) - 1)))
    return rows.select("clip_id", "y", "band", ((F.col("y") >= F.col("a")) & (F.col("y") < F.col("b"))).alias("estimates"))


def noise(diff: DataFrame, area: DataFrame, rows: DataFrame) -> DataFrame:
    """Robust centre and spread per (clip, frame, band): median and 1.4826 MAD (1 if zero)."""
    values = diff.join(area, ["clip_id", "y", "x"]).join(rows.where("estimates"), ["clip_id", "y"])
    band = [*FRAME, "band"]
    med = values.groupBy(*band).agg(F.percentile("diff", F.lit(0.5)).alias("center"))
    dev = values.join(med, band).groupBy(*band, "center").agg(F.percentile(F.abs(F.col("diff") - F.col("center")), F.lit(0.5)).alias("mad"))
    mad = F.col("mad") * MAD_SCALE
    return dev.select(*band, "center", F.when(mad == 0, F.lit(1.0)).otherwise(mad).alias("spread"))


def foreground(diff: DataFrame, area: DataFrame, rows: DataFrame, stats: DataFrame, c: DetectorConfig) -> DataFrame:
    """Active cells brighter than the band's threshold."""
    cells = diff.join(area, ["clip_id", "y", "x"]).join(rows.select("clip_id", "y", "band"), ["clip_id", "y"])
    s = cells.join(stats, [*FRAME, "band"], "left")
    center, spread = F.coalesce("center", F.lit(0.0)), F.coalesce("spread", F.lit(1.0))
    limit = F.greatest(center + c.threshold_sigma * spread, F.lit(c.min_contrast))
    return s.where(F.col("diff") > limit).select(*PIXEL)


def label_components(mask: DataFrame, width: int) -> DataFrame:
    """8-connected components: (pixel, label), the label being the component's smallest index.

    Every round each cell takes the smallest label around it and then its label's label, so
    chains halve; rounds stop when nothing changes.
    """
    cells = materialize(mask.select(*PIXEL, (F.col("y") * width + F.col("x")).cast("bigint").alias("node")))
    around = [(dy, dx) for dy, dx in square(3) if (dy, dx) != (0, 0)]
    pairs = _shifted(cells.select(*FRAME, "node", "y", "x"), around).withColumnRenamed("node", "src")
    edges = materialize(pairs.join(cells, PIXEL).select(*FRAME, "src", F.col("node").alias("dst")))
    labels = cells.select(*FRAME, "node", F.col("node").alias("label"))
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "src"), [*FRAME, "src"]).groupBy(*FRAME, F.col("dst").alias("node")).agg(
            F.min("label").alias("near")
        )
        low = labels.join(seen, [*FRAME, "node"], "left").select(*FRAME, "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        low = materialize(low)
        jump = low.select(*FRAME, F.col("node").alias("label"), F.col("label").alias("via"))
        step = low.join(jump, [*FRAME, "label"], "left").select(*FRAME, "node", "old", F.least("label", "via").alias("label"))
        nxt, changed = materialize_counted(step, F.col("label") != F.col("old"))
        labels = nxt.drop("old")
        if not changed:
            return cells.join(labels, [*FRAME, "node"]).select(*PIXEL, "label")


def component_boxes(labels: DataFrame, diff: DataFrame, rows: DataFrame, stats: DataFrame, c: DetectorConfig, height: int) -> DataFrame:
    """Boxes, area and noise-scaled contrast of the components within the area limits."""
    comp = labels.join(diff, PIXEL).groupBy(*FRAME, "label").agg(
        F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"),
        F.count(F.lit(1)).alias("area"), F.avg("diff").alias("contrast"),
    ).where(F.col("area").between(c.min_area, c.max_area))
    row = F.least(F.col("top") + F.floor((F.col("bottom") - F.col("top") + 1) / 2), F.lit(height - 1)).cast("int")
    banded = comp.withColumn("y", row).join(rows.select("clip_id", "y", "band"), ["clip_id", "y"])
    s = banded.join(stats, [*FRAME, "band"], "left")
    score = (F.col("contrast") - F.coalesce("center", F.lit(0.0))) / F.coalesce("spread", F.lit(1.0))
    return s.select(
        *FRAME, F.col("label").alias("det_id"), F.col("left").cast("double").alias("x_min"), F.col("top").cast("double").alias("y_min"),
        (F.col("right") + 1).cast("double").alias("x_max"), (F.col("bottom") + 1).cast("double").alias("y_max"), "area", score.alias("score"),
    )


def detect(cells: DataFrame, c: DetectorConfig, height: int, width: int) -> DataFrame:
    """Moving bright objects: boxes with scores, from background to components."""
    area = materialize(active_area(cells, c, height, width))
    rows = band_rows(row_bands(area, c.noise_bands), height)
    diff = materialize(differences(cells, c))
    stats = materialize(noise(diff, area, rows))
    mask = open_close(foreground(diff, area, rows, stats, c), c, height, width)
    return component_boxes(label_components(mask, width), diff, rows, stats, c, height)


def box_contrast(boxes: DataFrame, cells: DataFrame, offsets: Sequence[int], height: int, width: int) -> DataFrame:
    """Mean brightness inside each box minus the mean of a ring around it, ``offset`` frames
    away, per box and offset.

    A box is expanded to the cells of its padded area, which the grid's size bounds, and meets
    the pixels in an equi join.
    """
    edge = lambda c, fn: fn(F.col(c)).cast("int")
    zero = F.lit(0)
    b = boxes.select(
        "clip_id", "track_id", "frame_index",
        F.greatest(zero, edge("x_min", F.floor)).alias("x0"), F.greatest(zero, edge("y_min", F.floor)).alias("y0"),
        F.least(F.lit(width), edge("x_max", F.ceil)).alias("x1"), F.least(F.lit(height), edge("y_max", F.ceil)).alias("y1"),
    ).where("x1 > x0 and y1 > y0")
    pad = F.greatest(F.lit(3), F.floor(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2)).cast("int")
    b = b.withColumn("p", pad).withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    ys = F.sequence(F.greatest(zero, F.col("y0") - F.col("p")), F.least(F.lit(height), F.col("y1") + F.col("p")) - 1)
    xs = F.sequence(F.greatest(zero, F.col("x0") - F.col("p")), F.least(F.lit(width), F.col("x1") + F.col("p")) - 1)
    area = b.withColumn("y", F.explode(ys)).withColumn("x", F.explode(xs)).withColumn("at", F.col("frame_index") + F.col("offset"))
    pixels = cells.select("clip_id", F.col("frame_index").alias("at"), "y", "x", "value")
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    per = area.join(pixels.hint("merge"), ["clip_id", "at", "y", "x"]).groupBy("clip_id", "track_id", "frame_index", "offset").agg(
        F.avg(F.when(inside, F.col("value"))).alias("i"), F.avg(F.when(~inside, F.col("value"))).alias("o")
    )
    return per.select("clip_id", "track_id", "frame_index", "offset", (F.col("i") - F.col("o")).alias("contrast")).where("contrast is not null")


def contrast_by_offset(contrasts: DataFrame) -> DataFrame:
    return contrasts.groupBy("offset").agg(F.round(F.avg("contrast"), 6).alias("contrast"), F.count(F.lit(1)).alias("boxes"))
