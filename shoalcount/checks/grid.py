"""Cell-grid and tracking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalcount import adapters as ad
from shoalcount.checks import adapter_sql as q
from shoalcount.checks import counting as cc
from shoalcount.operators import counting as ct
from shoalcount.operators import grid as gr
from shoalcount.operators import tracking as tk
from shoalcount.operators.ordered import position
from shoalcount.plans import experiments as ex

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
N = ad.GRID
CONF = gr.DetectorConfig(
    background_window=21, background_stride=2, background_update_every=8, noise_bands=2, fan_threshold=100.0, fan_erode=3,
    threshold_sigma=1.0, min_contrast=8.0, open_px=1, close_px=3,
)


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query("WITH " + q.CELLS + " SELECT clip_id, y, x, round(avg(value),6) AS background FROM cells GROUP BY 1,2,3")
def clip_background(s, d):
    return gr.clip_background(ad.cells(s, d)).withColumn("background", F.round("background", 6))


@query("WITH " + q.CELLS + """, b AS (SELECT *, avg(value) OVER (PARTITION BY clip_id, y, x) AS bg, coalesce(lead(value) OVER w, lag(value) OVER w, value) AS o FROM cells WINDOW w AS (PARTITION BY clip_id, y, x ORDER BY frame_index))
  SELECT clip_id, frame_index, y, x, value AS c0, least(greatest(round_even(128+(value-bg),0),0),255)::INT AS c1, abs(o-value) AS c2 FROM b""")
def temporal_channels(s, d):
    return gr.temporal_channels(ad.cells(s, d))


BLOCKS = "WITH RECURSIVE " + q.CELLS + """, n AS (SELECT clip_id, max(frame_index)+1 AS n FROM cells GROUP BY 1),
 bl0 AS (SELECT clip_id, n, unnest(range(0,n,8)) AS start FROM n), bl1 AS (SELECT *, least(n,start+8) AS stop, (start+least(n,start+8)-1)//2 AS c FROM bl0),
 bl2 AS (SELECT *, greatest(0,c-10) AS lo0, least(n,c+11) AS hi0 FROM bl1),
 bl AS (SELECT clip_id, start, stop, CASE WHEN hi0-lo0<21 AND lo0<>0 THEN greatest(0,n-21) ELSE lo0 END AS lo, CASE WHEN hi0-lo0<21 AND lo0=0 THEN least(n,21) ELSE hi0 END AS hi FROM bl2),
 sm AS (SELECT clip_id, start, unnest(range(lo,hi,2)) AS frame_index FROM bl),
 bg AS (SELECT clip_id, start, y, x, quantile_cont(value, 0.5::DOUBLE) AS background FROM cells JOIN sm USING (clip_id, frame_index) GROUP BY 1,2,3,4)"""


@query(BLOCKS + " SELECT * FROM bg")
def rolling_background(s, d):
    return gr.rolling_background(ad.cells(s, d), CONF)


AREA = BLOCKS + """, df AS (SELECT c.clip_id, c.frame_index, c.y, c.x, value-background AS diff FROM cells c JOIN bg ON bg.clip_id=c.clip_id AND bg.start=(c.frame_index//8)*8 AND bg.y=c.y AND bg.x=c.x),
 lit AS (SELECT clip_id, y, x FROM cells JOIN n USING (clip_id) WHERE frame_index%greatest(1,n//32)=0 GROUP BY 1,2,3 HAVING quantile_cont(value,0.5::DOUBLE)>100),
 ar AS (SELECT clip_id, y, x FROM (SELECT DISTINCT clip_id, y, x FROM cells) c WHERE NOT EXISTS (SELECT 1 FROM range(-1,2) a(dy), range(-1,2) b(dx) WHERE c.y+dy BETWEEN 0 AND 7 AND c.x+dx BETWEEN 0 AND 7
   AND (c.clip_id, c.y+dy, c.x+dx) NOT IN (SELECT (clip_id, y, x) FROM lit))),
 rr AS (SELECT clip_id, min(y) AS r0, max(y)+1 AS r1 FROM ar GROUP BY 1),
 bd0 AS (SELECT clip_id, i, round_even(r0+(r1-r0)*i/2.0::DOUBLE,0)::INT AS a, round_even(r0+(r1-r0)*(i+1)/2.0::DOUBLE,0)::INT AS b FROM rr, range(2) z(i)),
 bd AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY i)-1 AS band, count(*) OVER (PARTITION BY clip_id) AS k FROM bd0 WHERE b>a),
 br AS (SELECT clip_id, y, band, y>=a AND y<b AS est FROM bd, range(8) z(y) WHERE y>=CASE WHEN band=0 THEN 0 ELSE a END AND y<CASE WHEN band=k-1 THEN 8 ELSE b END),
 vl AS (SELECT df.clip_id, frame_index, band, diff FROM df JOIN ar USING (clip_id, y, x) JOIN br USING (clip_id, y) WHERE est),
 md AS (SELECT clip_id, frame_index, band, quantile_cont(diff,0.5::DOUBLE) AS center FROM vl GROUP BY 1,2,3),
 nz AS (SELECT clip_id, frame_index, band, center, CASE WHEN quantile_cont(abs(diff-center),0.5::DOUBLE)=0 THEN 1.0 ELSE quantile_cont(abs(diff-center),0.5::DOUBLE)*1.4826::DOUBLE END AS spread FROM vl JOIN md USING (clip_id, frame_index, band) GROUP BY 1,2,3,4),
 fg AS (SELECT df.clip_id, df.frame_index, df.y, df.x FROM df JOIN ar USING (clip_id, y, x) JOIN br USING (clip_id, y) LEFT JOIN nz USING (clip_id, frame_index, band) WHERE diff>greatest(coalesce(center,0)+coalesce(spread,1), 8))"""


def parts(s, d):
    cells = ad.cells(s, d)
    area = gr.materialize(gr.active_area(cells, CONF, N, N))
    rows = gr.band_rows(gr.row_bands(area, CONF.noise_bands), N)
    diff = gr.materialize(gr.differences(cells, CONF))
    return area, rows, diff, gr.noise(diff, area, rows)


@query(AREA + " SELECT * FROM ar")
def active_area(s, d):
    return gr.active_area(ad.cells(s, d), CONF, N, N)


@query(AREA + " SELECT clip_id, frame_index, band, round(center,6) AS center, round(spread,6) AS spread FROM nz")
def band_noise(s, d):
    r = lambda c: F.round(c, 6).alias(c)
    return parts(s, d)[3].select("clip_id", "frame_index", "band", r("center"), r("spread"))


@query(AREA + " SELECT * FROM fg")
def foreground_cells(s, d):
    area, rows, diff, stats = parts(s, d)
    return gr.foreground(diff, area, rows, stats, CONF)


CROSS = "(VALUES (0,0),(0,1),(0,-1),(1,0),(-1,0)) o(dy,dx)"
CLOSED = AREA + f""", dl AS (SELECT DISTINCT clip_id, frame_index, y+dy AS y, x+dx AS x FROM fg, {CROSS} WHERE y+dy BETWEEN 0 AND 7 AND x+dx BETWEEN 0 AND 7),
 cl AS (SELECT d.* FROM dl d WHERE NOT EXISTS (SELECT 1 FROM {CROSS} WHERE d.y+dy BETWEEN 0 AND 7 AND d.x+dx BETWEEN 0 AND 7 AND (d.clip_id, d.frame_index, d.y+dy, d.x+dx) NOT IN (SELECT (clip_id, frame_index, y, x) FROM dl)))"""


def closed_mask(s, d):
    area, rows, diff, stats = parts(s, d)
    stats = gr.materialize(stats)
    return gr.materialize(gr.open_close(gr.foreground(diff, area, rows, stats, CONF), CONF, N, N)), diff, rows, stats


@query(CLOSED + " SELECT * FROM cl")
def closed_cells(s, d):
    return closed_mask(s, d)[0]


@query(AREA + f""", er AS (SELECT f.* FROM fg f WHERE NOT EXISTS (SELECT 1 FROM {CROSS} WHERE f.y+dy BETWEEN 0 AND 7 AND f.x+dx BETWEEN 0 AND 7 AND (f.clip_id, f.frame_index, f.y+dy, f.x+dx) NOT IN (SELECT (clip_id, frame_index, y, x) FROM fg)))
  SELECT DISTINCT clip_id, frame_index, y+dy AS y, x+dx AS x FROM er, {CROSS} WHERE y+dy BETWEEN 0 AND 7 AND x+dx BETWEEN 0 AND 7""")
def opened_cells(s, d):
    area, rows, diff, stats = parts(s, d)
    k = gr.ellipse(3)
    return gr.dilate(gr.erode(gr.foreground(diff, area, rows, stats, CONF), k, N, N), k, N, N)


COMP = CLOSED + """, rc AS (SELECT clip_id, frame_index, y, x, y*8+x AS l FROM cl UNION SELECT a.clip_id, a.frame_index, a.y, a.x, r.l FROM rc r JOIN cl a ON a.clip_id=r.clip_id AND a.frame_index=r.frame_index
   AND abs(a.y-r.y)<=1 AND abs(a.x-r.x)<=1 AND r.l<a.y*8+a.x),
 lb AS (SELECT clip_id, frame_index, y, x, min(l) AS label FROM rc GROUP BY 1,2,3,4)"""


@query(COMP + " SELECT * FROM lb")
def connected_components(s, d):
    return gr.label_components(closed_mask(s, d)[0], N)


@query(COMP + """, bx AS (SELECT clip_id, frame_index, label, min(lb.x) AS l, min(lb.y) AS t, max(lb.x) AS r, max(lb.y) AS b, count(*) AS area, avg(diff) AS contrast FROM lb JOIN df USING (clip_id, frame_index, y, x) GROUP BY 1,2,3)
  SELECT bx.clip_id, bx.frame_index, label AS det_id, l::DOUBLE AS x_min, t::DOUBLE AS y_min, (r+1)::DOUBLE AS x_max, (b+1)::DOUBLE AS y_max, area, round((contrast-coalesce(center,0))/coalesce(spread,1),6) AS score FROM bx
  JOIN br ON br.clip_id=bx.clip_id AND br.y=least(t+(b-t+1)//2,7) LEFT JOIN nz ON nz.clip_id=bx.clip_id AND nz.frame_index=bx.frame_index AND nz.band=br.band""")
def moving_objects(s, d):
    return gr.detect(ad.cells(s, d), CONF, N, N).withColumn("score", F.round("score", 6))


CONTRAST = "WITH " + q.CELLS + """, bxs AS (SELECT label AS clip_id, vec_id AS track_id, frame_index, vec_id%7 AS x0, vec_id%5 AS y0, vec_id%7+1+vec_id%3 AS x1, vec_id%5+1+vec_id%2 AS y1 FROM
   (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS frame_index FROM embeddings)),
 bc AS (SELECT clip_id, track_id, frame_index, x0, y0, least(8,x1) AS x1, least(8,y1) AS y1, greatest(3,greatest(least(8,x1)-x0,least(8,y1)-y0)//2) AS p, o FROM bxs, range(-1,2) z(o)),
 pr AS (SELECT b.clip_id, b.track_id, b.frame_index, o AS "offset", avg(value) FILTER (c.x>=x0 AND c.x<x1 AND c.y>=y0 AND c.y<y1) - avg(value) FILTER (NOT (c.x>=x0 AND c.x<x1 AND c.y>=y0 AND c.y<y1)) AS contrast
   FROM bc b JOIN cells c ON c.clip_id=b.clip_id AND c.frame_index=b.frame_index+o AND c.x>=x0-p AND c.x<x1+p AND c.y>=y0-p AND c.y<y1+p GROUP BY 1,2,3,4)"""


def grid_boxes(s, d):


    e = ad.table(s, d, "embeddings").selectExpr("vec_id", "bigint(label) as clip_id")
    e = position(e, ["clip_id"], F.expr("vec_id div 256"), [F.col("vec_id")], "frame_index")
    return e.selectExpr(
        "clip_id", "vec_id as track_id", "frame_index", "double(vec_id % 7) as x_min", "double(vec_id % 5) as y_min",
        "double(vec_id % 7 + 1 + vec_id % 3) as x_max", "double(vec_id % 5 + 1 + vec_id % 2) as y_max",
    )


@query(CONTRAST + ' SELECT clip_id, track_id, frame_index, "offset", round(contrast,6) AS contrast FROM pr WHERE contrast IS NOT NULL')
def box_contrast(s, d):
    return gr.box_contrast(grid_boxes(s, d), ad.cells(s, d), [-1, 0, 1], N, N).withColumn("contrast", F.round("contrast", 6))


@query(CONTRAST + ' SELECT "offset", round(avg(contrast),6) AS contrast, count(*) AS boxes FROM pr WHERE contrast IS NOT NULL GROUP BY 1')
def contrast_by_offset(s, d):
    return gr.contrast_by_offset(gr.box_contrast(grid_boxes(s, d), ad.cells(s, d), [-1, 0, 1], N, N))


# --- tracking (no SQL twin: a recursion with optimal assignment) ----------------------------

MX, MY = 12.0 / ad.WIDTH, 9.0 / ad.HEIGHT


@query()
def kalman_tracks(s, d):
    return tk.track(ad.detections(s, d), [tk.KalmanConfig(gate_m=0.6)], MX, MY)


@query()
def bytetrack_tracks(s, d):
    return tk.track(ad.detections(s, d), [tk.ByteTrackConfig()], MX, MY)


@query()
def tracked_counts(s, d):
    return ct.tally(ct.count_trajectories(kalman_tracks(s, d), cc.W, cc.H))


@query()
def tracker_grid(s, d):
    """Trackers x thresholds on one detection table, evaluated against the reference."""
    configs = [
        tk.KalmanConfig("current", gate_m=0.6), tk.KalmanConfig("tight", gate_m=0.3), tk.KalmanConfig("patient", gate_m=0.6, max_age=6),
        tk.KalmanConfig("strict", gate_m=0.6, score_threshold=0.4), tk.ByteTrackConfig("bytetrack"),
    ]
    return ex.evaluate_trackers(ad.detections(s, d), cc.ref_tracks(s, d), ad.clips(s, d), configs, MX, MY, ad.WIDTH, ad.HEIGHT)


@query("WITH " + q.PRED + ", t AS (SELECT *, dense_rank() OVER (PARTITION BY clip_id ORDER BY track_id) AS new_id FROM pred) SELECT clip_id, track_id, new_id, count(*) AS n FROM t GROUP BY 1,2,3")
def renumbered_tracks(s, d):
    return tk.dense_track_ids(ad.predicted_boxes(s, d)).groupBy("clip_id", "track_id", "new_id").agg(F.count(F.lit(1)).alias("n"))
