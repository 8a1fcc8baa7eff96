"""Validation of whole recordings to manifest rows, for full recordings and for windows of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalcount import adapters as ad
from shoalcount.plans import analyses as an
from shoalcount.session import materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return register


def _recordings(s, d):
    """A recording per supplier: named, placed, some with a wrong name."""
    place = F.get(F.array(*[F.lit(x) for x in ("kenai-train", "kenai-val", "kenai-rightbank", "kenai-channel", "elwha", "nushagak")]), (F.col("clip_id") % 6).cast("int"))
    name = F.format_string("2018-06-%02d_000000_%d_%d", 1 + F.col("clip_id") % 28, F.col("clip_id") * 1000, F.col("clip_id") * 1000 + F.when(F.col("clip_id") % 9 == 4, 101).otherwise(100))
    return materialize(ad.table(s, d, "supplier").select(F.col("s_suppkey").alias("clip_id")).withColumns({"location": place, "clip_name": name}))


def _rows(s, d):
    """Annotation rows: those of even recordings are sound, those of odd ones of uneven quality."""
    bad = ad.dataset_boxes(s, d).where("clip_id % 2 = 1")
    sound = ad.table(s, d, "lineitem").where("l_suppkey % 2 = 0").selectExpr(
        "l_suppkey as clip_id", "l_orderkey * 8 + l_linenumber as track_id", "l_partkey % 100 as frame_index", "double(l_orderkey % 600) as x_min", "double(l_partkey % 400) as y_min",
        "double(l_orderkey % 600 + 30) as x_max", "double(l_partkey % 400 + 20) as y_max",
    )
    return bad.unionByName(sound)


def _text(rows):
    """The rows as stored text, as files would hold it."""
    number = [F.format_string("%.3f", c) for c in (F.col("x_min") + 1, F.col("y_min") + 1, F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))]
    line = F.concat_ws(",", (F.col("frame_index") + 1).cast("string"), F.col("track_id").cast("string"), *number, F.lit("1.0,-1,-1,-1"))
    damaged = (F.col("clip_id") % 12 == 7) & (F.col("frame_index") % 10 == 3)
    line = F.when(damaged, F.concat(line, F.lit(",9"))).otherwise(line)
    return materialize(rows.select("clip_id", (F.col("frame_index") * 1000000 + F.col("track_id")).alias("line_number"), line.alias("line")))


def _inputs(s, d, lo, hi):
    clips = _recordings(s, d)
    rows = _rows(s, d).where("clip_id % 10 <> 3")
    frames = clips.where("clip_id % 8 <> 6 and clip_id % 11 <> 9").select("clip_id", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("frame_index")).where("clip_id % 5 <> 2 or frame_index % 13 <> 5")
    wide = "case when frame_index % 40 = 39 and clip_id % 4 = 1 then null when frame_index % 50 = 49 and clip_id % 3 = 0 then 641 when frame_index % 60 = 59 and clip_id % 7 = 2 then 600 else 640 end"
    frames = frames.selectExpr("clip_id", "frame_index", f"{wide} as image_width", f"if(({wide}) is null, null, 480) as image_height")
    empty = clips.where("clip_id % 11 = 9 and clip_id % 8 <> 6").selectExpr("clip_id", "null as frame_index", "null as image_width", "null as image_height")
    meta = clips.where("clip_id % 13 <> 5").withColumns({"num_frames": F.lit(100), "width": F.lit(640), "height": F.lit(480), "framerate": F.lit(10.0)})
    files = clips.where("clip_id % 10 <> 3").withColumn("gt_sha256", F.sha2(F.col("clip_id").cast("string"), 256))
    return files, rows, meta, clips.where("clip_id % 4 <> 0"), frames.unionByName(empty), clips.where("location = 'kenai-train' and clip_id % 5 = 1").select("clip_name")


def _full(s, d):
    files, rows, meta, checked, frames, holdout = _inputs(s, d, 0, 104)
    return an.validate_to_manifest(files, _text(rows), meta, checked, frames, holdout)


def _window(s, d):
    files, rows, meta, checked, frames, holdout = _inputs(s, d, 30, 69)
    near = rows.where("frame_index between 30 and 69 and clip_id % 14 <> 6")
    moved = near.withColumn("y_max", F.col("y_max") + F.when((F.col("clip_id") % 7 == 1) & (F.col("track_id") % 5 == 0), 1).otherwise(0))
    return an.validate_to_manifest(files, _text(rows), meta, checked, frames, holdout, files.where("clip_id % 14 <> 6"), _text(moved))


BASE = """WITH cl AS (SELECT s_suppkey AS clip_id, ['kenai-train','kenai-val','kenai-rightbank','kenai-channel','elwha','nushagak'][s_suppkey%6+1] AS location,
   format('2018-06-{:02d}_000000_{}_{}', 1+s_suppkey%28, s_suppkey*1000, s_suppkey*1000+CASE WHEN s_suppkey%9=4 THEN 101 ELSE 100 END) AS clip_name,
   s_suppkey%13<>5 AS meta, s_suppkey%10<>3 AS file, s_suppkey%4<>0 AS chk FROM supplier),
 rw AS (SELECT l_suppkey AS clip_id, l_orderkey%40 AS track_id, l_partkey%120 AS frame_index, (trunc(l_extendedprice)::BIGINT%700-30)::DOUBLE AS x_min,
    (l_orderkey%500-10)::DOUBLE AS y_min, (trunc(l_extendedprice)::BIGINT%700-30)::DOUBLE+l_quantity-2 AS x_max, (l_orderkey%500-10)::DOUBLE+l_linenumber*5 AS y_max FROM lineitem WHERE l_suppkey%2=1 AND l_suppkey%10<>3
   UNION ALL SELECT l_suppkey, l_orderkey*8+l_linenumber, l_partkey%100, l_orderkey%600, l_partkey%400, l_orderkey%600+30, l_partkey%400+20 FROM lineitem WHERE l_suppkey%2=0 AND l_suppkey%10<>3),
 torn AS (SELECT DISTINCT clip_id FROM rw WHERE clip_id%12=7 AND frame_index%10=3),
 ok AS (SELECT * FROM cl WHERE meta AND file AND clip_id NOT IN (SELECT clip_id FROM torn)),
 im AS (SELECT clip_id, f, CASE WHEN f%40=39 AND clip_id%4=1 THEN NULL WHEN f%50=49 AND clip_id%3=0 THEN 641 WHEN f%60=59 AND clip_id%7=2 THEN 600 ELSE 640 END AS w
   FROM (SELECT clip_id, unnest(range(%(lo)s, %(hi)s+1)) AS f FROM ok WHERE chk AND clip_id%8<>6 AND clip_id%11<>9) WHERE clip_id%5<>2 OR f%13<>5),
 fr AS (SELECT clip_id, count(*) AS files, min(f) AS lo, max(f) AS hi FROM im GROUP BY 1),
 st AS (SELECT ok.*, files, %(start)s AS a, %(stop)s AS b FROM ok LEFT JOIN fr USING (clip_id) %(only)s),
 al AS (SELECT rw.* FROM rw JOIN ok USING (clip_id)),
 bx AS (SELECT rw.* FROM rw JOIN st USING (clip_id) WHERE frame_index>=a AND frame_index<b),
 i AS (SELECT clip_id, 'invalid_clip_name' AS code, 1 AS n FROM cl WHERE meta AND clip_id%9=4
  UNION ALL SELECT clip_id, 'missing_metadata', 1 FROM cl WHERE NOT meta AND file UNION ALL SELECT clip_id, 'missing_annotations', 1 FROM cl WHERE meta AND NOT file
  UNION ALL SELECT clip_id, 'mot_format', 1 FROM cl JOIN torn USING (clip_id) WHERE meta
  UNION ALL SELECT clip_id, 'missing_clip_directory', 1 FROM ok WHERE chk AND clip_id%8=6
  UNION ALL SELECT clip_id, 'missing_frames', 1 FROM ok WHERE chk AND clip_id%8<>6 AND clip_id%11=9
  UNION ALL SELECT clip_id, 'missing_frames', %(gone)s FROM im GROUP BY 1
  UNION ALL SELECT clip_id, 'frame_window_out_of_range', count(*) FROM im WHERE f>=100 GROUP BY 1
  UNION ALL SELECT clip_id, CASE WHEN w IS NULL THEN 'unreadable_frame' WHEN w=641 THEN 'image_size_differs_slightly' ELSE 'image_size_mismatch' END, count(*) FROM im WHERE w IS NULL OR w<>640 GROUP BY 1,2
  UNION ALL SELECT clip_id, 'frame_out_of_range', count(*) FROM al WHERE frame_index>=100 GROUP BY 1
  UNION ALL SELECT clip_id, 'duplicate_track_frame', sum(k-1) FROM (SELECT clip_id, track_id, frame_index, count(*) AS k FROM bx GROUP BY 1,2,3) WHERE k>1 GROUP BY 1
  UNION ALL SELECT clip_id, CASE WHEN x_max<=x_min OR y_max<=y_min THEN 'non_positive_box_size' WHEN x_max<=0 OR y_max<=0 OR x_min>=640 OR y_min>=480 THEN 'box_outside_image' ELSE 'box_partially_outside_image' END, count(*)
    FROM bx WHERE x_max<=x_min OR y_max<=y_min OR x_min<0 OR y_min<0 OR x_max>640 OR y_max>480 GROUP BY 1,2 %(more)s),
 iss AS (SELECT * FROM i WHERE n>0), """
_WARN = "('box_partially_outside_image','image_size_differs_slightly','unexpected_file','missing_tiny_annotations','no_boxes_in_window')"
BASE += f"""why AS (SELECT clip_id, bool_or(code NOT IN {_WARN}) AS bad, coalesce(string_agg(code, ',' ORDER BY code) FILTER (code NOT IN {_WARN}), '') AS reasons,
   coalesce(string_agg(code, ',' ORDER BY code) FILTER (code IN {_WARN}), '') AS warnings FROM iss GROUP BY 1),
 tr AS (SELECT clip_id, count(*) AS boxes, count(DISTINCT track_id) AS tracks FROM bx GROUP BY 1) """


def _filled(parts):
    text = BASE
    for name, part in parts.items():
        text = text.replace(f"%({name})s", part)
    return text


FULL = _filled({"lo": "0", "hi": "104", "start": "0", "stop": "100", "only": "", "gone": "100-count(*) FILTER (f<100)", "more": ""})
WINDOW = _filled({
    "lo": "30", "hi": "69", "start": "lo", "stop": "hi+1", "only": "WHERE files IS NOT NULL", "gone": "max(f)-min(f)+1-count(*)",
    "more": """UNION ALL SELECT clip_id, 'missing_tiny_annotations', 1 FROM st WHERE clip_id%14=6
  UNION ALL SELECT clip_id, 'no_boxes_in_window', 1 FROM st WHERE clip_id NOT IN (SELECT clip_id FROM bx)
  UNION ALL SELECT clip_id, 'tiny_rows_not_in_gt', count(*) FROM (SELECT clip_id, track_id, frame_index, x_min, y_min, x_max, y_max+1 AS y_max FROM al WHERE frame_index BETWEEN 30 AND 69 AND clip_id%7=1 AND track_id%5=0) t
    WHERE clip_id IN (SELECT clip_id FROM st) AND clip_id%14<>6 AND NOT EXISTS (SELECT 1 FROM al WHERE al.clip_id=t.clip_id AND al.track_id=t.track_id AND al.frame_index=t.frame_index AND al.x_min=t.x_min AND al.y_min=t.y_min AND al.x_max=t.x_max AND al.y_max=t.y_max) GROUP BY 1""",
})
ISSUES = f" SELECT clip_id, code, CASE WHEN code IN {_WARN} THEN 'warning' ELSE 'error' END AS severity, n AS count FROM iss"
MANIFEST = """SELECT location, clip_name, CASE WHEN bad THEN 'quarantined' WHEN bad IS NOT NULL THEN 'warning' ELSE 'ok' END AS status, NOT coalesce(bad, false) AS usable, coalesce(reasons, '') AS reasons, coalesce(warnings, '') AS warnings,
   CASE WHEN location='kenai-train' AND clip_id%5=1 THEN 'holdout' WHEN location='kenai-train' THEN 'train' WHEN location='kenai-val' THEN 'val' ELSE 'test' END AS partition,
   coalesce(st.files>0, false) AS frames_validated, CASE WHEN cl.meta THEN 100 END AS num_frames, a AS frame_start, b AS frame_stop, CASE WHEN st.clip_id IS NOT NULL THEN coalesce(boxes,0) END AS boxes,
   CASE WHEN st.clip_id IS NOT NULL THEN coalesce(tracks,0) END AS tracks, CASE WHEN cl.file THEN sha256(clip_id::VARCHAR) END AS gt_sha256
   FROM cl LEFT JOIN why USING (clip_id) LEFT JOIN (SELECT clip_id, files, a, b FROM st) st USING (clip_id) LEFT JOIN tr USING (clip_id) WHERE cl.meta OR cl.file"""
STATS = """, cell AS (SELECT clip_id, track_id, frame_index FROM bx GROUP BY 1,2,3), per AS (SELECT clip_id, track_id, count(*) AS f, max(frame_index)-min(frame_index)+1 AS sp FROM cell GROUP BY 1,2),
  beside AS (SELECT DISTINCT al.clip_id, track_id FROM al JOIN st USING (clip_id) WHERE frame_index<a OR frame_index>=b)
  SELECT st.clip_id, coalesce((SELECT count(DISTINCT frame_index) FROM cell WHERE cell.clip_id=st.clip_id),0) AS annotated_frames,
   coalesce((SELECT count(*) FROM per WHERE per.clip_id=st.clip_id AND sp<>f),0) AS tracks_with_gaps, coalesce((SELECT count(*) FROM per WHERE per.clip_id=st.clip_id AND f=1),0) AS single_observation_tracks,
   coalesce((SELECT count(*) FROM per JOIN beside USING (clip_id, track_id) WHERE per.clip_id=st.clip_id),0) AS tracks_cut_by_window, coalesce(st.files,0) AS frames_checked FROM st"""


def _manifest(t):
    return t["manifest"].select(
        "location", "clip_name", "status", "usable", F.array_join("quarantine_reasons", ",").alias("reasons"), F.array_join("warning_codes", ",").alias("warnings"), "partition",
        "frames_validated", "num_frames", "frame_start", "frame_stop", "boxes", "tracks", "gt_sha256",
    )


@query(FULL + ISSUES)
def recording_issues(s, d):
    return _full(s, d)["issues"]


@query(FULL + MANIFEST)
def recording_manifest(s, d):
    return _manifest(_full(s, d))


@query(WINDOW + ISSUES)
def window_issues(s, d):
    return _window(s, d)["issues"]


@query(WINDOW + MANIFEST)
def window_manifest(s, d):
    return _manifest(_window(s, d))


@query(WINDOW + STATS)
def window_statistics(s, d):
    t = _window(s, d)["status"].where("checked_boxes")
    return t.select("clip_id", "annotated_frames", "tracks_with_gaps", "single_observation_tracks", "tracks_cut_by_window", "frames_checked")
