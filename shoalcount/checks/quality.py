"""Validation, manifest, source and service-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalcount import adapters as ad
from shoalcount.checks import adapter_sql as q
from shoalcount.functions import hashing as fh
from shoalcount.functions import names as nm
from shoalcount.operators import boxes as bx
from shoalcount.operators import ops
from shoalcount.operators import quality as ql
from shoalcount.session import materialize
from shoalcount.sources import files as fi
from shoalcount.sources import manifest as mf
from shoalcount.sources import metadata as md
from shoalcount.sources import mot
from shoalcount.sources import reports as rp

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


# --- tracker text --------------------------------------------------------------------------

LINE = "format('{},{},{:.3f},{:.3f},{:.3f},{:.3f},1.0,-1,-1,-1', frame_index+1, track_id, x_min+1, y_min+1, x_max-x_min, y_max-y_min)"


@query("WITH " + q.REF + f" SELECT clip_id, {LINE} AS line FROM ref")
def mot_lines(s, d):
    return bx.internal_to_mot(ad.reference_boxes(s, d)).select("clip_id", mot.format_line().alias("line"))


def damaged_lines(s, d):
    """Well-formed lines, some of them then damaged the way real files are."""
    base = bx.internal_to_mot(ad.reference_boxes(s, d)).withColumn("line", mot.format_line())
    kind = (F.col("frame") * 7 + F.col("track_id") * 3 + F.col("clip_id")) % 40
    line = (
        F.when(kind == 0, F.lit("")).when(kind == 1, F.concat("line", F.lit(",9")))
        .when(kind == 2, F.regexp_replace("line", r"^(\d+),", "$1.5,")).when(kind == 3, F.regexp_replace("line", r"^(\d+),", "$1.0,"))
        .when(kind == 4, F.regexp_replace("line", r"1\.0,-1,-1,-1$", "1.0,-1,-1,-1").substr(F.lit(1), F.lit(0)))
        .when(kind == 5, F.regexp_replace("line", r"^(\d+,\d+),[-\d.]+,", "$1,nan,")).when(kind == 6, F.regexp_replace("line", r"^(\d+,\d+),[-\d.]+,", "$1,x,"))
        .otherwise(F.col("line"))
    )
    return base.select(F.col("clip_id").cast("string").alias("path"), (F.col("frame") * 1000 + F.col("track_id")).alias("line_number"), line.alias("line"))


DAMAGED = "WITH " + q.REF + """, dm AS (SELECT clip_id::VARCHAR AS path, (frame_index+1)*1000+track_id AS line_number, frame_index+1 AS frame, track_id, x_min+1 AS l, y_min+1 AS t,
  ((frame_index+1)*7+track_id*3+clip_id)%40 AS kind FROM ref)"""


@query(DAMAGED + """ SELECT path, line_number, CASE kind WHEN 1 THEN 'expected 10 columns, got 11' WHEN 2 THEN 'not an integer' WHEN 5 THEN 'non-finite box value' ELSE 'not a number' END AS error,
  path||':'||line_number AS "where" FROM dm WHERE kind IN (1,2,5,6)""")
def mot_rejects(s, d):
    return mot.rejects(mot.parse_lines(damaged_lines(s, d)))


@query(DAMAGED + " SELECT path, line_number, frame, track_id, l AS bb_left, t AS bb_top, 30.0 AS bb_width, 20.0 AS bb_height FROM dm WHERE kind NOT IN (0,1,2,4,5,6)")
def mot_rows(s, d):
    return mot.good_rows(mot.parse_lines(damaged_lines(s, d)))


# --- metadata ------------------------------------------------------------------------------


def metadata_documents(s, d):
    c = ad.table(s, d, "customer").selectExpr(
        "concat('m', c_nationkey) as source",
        """concat('{"clip_name":"clip', c_custkey - if(c_custkey % 17 = 0 and c_custkey > 24, 25, 0), '","num_frames":', if(c_custkey % 19 = 0, '0', string(100 + c_custkey)),
           ',"framerate":', if(c_custkey % 23 = 0, '"x"', '10.5'), ',"width":640', if(c_custkey % 29 = 0, '.5', ''), ',"height":480,"x_meter_start":0,"x_meter_stop":12.5,"y_meter_start":0',
           if(c_custkey % 31 = 0, '', ',"y_meter_stop":9'), if(c_custkey % 37 = 0, ',"note":"a"', ''), '}') as entry""",
        "c_custkey",
    )
    per = c.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "entry"))), lambda x: x["entry"]), ",").alias("t"))
    return per.select("source", F.concat(F.lit("["), "t", F.lit("]")).alias("text"))


META = """WITH c AS (SELECT 'm'||c_nationkey AS source, c_custkey AS k, 'clip'||(c_custkey-CASE WHEN c_custkey%17=0 AND c_custkey>24 THEN 25 ELSE 0 END) AS clip_name,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)-1 AS index FROM customer),
 e AS (SELECT *, CASE WHEN k%37=0 THEN 'unknown field note' WHEN k%31=0 THEN 'missing field y_meter_stop' WHEN k%23=0 THEN 'not a finite number' WHEN k%29=0 THEN 'not an integer' WHEN k%19=0 THEN 'not positive' END AS e0 FROM c),
 f AS (SELECT *, CASE WHEN e0 IS NULL AND count(*) FILTER (e0 IS NULL) OVER (PARTITION BY source, clip_name)>1 THEN 'duplicate clip_name' ELSE e0 END AS error FROM e)"""


@query(META + " SELECT source, index, clip_name, CASE WHEN k%19=0 THEN 0 ELSE 100+k END AS num_frames, error FROM f")
def metadata_entries(s, d):
    rows = md.check_entries(md.entries(metadata_documents(s, d)))
    return rows.select("source", "index", "clip_name", "num_frames", "error")


# --- files ---------------------------------------------------------------------------------


def document_files(s, d):
    return ad.table(s, d, "documents").select(
        F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("bigint").alias("size"), F.col("text").cast("binary").alias("content"), "doc_id"
    )


@query("SELECT lang||'/'||doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents")
def content_inventory(s, d):
    return fi.inventory(document_files(s, d))


@query("""SELECT lang||'/'||doc_id AS path, CASE WHEN doc_id%10=3 THEN 'unknown' ELSE 'changed' END AS problem FROM documents WHERE doc_id%10=3 OR doc_id%10=4""")
def inventory_changes(s, d):
    files = document_files(s, d)
    known = files.where("doc_id % 10 <> 3").withColumn("content", F.when(F.col("doc_id") % 10 == 4, F.lit(b"old")).otherwise(F.col("content")))
    return fi.compare_inventory(fi.inventory(files), fi.inventory(known))


@query("""SELECT lang||'/'||doc_id AS path, CASE doc_id%7 WHEN 0 THEN 'missing' WHEN 1 THEN 'size_mismatch' WHEN 2 THEN 'md5_mismatch' ELSE 'verified' END AS status FROM documents""")
def verified_checksums(s, d):
    files = document_files(s, d)
    registry = files.select(
        "path", F.when(F.col("doc_id") % 7 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(F.col("doc_id") % 7 == 2, F.lit("0")).otherwise(F.md5("content")).alias("md5"),
    )
    return fi.verify_checksums(files.where("doc_id % 7 <> 0"), registry)


@query("""WITH m AS (SELECT l_suppkey AS archive, CASE WHEN l_suppkey%8=0 THEN 'b' ELSE 'a' END||'/'||f||'.jpg' AS name, f FROM (SELECT DISTINCT l_suppkey, unnest(range(0, 20+l_suppkey%5)) AS f FROM lineitem))
  SELECT archive, CASE WHEN archive%6=1 THEN 19+archive%5 WHEN archive%6=2 THEN 20+archive%5 ELSE 20+archive%5 END AS frames,
  CASE archive%6 WHEN 1 THEN 'frames missing' WHEN 2 THEN 'frame appears twice' WHEN 3 THEN 'not a frame file' WHEN 4 THEN 'frames must be in one folder' END AS problem FROM m GROUP BY 1""")
def frame_archive_checks(s, d):
    base = ad.table(s, d, "lineitem").selectExpr("l_suppkey as archive").distinct().selectExpr("archive", "explode(sequence(0L, 19 + archive % 5)) as f")
    folder = F.when((F.col("archive") % 6 == 4) & (F.col("f") == 3), "c").otherwise(F.when(F.col("archive") % 8 == 0, "b").otherwise("a"))
    names = base.where("not (archive % 6 = 1 and f = 5)").select("archive", F.concat_ws("/", folder, F.concat(F.col("f").cast("string"), F.lit(".jpg"))).alias("name"))
    same = F.when(F.col("archive") % 8 == 0, "b").otherwise("a")
    extra = base.where("f = 0").select(
        "archive",
        F.when(F.col("archive") % 6 == 2, F.concat(same, F.lit("/7.png"))).when(F.col("archive") % 6 == 3, F.concat(same, F.lit("/notes.txt"))).otherwise("a/.hidden").alias("name"),
    )
    return fi.check_frame_members(names.unionByName(extra))


MEMBER = """WITH """ + q.COUNTS + """, m AS (SELECT k, CASE WHEN k%9=0 THEN 'other/' ELSE 'data/' END||clip_name||'_'||(k%30)||CASE WHEN k%14=0 THEN '.txt' ELSE '.jpg' END AS name, clip_name, location FROM cc),
 r AS (SELECT name, CASE WHEN k%9<>0 AND k%14<>0 THEN clip_name END AS clip_name, CASE WHEN k%9=0 OR k%14=0 THEN 'unexpected_name' WHEN k%10=4 THEN 'unknown_clip' WHEN location='nushagak' THEN 'not_selected' END AS skipped FROM m)"""


@query(MEMBER + " SELECT name, clip_name, skipped FROM r")
def selected_members(s, d):
    c = ad.clip_counts(s, d)
    m = c.selectExpr("concat(if(k % 9 = 0, 'other/', 'data/'), clip_name, '_', k % 30, if(k % 14 = 0, '.txt', '.jpg')) as name")
    out = fi.select_members(m, "data/", c.where("k % 10 <> 4").select("clip_name"), c.where("location <> 'nushagak' and k % 10 <> 4").select("clip_name", "location"))
    return out.select("name", "clip_name", "skipped")


@query(MEMBER + " SELECT coalesce(skipped,'selected') AS reason, count(*) AS n FROM r GROUP BY 1")
def skipped_members(s, d):
    return selected_members(s, d).groupBy(F.coalesce("skipped", F.lit("selected")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


PRINTS = "WITH " + q.DET + """, r AS (SELECT clip_id, frame_index, round(x_min,1) AS a, round(y_min,1) AS b, round(x_max,1) AS c, round(y_max,1) AS e, round(score,1) AS f FROM det),
  fr AS (SELECT clip_id, frame_index, sha256(string_agg(concat_ws(':', a, b, c, e, f), ',' ORDER BY a, b, c, e, f)) AS sha256 FROM r GROUP BY 1,2)"""


@query(PRINTS + " SELECT clip_id, frame_index, sha256 FROM fr")
def detection_fingerprints(s, d):
    return fi.detection_digests(ad.detections(s, d), decimals=1)[0]


@query(PRINTS + ", lv AS (SELECT clip_id, frame_index AS pos, sha256 AS digest FROM fr), " + q.tree("lv", "clip_id", "rt") + " SELECT clip_id, digest AS sha256 FROM rt")
def clip_fingerprints(s, d):
    return fi.detection_digests(ad.detections(s, d), decimals=1)[1]


# --- reports and plans ---------------------------------------------------------------------


@query("WITH " + q.COUNTS + " SELECT k AS report_id, clip_name, ref_right, ref_left, a_right AS pred_right, a_left AS pred_left FROM cc")
def report_clip_counts(s, d):
    doc = F.format_string(
        '{"clip_name":"%s","reference":[%d,%d],"predicted":[%d,%d]}', "clip_name", "ref_right", "ref_left", "a_right", "a_left"
    )
    other = F.lit('{"epoch":1,"threshold":0.3,"clips":[]}')
    text = (
        F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"results":['), other, F.lit(',{"epoch":2,"threshold":0.2,"clips":['), doc, F.lit("]}]}")))
        .when(F.col("k") % 3 == 1, F.concat(F.lit('{"clips":['), doc, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"locations":[{"location":"x","clip_errors":['), doc, F.lit("]}]}")))
    )
    reports = ad.clip_counts(s, d).select(F.col("k").alias("report_id"), text.alias("text"))
    return rp.clip_counts(reports, epoch=2, threshold=0.2)


@query("""SELECT event_id AS id, 'event.props.k' AS key, props->>'$.k' AS value FROM events UNION ALL SELECT event_id, 'event.type', event_type FROM events UNION ALL SELECT event_id, 'list', '[1,2]' FROM events
  UNION ALL SELECT event_id, 'a.b.c.d.e.f', event_id::VARCHAR FROM events UNION ALL SELECT event_id, 'a.text', '{'||event_type FROM events UNION ALL SELECT event_id, 'a.b.none', 'None' FROM events UNION ALL SELECT event_id, 'a.b.even', CASE WHEN event_id%2=0 THEN 'True' ELSE 'False' END FROM events""")
def flattened_configs(s, d):
    deep = F.format_string('"a":{"b":{"c":{"d":{"e":{"f":%d}}},"none":null,"even":%s},"text":"{%s"}', "event_id", (F.col("event_id") % 2 == 0).cast("string"), "event_type")
    text = F.concat(F.lit('{"event":{"props":'), "props", F.lit(',"type":"'), "event_type", F.lit('"},"list":[1,2],'), deep, F.lit("}"))
    return rp.flatten_config(ad.table(s, d, "events").select(F.col("event_id").alias("id"), text.alias("text")))


@query("""SELECT 'loss' AS key, event_id*1.0 AS value, event_id AS step FROM events UNION ALL SELECT 'k', (props->>'$.k')::DOUBLE, event_id FROM events UNION ALL SELECT 'head_only', (event_id%2=0)::INT::DOUBLE, event_id FROM events""")
def training_metrics(s, d):
    line = F.concat(
        F.lit('{"iteration":'), F.col("event_id").cast("string"), F.lit(',"loss":'), F.col("event_id").cast("string"), F.lit('.0,"note":"7","flag":"true","none":null,"k":'),
        F.get_json_object("props", "$.k"), F.lit(',"head_only":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit("}"),
    )
    return rp.metric_rows(ad.table(s, d, "events").select(line.alias("line")))


# --- validation ----------------------------------------------------------------------------

CODE = """CASE WHEN frame_index>=100 THEN 'frame_out_of_range' WHEN x_max<=x_min OR y_max<=y_min THEN 'non_positive_box_size' WHEN x_max<=0 OR y_max<=0 OR x_min>=640 OR y_min>=480 THEN 'box_outside_image'
  WHEN x_min<0 OR y_min<0 OR x_max>640 OR y_max>480 THEN 'box_partially_outside_image' END"""
ISS = "WITH " + q.DATASET + f""", iss AS (SELECT clip_id, code, count(*) AS count FROM (SELECT clip_id, {CODE} AS code FROM db) WHERE code IS NOT NULL GROUP BY 1,2)"""


def issues(s, d):
    return ql.box_issues(ad.dataset_boxes(s, d), ad.dataset_clips(s, d))


@query(ISS + f""", x AS (SELECT clip_id, {CODE} AS code, format('frame_index {{}} track {{}} box ({{:.3f}}, {{:.3f}}, {{:.3f}}, {{:.3f}})', frame_index, track_id, x_min, y_min, x_max, y_max) AS e,
   row_number() OVER (PARTITION BY clip_id, {CODE} ORDER BY frame_index, track_id, x_min, y_min) AS r FROM db),
  y AS (SELECT clip_id, code, string_agg(e, '; ' ORDER BY r) FILTER (r=1) AS examples FROM x WHERE r<=5 AND code IS NOT NULL GROUP BY 1,2)
  SELECT clip_id, code, count, CASE WHEN code='box_partially_outside_image' THEN 'warning' ELSE 'error' END AS severity, least(count, 5) AS n_examples, split_part(examples, ' box', 1) AS first FROM iss JOIN y USING (clip_id, code)""")
def dataset_box_issues(s, d):
    i = issues(s, d)
    return i.select(
        "clip_id", "code", "count", "severity", F.size("examples").alias("n_examples"), F.split_part(F.get("examples", F.lit(0)), F.lit(" box"), F.lit(1)).alias("first")
    )


@query("WITH " + q.DATASET + " SELECT clip_id, 'duplicate_track_frame' AS code, sum(n-1) AS count FROM (SELECT clip_id, track_id, frame_index, count(*) AS n FROM db GROUP BY 1,2,3) WHERE n>1 GROUP BY 1")
def dataset_duplicates(s, d):
    return ql.duplicate_issues(ad.dataset_boxes(s, d))


@query("WITH " + q.DATASET + """, t AS (SELECT clip_id, track_id, count(*) AS b, count(DISTINCT frame_index) AS f, max(frame_index)-min(frame_index)+1 AS sp FROM db GROUP BY 1,2)
  SELECT t.clip_id, sum(b) AS boxes, count(*) AS tracks, count(*) FILTER (sp<>f) AS tracks_with_gaps, count(*) FILTER (f=1) AS single_observation_tracks,
  any_value(af) AS annotated_frames FROM t JOIN (SELECT clip_id, count(DISTINCT frame_index) AS af FROM db GROUP BY 1) z USING (clip_id) GROUP BY 1""")
def track_statistics(s, d):
    return ql.track_stats(ad.dataset_boxes(s, d))


@query("WITH " + q.DATASET + """ SELECT clip_id, count(*) AS tracks_cut_by_window FROM (SELECT clip_id, track_id FROM db GROUP BY 1,2 HAVING bool_or(frame_index>=30 AND frame_index<60) AND bool_or(NOT (frame_index>=30 AND frame_index<60))) GROUP BY 1""")
def tracks_cut_by_window(s, d):
    return ql.tracks_cut_by_window(ad.dataset_boxes(s, d), F.lit(30), F.lit(60))


@query("""SELECT coalesce(a.k, b.k) AS clip_name, CASE WHEN b.k IS NULL THEN 'missing_metadata' ELSE 'missing_annotations' END AS code FROM
  (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_suppkey%10<>3) a FULL JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey%10<>7) b ON a.k=b.k WHERE a.k IS NULL OR b.k IS NULL""")
def coverage_issues(s, d):
    disk = ad.table(s, d, "lineitem").where("l_suppkey % 10 <> 3").selectExpr("l_suppkey as clip_name")
    meta = ad.table(s, d, "supplier").where("s_suppkey % 10 <> 7").selectExpr("s_suppkey as clip_name")
    return ql.coverage_issues(disk, meta)


MISS = "WITH " + q.DATASET + """, p AS (SELECT DISTINCT clip_id, frame_index FROM db WHERE (frame_index*13+clip_id)%5<>0),
 m AS (SELECT clip_id, f FROM (SELECT clip_id, unnest(range(num_frames)) AS f FROM dc) x WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.clip_id=x.clip_id AND p.frame_index=f)),
 g AS (SELECT *, f-row_number() OVER (PARTITION BY clip_id ORDER BY f) AS i FROM m)"""


def present_frames(s, d):
    return ad.dataset_boxes(s, d).where("(frame_index * 13 + clip_id) % 5 <> 0").select("clip_id", "frame_index").distinct()


@query(MISS + " SELECT clip_id, CASE WHEN min(f)=max(f) THEN min(f)::VARCHAR ELSE min(f)||'-'||max(f) END AS frames, count(*) AS n FROM g GROUP BY clip_id, i")
def missing_frames(s, d):
    runs = ql.missing_frames(present_frames(s, d), ad.dataset_clips(s, d))
    return runs.select("clip_id", ql.range_text(F.col("start"), F.col("stop")).alias("frames"), (F.col("stop") - F.col("start") + 1).alias("n"))


@query(MISS + " SELECT clip_id, frame_index FROM p WHERE frame_index>=100")
def frames_beyond(s, d):
    return ql.frames_beyond(present_frames(s, d), ad.dataset_clips(s, d))


@query("""SELECT DISTINCT l_suppkey AS clip_id, l_orderkey%40 AS track_id, l_partkey%120 AS frame_index FROM lineitem WHERE l_returnflag='A'
  EXCEPT SELECT l_suppkey, l_orderkey%40, l_partkey%120 FROM lineitem WHERE l_returnflag<>'A'""")
def subset_rows_not_in_full(s, d):
    rows = ad.table(s, d, "lineitem").selectExpr("l_suppkey as clip_id", "l_orderkey % 40 as track_id", "l_partkey % 120 as frame_index", "l_returnflag")
    return ql.rows_not_in(rows.where("l_returnflag = 'A'").drop("l_returnflag"), rows.where("l_returnflag <> 'A'"))


STATUS = ISS + """, sts AS (SELECT dc.clip_id, location, CASE WHEN bool_or(code<>'box_partially_outside_image') THEN 'quarantined' WHEN count(code)>0 THEN 'warning' ELSE 'ok' END AS status,
  coalesce(string_agg(code, ',' ORDER BY code) FILTER (code<>'box_partially_outside_image'), '') AS reasons FROM dc LEFT JOIN iss i ON i.clip_id=dc.clip_id GROUP BY 1,2)"""


def statuses(s, d):
    return ql.clip_status(ad.dataset_clips(s, d), issues(s, d))


@query(STATUS + " SELECT clip_id, location, status, reasons FROM sts")
def clip_statuses(s, d):
    return statuses(s, d).select("clip_id", "location", "status", F.array_join("quarantine_reasons", ",").alias("reasons"))


@query(STATUS + " SELECT location, count(*) AS clips, count(*) FILTER (status='ok') AS ok, count(*) FILTER (status='warning') AS warning, count(*) FILTER (status='quarantined') AS quarantined FROM sts GROUP BY ROLLUP(location)")
def status_summary(s, d):
    return ql.status_summary(statuses(s, d))


@query(ISS + " SELECT code, sum(count) AS count, count(DISTINCT clip_id) AS clips FROM iss GROUP BY 1")
def issue_totals(s, d):
    return ql.issue_totals(issues(s, d))


@query("SELECT s_suppkey AS clip_id, CASE WHEN s_suppkey%3=1 THEN 1 WHEN s_suppkey%3=2 THEN 2 ELSE 0 END AS report FROM supplier")
def merged_reports(s, d):
    clips = ad.dataset_clips(s, d).select("clip_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("report"))
    claims = ad.dataset_clips(s, d).where("clip_id % 3 <> 0").select("clip_id", (F.col("clip_id") % 3).cast("int").alias("report"))
    return ql.merge_reports(clips, claims).select("clip_id", "report")


@query("WITH " + q.COUNTS + " SELECT clip_name, 'invalid_clip_name' AS code FROM cc WHERE k%6=0")
def clip_name_issues(s, d):
    c = ad.clip_counts(s, d).withColumn("num_frames", F.when(F.col("k") % 6 == 0, F.col("num_frames") + 1).otherwise(F.col("num_frames")))
    return ql.name_issues(c)


@query("""SELECT l_suppkey AS clip_id, CASE l_linenumber WHEN 7 THEN 'unreadable_frame' WHEN 6 THEN 'image_size_differs_slightly' ELSE 'image_size_mismatch' END AS code,
  CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN 641 ELSE 600 END AS image_width, CASE WHEN l_linenumber<>7 THEN 480 END AS image_height, count(*) AS count FROM lineitem WHERE l_linenumber>=5 GROUP BY 1,2,3,4""")
def image_size_issues(s, d):
    frames = ad.table(s, d, "lineitem").selectExpr(
        "l_suppkey as clip_id", "case l_linenumber when 7 then null when 6 then 641 when 5 then 600 else 640 end as image_width", "if(l_linenumber = 7, null, 480) as image_height"
    )
    return ql.image_size_issues(frames, ad.dataset_clips(s, d))


# --- manifest ------------------------------------------------------------------------------


@query("WITH " + q.MANIFEST + """ SELECT partition, count(*) AS clips, count(*) FILTER (usable) AS usable_clips, coalesce(sum(frame_stop-frame_start) FILTER (usable),0) AS window_frames,
  coalesce(sum(boxes) FILTER (usable),0) AS boxes FROM mf GROUP BY 1""")
def manifest_totals(s, d):
    return mf.totals(ad.manifest(s, d))


@query("WITH " + q.MANIFEST + f""", h AS (SELECT location||'|'||clip_name AS k, sha256('{{"clip_name":"'||clip_name||'","location":"'||location||'","num_frames":'||num_frames||'}}') AS h FROM mf),
  n AS (SELECT k, h, count(*) AS n FROM h GROUP BY 1,2), lv AS (SELECT 0 AS t, {q.hash32('k')}>>2 AS pos, sha256(string_agg(h||':'||n, ',' ORDER BY k, h)) AS digest FROM n GROUP BY 1,2),
  {q.tree('lv', 't', 'rt')} SELECT digest AS content_sha256, (SELECT count(*) FROM h) AS rows FROM rt""")
def manifest_content_hash(s, d):
    return mf.content_hash(ad.manifest(s, d).select("location", "clip_name", "num_frames"), ["location", "clip_name"])


@query("WITH " + q.MANIFEST + " SELECT clip_name, location, partition FROM mf WHERE partition IN ('train','val') AND usable AND frames_validated")
def tuning_rows(s, d):
    return mf.select_rows(ad.manifest(s, d), ["train", "val"]).select("clip_name", "location", "partition")


@query("WITH " + q.MANIFEST + " SELECT clip_name, num_frames FROM mf WHERE partition='test' AND location='elwha' AND usable")
def release_rows(s, d):
    return mf.release_rows(ad.manifest(s, d), "test", "elwha").select("clip_name", "num_frames")


def dated_clips(s, d):
    return ad.clip_counts(s, d).select("location", "clip_name", nm.parse_clip_name(F.col("clip_name"))["recording_date"].alias("recording_date"))


def include(s):
    rows = [("elwha", None), ("kenai-train", "2018-06-03"), ("kenai-train", "2018-06-10"), ("kenai-val", "2018-07-01")]
    return s.createDataFrame(rows, "location string, day string").withColumn("day", F.col("day").cast("date"))


@query("WITH " + q.COUNTS + " SELECT location, clip_name FROM cc WHERE location='elwha' OR (location='kenai-train' AND k%28+1 IN (3,10))")
def clips_by_day(s, d):
    return mf.select_clips(dated_clips(s, d), include(s)).select("location", "clip_name")


@query("SELECT 'kenai-val' AS location, '2018-07-01' AS day")
def requested_days_without_clips(s, d):
    return mf.missing_days(dated_clips(s, d), include(s)).select("location", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("WITH " + q.COUNTS + """ SELECT clip_name, CASE location WHEN 'kenai-train' THEN 'train' WHEN 'kenai-val' THEN 'val' ELSE 'test' END AS official_split,
  CASE WHEN location='kenai-train' AND k%5=0 THEN 'holdout' WHEN location='kenai-train' THEN 'train' WHEN location='kenai-val' THEN 'val' ELSE 'test' END AS partition,
  location IN ('kenai-train','kenai-val') AND NOT (location='kenai-train' AND k%5=0) AS tuning_allowed, k%11<>0 AS usable, format('2018-06-{:02d}', k%28+1) AS day, k*1000 AS recording_frame_start, k%50 AS boxes FROM cc""")
def manifest_rows(s, d):
    c = ad.clip_counts(s, d)
    status = c.select("clip_name", "location", F.when(F.col("k") % 11 == 0, "quarantined").otherwise("ok").alias("status"))
    rows = ql.manifest_rows(status, c.select("clip_name", (F.col("k") % 50).alias("boxes")), c.where("location = 'kenai-train' and k % 5 = 0"))
    return rows.select(
        "clip_name", "official_split", "partition", "tuning_allowed", "usable", F.date_format("recording_date", "yyyy-MM-dd").alias("day"), "recording_frame_start", "boxes"
    )


@query("SELECT c_custkey AS k, sha256('{\"clip\":'||c_custkey||',\"seg\":\"'||c_mktsegment||'\"}') AS request_sha256, ('0x'||substr(sha256(c_name),1,16))::UBIGINT::VARCHAR AS seed FROM customer")
def content_keys(s, d):
    c = ad.table(s, d, "customer")
    return c.select(
        F.col("c_custkey").alias("k"), fh.content_key(clip=F.col("c_custkey"), seg=F.col("c_mktsegment")).alias("request_sha256"), fh.seed64(F.col("c_name")).cast("string").alias("seed")
    )


# --- service tables ------------------------------------------------------------------------

NOW = "TIMESTAMP '2001-08-01 12:00:00'"


def now():
    return F.lit("2001-08-01 12:00:00").cast("timestamp")


@query("WITH " + q.JOBS + f""" SELECT {', '.join(f"count(*) FILTER (status='{x}') AS jobs_{x}" for x in ops.JOB_STATUSES)}, count(*) FILTER (status='queued') AS queue_depth,
  (epoch_us({NOW})-epoch_us(min(created_at) FILTER (status='queued')))/1e6 AS oldest_queued_seconds FROM jb""")
def job_gauges(s, d):
    return ops.job_gauges(ad.service_jobs(s, d), now())


@query("""WITH h AS (SELECT user_id%7 AS pipeline, user_id AS worker_id, max(ts) AS t FROM events GROUP BY 1,2) SELECT pipeline, count(*) FILTER (epoch_us(TIMESTAMP '2024-01-30 23:00:00')-epoch_us(t)<=7200*1e6) AS live_workers,
  count(*) AS workers FROM h GROUP BY 1""")
def live_workers(s, d):
    h = ad.table(s, d, "events").select((F.col("user_id") % 7).alias("pipeline"), F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("heartbeat_at"))
    return ops.live_workers(h, F.lit("2024-01-30 23:00:00").cast("timestamp"), 7200, "pipeline")


@query("WITH " + q.JOBS + f""" SELECT pipeline_version, job_id, (epoch_us({NOW})-epoch_us(created_at))/1e6 AS age_seconds, row_number() OVER (PARTITION BY pipeline_version ORDER BY created_at, job_id)-1 AS rank
  FROM jb WHERE status='queued' OR (status='running' AND lease_expires_at<{NOW})""")
def backlog(s, d):
    return ops.backlog(ad.service_jobs(s, d), now()).select("pipeline_version", "job_id", "age_seconds", "rank")


@query("WITH " + q.JOBS + f""" SELECT * FROM (SELECT job_id, CASE WHEN epoch_us({NOW})-epoch_us(started_at)>deadline_seconds*1e6 THEN 'deadline exceeded' WHEN lease_expires_at<{NOW} AND attempts>=max_attempts THEN 'lease expired after the last attempt'
  WHEN lease_expires_at<{NOW} THEN 'lease expired' END AS problem FROM jb WHERE status='running') WHERE problem IS NOT NULL""")
def job_problems(s, d):
    return ops.job_problems(ad.service_jobs(s, d), now())


@query("WITH " + q.JOBS + """ SELECT c_custkey AS clip_id FROM customer WHERE c_custkey%4<>0 AND c_custkey%5<>0 AND c_custkey NOT IN (SELECT clip_id FROM jb WHERE status IN ('queued','running'))""")
def expired_uploads(s, d):
    c = ad.table(s, d, "customer").selectExpr(
        "c_custkey as clip_id", "if(c_custkey % 4 = 0, timestamp'2030-01-01', timestamp'2001-01-01') as expires_at", "if(c_custkey % 5 = 0, timestamp'2001-02-01', null) as deleted_at"
    )
    return ops.expired_uploads(c, ad.service_jobs(s, d), now()).select("clip_id")


@query("WITH " + q.JOBS + """, f AS (SELECT cache_key, arg_min(job_id, (created_at, job_id)) AS cached_from FROM jb WHERE status='succeeded' AND cached_from IS NULL GROUP BY 1)
  SELECT job_id, f.cached_from FROM jb LEFT JOIN f USING (cache_key) WHERE status='queued'""")
def cache_hits(s, d):
    j = ad.service_jobs(s, d)
    return ops.cache_hits(j.where("status = 'queued'").select("job_id", "cache_key"), j).select("job_id", "cached_from")


@query("WITH " + q.JOBS + """, f AS (SELECT clip_id, min((finished_at, job_id)) AS f, arg_min(job_id, (finished_at, job_id)) AS job_id FROM jb WHERE status='succeeded' AND cached_from IS NULL AND pipeline_version='1-URGENT' GROUP BY 1)
  SELECT c_custkey AS demo_id, f.job_id, f.job_id IS NOT NULL AS available FROM customer LEFT JOIN f ON clip_id=c_custkey""")
def demo_results(s, d):
    items = ad.table(s, d, "customer").selectExpr("c_custkey as demo_id", "c_custkey as clip_id")
    return ops.first_results(items, ad.service_jobs(s, d), "1-URGENT").select("demo_id", "job_id", "available")


@query("WITH " + q.JOBS + """ SELECT idempotency_key, count(*) AS requests, count(DISTINCT pipeline_version) AS contents, arg_min(job_id, (created_at, job_id)) AS job_id, count(DISTINCT pipeline_version)>1 AS conflict FROM jb GROUP BY 1""")
def idempotency_report(s, d):
    keyed = ops.request_keys(ad.service_jobs(s, d), ["pipeline_version"])
    return ops.idempotency_report(keyed)


@query("WITH " + q.JOBS + f""" SELECT pipeline_version, {', '.join(f"count(*) FILTER (seconds<={x}) AS le_{x}" for x in ops.JOB_SECONDS_BUCKETS)}, count(*) AS le_inf, round(sum(seconds),3) AS sum_seconds
  FROM jb WHERE status='succeeded' GROUP BY 1""")
def duration_histogram(s, d):
    return ops.duration_histogram(ad.service_jobs(s, d), F.col("seconds"), "pipeline_version")


@query("WITH " + q.JOBS + """, x AS (SELECT pipeline_version, unnest(['decode','detect','track']) AS stage, unnest([seconds*0.25, seconds*0.5, seconds*0.125])::DOUBLE AS s, 100+job_id%50 AS frames FROM jb)
  SELECT pipeline_version, stage, round(sum(s),3) AS seconds, sum(frames) AS frames, round(1000*sum(s)/sum(frames),6) AS ms_per_frame FROM x GROUP BY 1,2""")
def stage_times(s, d):
    runs = ad.service_jobs(s, d).selectExpr(
        "pipeline_version", "100 + job_id % 50 as frames", "map('decode', seconds * 0.25D, 'detect', seconds * 0.5D, 'track', seconds * 0.125D) as stages"
    )
    return ops.stage_times(runs, "pipeline_version")


@query("""SELECT event_id, round(max(value) OVER w - min(value) OVER w, 6) AS delta FROM events WINDOW w AS (PARTITION BY event_type ORDER BY (epoch_us(ts)//1000000) RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW)""")
def gauge_range_delta(s, d):
    e = ad.table(s, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    return ops.range_delta(e, "event_type", "ts", "value").select("event_id", F.round("delta", 6).alias("delta"))


@query("""WITH s AS (SELECT event_type AS k, ts, value>20 AS o FROM events), p AS (SELECT *, sum((NOT o)::INT) OVER (PARTITION BY k ORDER BY ts) AS g FROM s)
  SELECT k AS series, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS start, count(*) AS samples FROM p WHERE o GROUP BY k, g HAVING epoch_us(max(ts))-epoch_us(min(ts))>=3600*1e6""")
def sustained_alerts(s, d):
    e = ad.table(s, d, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = ops.sustained(e, "series", "ts", F.col("value") > 20, 3600)
    return out.select("series", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "samples")


@query("""WITH w AS (SELECT event_type, value, ts, unnest(range(6)) AS i FROM events), x AS (SELECT event_type, value, time_bucket(INTERVAL 5 MINUTE, ts)-to_minutes(5*i) AS st FROM w)
  SELECT strftime(st,'%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, count(*) FILTER (event_type='error') AS failures, sum(value::DECIMAL(28,6))::DOUBLE/count(*) AS mean_value FROM x GROUP BY 1""")
def windowed_failures(s, d):
    e = ad.table(s, d, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    out = ops.windowed_rates(e, "ts", F.col("event_type") == "error", F.col("value"), "30 minutes", "5 minutes")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "failures", "mean_value")


@query("WITH " + q.COUNTS + " SELECT k AS report_id, clip_name, ref_right, ref_left, a_right AS auto_right, a_left AS auto_left, num_frames FROM cc")
def report_candidates(s, d):
    clip = lambda p: F.format_string(
        '[{"clip_name":"%s","reference":[%d,%d],"predicted":[%d,%d]}]', "clip_name", "ref_right", "ref_left", f"{p}_right", f"{p}_left"
    )
    text = F.concat(
        F.lit('{"best":{"epoch":3,"threshold":0.2},"results":[{"epoch":3,"threshold":0.3,"clips":'), clip("b"),
        F.lit('},{"epoch":3,"threshold":0.2,"clips":'), clip("a"), F.lit("}]}"),
    )
    c = ad.clip_counts(s, d)
    return rp.candidates_from_report(c.select(F.col("k").alias("report_id"), text.alias("text")), c).drop("framerate")


@query("""SELECT c_custkey AS plan_id, 'R1' AS reviewer, CASE WHEN c_custkey%2=0 THEN 'n'||c_custkey ELSE 'o'||c_custkey END AS code FROM customer
  UNION ALL SELECT c_custkey, 'R2', 'x' FROM customer WHERE c_custkey%2=1""")
def plan_assignments(s, d):
    text = F.expr(
        """concat('{"assignments":{"R1":["o', c_custkey, '"],"R2":["x"]}', if(c_custkey % 2 = 0, concat(',"amendments":[{"assignments":{}},{"assignments":{"R1":["n', c_custkey, '"]}}]'), ''), '}')"""
    )
    return rp.assignments(ad.table(s, d, "customer").select(F.col("c_custkey").alias("plan_id"), text.alias("text")))
