"""Validation of recordings: odd files, repeated names, windows."""

from shoalcount.plans import analyses as an

FILES = "clip_id bigint, location string, clip_name string, gt_sha256 string"
LINES = "clip_id bigint, line_number bigint, line string"
CLIPS = "clip_id bigint, location string, clip_name string, num_frames bigint, width int, height int, framerate double"
FRAMES = "clip_id bigint, frame_index bigint, image_width int, image_height int"


def line(frame, track, x, y, w=10.0, h=10.0):
    return f"{frame},{track},{x},{y},{w},{h},1.0,-1,-1,-1"


def tables(spark, files, lines, clips, frames):
    name = lambda i: f"2018-06-01_000000_0_{i}"
    return (
        spark.createDataFrame([(k, p, name(n), "h") for k, p, n in files], FILES),
        spark.createDataFrame([(k, i + 1, t) for k, ts in lines.items() for i, t in enumerate(ts)], LINES),
        spark.createDataFrame([(k, p, name(n), m, 100, 100, 10.0) for k, p, n, m in clips], CLIPS),
        spark.createDataFrame(frames, FRAMES),
    )


def found(t):
    return {(r["clip_id"], r["code"]): r["count"] for r in t["issues"].collect()}


def test_odd_files_of_full_recordings(spark):
    # 1 and 2 share a name in two places, 3 has an empty annotation file, 4 torn text, 5 no metadata, 6 no annotations
    files, lines, clips, frames = tables(
        spark, [(1, "elwha", 3), (2, "kenai-train", 3), (3, "elwha", 4), (4, "elwha", 5), (5, "elwha", 6)],
        {1: [line(1, 1, 5, 5), "", line(1, 1, 5, 5), line(9, 2, 5, 5), line(2, 3, 96, 5)], 2: [line(1, 1, 5, 5)], 4: [line(1, 1, 5, 5), "1,2"], 5: ["x"]},
        [(1, "elwha", 3, 3), (2, "kenai-train", 3, 4), (3, "elwha", 4, 4), (4, "elwha", 5, 5), (6, "elwha", 7, 7)],
        [(1, 0, 100, 100), (1, 1, None, None), (1, 1, None, None), (1, 7, 99, 100), (3, None, None, None), (4, 0, 5, 5)],
    )
    t = an.validate_to_manifest(files, lines, clips, clips, frames, clips.where("false").select("clip_name"))
    assert found(t) == {
        (1, "missing_frames"): 1, (1, "frame_window_out_of_range"): 1, (1, "unreadable_frame"): 1, (1, "image_size_differs_slightly"): 1,
        (1, "frame_out_of_range"): 1, (1, "duplicate_track_frame"): 1, (1, "box_partially_outside_image"): 1, (2, "invalid_clip_name"): 1,
        (2, "missing_clip_directory"): 1, (3, "missing_frames"): 1, (4, "mot_format"): 1, (5, "missing_metadata"): 1, (6, "missing_annotations"): 1,
    }
    rows = {(r["location"], r["clip_name"]): r for r in t["manifest"].collect()}
    assert len(rows) == 6 and not any(r["usable"] for r in rows.values())
    first = rows["elwha", "2018-06-01_000000_0_3"]
    assert (first["boxes"], first["tracks"], first["frames_validated"], first["frame_stop"]) == (3, 2, True, 3)
    empty, torn = rows["elwha", "2018-06-01_000000_0_4"], rows["elwha", "2018-06-01_000000_0_5"]
    assert (empty["boxes"], empty["frames_validated"], torn["boxes"], torn["frame_stop"]) == (0, False, None, None)
    lines_of = {r["clip_id"]: r["line"] for r in t["lines"].collect()}
    assert '"stats":null' in lines_of[4].replace(" ", "") and len(lines_of) == 6


def test_windows_and_their_rows(spark):
    # 1 sound, 2 rows the full text lacks, 3 torn rows, 4 no file of rows and no boxes, 5 no frames
    files, lines, clips, frames = tables(
        spark, [(k, "elwha", 9) for k in range(1, 6)], {k: [line(f, 7, 5, 5) for f in (1, 4, 5)] for k in (1, 2, 3, 5)},
        [(k, "elwha", 9, 9) for k in range(1, 6)], [(k, f, 100, 100) for k in range(1, 5) for f in (3, 4, 6) if not (k < 4 and f == 6)],
    )
    sub = {1: [line(4, 7, 5, 5)], 2: [line(4, 7, 5, 5), line(4, 7, 6, 5), line(4, 7, 6, 5)], 3: ["1,2"]}
    rows = spark.createDataFrame([(k, i, t) for k, ts in sub.items() for i, t in enumerate(ts)], LINES)
    t = an.validate_to_manifest(files, lines, clips, clips, frames, clips.where("false").select("clip_name"), files.where("clip_id < 4"), rows)
    assert found(t) == {
        (2, "tiny_rows_not_in_gt"): 2, (3, "mot_format"): 1, (4, "missing_tiny_annotations"): 1, (4, "no_boxes_in_window"): 1, (4, "missing_frames"): 1,
        (5, "missing_clip_directory"): 1,
    }
    cut = {r["clip_id"]: r for r in t["status"].collect()}
    assert (cut[1]["frame_start"], cut[1]["frame_stop"], cut[1]["boxes"], cut[1]["tracks_cut_by_window"]) == (3, 5, 2, 1)
    assert cut[1]["status"] == "ok" and cut[5]["frame_start"] is None
