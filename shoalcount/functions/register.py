"""SQL surface: the scalar functions as temporary SQL functions (inlined by the optimizer) and
the audit-window draw as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

BOX = "x_min DOUBLE, y_min DOUBLE, x_max DOUBLE, y_max DOUBLE"
PAIR = ", ".join(f"{p}_{e} DOUBLE" for p in ("a", "b") for e in ("x_min", "y_min", "x_max", "y_max"))
INTER = "greatest(least(a_x_max, b_x_max) - greatest(a_x_min, b_x_min), 0D) * greatest(least(a_y_max, b_y_max) - greatest(a_y_min, b_y_min), 0D)"
AREA = "greatest({p}_x_max - {p}_x_min, 0D) * greatest({p}_y_max - {p}_y_min, 0D)"
A, B = AREA.format(p="a"), AREA.format(p="b")

FUNCTIONS = {
    "center_u": ("x_min DOUBLE, x_max DOUBLE, width DOUBLE", "DOUBLE", "x_min / width + ((x_max - x_min) / width) / 2.0D"),
    "box_iou": (PAIR, "DOUBLE", f"CASE WHEN {A} + {B} - {INTER} > 0 THEN ({INTER}) / ({A} + {B} - {INTER}) ELSE 0D END"),
    "box_containment": (PAIR, "DOUBLE", f"CASE WHEN least({A}, {B}) > 0 THEN ({INTER}) / least({A}, {B}) ELSE 0D END"),
    "meters_per_pixel": ("m0 DOUBLE, m1 DOUBLE, pixels DOUBLE", "DOUBLE", "abs(m1 - m0) / pixels"),
    "ramp": ("v DOUBLE, zero DOUBLE, one DOUBLE", "DOUBLE", "least(greatest((v - zero) / (one - zero), 0D), 1D)"),
    "passage_direction": (
        "u0 DOUBLE, u1 DOUBLE, displacement DOUBLE, line DOUBLE, floor DOUBLE",
        "STRING",
        "CASE WHEN floor > 0 AND displacement < floor THEN NULL WHEN u0 < line AND u1 >= line THEN 'right' WHEN u1 < line AND u0 >= line THEN 'left' END",
    ),
    "river_direction": (
        "direction STRING, upstream STRING", "STRING",
        "CASE WHEN direction IS NULL OR upstream IS NULL THEN NULL WHEN direction = upstream THEN 'upstream' ELSE 'downstream' END",
    ),
}


@udtf(returnType="window_index int, start_frame bigint, stop_frame bigint")
class AuditWindows:
    """audit_windows(starts, stops, window, fraction, seed): seeded windows over free runs."""

    def eval(self, starts: list[int], stops: list[int], window: int, fraction: float, seed: int) -> Iterator[tuple[int, int, int]]:
        from shoalcount.operators.audit import _draw

        order = np.argsort(starts)
        for i, (a, b) in enumerate(_draw(np.array(starts)[order], np.array(stops)[order], window, fraction, seed)):
            yield i, int(a), int(b)


def register(spark: SparkSession) -> None:
    """Make every function callable from SQL in this session."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    spark.udtf.register("audit_windows", AuditWindows)
