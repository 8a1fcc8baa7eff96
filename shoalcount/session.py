"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "shoalcount", master: str | None = None, partitions: int | None = None):
    """A session with adaptive execution on; cluster settings win over these defaults."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # no Python call-site capture per column: plans with many expressions build faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    A folder of this machine is used only where none is set and all tasks run on this machine,
    as in tests; on a cluster a missing setting is refused.
    """
    global _local_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _local_dir = _local_dir or tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        base = _local_dir
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_local_dir: str | None = None


#: Stored tables of more bytes than this, uncompressed, are joined by sorting.
JOIN_BY_SORTING = 8 << 20


def materialize(df: DataFrame) -> DataFrame:
    """Store a table in the shared folder and return it as read back.

    Cuts lineage, survives lost executors, and gives later plans columnar reads and column
    pruning. Joins are chosen by the size of the files, and rows of small integers take a
    hundredth of their memory there: a table of many rows is told not to be broadcast.
    """
    return materialize_counted(df, F.lit(False))[0]


def materialize_counted(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """:func:`materialize`, and how many rows meet ``condition``, counted while writing."""
    seen, path = Observation(), scratch_dir(df.sparkSession, "table")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(condition, 1)).alias("n")).write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    found = seen.get
    large = found["rows"] * 16 * (len(df.columns) + 1) > JOIN_BY_SORTING
    return stored.hint("merge") if large else stored, int(found["n"])
