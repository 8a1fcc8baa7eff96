"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per
digest, meets the index in a sort-merge anti join (the index side needs neither shuffle nor,
with one file per bucket, sort), and what is new is appended under the batch's name. A batch that
is run again under its name, after a failure at any point, gets the verdict of its first run.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalcount.llm.util import ascii_lower, without
from shoalcount.session import materialize, scratch_dir


def digest(text):
    """SHA-256 (binary) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(text), 256))


class DigestIndex:
    """Digests seen so far: (digest, keep_id, batch), bucketed and sorted by digest below ``path``.

    The files outlive the session: opening the same path with the same ``buckets`` continues it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self, but: str | None = None) -> DataFrame:
        """What is held; with ``but``, what other batches brought."""
        table = self.spark.table(self.table)
        return table if but is None else table.where(~F.col("batch").eqNullSafe(F.lit(but)))

    def unseen(self, batch: DataFrame, but: str | None = None) -> DataFrame:
        """Rows of the batch (one per digest) that the index does not hold."""
        return batch.join(self.rows(but).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, batch: DataFrame, name: str) -> None:
        """Add the batch's digests that are not held yet, one file per bucket; doing so again adds nothing."""
        new = self.unseen(batch).select("digest", F.col("keep_id").cast("bigint"), F.lit(name).alias("batch"))
        (
            new.repartition(self.buckets, "digest").write.format("parquet").mode("append")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        )


def decide(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (after lower-casing A-Z, null as empty) the row with the largest doc_id
    stays, unless an earlier batch had the text: then its keep_id stands and no row of this
    batch stays. A null doc_id is smaller than any other; of repeated rows with that doc_id one
    stays. group_size counts the copies in ``docs``. An empty table gives no rows; other
    columns are ignored.

    ``batch`` names the batch in the index. The digests of a batch never count against itself,
    so a rerun under the same name, of the same rows, decides as before. Without a name every
    call is a batch of its own.
    """
    name = batch or uuid.uuid4().hex
    # rows that repeat both columns are counted per input partition: no group of copies meets in a
    # task, and a count is never more than a partition's rows when it is opened again
    pairs = materialize(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("digest"), F.spark_partition_id().alias("part"))
        .groupBy("digest", "doc_id", "part").agg(F.count(F.lit(1)).alias("copies"))
    )
    stays = F.max(F.struct("doc_id", (-F.col("part")).alias("part")))
    found = materialize(
        pairs.groupBy("digest").agg(stays.alias("s"), F.sum("copies").alias("group_size"))
        .select("digest", F.col("s.doc_id").alias("keep_id"), (-F.col("s.part")).alias("keep_part"), "group_size")
    )
    fresh = index.unseen(found, but=name).select("digest", F.lit(True).alias("fresh"))
    known = index.rows(but=name).select("digest", F.col("keep_id").alias("earlier"))
    groups = materialize(
        found.join(fresh, "digest", "left").join(known.hint("merge"), "digest", "left")
        .select(
            "digest", "group_size", "keep_part", F.coalesce("fresh", F.lit(False)).alias("fresh"),
            F.when(F.col("fresh"), F.col("keep_id")).otherwise(F.col("earlier")).alias("keep_id"),
        )
    )
    index.append(found, name)
    # both sides are shuffled on the digest, so adaptive execution splits a hot one
    each = pairs.join(groups, "digest")
    here = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("part") == F.col("keep_part"))
    slim = lambda stays: ("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    one = each.select(*slim(here))
    # the other rows of a repeated (doc_id, text), opened after being dealt by partition too
    more = pairs.where("copies > 1").join(groups, "digest").repartition("digest", "doc_id", "part")
    rest = more.withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("copies").cast("int"))))
    return one.unionByName(rest.select(*slim(F.lit(False))))


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, scratch_dir(spark, "digest-index"))


def survivors(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The documents that stay, with their columns as they were; ``batch`` as in :func:`decide`."""
    verdict = materialize(decide(docs, index, batch))
    key = {"doc_id": F.col("doc_id").cast("bigint"), "text_sha256": F.lower(F.hex(digest(F.col("text"))))}
    tally = verdict.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marked = materialize(tally.where(~F.col("kept") | (F.col("n") > 1)))
    out = without(docs, marked, **key)
    again = marked.where("kept")
    if again.isEmpty():
        return out
    # rows repeated under one doc_id: one of them stays
    named = again.select(*[F.col(k).alias(f"__k_{k}") for k in key])
    cond = key["doc_id"].eqNullSafe(F.col("__k_doc_id")) & (key["text_sha256"] == F.col("__k_text_sha256"))
    once = docs.join(named, cond).dropDuplicates(["__k_doc_id", "__k_text_sha256"]).select(*docs.columns)
    return out.unionByName(once)
