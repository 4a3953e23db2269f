"""Exact deduplication as a stream over keyed state that never expires.

For each digest of the normalised text the state (RocksDB on the executors' disks,
with its checkpoints in the shared folder) keeps the stable id of the row that stays
and the locator of its content: file and row. Rows that hit a known digest are then
compared byte by byte with the content the locator points to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import shared_folder, stage
from .text import SPACE, RowStore

#: State on disk; no space set aside beforehand and small change logs, so that many small partitions stay small.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Bytes of input files in one micro-batch.
MAX_BYTES = 1 << 28
FIRST = -(2**63)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _standing(n_points: Column, doc_id: Column, where: Column) -> Column:
    """Largest for the row that stays: most code points, then the smallest id (null
    ids last), then the first place in the files."""
    return F.struct(
        n_points.alias("points"), F.coalesce(F.bitwise_not(doc_id), F.lit(FIRST)).alias("not_id"),
        F.bitwise_not(where["row"]).alias("not_row"), where["file"].alias("file"), doc_id.alias("doc_id"),
    )


def _rows(docs: DataFrame, digest: Callable[[Column], Column], norm: bool) -> DataFrame:
    out = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
    )
    out = out.select("doc_id", "at", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("points"), normalised(F.col("text")).alias("norm"))
    out = out.withColumn("digest", digest(F.col("norm")))
    return out if norm else out.drop("norm")


def digest_state(spark: SparkSession, path: str, digest=sha256, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Stream every file below ``path`` through the keyed state; returns digest,
    ``keep`` (id and locator of the row that stays) and ``n``."""
    folder = f"{shared_folder(spark)}/panelcast/digests-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    # As a pattern, the path may be one file or a folder of files.
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(f"{path[:-1]}[{path[-1]}]")
    groups = _rows(stream, digest, False).groupBy("digest").agg(
        F.max(_standing(F.col("points"), F.col("doc_id"), F.col("at"))).alias("keep"), F.count("*").alias("n")
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/groups/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = groups.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = "digest string, keep struct<points: bigint, not_id: bigint, not_row: bigint, file: string, doc_id: bigint>, n bigint, batch bigint"
    if query.lastProgress is None and not query.recentProgress:
        return spark.createDataFrame([], kind).drop("batch")
    saved = spark.read.schema(kind).parquet(f"{folder}/groups")
    return saved.groupBy("digest").agg(F.max_by("keep", "batch").alias("keep"), F.max_by("n", "batch").alias("n"))


def dedup(spark: SparkSession, path: str, digest=sha256, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of the Parquet files at ``path``: doc_id, keep_id, group_size,
    kept, digest, and ``at`` (its file and row).

    Null and empty texts, and texts of white space alone, are equal to each other.
    Repeated rows and rows that share an id are rows of their own; one of them stays.
    Null ids stay last among rows of equal length. An empty table gives no rows.
    ``digest`` may be any function of the normalised text: groups whose bytes differ
    are taken apart.
    """
    state = stage(digest_state(spark, path, digest, max_bytes), "digest-state")
    rows = lambda norm: _rows(spark.read.parquet(path), digest, norm)
    own = (F.col("at.file") == F.col("keep.file")) & (F.bitwise_not("at.row") == F.col("keep.not_row"))
    # Hits: every row of a digest that occurs more than once, with its bytes.
    hits = stage(rows(True).join(state.where("n > 1"), "digest").withColumn("stays", own), "digest-hits")
    stays = hits.where("stays").select("digest", F.col("norm").alias("kept_norm"))
    odd = hits.where("not stays").join(stays, "digest").where("norm != kept_norm").groupBy("digest").agg(F.count("*").alias("differ"))
    apart = hits.drop("keep", "n").join(odd, "digest")
    parts = apart.groupBy("digest", "norm").agg(F.max(_standing(F.col("points"), F.col("doc_id"), F.col("at"))).alias("keep2"), F.count("*").alias("n2"))
    apart = apart.join(parts, ["digest", "norm"]).select("at", "keep2", "n2")
    out = rows(False).join(state, "digest").join(apart, "at", "left")
    out = out.withColumn("keep", F.coalesce("keep2", "keep")).withColumn("n", F.coalesce("n2", "n"))
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), own.alias("kept"), "digest", "at")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called. The
    rows are written to the shared folder first, so that the stream and the locators have
    files to point to. Other cases are as in :func:`dedup`."""
    store = RowStore(docs, "corpus")
    kept = dedup(docs.sparkSession, store.path, **options).where("kept")
    return store.keep(kept.select("at.file", "at.row"))
