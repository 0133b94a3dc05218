"""Exact deduplication as a stateful stream.

The stream's keyed state (RocksDB, kept in the checkpoint folder) never expires. Under each digest it retains the
stable identifier of the row that stays, the number of rows, and a content locator (file and row number of one of
them). Rows are combined before the shuffle, so a text that a third of the input repeats moves once per task.
A hit (a digest with more than one row) is believed only after its full bytes equal those at the locator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.store import fresh_path
from quillon.sources.shared import settings, stream_pattern

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # each store would reserve megabytes for its manifest and log before it holds anything
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: A digest takes about 100 bytes, so this many stay well below 32 MB when sent to every executor.
BROADCAST_DIGESTS = 250_000


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(frame: DataFrame, digest) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return frame.select(F.col("doc_id"), text.alias("text"), digest(text).alias("digest"), place.alias("place"))


def ingest(spark: SparkSession, path: str, state_dir: str, *, digest=sha256_hex, bytes_per_batch: int = 256 << 30) -> DataFrame:
    """Feed the files at ``path`` that the state has not seen yet; returns the state as digest, keep_id, n, place.

    Calling it again with the same ``state_dir`` after files were added continues where the last call (or a lost
    driver) ended; a batch that is replayed overwrites its own output.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(stream_pattern(path))
    state = _rows(stream, digest).groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.min("place").alias("place")
    )

    def publish(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state_dir}/published/batch={batch}")

    with settings(spark, STATE_STORE):
        query = state.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    kinds = f"digest string, keep_id {schema['doc_id'].dataType.simpleString()}, n long, place struct<file: string, row: long>, batch int"
    published = spark.read.schema(kinds).parquet(f"{state_dir}/published")
    # later batches only raise keep_id and n and lower place, so the newest entry is the extreme one
    return published.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("n"), F.min("place").alias("place"))


def exact_duplicates(spark: SparkSession, path: str, *, state_dir: str | None = None, digest=sha256_hex, bytes_per_batch: int = 256 << 30) -> DataFrame:
    """One row per row of the Parquet table at ``path`` (doc_id, text; other columns are not read):
    doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the largest doc_id stays; rows that share
    that doc_id as well are all marked kept (they are the same document). A null doc_id never stays while its group
    has another id; in a group without any id keep_id is null and kept false. An empty table gives an empty result.
    ``path`` may be a file, a folder or a pattern; letters of a name that are pattern characters are escaped by the caller.
    Texts that share a digest but not their bytes are told apart by the byte check.
    """
    path = path.rstrip("/")
    state_dir = state_dir or fresh_path(spark, "exact-state")
    state = ingest(spark, path, state_dir, digest=digest, bytes_per_batch=bytes_per_batch)
    state.write.mode("overwrite").parquet(f"{state_dir}/latest")
    state = spark.read.schema(state.schema).parquet(f"{state_dir}/latest")
    rows = _rows(spark.read.parquet(path), digest)

    hits = state.where("n > 1").select("digest", F.col("place").alias("kept_place"))
    if hits.count() <= BROADCAST_DIGESTS:
        hits = F.broadcast(hits)
    # each distinct content of a hit, and whether it is the one at the locator
    contents = rows.join(hits, "digest").groupBy("digest", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.max(F.col("place") == F.col("kept_place")).alias("located")
    )
    differing = contents.where(~F.col("located")).select("digest").distinct()
    out = rows.select("doc_id", "digest", sha256_hex(F.col("text")).alias("text_sha256"), "text")
    if differing.limit(1).count():
        apart = contents.join(differing, "digest").select("digest", "text", "keep_id", "n")
        told = out.join(apart, ["digest", "text"])
        out = out.join(differing, "digest", "left_anti").join(state.select("digest", "keep_id", "n"), "digest").unionByName(told.select(*out.columns, "keep_id", "n"))
    else:
        out = out.drop("text").join(state.select("digest", "keep_id", "n"), "digest")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), "text_sha256")
