"""Shared-folder tables and binary files.

Every intermediate table goes below the folder that the cluster names in ``spark.checkpoint.dir``; a folder of
our own is used only where that setting is absent (tests, a laptop). Tables are written once and reread, which
cuts lineage: a lost executor re-reads files and recomputes no earlier stage.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else a temporary folder of this machine (local mode only)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/quillon-shared"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"


_scopes: list[list[tuple[DataFrame, str]]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Within this block tables are noted as they are materialised, and deleted at its end but for those that were
    passed to the function it gives: what the caller still reads."""
    made: list[tuple[DataFrame, str]] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield kept.append
    finally:
        _scopes.remove(made)
        for df, path in made:
            if not any(df is k for k in kept):
                remove(spark, path)
            elif _scopes:
                _scopes[-1].append((df, path))


def materialize(df: DataFrame, name: str, *, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _scopes:
        _scopes[-1].append((table, path))
    return table


def row_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with __key, a table that it reads). Rows are one document only where doc_id and __key are equal: the
    key of a row with a doc_id is a hash of its text, and rows without one are each a document of their own. These are
    written once with their numbers, so that every reader sees the same ones."""
    unnamed = docs.where("doc_id is null").withColumn("__key", F.monotonically_increasing_id())
    unnamed = materialize(unnamed, "rows-without-id")
    return docs.where("doc_id is not null").withColumn("__key", F.xxhash64("text")).unionByName(unnamed), unnamed


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(*columns: str) -> Column:
    """A 64-bit hash of a row's named columns in which null is a value of its own."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c), F.col(c).isNull())))


def bounded_batches(spark: SparkSession) -> None:
    """Cap the Arrow batches of this session's Python stages by bytes, so that a worker's memory doesn't depend on how
    long the texts are. Every operator that runs Python calls it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by this module."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_binary_files(rows: DataFrame, path: str, trailer: bytes) -> None:
    """Write each row's single ``value`` (string holding raw bytes) as a file of its own, followed by ``trailer``.

    Spark's text writer puts a separator of our choice behind every record and starts a new file after
    ``maxRecordsPerFile`` records, so one record per file with the format's own closing bytes as separator gives
    byte-exact binary files on any file system Spark can write, with its commit protocol.
    """
    (
        rows.select(rows["value"].cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", trailer.decode("latin-1"))
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20, max_rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``max_bytes`` each, of ``max_rows`` at most; a longer single row
    is a slice alone."""
    start, size = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths.tolist()):
        if i > start and (size + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)
