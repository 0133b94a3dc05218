"""Writers: records, reports, datasets, versioned registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalars import confidence


def write_predictions(scored: DataFrame, path: str) -> None:
    """One JSON record per chunk (chunk_id, score and whatever else there is), with its confidence."""
    scored.withColumn("confidence", confidence("score")).write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str, *, by: str) -> None:
    """A small sorted report as one CSV file with a header."""
    rows.orderBy(F.col(by).desc()).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(metrics: dict[str, float] | DataFrame, path: str, spark: SparkSession | None = None) -> None:
    """A bundle of metrics as one JSON document: a dictionary, or a table of one row."""
    rows = metrics if isinstance(metrics, DataFrame) else spark.createDataFrame([tuple(float(v) for v in metrics.values())], ", ".join(f"`{k}` double" for k in metrics))
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_vocabulary(vocabulary: DataFrame, path: str, *, by: tuple[str, ...] = ("n", "rank")) -> None:
    """A vocabulary of bounded size in its order, with its counts, as one JSON lines file."""
    vocabulary.orderBy(*by).coalesce(1).write.mode("overwrite").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_vocabulary`` wrote; empty (n, rank, gram, cnt) where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    kinds = "n int, rank int, gram string, cnt long"
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).json(path)


def write_dataset(chunks: DataFrame, path: str, *, partition: str = "source_date") -> None:
    """A dataset partitioned for later pruning; days that are rewritten replace themselves only."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_releases(chunks: DataFrame, path: str, *, key: str = "hash", date: str = "source_date") -> int:
    """Take up new releases: a folder of JSON lines for each date that is not there yet, with the chunks whose ``key`` no
    earlier release had; the keys that were seen are kept as a versioned set. Gives the number of new chunks. A run that
    broke off is repeated as a whole: its keys are published last, and its dates are written again."""
    spark = chunks.sparkSession
    kind = f"{key} {chunks.schema[key].dataType.simpleString()}, {date} string"
    seen = current(spark, f"{path}/_seen", kind)
    known = seen.select(date).distinct()
    first = chunks.where(F.col(key).isNotNull() & F.col(date).isNotNull()).join(known, date, "left_anti").join(seen.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    first.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).json(f"{path}/releases")
    new = chunks.join(known, date, "left_anti").select(key, F.col(date).cast("string").alias(date)).where(F.col(key).isNotNull() & F.col(date).isNotNull()).distinct()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_seen/v=*/_SUCCESS")
    versions = len(folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or [])
    n = first.count()
    publish(seen.unionByName(new), f"{path}/_seen", versions + 1)
    return n


def publish(rows: DataFrame, path: str, version: int) -> None:
    """A registry's next version: a complete folder, visible once its marker is there. Repeating a version is harmless."""
    rows.write.mode("overwrite").parquet(f"{path}/v={version:012d}")


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete version; empty if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = sorted(x.getPath().toString() for x in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")) or [])
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(done[-1].rsplit("/", 1)[0])


def remove_keys(registry: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return registry.join(gone.select(key).distinct(), key, "left_anti")
