"""The folder that driver and executors share, for checkpoints and intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; below a local temporary folder where that is unset (local mode)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or 'file://' + tempfile.gettempdir() + '/quillon-shared').rstrip('/')}/quillon/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` worked out once and written below the shared folder, for what is read by more jobs than one."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def stream_pattern(path: str) -> str:
    """The path as a pattern that matches only itself: a stream then takes a single file as well as a folder. A path that
    is a pattern already stays one."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[]{}\\") else f"{path[:-1]}[{path[-1]}]"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's options are ``values`` within this block and as before after it. A stream keeps those it began with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
