"""Keyed state over streams: ring buffers, averages, status registries, deduplicated chunks, epochs.

Each takes a streaming DataFrame and gives one. State lives in RocksDB below the checkpoint folder and is bounded per
key. The batch twins are in ``quillon.operators``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.sources.shared import settings, shared_path, stream_pattern

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


class RingBuffer(StatefulProcessor):
    """Keeps the last n (at, value) of a key; tells how many it holds, their mean and the oldest."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "at timestamp, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = pd.DataFrame(list(self.held.get()), columns=["at", "value"]) if self.held.exists() else pd.DataFrame({"at": [], "value": []})
        new = pd.concat([old, *(x[["at", "value"]] for x in rows)]) if len(old) else pd.concat([x[["at", "value"]] for x in rows])
        last = new.sort_values("at").tail(self.n)
        self.held.put([(a.to_pydatetime(), float(v)) for a, v in zip(last["at"], last["value"], strict=True)])
        yield pd.DataFrame({"key": [key[0]], "held": [len(last)], "mean": [float(last["value"].mean())], "oldest": [last["at"].iloc[0]]})

    def close(self) -> None:
        pass


class MovingAverage(StatefulProcessor):
    """The exponential moving average of a key's values in order of ``at``, from zero."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mean = handle.getValueState("mean", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value = self.mean.get()[0] if self.mean.exists() else 0.0
        for v in pd.concat(list(rows)).sort_values("at")["value"]:
            value = self.alpha * float(v) + (1 - self.alpha) * value
        self.mean.update((value,))
        yield pd.DataFrame({"key": [key[0]], "ema": [value]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.mean.update((float(initialState["ema"].iloc[0]),))

    def close(self) -> None:
        pass


class StatusRegistry(StatefulProcessor):
    """Counts events and changes of status per key; remembers the last status. The first event is a change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "status string, events long, changes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, events, changes = self.seen.get() if self.seen.exists() else (None, 0, 0)
        for s in pd.concat(list(rows)).sort_values("at")["status"]:
            events, changes = events + 1, changes + (s != status)
            status = s
        self.seen.update((status, events, changes))
        yield pd.DataFrame({"key": [key[0]], "status": [status], "events": [events], "changes": [changes]})

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, processor: StatefulProcessor, schema: str, initial: DataFrame | None = None) -> DataFrame:
    first = None if initial is None else initial.groupBy("key")
    return stream.groupBy("key").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Update", timeMode="None", initialState=first)


def ring_buffers(stream: DataFrame, n: int) -> DataFrame:
    """key, held, mean, oldest from key, at, value."""
    return _stateful(stream, RingBuffer(n), f"key {stream.schema['key'].dataType.simpleString()}, held long, mean double, oldest timestamp")


def moving_averages(stream: DataFrame, alpha: float, *, initial: DataFrame | None = None) -> DataFrame:
    """key, ema from key, at, value. ``initial`` (key, ema; a row a key): where another stream stopped."""
    return _stateful(stream, MovingAverage(alpha), f"key {stream.schema['key'].dataType.simpleString()}, ema double", initial)


def saved_averages(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, ema of a stream of averages, as its last batch left them."""
    state = spark.read.format("statestore").option("stateVarName", "mean").load(checkpoint)
    key = state.schema["key"].dataType.fields[0].name
    return state.select(F.col("key")[key].alias("key"), F.col("value.value").alias("ema"))


def status_registry(stream: DataFrame) -> DataFrame:
    """key, status, events, changes from key, at, status."""
    return _stateful(stream, StatusRegistry(), f"key {stream.schema['key'].dataType.simpleString()}, status string, events long, changes long")


def served(stream: DataFrame) -> DataFrame:
    """key, first_seen, last_seen, times from key, at: all on the JVM."""
    return stream.groupBy("key").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("times"))


def epochs(stream: DataFrame, *, late: str = "1 hour", hours: int = 72, anchor: str = "20 hours") -> DataFrame:
    """start, n, total of every closed epoch of at, value; rows later than ``late`` are left out."""
    w = F.window("at", f"{hours} hours", startTime=anchor)
    return stream.withWatermark("at", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def unseen(stream: DataFrame, *, late: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["key"])


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "update") -> None:
    """Process what is there and stop. Offsets are committed after the sink returns: a batch that failed comes again
    under its number, so sinks write by number (at least once, idempotent)."""
    with settings(stream.sparkSession, STATE_STORE):
        stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(stream: DataFrame, key: str, *, state_dir: str | None = None, mode: str = "update") -> DataFrame:
    """Run the stream over all available input and return the newest row of each key."""
    spark = stream.sparkSession
    state_dir = state_dir or shared_path(spark, "stream")
    run_available(stream, lambda df, i: df.write.mode("overwrite").parquet(f"{state_dir}/out/batch={i}"), f"{state_dir}/checkpoint", mode=mode)
    rows = spark.read.parquet(f"{state_dir}/out")
    kept = [c for c in rows.columns if c not in (key, "batch")]
    newest = rows.groupBy(key).agg(F.max(F.struct("batch", *kept)).alias("x"))
    return newest.select(key, *(F.col(f"x.{c}").alias(c) for c in kept))


def read_stream(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(stream_pattern(path))
