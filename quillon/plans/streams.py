"""Queries that run a stream over the event table and return its final state; the SQL twins are the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import bindings as B
from quillon.functions import scalars as S
from quillon.operators import metrics as M
from quillon.plans import board
from quillon.plans.catalog import SQL, query
from quillon.sources import sinks
from quillon.sources.shared import shared_path
from quillon.streaming import buffers as U
from quillon.streaming import state as T


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read_stream(spark, f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), "value", F.col("event_type").alias("status"))


@query("""
SELECT user_id AS key, count(*) AS held, round(avg(value) + 1e-9, 6) AS mean, min(ts) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS b FROM events) WHERE b <= 40 GROUP BY user_id""")
def stream_ring_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.latest(T.ring_buffers(_events(spark, sf_dir).select("key", "at", "value"), 40), "key")
    return out.select("key", "held", S.tidy("mean").alias("mean"), F.col("oldest").cast("timestamp_ntz").alias("oldest"))


@query("""
SELECT user_id AS key, round(sum(0.05 * 0.95 ** age * value) + 1e-9, 6) AS ema FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) - 1 AS age FROM events) GROUP BY user_id""")
def stream_moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.latest(T.moving_averages(_events(spark, sf_dir).select("key", "at", "value"), 0.05), "key")
    return out.select("key", S.tidy("ema").alias("ema"))


@query("""
SELECT user_id AS key, max_by(event_type, ts) AS status, count(*) AS events, count(*) FILTER (WHERE b IS NULL OR b <> event_type) AS changes FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) GROUP BY user_id""")
def stream_status_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest(T.status_registry(_events(spark, sf_dir).select("key", "at", "status")), "key")


@query("SELECT user_id AS key, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times FROM events GROUP BY user_id")
def stream_served_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.latest(T.served(_events(spark, sf_dir).select("key", "at")), "key")
    return out.select("key", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "times")


@query("""
WITH w AS (SELECT epoch_ms(((floor((epoch(ts) - 72000) / 259200) * 259200 + 72000) * 1000)::BIGINT) AS start, value, ts FROM events)
SELECT start, count(*) AS n, round(sum(value) + 1e-9, 4) AS total FROM w GROUP BY start HAVING start + INTERVAL 72 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs that the watermark has closed."""
    out = T.latest(T.epochs(_events(spark, sf_dir).select("at", "value")), "start", mode="append")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round(F.col("total") + 1e-9, 4).alias("total"))


@query("""
WITH w AS (SELECT epoch_ms((CASE WHEN t < a THEN a + floor((t - a) / 86400.0) * 86400 ELSE a + floor((t - a) / 259200.0) * 259200 END * 1000)::BIGINT) AS start, value, ts
           FROM (SELECT ts, value, floor(epoch(ts)) AS t, epoch(TIMESTAMP '2024-01-10 20:00:00') AS a FROM events))
SELECT start, count(*) AS n, round(sum(value) + 1e-9, 4) AS total, max(ts) AS newest FROM w GROUP BY start""")
def stream_corrected_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All epochs with all their rows, however late; a row that comes after its epoch corrects it."""
    e = _events(spark, sf_dir).select("at", "value")
    out = T.latest(U.corrected_epochs(e, anchor="2024-01-10 20:00:00"), "start")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round(F.col("total") + 1e-9, 4).alias("total"), F.col("newest").cast("timestamp_ntz").alias("newest"))


@query(SQL["trailing_rewards"])
def stream_trailing_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards over the last 40 answers of each uid, from append buffers."""
    e = T.read_stream(spark, f"{sf_dir}/events.parquet")
    score = F.least(F.col("value") / 100, F.lit(1.0))
    answers = e.select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("nth"), F.array(score).alias("scores"),
        F.array((F.col("event_type") == "purchase").cast("int")).alias("labels"), F.lit(1.0).alias("coverage"), F.lit(None).cast("double").alias("latency"),
    )
    held = T.latest(U.append_buffers(answers, 40), "key")
    recent = held.select(F.col("key").alias("uid"), F.inline(F.arrays_zip(F.col("scores").alias("score"), F.col("labels").alias("y"))))
    r = M.reward(recent, ["uid"]).join(held.select(F.col("key").alias("uid"), "sample_count"), "uid")
    few = F.col("sample_count") < 40
    return r.select("uid", "sample_count", S.tidy(F.when(few, 0.0).otherwise(F.col("reward"))).alias("reward"), S.tidy(F.when(few, 1.0).otherwise(F.col("fpr"))).alias("fpr"))


@query(SQL["audit_states"])
def stream_audit_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit lane as a state machine in a stream."""
    r = board.audit_reports(spark, T.read_stream(spark, f"{sf_dir}/events.parquet"))
    key, digest = F.col("user_id").cast("string").alias("key"), F.sha2(F.col("event_id").cast("string"), 256).alias("input_hash")
    lane = U.audit_lane(r.select(key, F.col("ts").cast("timestamp").alias("created_at"), F.col("event_id").alias("nth"), "status", "status_reason", digest, "proof_verified"))
    path = shared_path(spark, "stream")
    T.run_available(lane, lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out/batch={i}"), f"{path}/checkpoint", mode="append")
    out = spark.read.parquet(f"{path}/out")
    return out.select(F.col("key").cast("long").alias("user_id"), F.col("nth").alias("event_id"), "status", "previous_status", "recent_reports", "verified_reports", "failed_reports")


@query(SQL["stream_moving_averages"])
def stream_restored_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of a stream that stopped half-way: its state is kept as a version, and another stream begins from it."""
    path, half = shared_path(spark, "stream"), B.table(spark, sf_dir, "events")
    middle = half.agg(F.expr("timestamp_seconds((min(unix_timestamp(ts)) + max(unix_timestamp(ts))) div 2)")).first()[0]
    e = _events(spark, sf_dir).select("key", "at", "value")
    T.latest(T.moving_averages(e.where(F.col("at") < F.lit(middle)), 0.05), "key", state_dir=f"{path}/first")
    sinks.publish(T.saved_averages(spark, f"{path}/first/checkpoint"), f"{path}/state", 1)
    kept = sinks.current(spark, f"{path}/state", "key long, ema double")
    out = T.latest(T.moving_averages(e.where(F.col("at") >= F.lit(middle)), 0.05, initial=kept), "key", state_dir=f"{path}/second")
    every = kept.join(out.withColumnRenamed("ema", "newer"), "key", "full")
    return every.select("key", S.tidy(F.coalesce("newer", "ema")).alias("ema"))
