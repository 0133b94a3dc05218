"""Queries of leaderboards, weights, registries, set operations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import bindings as B
from quillon.functions import scalars as S
from quillon.functions.python_json import json_text
from quillon.operators import board as L
from quillon.operators import metrics as M
from quillon.operators import rollups as R
from quillon.operators import sequences as Q
from quillon.plans.catalog import query
from quillon.plans.metrics import CURVE_SQL
from quillon.sources import chunks as C


def _tidy(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(S.tidy(c).alias(c) for c in df.columns if c not in keys))


def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.reward(B.responses(spark, sf_dir), ["uid"])


@query(B.with_sql(CURVE_SQL.format(k="uid", t="responses") + """
, top AS (SELECT uid, row_number() OVER (ORDER BY reward DESC, uid) AS r FROM rwd WHERE reward > 0 QUALIFY r <= 3)
SELECT uid::BIGINT AS uid, round(w + 1e-9, 6) AS weight FROM (SELECT 0 AS uid, CASE WHEN (SELECT count(*) FROM top) > 0 THEN 0.7 ELSE 1.0 END AS w UNION ALL SELECT uid, 0.3 * [0.5, 0.3, 0.2][r::INT] FROM top)"""))
def podium_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(L.podium(_rewards(spark, sf_dir)), "uid")


@query("""
WITH g AS (SELECT s_suppkey AS uid, s_acctbal AS weight FROM supplier WHERE s_suppkey BETWEEN 1 AND 127 AND s_acctbal > 0)
SELECT i::INT AS uid, round(CASE WHEN i = 0 THEN 0.7 ELSE coalesce(weight * 0.3 / (SELECT sum(weight) FROM g), 0) END + 1e-9, 6) AS weight FROM range(0, 128) r(i) LEFT JOIN g ON uid = i""")
def settlement_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = B.table(spark, sf_dir, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("uid"), F.col("s_acctbal").alias("weight"))
    return _tidy(L.settlement_vector(w, 128), "uid")


@query("""SELECT s_suppkey AS uid, floor(greatest(s_acctbal, 0) / max(greatest(s_acctbal, 0)) OVER () * 65535)::INT AS weight FROM supplier""")
def emitted_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.emitted(B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), F.col("s_acctbal").alias("weight")))


@query("SELECT s_suppkey, round(s_acctbal / (SELECT sum(abs(s_acctbal)) FROM supplier) + 1e-9, 6) AS s_acctbal FROM supplier")
def normalized_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(L.normalized(B.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal"), "s_suppkey")


@query(B.with_sql(", r2 AS (SELECT uid, score, y FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, event_id DESC) AS b FROM responses) WHERE b <= 40)" + CURVE_SQL.format(k="uid", t="r2") + """
SELECT uid, n AS sample_count, round(CASE WHEN n < 40 THEN 0 ELSE reward END + 1e-9, 6) AS reward, round(CASE WHEN n < 40 THEN 1 ELSE fpr END + 1e-9, 6) AS fpr FROM rwd JOIN (SELECT uid, count(*) AS n FROM r2 GROUP BY uid) USING (uid)"""))
def trailing_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards over the last 40 answers of each uid; with fewer, nothing is earned."""
    recent = Q.trailing(B.responses(spark, sf_dir), ["uid"], ["ts", "event_id"], 40).select("uid", "score", "y")
    n = recent.groupBy("uid").agg(F.count(F.lit(1)).alias("sample_count"))
    r = M.reward(recent, ["uid"]).join(n, "uid")
    few = F.col("sample_count") < 40
    return r.select("uid", "sample_count", S.tidy(F.when(few, 0.0).otherwise(F.col("reward"))).alias("reward"), S.tidy(F.when(few, 1.0).otherwise(F.col("fpr"))).alias("fpr"))


@query(B.with_sql("""
, a AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY ts DESC) - 1 AS age FROM responses)
SELECT uid, round(sum(0.05 * 0.95 ** age * score) + 1e-9, 6) AS ema FROM a GROUP BY uid"""))
def reward_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(Q.ema(B.responses(spark, sf_dir), ["uid"], "ts", "score", 0.05, "ema"), "uid")


@query(B.with_sql("""
, c AS (SELECT cycle, row_number() OVER (ORDER BY cycle DESC) - 1 AS age FROM (SELECT DISTINCT cycle FROM responses)),
d AS (SELECT uid, cycle, avg(score) AS score FROM responses GROUP BY uid, cycle)
SELECT uid, round(sum(0.05 * 0.95 ** age * score) + 1e-9, 6) AS ema FROM d JOIN c USING (cycle) GROUP BY uid"""))
def reward_ema_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages by cycle, in which a missed cycle counts as a zero."""
    r = B.responses(spark, sf_dir).groupBy("uid", "cycle").agg(F.avg("score").alias("score"))
    return _tidy(Q.ema(r, ["uid"], "cycle", "score", 0.05, "ema", cycles=r), "uid")


@query("""
WITH e AS (SELECT uid, n, row_number() OVER (ORDER BY uid) - 1 AS i, count(*) OVER () AS c FROM (SELECT c_custkey AS uid, c_name AS n FROM customer WHERE c_custkey <> 0 AND c_nationkey % 2 = 1 AND c_acctbal > 0))
SELECT uid FROM e WHERE c <= 16 OR (i - ((7 - 1) * 16) % c + c) % c < 16""")
def rotating_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen candidates of one cycle, after the filter for reachable nodes."""
    c = B.table(spark, sf_dir, "customer")
    nodes = c.select(
        F.col("c_custkey").alias("uid"), (F.col("c_nationkey") % 2 == 0).alias("permit"), F.lit("10.0.0.1").alias("ip"), F.when(F.col("c_acctbal") > 0, 8091).otherwise(0).alias("port")
    )
    return L.rotating_page(L.eligible_miners(nodes), "uid", 7, 16).select("uid")


@query(B.with_sql("""
, r AS (SELECT uid, cycle, event_id, score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, event_id DESC) <= 5 AS f, count(*) OVER (PARTITION BY uid) AS n FROM responses),
b AS (SELECT *, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS part FROM r WINDOW w AS (PARTITION BY uid, f))
SELECT uid, event_id AS idx, round(CASE WHEN n <= 5 THEN score WHEN f THEN round(0.5 + 1e-6 + part * (0.5 - 1e-6), 6) ELSE round(part * (0.5 - 1e-6), 6) END + 1e-9, 6) AS score FROM b"""))
def top_k_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = B.responses(spark, sf_dir).select("uid", F.col("event_id").alias("idx"), "score")
    return _tidy(L.top_k_bands(r, ["uid"], 5), "uid", "idx")


@query("""
SELECT count(*) AS nodes, count(*) FILTER (WHERE c_acctbal > 0) AS active, count(*) FILTER (WHERE c_nationkey % 2 = 0) AS permits, count(*) FILTER (WHERE c_nationkey % 2 = 0 AND c_acctbal > 0) AS active_validators,
  count(*) FILTER (WHERE c_nationkey % 2 = 1 AND c_acctbal > 0 AND c_custkey <> 0) AS active_miners, (SELECT c_acctbal FROM customer WHERE c_custkey = 1) AS burn_balance FROM customer""")
def network_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "customer")
    nodes = c.select(F.col("c_custkey").alias("uid"), (F.col("c_nationkey") % 2 == 0).alias("permit"), (F.col("c_acctbal") > 0).alias("active"), F.col("c_acctbal").alias("balance"))
    return R.network_snapshot(nodes, burn_uid=1)


MANIFEST_SQL = """
WITH m AS (SELECT p_partkey AS uid, p_size % 4 > 0 AS open_source, CASE WHEN p_size % 5 = 0 THEN '  ' WHEN p_size % 7 = 0 THEN 'https://example.org/base.git/' ELSE 'https://example.org/' || p_brand END AS repo_url,
    CASE WHEN p_size % 6 = 0 THEN 'main' ELSE substr(sha256(p_name), 1, 12) END AS repo_commit, CASE WHEN p_size % 14 = 0 THEN 'base' ELSE p_name END AS model_name, p_type AS model_version,
    CASE WHEN p_size % 9 > 0 THEN 'public' END AS training_data_statement, 'none' AS private_data_attestation, CASE WHEN p_size % 8 > 0 THEN [' a.py ', ''] ELSE [''] END AS implementation_files,
    CASE WHEN p_size % 10 > 0 THEN sha256(p_brand) END AS implementation_sha256 FROM part),
c AS (SELECT uid, list_filter([CASE WHEN NOT open_source THEN 'open_source' END, CASE WHEN trim(repo_url) = '' THEN 'repo_url' END, CASE WHEN trim(coalesce(training_data_statement, '')) = '' THEN 'training_data_statement' END,
    CASE WHEN len(list_filter(implementation_files, lambda x: trim(x) <> '')) = 0 THEN 'implementation_files' END, CASE WHEN implementation_sha256 IS NULL THEN 'implementation_sha256' END], lambda x: x IS NOT NULL) AS missing,
    list_filter([CASE WHEN NOT regexp_full_match(repo_commit, '[0-9a-f]{7,40}') THEN 'repo_commit_invalid' END,
      CASE WHEN repo_url = 'https://example.org/base.git/' AND model_name <> 'base' THEN 'repo_url_must_point_to_model_repo' END], lambda x: x IS NOT NULL) AS broken,
    list_filter([CASE WHEN NOT open_source THEN 'manifest_not_open_source' END, CASE WHEN trim(repo_url) = '' THEN 'manifest_missing_repo_url' END, CASE WHEN training_data_statement IS NULL THEN 'manifest_missing_training_data_statement' END], lambda x: x IS NOT NULL) AS reasons FROM m)
"""


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = B.table(spark, sf_dir, "part"), F.col("p_size")
    url = F.when(size % 5 == 0, "  ").when(size % 7 == 0, "https://example.org/base.git/").otherwise(F.concat(F.lit("https://example.org/"), "p_brand"))
    return p.select(
        F.col("p_partkey").alias("uid"), (size % 4 > 0).alias("open_source"), url.alias("repo_url"),
        F.when(size % 6 == 0, "main").otherwise(F.substring(F.sha2(F.col("p_name").cast("binary"), 256), 1, 12)).alias("repo_commit"),
        F.when(size % 14 == 0, "base").otherwise(F.col("p_name")).alias("model_name"), F.col("p_type").alias("model_version"), F.when(size % 9 > 0, "public").alias("training_data_statement"),
        F.lit("none").alias("private_data_attestation"), F.when(size % 8 > 0, F.array(F.lit(" a.py "), F.lit(""))).otherwise(F.array(F.lit(""))).alias("implementation_files"),
        F.when(size % 10 > 0, F.sha2(F.col("p_brand").cast("binary"), 256)).alias("implementation_sha256"),
    )


@query(MANIFEST_SQL + """
SELECT uid, array_to_string(missing, ',') AS missing_fields, array_to_string(broken, ',') AS policy_violations, CASE WHEN len(missing) = 0 AND len(broken) = 0 THEN 'transparent' ELSE 'opaque' END AS status, array_to_string(reasons, ',') AS reasons FROM c""")
def manifest_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = L.compliance(L.normalized_manifest(_manifests(spark, sf_dir)), reference_repo="https://example.org/base", reference_model="base")
    return m.select("uid", F.array_join("missing_fields", ",").alias("missing_fields"), F.array_join("policy_violations", ",").alias("policy_violations"), "status", F.array_join(L.suspicion(m), ",").alias("reasons"))


@query(MANIFEST_SQL + """SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM c) GROUP BY reason
UNION ALL SELECT s, count(*) FROM (SELECT CASE WHEN len(missing) = 0 AND len(broken) = 0 THEN 'transparent' ELSE 'opaque' END AS s FROM c) GROUP BY s UNION ALL SELECT 'tracked', count(*) FROM c""")
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = L.compliance(L.normalized_manifest(_manifests(spark, sf_dir)), reference_repo="https://example.org/base", reference_model="base")
    told = F.concat(L.suspicion(m), F.array("status", F.lit("tracked")))
    return m.select(F.explode(told).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_partkey % 500 AS chunk, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(*) AS times, count(*) - 1 AS repeats FROM lineitem GROUP BY 1""")
def served_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("chunk"), "l_shipdate")
    return L.served_registry(li, "chunk", "l_shipdate")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE b IS NULL OR b <> event_type""")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.changes(B.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_type").drop("ts")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) WHERE b <= 64""")
def ring_of_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.trailing(B.table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 64).select("user_id", "event_id")


@query("""
SELECT c_custkey AS uid, e AS expected, least(coalesce(r, 0), e)::BIGINT AS received, round(coalesce(least(coalesce(r, 0), e) / nullif(e, 0)::DOUBLE, 0) + 1e-9, 6) AS coverage
FROM (SELECT c_custkey, 12::BIGINT AS e FROM customer) LEFT JOIN (SELECT o_custkey, count(*) AS r FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey) ON c_custkey = o_custkey""")
def response_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.lit(12).cast("long").alias("expected"))
    received = B.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("uid"))
    return _tidy(L.coverage(expected, received, ["uid"]), "uid", "expected", "received")


@query("""
SELECT c_custkey AS uid, coalesce(c_name, 'unknown') AS hotkey, n_name AS model_name, coalesce(orders, 0) AS sample_count, round(coalesce(spent, 0) + 1e-9, 2) AS reward, s_name AS digest
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey""")
def leaderboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per uid from four sources, each of which may lack it."""
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("hotkey"), "c_nationkey")
    models = c.join(B.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("uid", F.col("n_name").alias("model_name"))
    spent = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.count(F.lit(1)).alias("sample_count"), F.sum("o_totalprice").alias("reward"))
    digests = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), F.col("s_name").alias("digest"))
    out = R.leaderboard(c.select("uid", "hotkey"), [models, spent, digests], "uid", defaults={"hotkey": "unknown", "sample_count": 0, "reward": 0.0})
    return out.withColumn("reward", F.round(F.col("reward") + 1e-9, 2))


@query("""
WITH s AS (SELECT conv_id, list(turn ORDER BY turn) AS a, list(length(text) ORDER BY turn) FILTER (WHERE turn > 1) AS b FROM conversations GROUP BY conv_id)
SELECT conv_id, i - 1 AS pos, a[i] AS turn, b[i] AS size FROM s, range(1, 100) r(i) WHERE i <= least(len(a), coalesce(len(b), 0))""")
def zipped_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of unequal length paired by position."""
    c = B.table(spark, sf_dir, "conversations")
    take = lambda cond, v: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", v.alias("v"))))), lambda x: x["v"])
    s = c.groupBy("conv_id").agg(take(F.lit(True), F.col("turn")).alias("turn"), take(F.col("turn") > 1, F.length("text").cast("long")).alias("size"))
    return L.zip_ordinal(s, s, ["conv_id"], "turn", "size").withColumn("pos", F.col("pos").cast("long"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def unseen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"))
    return L.unseen(li, B.table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("k")), "k").withColumnRenamed("k", "l_partkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def admitted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A membership test as a semi join."""
    o = B.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.admitted(B.table(spark, sf_dir, "customer"), o, "c_custkey").select("c_custkey")


@query("""
WITH a AS (SELECT s_suppkey AS uid, s_name AS k FROM supplier WHERE s_suppkey % 5 <> 0), b AS (SELECT s_suppkey AS uid, CASE WHEN s_suppkey % 3 = 0 THEN s_name || 'x' ELSE s_name END AS k FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT coalesce(a.uid, b.uid) AS uid, CASE WHEN a.uid IS NULL THEN 'new' WHEN b.uid IS NULL THEN 'gone' WHEN a.k = b.k THEN 'same' ELSE 'reset' END AS state FROM a FULL JOIN b ON a.uid = b.uid""")
def owner_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new owners by uid: a changed owner resets the score, new uids lengthen the vector."""
    s = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), F.col("s_name").alias("owner"))
    new = s.where("uid % 7 <> 0").withColumn("owner", F.when(F.col("uid") % 3 == 0, F.concat("owner", F.lit("x"))).otherwise(F.col("owner")))
    return R.owner_states(s.where("uid % 5 <> 0"), new, "uid", "owner")


@query("""
SELECT ts::TIMESTAMP AS ts, make_timestamp((CASE WHEN t < a THEN a + floor((t - a) / 86400.0) * 86400 ELSE a + floor((t - a) / 259200.0) * 259200 END * 1000000)::BIGINT) AS start,
  strftime(make_timestamp((CASE WHEN t < a THEN a + floor((t - a) / 86400.0) * 86400 ELSE a + floor((t - a) / 259200.0) * 259200 END * 1000000)::BIGINT), 'day_%Y-%m-%d_%H%Mutc') AS epoch_id
FROM (SELECT DISTINCT ts, floor(epoch(ts)) AS t, epoch(TIMESTAMP '2024-01-10 20:00:00') AS a FROM events)""")
def event_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs of three days on from an anchor, of a day before it."""
    ts = B.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts")).distinct()
    start = L.epoch_start(F.col("ts"), anchor="2024-01-10 20:00:00")
    name = F.concat(F.lit("day_"), F.date_format(start, "yyyy-MM-dd"), F.lit("_"), F.date_format(start, "HHmm"), F.lit("utc"))
    return ts.select(F.col("ts").cast("timestamp_ntz").alias("ts"), start.cast("timestamp_ntz").alias("start"), name.alias("epoch_id"))


@query("""
SELECT uid, row_number() OVER (ORDER BY (TRY_CAST(uid AS BIGINT) IS NULL)::INT, TRY_CAST(uid AS BIGINT), uid) AS place FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS uid FROM part)""")
def mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric ids by value before all others (a list of distinct ids, small by construction)."""
    ids = B.table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")).alias("uid")).distinct()
    return ids.select("uid", F.row_number().over(Window.orderBy(*L.numeric_first("uid"))).cast("long").alias("place"))


@query("""
SELECT 'orders' AS origin, o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'customers', c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'parts', p_partkey FROM part WHERE p_size = 1""")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    c = B.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    p = B.table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("k"))
    return R.union_of({"orders": o, "customers": c, "parts": p})


@query("""
SELECT o_orderpriority, list_sort(list_distinct(list(o_orderstatus))) = ['F', 'O', 'P'] AS has_all, array_to_string(list_sort(list_filter(['F', 'O', 'P', 'X'], lambda s: NOT list_contains(list_distinct(list(o_orderstatus)), s))), ',') AS absent FROM orders GROUP BY o_orderpriority""")
def set_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subset and difference against a required set."""
    got = R.set_report(B.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", required=["F", "O", "P"], wanted=["F", "O", "P", "X"])
    return got.select("o_orderpriority", "has_all", F.array_join("absent", ",").alias("absent"))


@query("""
SELECT o_custkey AS chunk_id,
  sha256(string_agg(sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice || '}'), chr(10) ORDER BY o_orderkey)) AS digest,
  sha256('[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice || '}', ',' ORDER BY o_orderkey) || ']') AS fingerprint,
  array_to_string(list_sort(list(DISTINCT o_orderkey % 7)), ',') AS residues
FROM orders GROUP BY o_custkey""")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of a chunk's content in a stable order, one over any number of rows, one as Python makes it; its distinct sorted ids."""
    o = B.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "chunk_id")
    fields = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    told = o.select("chunk_id", "o_orderkey", json_text(F.struct(*fields), o.select(*fields).schema).alias("payload"))
    out = R.content_digest(o, ["chunk_id"], "o_orderkey", fields).join(R.fingerprints(told, ["chunk_id"], "o_orderkey"), "chunk_id")
    ids = R.distinct_ids(o, ["chunk_id"], F.col("o_orderkey") % 7, "ids")
    return out.join(ids, "chunk_id").select("chunk_id", "digest", "fingerprint", F.array_join("ids", ",").alias("residues"))


@query(B.with_sql("""
SELECT cycle, count(*) AS n, round(min(score) + 1e-9, 6) AS lowest, round(max(score) + 1e-9, 6) AS highest, round(avg(score) + 1e-9, 6) AS mean, count(*) FILTER (WHERE score > 0) AS nonzero, round(count(DISTINCT uid) / (SELECT count(DISTINCT user_id) FROM events)::DOUBLE + 1e-9, 6) AS response_rate FROM responses GROUP BY cycle"""))
def cycle_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = B.responses(spark, sf_dir)
    everyone = r.agg(F.countDistinct("uid")).first()[0]
    return _tidy(R.cycle_summary(r, ["cycle"], "score", "uid", everyone), "cycle", "n", "nonzero")


@query(B.with_sql("""
, p AS (SELECT l_orderkey AS hand_id, (l_suppkey % 6 + 1)::INT AS seat, l_extendedprice AS stack, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 6 ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem WHERE l_linenumber > 1)
SELECT acts.hand_id, ord, coalesce(round(stack, 2), -1) AS stack FROM acts LEFT JOIN p ON p.hand_id = acts.hand_id AND p.seat = acts.seat AND r = 1"""))
def actor_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action with its actor's stack: the last player listed for a seat counts, a seat without one has none."""
    li = B.table(spark, sf_dir, "lineitem").where("l_linenumber > 1")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    players = li.select(F.col("l_orderkey").alias("hand_id"), (F.col("l_suppkey") % 6 + 1).cast("int").alias("seat"), *order, F.col("l_extendedprice").alias("stack"))
    out = R.with_last(B.actions(spark, sf_dir), players, ["hand_id", "seat"], order, "stack")
    return out.select("hand_id", F.col("ord").cast("long").alias("ord"), F.coalesce(F.round("stack", 2), F.lit(-1.0)).alias("stack"))


@query("""
WITH o AS (SELECT o_custkey AS batch, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderkey AS own FROM orders),
refs AS (SELECT c_custkey AS batch, range(c_custkey * 10, c_custkey * 10 + c_custkey % 6) AS ids FROM customer)
SELECT o.batch, i, coalesce(ids[(i + 1)::INT], own) AS reference FROM o LEFT JOIN refs USING (batch)""")
def batch_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th reference of a batch, or the row's own id where the list is too short."""
    o = B.table(spark, sf_dir, "orders")
    own = o.select(F.col("o_custkey").alias("batch"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("i"), F.col("o_orderkey").alias("own"))
    k, n = F.col("c_custkey"), F.col("c_custkey") % 6
    refs = B.table(spark, sf_dir, "customer").select(k.alias("batch"), F.when(n > 0, F.sequence(k * 10, k * 10 + n - 1)).otherwise(F.array().cast("array<bigint>")).alias("ids"))
    return R.by_position(own, refs, "batch", "i", "ids", "own", "reference").drop("own")


@query(B.with_sql("""
SELECT c_custkey AS chunk_id, round(coalesce(m, h, 0.5) + 1e-9, 6) AS score, CASE WHEN m IS NOT NULL THEN 'model' WHEN h IS NOT NULL THEN 'heuristic' ELSE 'constant' END AS origin
FROM customer LEFT JOIN (SELECT user_id, avg(value) / 1000 AS m FROM events GROUP BY user_id) ON user_id = c_custkey LEFT JOIN (SELECT chunk_id, avg(hand_id % 10) / 10 AS h FROM hands GROUP BY chunk_id) ON chunk_id = c_custkey"""))
def degraded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's score, else a heuristic's, else one half."""
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"))
    model = B.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("chunk_id")).agg((F.avg("value") / 1000).alias("score"))
    rule = B.hands(spark, sf_dir).groupBy("chunk_id").agg((F.avg(F.col("hand_id") % 10) / 10).alias("score"))
    return _tidy(R.degraded(c, "chunk_id", [("model", model), ("heuristic", rule)]), "chunk_id", "origin")


@query("""
WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events)
SELECT user_id, count(*) AS reports, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS passed, round(max(value) + 1e-9, 6) AS worst FROM r WHERE b <= 32 GROUP BY user_id""")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status over the last 32 reports of each key; the evidence itself is left out."""
    e = B.table(spark, sf_dir, "events")
    out = R.audit_report(e, ["user_id"], ["ts", "event_id"], "event_type", {"failed": "error", "passed": "purchase"}, worst="value")
    return out.withColumn("worst", S.tidy("worst"))


#: Reports of audits that stand behind the events: whom they asked, how, and what came of it.
AUDIT_SQL = """
r AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS proof, CASE event_id % 11 WHEN 0 THEN 'none' WHEN 1 THEN 'other' ELSE 'main' END AS provider,
        CASE WHEN event_id % 7 = 0 THEN 'disabled' ELSE 'shadow' END AS mode, event_id % 13 <> 0 AS ready, event_type = 'error' AS broke FROM events),
s AS (SELECT *, CASE WHEN provider = 'none' THEN 'local_only' WHEN provider = 'other' THEN 'provider_unsupported' WHEN mode = 'disabled' THEN 'provider_disabled' WHEN NOT ready THEN 'provider_unconfigured'
        WHEN broke THEN 'provider_failed' WHEN proof THEN 'verified' ELSE 'provider_completed' END AS status FROM r),
l AS (SELECT user_id, event_id, status, lag(status) OVER w AS previous_status, count(*) OVER v AS recent_reports, count(*) FILTER (WHERE status = 'verified') OVER v AS verified_reports,
        count(*) FILTER (WHERE status IN ('provider_unsupported', 'provider_disabled', 'provider_unconfigured', 'provider_failed')) OVER v AS failed_reports
      FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW))
"""


def audit_reports(spark: SparkSession, events: DataFrame) -> DataFrame:
    """user_id, ts, event_id, status, status_reason, proof_verified of ``events``."""
    n, kind = F.col("event_id"), F.col("event_type")
    provider = F.when(n % 11 == 0, "none").when(n % 11 == 1, "other").otherwise("main")
    mode = F.when(n % 7 == 0, "disabled").otherwise("shadow")
    status, reason = R.audit_status(provider, mode, n % 13 != 0, F.when(kind == "error", "no answer"), kind == "purchase", supported="main")
    return events.select("user_id", "ts", "event_id", status.alias("status"), reason.alias("status_reason"), (status == "verified").alias("proof_verified"))


@query(f"WITH {AUDIT_SQL.strip()} SELECT * FROM l")
def audit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report's status, the status before it, and the counts over its key's last 32 reports."""
    lane = R.audit_lane(audit_reports(spark, B.table(spark, sf_dir, "events")), ["user_id"], ["ts", "event_id"])
    return lane.select("user_id", "event_id", "status", "previous_status", "recent_reports", "verified_reports", "failed_reports")


@query(B.with_sql("""
, a AS (SELECT hand_id, string_agg('{"action_id":"' || ord || '","action_type":"' || action_type || '","actor_seat":' || seat || ',"amount":' || amount || ',"call_to":' || coalesce(call_to::VARCHAR, 'null')
          || ',"normalized_amount_bb":' || amount_bb || ',"pot_after":' || pot_after || ',"pot_before":' || pot_before || ',"raise_to":' || coalesce(raise_to::VARCHAR, 'null') || ',"street":"' || street || '"}', ',' ORDER BY ord) AS t FROM acts GROUP BY hand_id),
p AS (SELECT hand_id, string_agg('{"hole_cards":null,"player_uid":"seat_' || seat || '","seat":' || seat || ',"showed_hand":false,"starting_stack":' || stack || '}', ',' ORDER BY seat) AS t FROM players GROUP BY hand_id),
s AS (SELECT hand_id, string_agg('{"board_cards":[],"street":"' || street || '"}', ',' ORDER BY nth) AS t FROM streets GROUP BY hand_id)
SELECT chunk_id, hand_id, sha256('{"actions":[' || coalesce(a.t, '') || CASE hand_id % 3 WHEN 0 THEN '],"label":"human' WHEN 1 THEN '],"label":"bot' ELSE ']' END || CASE WHEN hand_id % 3 < 2 THEN '"' ELSE '' END
    || ',"metadata":{"ante":0.0,"bb":' || (hand_id % 97)::DOUBLE / 7 || ',"button_seat":' || hand_id % 7 || ',"game_type":"caf\\u00e9 \\"x\\"","hand_ended_on_street":"","hero_seat":' || hero_seat || ',"limit_type":"","max_seats":6,"rng_seed_commitment":null,"sb":0.0}'
    || ',"outcome":{"payouts":{},"rake":0.0,"result_reason":"","showdown":false,"total_pot":0.0,"winners":[]},"players":[' || coalesce(p.t, '') || '],"streets":[' || coalesce(s.t, '') || ']}') AS payload_sha256
FROM hands LEFT JOIN a USING (hand_id) LEFT JOIN p USING (hand_id) LEFT JOIN s USING (hand_id)"""))
def payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hand put together from its players, streets and actions, decoded, projected and written as canonical JSON."""
    ordered = lambda df, k, x: df.groupBy("hand_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(k, x.alias("x")))), lambda e: e["x"]).alias("x"))
    a = B.actions(spark, sf_dir).select("hand_id", "ord", F.struct(F.col("ord").cast("string").alias("action_id"), "street", F.col("seat").alias("actor_seat"), "action_type", "amount", "raise_to", "call_to", F.col("amount_bb").alias("normalized_amount_bb"), "pot_before", "pot_after").alias("v"))
    p = B.players(spark, sf_dir).select("hand_id", "nth", F.struct(F.concat(F.lit("seat_"), F.col("seat")).alias("player_uid"), "seat", F.col("stack").alias("starting_stack"), F.lit(False).alias("showed_hand")).alias("v"))
    s = B.streets(spark, sf_dir).select("hand_id", "nth", F.struct("street").alias("v"))
    h = B.hands(spark, sf_dir).select("chunk_id", "hand_id", "hero_seat")
    for name, df, k in (("actions", a, "ord"), ("players", p, "nth"), ("streets", s, "nth")):
        h = h.join(ordered(df, k, F.col("v")).withColumnRenamed("x", name), "hand_id", "left")
    n = F.col("hand_id") % 3
    meta = F.struct(F.lit('café "x"').alias("game_type"), F.lit(6).alias("max_seats"), "hero_seat", (F.col("hand_id") % 7).alias("button_seat"), ((F.col("hand_id") % 97) / F.lit(7.0)).alias("bb"))
    record = F.to_json(F.struct(meta.alias("metadata"), "players", "streets", "actions", F.when(n == 0, "human").when(n == 1, "bot").alias("label")))
    typed = C.decoded(h.select("chunk_id", "hand_id", F.array(F.from_json(record, C.HAND)).alias("hands")))
    # a generator between the steps: the planner would decode a hand again for every field that is named above it
    one = typed.select("chunk_id", "hand_id", F.explode("hands").alias("hand"))
    made = one.select("chunk_id", "hand_id", C.payload_of(F.col("hand")).alias("payload"))
    text = json_text(F.col("payload"), made.schema["payload"].dataType, optional=C.PAYLOAD_OPTIONAL)
    return made.select("chunk_id", "hand_id", F.sha2(text, 256).alias("payload_sha256"))


@query(B.with_sql(CURVE_SQL.format(k="uid", t="responses") + """
SELECT uid, round(reward + 1e-9, 6) AS reward, row_number() OVER (ORDER BY reward DESC, uid)::INT AS place FROM rwd QUALIFY place <= 8"""))
def best_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the eight best; only eight rows leave each partition."""
    top = _rewards(spark, sf_dir).orderBy(F.col("reward").desc(), "uid").limit(8)
    return top.select("uid", S.tidy("reward").alias("reward"), F.row_number().over(Window.orderBy(F.col("reward").desc(), "uid")).alias("place"))
