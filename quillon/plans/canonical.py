"""Queries of the canonical view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import bindings as B
from quillon.functions import scalars as S
from quillon.operators import canonical as C
from quillon.operators import sequences as Q
from quillon.plans.catalog import query

#: Pots of the stand-in tables are thousands of units; this many make a big blind.
BB = 97.0
_near = "CASE " + " ".join(f"WHEN abs(b - {lo}) <= abs(b - {hi}) THEN {lo}" for lo, hi in zip(S.VISIBLE_BUCKETS, S.VISIBLE_BUCKETS[1:], strict=False)) + f" ELSE {S.VISIBLE_BUCKETS[-1]} END"
COARSE_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, b AS blinds, nb AS bucket, round(z + 1e-9, 6) AS noise,
       round(CASE WHEN b <= 0 THEN 0 ELSE round_even(least(126.0, greatest(0.0, nb + z * CASE WHEN nb <= 1.5 THEN 0.08 WHEN nb <= 8 THEN 0.22 ELSE greatest(0.35, nb * 0.05) END)), 2) END + 1e-9, 6) AS coarse
FROM (SELECT *, ({_near})::DOUBLE AS nb, ('0x' || substr(sha256(l_orderkey || '|' || l_linenumber || '|amount'), 3, 2))::INT / 255.0::DOUBLE * 2 - 1 AS z
      FROM (SELECT *, round_even(greatest(0, least(200, l_extendedprice / 97.0::DOUBLE)), 2) AS b FROM lineitem))
"""


@query(COARSE_SQL)
def coarse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money in big blinds, its nearest visible bucket, seeded noise and the coarse value."""
    li = B.table(spark, sf_dir, "lineitem")
    seed = S.seeded("l_orderkey", "l_linenumber", F.lit("amount"))
    li = li.withColumn("blinds", S.in_blinds("l_extendedprice", F.lit(BB), 200.0)).withColumns({"bucket": S.nearest_bucket("blinds"), "noise": S.noise(seed)})
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "blinds", "bucket", S.tidy("noise").alias("noise"), S.tidy(S.coarse("blinds", "bucket", "noise")).alias("coarse"))


@query("""
SELECT event_id, CASE WHEN t IN ('check', 'call') THEN t WHEN t LIKE '%raise%' THEN 'raise' WHEN t LIKE '%bet%' THEN 'bet' WHEN t LIKE '%call%' THEN 'call' WHEN t LIKE '%check%' THEN 'check' WHEN t LIKE '%fold%' OR t = 'muck' THEN 'fold' ELSE '' END AS direct,
  CASE WHEN t IN ('check', 'call') THEN t WHEN t LIKE '%raise%' THEN 'raise' WHEN t LIKE '%bet%' THEN 'bet' WHEN t LIKE '%call%' THEN 'call' WHEN t LIKE '%check%' THEN 'check' WHEN t LIKE '%fold%' OR t = 'muck' THEN 'fold'
       WHEN r > 0 THEN 'raise' WHEN c > 0 THEN 'call' WHEN a > 0 AND n > b THEN 'bet' WHEN a > 0 THEN 'call' WHEN n <= b THEN 'check' ELSE 'call' END AS resolved
FROM (SELECT event_id, lower(trim(CASE event_type WHEN 'click' THEN ' Check ' WHEN 'view' THEN 'open_raise' WHEN 'error' THEN 'muck' WHEN 'signup' THEN 'post' ELSE 'unknown' END)) AS t,
        event_id % 3 AS a, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS r, CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS c, event_id % 4 AS b, event_id % 6 AS n FROM events)""")
def action_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    raw = F.when(kind == "click", " Check ").when(kind == "view", "open_raise").when(kind == "error", "muck").when(kind == "signup", "post").otherwise("unknown")
    i = F.col("event_id")
    e = e.select("event_id", raw.alias("t"), (i % 3).alias("a"), F.when(i % 5 == 0, 2).otherwise(0).alias("r"), F.when(i % 7 == 0, 2).otherwise(0).alias("c"), (i % 4).alias("b"), (i % 6).alias("n"))
    return e.select("event_id", S.direct_type("t").alias("direct"), S.resolved_type("t", "a", "r", "c", "b", "n").alias("resolved"))


@query(B.with_sql("""
SELECT hand_id, seat, row_number() OVER (PARTITION BY hand_id ORDER BY first)::INT AS alias FROM (SELECT hand_id, seat, min(ord) AS first FROM acts GROUP BY hand_id, seat)"""))
def seat_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.seat_aliases(B.actions(spark, sf_dir))


IDLE_SQL = """
, idle AS (SELECT hand_id, ord, seat % 2 AS seat, CASE WHEN action_type IN ('fold', 'check') THEN action_type ELSE 'check' END AS action_type, 'flop' AS street, CASE WHEN amount_bb > 25 THEN amount_bb ELSE 0 END AS amount_bb, 0 AS pot_before, 0 AS pot_after FROM acts)
SELECT hand_id, ord FROM (SELECT *, amount_bb <= 0 AS z, lag(action_type) OVER h AS pt, lag(seat) OVER h AS ps, lag(amount_bb) OVER h <= 0 AS pz FROM idle WINDOW h AS (PARTITION BY hand_id ORDER BY ord))
WHERE NOT coalesce(z AND pz AND pt = action_type AND ps = seat, false)"""


@query(B.with_sql(IDLE_SQL))
def collapsed_noops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.actions(spark, sf_dir)
    kind = F.when(F.col("action_type").isin("fold", "check"), F.col("action_type")).otherwise("check")
    a = a.select(
        "hand_id", "ord", (F.col("seat") % 2).alias("seat"), kind.alias("action_type"), F.lit("flop").alias("street"),
        F.when(F.col("amount_bb") > 25, F.col("amount_bb")).otherwise(0.0).alias("amount_bb"), F.lit(0).alias("pot_before"), F.lit(0).alias("pot_after"),
    )
    return Q.collapse_noops(a).select("hand_id", F.col("ord").cast("long").alias("ord"))


SAMPLE_SQL = """
, a AS (SELECT acts.hand_id, ord, street, hero_seat, max_seats, count(*) OVER (PARTITION BY acts.hand_id) AS n, min(CASE WHEN ord = 1 THEN street END) OVER (PARTITION BY acts.hand_id) AS fs FROM acts JOIN hands USING (hand_id)),
s AS (SELECT *, hero_seat || '|' || max_seats || '|' || fs || '|' || n AS seed FROM a),
w AS (SELECT *, least(n, 5 + (('0x' || substr(sha256(seed), 1, 2))::INT % 4)) AS win, ord > 1 AND ord < n AS inn, sha256(seed || ':' || (ord - 1) || ':' || street) AS sk, sha256(seed || ':' || (ord - 1) || ':') AS ik FROM s),
f AS (SELECT *, inn AND row_number() OVER (PARTITION BY hand_id, inn, street ORDER BY sk) = 1 AS fos FROM w),
p AS (SELECT *, NOT inn OR (fos AND row_number() OVER (PARTITION BY hand_id, fos ORDER BY street) + 2 <= win) AS picked FROM f),
t AS (SELECT *, count(*) FILTER (WHERE picked) OVER (PARTITION BY hand_id) AS taken FROM p),
c AS (SELECT *, picked OR row_number() OVER (PARTITION BY hand_id, picked ORDER BY ik) <= win - taken AS chosen FROM t)
SELECT hand_id, ord, row_number() OVER (PARTITION BY hand_id ORDER BY ord, copy) AS place FROM (SELECT *, unnest(range(0, CASE WHEN n = 1 THEN 12 ELSE 1 END)) AS copy FROM c WHERE chosen)"""


@query(B.with_sql(SAMPLE_SQL))
def visible_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic sample of five to eight actions."""
    from pyspark.sql import Window

    a = B.actions(spark, sf_dir).join(B.hands(spark, sf_dir).select("hand_id", "hero_seat", "max_seats"), "hand_id")
    a = a.select("hand_id", "ord", "street", "hero_seat", "max_seats", F.count(F.lit(1)).over(Window.partitionBy("hand_id")).alias("n"))
    return C.visible_sample(a).select("hand_id", F.col("ord").cast("long").alias("ord"), F.col("place").cast("long").alias("place"))


@query()
def canonical_hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole view as nested records; ``canonical_parts`` and the other queries here have SQL for its parts, the whole is
    tested on small hands."""
    hands, actions = B.hands(spark, sf_dir), B.actions(spark, sf_dir)
    seen = C.visible_sample(C.canonical_actions(hands, actions, bb=BB))
    return C.canonical_hands(hands.withColumn("bb", F.lit(BB)), seen, actions, B.players(spark, sf_dir), B.streets(spark, sf_dir))


@query(B.with_sql("""
, push AS (SELECT hand_id, seat, 0 AS kind, ord AS o FROM acts UNION ALL SELECT hand_id, seat, 1, seat FROM players UNION ALL SELECT hand_id, s, 2, s FROM hands, unnest(range(1, 7)) AS u(s)),
fst AS (SELECT hand_id, seat, min(kind * 1000 + o) AS p FROM push GROUP BY hand_id, seat),
al AS (SELECT hand_id, seat, row_number() OVER (PARTITION BY hand_id ORDER BY p)::INT AS alias FROM fst),
pl AS (SELECT hand_id, alias, round_even(greatest(0, round_even(greatest(0, least(500, stack / 97.0::DOUBLE)), 2)) * 0.02, 4) AS stack FROM players JOIN al USING (hand_id, seat)),
ps AS (SELECT hand_id, string_agg('seat_' || alias, ',' ORDER BY alias) AS players, round(sum(stack) + 1e-9, 4) AS stacks FROM pl GROUP BY hand_id),
st AS (SELECT hand_id, string_agg(street, ',' ORDER BY nth) AS streets FROM streets GROUP BY hand_id)
SELECT h.hand_id, al.alias AS hero, 6 AS seats, ps.players, ps.stacks, coalesce(st.streets, '') AS streets FROM hands h JOIN al ON al.hand_id = h.hand_id AND al.seat = h.hero_seat JOIN ps ON ps.hand_id = h.hand_id LEFT JOIN st ON st.hand_id = h.hand_id"""))
def canonical_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases, players and streets of the whole view."""
    c = canonical_hands(spark, sf_dir)
    stacks = F.aggregate("players", F.lit(0.0), lambda a, p: a + p["starting_stack"])
    return c.select(
        "hand_id", F.col("metadata.hero_seat").alias("hero"), F.col("metadata.max_seats").alias("seats"), F.array_join(F.transform("players", lambda p: p["player_uid"]), ",").alias("players"),
        F.round(stacks + 1e-9, 4).alias("stacks"), F.array_join(F.transform("streets", lambda s: s["street"]), ",").alias("streets"),
    )


@query(B.with_sql("""
, per AS (SELECT hand_id, count(*) FILTER (WHERE action_type = 'call') AS calls, count(*) FILTER (WHERE action_type = 'check') AS checks, count(*) FILTER (WHERE action_type = 'raise') AS raises,
            count(*) FILTER (WHERE action_type = 'fold') AS folds, count(*) AS actions, sum(amount_bb) AS amount, sum(pot_after) AS pot FROM acts GROUP BY hand_id)
SELECT chunk_id, round(avg(coalesce(calls, 0)) + 1e-9, 6) AS calls, round(avg(coalesce(checks, 0)) + 1e-9, 6) AS checks, round(avg(coalesce(raises, 0)) + 1e-9, 6) AS raises, round(avg(coalesce(folds, 0)) + 1e-9, 6) AS folds,
  round(avg(coalesce(actions, 0)) + 1e-9, 6) AS actions, round(avg(hand_id % 5) + 1e-9, 6) AS streets, round(avg(n_players) + 1e-9, 6) AS players, round(avg(coalesce(amount, 0)) + 1e-9, 6) AS amount, round(avg(coalesce(pot, 0)) + 1e-9, 4) AS pot
FROM hands LEFT JOIN per USING (hand_id) GROUP BY chunk_id"""))
def chunk_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.chunk_signature(B.hands(spark, sf_dir), B.actions(spark, sf_dir), B.streets(spark, sf_dir), B.players(spark, sf_dir))
    return s.select("chunk_id", *(F.round(F.col(c) + 1e-9, 4 if c == "pot" else 6).alias(c) for c in s.columns if c != "chunk_id"))


@query(B.with_sql("""
, per AS (SELECT hand_id, count(*) FILTER (WHERE action_type = 'call') AS c, count(*) FILTER (WHERE action_type = 'check') AS k, count(*) FILTER (WHERE action_type = 'raise') AS r, count(*) FILTER (WHERE action_type = 'fold') AS f,
            count(*) FILTER (WHERE action_type IN ('call', 'check', 'bet', 'raise', 'fold')) AS m FROM acts GROUP BY hand_id),
p AS (SELECT h.chunk_id, h.hand_id, n_players, coalesce(c, 0) / greatest(coalesce(m, 0), 1)::DOUBLE AS c, coalesce(k, 0) / greatest(coalesce(m, 0), 1)::DOUBLE AS k, coalesce(r, 0) / greatest(coalesce(m, 0), 1)::DOUBLE AS r,
        coalesce(f, 0) / greatest(coalesce(m, 0), 1)::DOUBLE AS f FROM hands h LEFT JOIN per USING (hand_id)),
sc AS (SELECT chunk_id, greatest(0, least(1, 0.32 * (hand_id % 5) / 3 + 0.22 * (hand_id % 3 = 0)::INT + 0.18 * least(1, c / 0.35) + 0.12 * least(1, k / 0.30) + 0.08 * greatest(0, least(1, (6 - least(n_players, 6)) / 4.0::DOUBLE))
           - 0.18 * least(1, f / 0.55) - 0.10 * least(1, r / 0.20))) AS s FROM p)
SELECT c_custkey AS chunk_id, round(coalesce(avg(s), 0.5) + 1e-9, 6) AS score FROM customer LEFT JOIN sc ON c_custkey = chunk_id GROUP BY c_custkey"""))
def heuristic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without a model; a chunk without hands gets one half."""
    hands = B.hands(spark, sf_dir).withColumn("showdown", F.col("hand_id") % 3 == 0)
    chunks = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"))
    return C.heuristic_scores(hands, B.actions(spark, sf_dir), B.streets(spark, sf_dir), chunks)
