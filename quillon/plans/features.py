"""Queries over hands and chunks: features, signatures, n-grams, runs, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import bindings as B
from quillon.functions import scalars as S
from quillon.operators import features as X
from quillon.operators import encoding as E
from quillon.operators import sequences as Q
from quillon.plans.catalog import query

HAND_SQL = """,
win AS (
  SELECT *, coalesce(rank - lag(rank) OVER h, 0) AS step, lead(pot_before) OVER h - pot_after AS gap,
         coalesce((lag(seat) OVER h = seat)::INT, 0) AS same_actor,
         coalesce(max((action_type = 'fold')::INT) OVER (PARTITION BY hand_id, seat ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after_fold
  FROM (SELECT *, list_position(['preflop', 'flop', 'turn', 'river', 'showdown'], street) - 1 AS rank FROM acts)
  WINDOW h AS (PARTITION BY hand_id ORDER BY ord)),
ent AS (
  SELECT hand_id, max(e) FILTER (WHERE k = 't') AS te, max(e) FILTER (WHERE k = 'a') AS ae, max(e) FILTER (WHERE k = 's') AS se FROM (
    SELECT hand_id, k, CASE WHEN count(*) > 1 THEN -sum(c / n * ln(c / n + 1e-12)) / ln(count(*)) ELSE 0 END AS e FROM (
      SELECT hand_id, k, c::DOUBLE AS c, sum(c) OVER (PARTITION BY hand_id, k)::DOUBLE AS n FROM (
        SELECT hand_id, k, v, count(*) AS c FROM (
          SELECT hand_id, 't' AS k, action_type AS v FROM acts UNION ALL SELECT hand_id, 'a', seat::VARCHAR FROM acts UNION ALL SELECT hand_id, 's', street FROM acts)
        GROUP BY ALL)) GROUP BY hand_id, k) GROUP BY hand_id),
agg AS (
  SELECT hand_id, count(*)::DOUBLE AS n, count(*) FILTER (WHERE action_type = 'fold') AS n_fold, count(*) FILTER (WHERE action_type = 'check') AS n_check,
    count(*) FILTER (WHERE action_type = 'call') AS n_call, count(*) FILTER (WHERE action_type = 'bet') AS n_bet, count(*) FILTER (WHERE action_type = 'raise') AS n_raise,
    count(*) FILTER (WHERE street = 'preflop') AS s_preflop, count(*) FILTER (WHERE street = 'flop') AS s_flop, count(*) FILTER (WHERE street = 'turn') AS s_turn,
    count(*) FILTER (WHERE street = 'river') AS s_river, count(*) FILTER (WHERE street = 'showdown') AS s_showdown,
    sum(after_fold) AS after_fold, sum(same_actor) AS same_actor, sum((step < 0)::INT) AS regression, sum((step > 1)::INT) AS jump,
    max(CASE WHEN step > 1 THEN step END) AS max_jump, sum(coalesce((abs(gap) > 0.01)::INT, 0)) AS pot_mismatch, sum(coalesce((gap < -0.01)::INT, 0)) AS pot_decrease,
    count(*) FILTER (WHERE pot_after < 0) AS pot_negative, count(*) FILTER (WHERE amount_bb < 0) AS negative,
    count(*) FILTER (WHERE action_type = 'raise' AND raise_to IS NULL) AS no_raise_to, count(*) FILTER (WHERE action_type = 'call' AND call_to IS NULL) AS no_call_to,
    count(*) FILTER (WHERE action_type IN ('bet', 'raise') AND amount_bb <= 0) AS zero_bets, count(*) FILTER (WHERE amount_bb > 0) AS n_paid,
    avg(amount_bb) FILTER (WHERE amount_bb > 0) AS paid_mean, stddev_pop(amount_bb) FILTER (WHERE amount_bb > 0) AS paid_std, max(amount_bb) FILTER (WHERE amount_bb > 0) AS paid_max,
    quantile_cont(amount_bb, 0.75) FILTER (WHERE amount_bb > 0) AS paid_q75, avg(ln(1 + amount_bb)) FILTER (WHERE amount_bb > 0) AS paid_log
  FROM win GROUP BY hand_id),
heroes AS (SELECT hand_id, count(*)::DOUBLE AS hero FROM acts JOIN hands USING (hand_id) WHERE seat = hero_seat GROUP BY hand_id),
pre AS (SELECT h.*, a.* EXCLUDE (hand_id), e.te, e.ae, e.se, coalesce(hero, 0) AS hero, greatest(coalesce(n, 0), 1) AS d, greatest(coalesce(n, 0) - 1, 1) AS pairs,
    greatest(CASE WHEN s_flop > 0 THEN 1.0 ELSE 0 END, CASE WHEN s_turn > 0 THEN 2.0 ELSE 0 END, CASE WHEN s_river > 0 THEN 3.0 ELSE 0 END, CASE WHEN s_showdown > 0 THEN 4.0 ELSE 0 END)::DOUBLE AS rank
  FROM hands h LEFT JOIN agg a USING (hand_id) LEFT JOIN ent e USING (hand_id) LEFT JOIN heroes USING (hand_id)),
hf AS (SELECT chunk_id, hand_id, n_players::DOUBLE AS num_players, n_players / max_seats AS seat_utilization, hero_seat / max_seats AS hero_seat_norm, coalesce(n, 0) AS num_actions,
    (coalesce(s_preflop > 0, false)::INT + coalesce(s_flop > 0, false)::INT + coalesce(s_turn > 0, false)::INT + coalesce(s_river > 0, false)::INT + coalesce(s_showdown > 0, false)::INT)::DOUBLE AS num_streets_observed,
    rank AS last_street_rank, (rank = 0)::INT::DOUBLE AS ended_preflop, coalesce(s_flop > 0, false)::INT::DOUBLE AS reached_flop, coalesce(s_turn > 0, false)::INT::DOUBLE AS reached_turn,
    coalesce(s_river > 0, false)::INT::DOUBLE AS reached_river, coalesce(s_showdown > 0, false)::INT::DOUBLE AS reached_showdown,
    coalesce(n_bet + n_raise, 0) / greatest(coalesce(n_check + n_call, 0), 1) AS aggression_ratio, coalesce(n_check + n_call, 0) / d AS passive_ratio, hero / d AS hero_action_ratio,
    coalesce(te, 0) AS action_type_entropy, coalesce(ae, 0) AS actor_seat_entropy, coalesce(se, 0) AS street_entropy,
    coalesce(after_fold, 0) / d AS acted_after_fold_ratio, (coalesce(after_fold, 0) > 0)::INT::DOUBLE AS has_actor_after_fold, coalesce(same_actor, 0) / d AS same_actor_consecutive_ratio,
    coalesce(regression, 0) / d AS street_regression_ratio, coalesce(jump, 0) / d AS street_jump_ratio, coalesce(max_jump, 0)::DOUBLE AS max_street_jump,
    coalesce(pot_mismatch, 0) / pairs AS pot_mismatch_ratio, coalesce(pot_decrease, 0) / pairs AS pot_decrease_ratio, coalesce(pot_negative, 0) / d AS pot_negative_ratio,
    coalesce(negative, 0) / d AS amount_negative_ratio, coalesce(no_raise_to, 0) / d AS raise_to_missing_ratio, coalesce(no_call_to, 0) / d AS call_to_missing_ratio,
    coalesce(zero_bets, 0) / d AS zero_amount_betraise_ratio, coalesce(n_fold, 0) / d AS fold_ratio, coalesce(n_check, 0) / d AS check_ratio, coalesce(n_call, 0) / d AS call_ratio,
    coalesce(n_bet, 0) / d AS bet_ratio, coalesce(n_raise, 0) / d AS raise_ratio, coalesce(s_preflop, 0) / d AS preflop_action_ratio, coalesce(s_flop, 0) / d AS flop_action_ratio,
    coalesce(s_turn, 0) / d AS turn_action_ratio, coalesce(s_river, 0) / d AS river_action_ratio, coalesce(s_showdown, 0) / d AS showdown_action_ratio,
    coalesce(paid_mean, 0) AS amount_mean, coalesce(paid_std, 0) AS amount_std, coalesce(paid_max, 0) AS amount_max, coalesce(paid_q75, 0) AS amount_q75, coalesce(paid_log, 0) AS amount_log_mean,
    coalesce(n_paid, 0) / d AS nonzero_amount_ratio
  FROM pre)
"""
_TIDY = lambda c, name=None: f"round({c} + 1e-9, 6) AS {name or c}"
_STAT_SQL = {
    "mean": "avg({k})", "std": "stddev_pop({k})", "min": "min({k})", "max": "max({k})",
    "q25": "quantile_cont({k}, 0.25)", "q50": "quantile_cont({k}, 0.5)", "q75": "quantile_cont({k}, 0.75)",
}
_WIDE = ", ".join(_TIDY("coalesce(" + sql.format(k=k) + ", 0)", f"{k}_{s}") for k in X.HAND_FEATURES for s, sql in _STAT_SQL.items())


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.hand_features(B.hands(spark, sf_dir), B.actions(spark, sf_dir))


def _tidy(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(S.tidy(c).alias(c) for c in df.columns if c not in keys))


@query(B.with_sql(HAND_SQL + "SELECT chunk_id, hand_id, " + ", ".join(map(_TIDY, X.HAND_FEATURES)) + " FROM hf"))
def hand_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(_features(spark, sf_dir), "chunk_id", "hand_id")


@query(B.with_sql(HAND_SQL + f"SELECT c_custkey AS chunk_id, count(hand_id)::DOUBLE AS num_hands, {_WIDE} FROM customer LEFT JOIN hf ON c_custkey = chunk_id GROUP BY c_custkey"))
def chunk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: seven statistics of 46 hand features for every chunk, also those without hands."""
    chunks = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"))
    return _tidy(X.chunk_vectors(chunks, _features(spark, sf_dir)), "chunk_id")


@query(B.with_sql(HAND_SQL + f"""
SELECT chunk_id, feature, {", ".join(_TIDY(sql.format(k="v"), s) for s, sql in _STAT_SQL.items())}
FROM (UNPIVOT hf ON {", ".join(X.HAND_FEATURES)} INTO NAME feature VALUE v) GROUP BY chunk_id, feature"""))  # fmt: skip
def chunk_feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(X.feature_stats(_features(spark, sf_dir)), "chunk_id", "feature")


BUCKET_SQL = "CASE WHEN amount_bb <= 0 THEN 0 WHEN amount_bb <= 1 THEN 1 WHEN amount_bb <= 2 THEN 2 WHEN amount_bb <= 5 THEN 3 WHEN amount_bb <= 10 THEN 4 WHEN amount_bb <= 25 THEN 5 WHEN amount_bb <= 50 THEN 6 WHEN amount_bb <= 100 THEN 7 ELSE 8 END"
SIGNED_SQL = f""",
sig AS (SELECT chunk_id, h.hand_id, coalesce(string_agg(action_type, ',' ORDER BY ord), '') AS kinds, coalesce(string_agg(({BUCKET_SQL})::VARCHAR, ',' ORDER BY ord), '') AS amounts
        FROM hands h LEFT JOIN acts USING (hand_id) GROUP BY chunk_id, h.hand_id),
shares AS (SELECT chunk_id, k, count(*) / sum(c) AS u, max(c) / sum(c) AS t FROM (
             SELECT chunk_id, 'a' AS k, kinds, count(*)::DOUBLE AS c FROM sig GROUP BY ALL UNION ALL SELECT chunk_id, 'b', amounts, count(*)::DOUBLE FROM sig GROUP BY ALL) GROUP BY chunk_id, k)
"""


@query(B.with_sql(HAND_SQL + SIGNED_SQL + f"""
SELECT chunk_id, {_TIDY("max(u) FILTER (WHERE k = 'a')", "unique_action_pattern_ratio")}, {_TIDY("max(t) FILTER (WHERE k = 'a')", "top_action_pattern_share")},
  {_TIDY("max(u) FILTER (WHERE k = 'b')", "unique_amount_pattern_ratio")}, {_TIDY("max(t) FILTER (WHERE k = 'b')", "top_amount_pattern_share")},
  {_TIDY("any_value(x)", "chunk_aggression_dispersion")}, {_TIDY("any_value(y)", "chunk_action_entropy_mean")}, {_TIDY("any_value(z)", "chunk_anomaly_load")}
FROM shares JOIN (SELECT chunk_id, stddev_pop(aggression_ratio) AS x, avg(action_type_entropy) AS y,
                         avg(street_jump_ratio + street_regression_ratio + acted_after_fold_ratio + pot_mismatch_ratio) AS z FROM hf GROUP BY chunk_id) USING (chunk_id)
GROUP BY chunk_id"""))  # fmt: skip
def chunk_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hands, actions = B.hands(spark, sf_dir), B.actions(spark, sf_dir)
    return _tidy(X.chunk_patterns(hands, actions, X.hand_features(hands, actions)), "chunk_id")


GRAM_SQL = """,
codes AS (SELECT hand_id, ord, seat, CASE street WHEN 'preflop' THEN 'p' WHEN 'flop' THEN 'f' WHEN 'turn' THEN 't' WHEN 'river' THEN 'r' ELSE 's' END AS st,
    CASE action_type WHEN 'fold' THEN 'F' WHEN 'check' THEN 'C' WHEN 'call' THEN 'K' WHEN 'bet' THEN 'B' WHEN 'raise' THEN 'R' ELSE 'b' END AS act,
    CASE WHEN amount <= 0 THEN '0' WHEN pot_before <= 0 THEN (CASE WHEN amount_bb <= 0 THEN '0' WHEN amount_bb < 2 THEN 's' WHEN amount_bb < 5 THEN 'm' WHEN amount_bb < 10 THEN 'p' ELSE 'o' END)
         WHEN amount / pot_before < 0.4 THEN 's' WHEN amount / pot_before < 0.75 THEN 'm' WHEN amount / pot_before <= 1.15 THEN 'p' ELSE 'o' END AS sz FROM acts),
toks AS (SELECT hand_id, row_number() OVER (PARTITION BY hand_id ORDER BY ord, part) AS i, tok FROM (
    SELECT hand_id, ord, 1 AS part, st || act || sz AS tok FROM codes WHERE act <> 'b' UNION ALL SELECT hand_id, ord, 2, 'pos' || seat || act FROM codes WHERE act <> 'b')),
grams AS (SELECT hand_id, i, n, gram FROM (
    SELECT hand_id, i, 1 AS n, tok AS gram FROM toks
    UNION ALL SELECT hand_id, i, 2, tok || '|' || lead(tok) OVER w FROM toks WINDOW w AS (PARTITION BY hand_id ORDER BY i)
    UNION ALL SELECT hand_id, i, 3, tok || '|' || lead(tok) OVER w || '|' || lead(tok, 2) OVER w FROM toks WINDOW w AS (PARTITION BY hand_id ORDER BY i)) WHERE gram IS NOT NULL),
vocab AS (SELECT n, rank, gram, cnt FROM (SELECT n, gram, count(*) AS cnt, row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, min((hand_id, i))) AS rank FROM grams GROUP BY n, gram)
          WHERE rank <= CASE n WHEN 1 THEN 80 WHEN 2 THEN 160 ELSE 90 END)
"""


@query(B.with_sql(GRAM_SQL + "SELECT n, rank, gram, cnt FROM vocab"))
def gram_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.gram_vocabulary(X.hand_grams(B.actions(spark, sf_dir)))


@query(B.with_sql(GRAM_SQL + """
SELECT chunk_id, gram, round(count(*)::DOUBLE / any_value(m) + 1e-9, 6) AS mean_count
FROM grams JOIN vocab USING (n, gram) JOIN hands USING (hand_id) JOIN (SELECT chunk_id, count(*) AS m FROM hands GROUP BY chunk_id) USING (chunk_id) GROUP BY chunk_id, gram"""))  # fmt: skip
def gram_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = X.hand_grams(B.actions(spark, sf_dir))
    return _tidy(X.gram_means(B.hands(spark, sf_dir), grams, X.gram_vocabulary(grams)), "chunk_id", "gram")


FIXED_GRAMS = ["pF0", "fCs", "fC0", "pos1F|pC0", "pF0|pos1F"]


@query(B.with_sql(GRAM_SQL + "SELECT c_custkey AS chunk_id, " + ", ".join(
    f"round(coalesce(count(*) FILTER (WHERE gram = '{g}') / any_value(m)::DOUBLE, 0) + 1e-9, 6) AS schema_ngram_{g.replace('|', '__')}" for g in FIXED_GRAMS) + """
FROM customer LEFT JOIN hands ON c_custkey = chunk_id LEFT JOIN grams USING (hand_id) LEFT JOIN (SELECT chunk_id, count(*) AS m FROM hands GROUP BY chunk_id) s ON s.chunk_id = c_custkey GROUP BY c_custkey"""))  # fmt: skip
def gram_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide block for a frozen vocabulary."""
    chunks = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"))
    vocabulary = spark.createDataFrame([(g,) for g in FIXED_GRAMS], "gram string")
    means = X.gram_means(B.hands(spark, sf_dir), X.hand_grams(B.actions(spark, sf_dir)), vocabulary)
    return _tidy(X.gram_columns(means, chunks, FIXED_GRAMS), "chunk_id")


@query()
def pooled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk features that pool all actions; the tests compare them with a plain loop over one chunk."""
    return _tidy(X.pooled_features(B.hands(spark, sf_dir), B.actions(spark, sf_dir)), "chunk_id")


def _seen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hands = B.tables(spark, sf_dir).withColumn("showdown", F.col("hand_id") % 2 == 0)
    of = F.col("hand_id") + F.col("seat")
    return hands, B.players(spark, sf_dir).withColumns({"visible": of % 3 == 0, "showed": of % 5 == 0})


@query(B.with_sql(""",
p AS (SELECT hand_id, count(*) AS n, max((seat = hero_seat)::INT) AS hero, max((seat = button_seat)::INT) AS button,
             count(*) FILTER (WHERE (hand_id + seat) % 3 = 0) AS visible, count(*) FILTER (WHERE (hand_id + seat) % 5 = 0) AS showed
      FROM players JOIN tables USING (hand_id) GROUP BY hand_id)
SELECT chunk_id, round(avg((hand_id % 2 = 0)::INT) + 1e-9, 6) AS showdown_rate, round(sum(hero) / count(*)::DOUBLE + 1e-9, 6) AS hero_present_rate,
  round(sum(button) / count(*)::DOUBLE + 1e-9, 6) AS button_present_rate, round(sum(visible) / sum(n)::DOUBLE + 1e-9, 6) AS visible_hole_card_rate,
  round(sum(showed) / sum(n)::DOUBLE + 1e-9, 6) AS showed_hand_rate FROM tables LEFT JOIN p USING (hand_id) GROUP BY chunk_id"""))  # fmt: skip
def player_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often there is a showdown, hero and button sit at the table, and cards are seen and shown."""
    return _tidy(X.player_features(*_seen(spark, sf_dir)), "chunk_id")


@query()
def table_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chunk vector of 51 columns, also for chunks without hands; the tests compare it with a plain loop."""
    chunks = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"))
    hands, players = _seen(spark, sf_dir)
    return _tidy(X.table_features(chunks, hands, B.actions(spark, sf_dir), players, B.streets(spark, sf_dir)), "chunk_id")


@query("""
WITH p AS (SELECT l_suppkey AS chunk_id, l_quantity AS stack FROM lineitem), s AS (
  SELECT chunk_id, avg(stack / 0.5) AS m, min(stack / 0.5) AS lo, max(stack / 0.5) AS hi, count(*) AS n, count(*) FILTER (WHERE stack / 0.5 <= 20) AS sh, count(*) FILTER (WHERE stack / 0.5 >= 100) AS dp
  FROM p WHERE stack > 0 GROUP BY chunk_id)
SELECT chunk_id, round(least(ln(1 + m) / ln(201.0::DOUBLE), 1) + 1e-9, 6) AS mean_stack_bb_scaled, round(least(ln(1 + lo) / ln(201.0::DOUBLE), 1) + 1e-9, 6) AS min_stack_bb_scaled,
  round(least(ln(1 + hi) / ln(201.0::DOUBLE), 1) + 1e-9, 6) AS max_stack_bb_scaled, round(least(ln(1 + hi - lo) / ln(201.0::DOUBLE), 1) + 1e-9, 6) AS stack_spread_bb_scaled,
  round(sh / n::DOUBLE + 1e-9, 6) AS short_stack_rate, round(dp / n::DOUBLE + 1e-9, 6) AS deep_stack_rate FROM s""")  # fmt: skip
def stack_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chunk_id"), F.col("l_quantity").alias("stack"))
    return _tidy(X.stack_features(players, 0.5), "chunk_id")


@query("""
WITH s AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_tax) AS tm, stddev_pop(l_tax) AS ts FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - qm) / qs + 1e-9, 6) AS l_quantity, round((l_tax - tm) / ts + 1e-9, 6) AS l_tax FROM lineitem, s""")
def standardized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return _tidy(X.standardize(rows, ["l_quantity", "l_tax"]), "l_orderkey", "l_linenumber")


@query("""
SELECT value, row_number() OVER (ORDER BY first, value) + 1 AS id FROM (SELECT c_mktsegment AS value, min(c_custkey) AS first FROM customer GROUP BY c_mktsegment HAVING count(*) >= 5)""")
def value_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_custkey").alias("at"))
    return X.value_vocabulary(rows, "c_mktsegment", 5).withColumn("id", F.col("id").cast("long"))


@query("""
WITH v AS (SELECT value, row_number() OVER (ORDER BY first, value) + 1 AS id FROM (SELECT p_type AS value, min(p_partkey) AS first FROM part WHERE p_size < 20 GROUP BY p_type HAVING count(*) >= 3))
SELECT p_partkey, coalesce(id, 1)::BIGINT AS type_id FROM part LEFT JOIN v ON p_type = value""")
def encoded_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories as ids; values that the vocabulary lacks are 1. A vocabulary is small by construction here (types)."""
    part = B.table(spark, sf_dir, "part")
    vocabulary = X.value_vocabulary(part.where("p_size < 20").select("p_type", F.col("p_partkey").alias("at")), "p_type", 3)
    return part.join(vocabulary, part["p_type"] == vocabulary["value"], "left").select("p_partkey", F.coalesce("id", F.lit(1)).cast("long").alias("type_id"))


RUN_SQL = """,
isl AS (SELECT hand_id, {c} AS v, row_number() OVER (PARTITION BY hand_id ORDER BY ord) - row_number() OVER (PARTITION BY hand_id, {c} ORDER BY ord) AS g FROM acts)
SELECT hand_id, max(n) AS run FROM (SELECT hand_id, v, g, count(*) AS n FROM isl GROUP BY hand_id, v, g) GROUP BY hand_id"""


@query(B.with_sql(RUN_SQL.format(c="action_type")))
def longest_type_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.longest_runs(B.actions(spark, sf_dir), ["hand_id"], "ord", "action_type", "run")


@query(B.with_sql(RUN_SQL.format(c="seat")))
def longest_seat_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.longest_runs(B.actions(spark, sf_dir), ["hand_id"], "ord", "seat", "run")


@query(B.with_sql("""
SELECT hand_id, round(coalesce(avg(c), 0) + 1e-9, 6) AS rate FROM (SELECT hand_id, (lag(seat) OVER (PARTITION BY hand_id ORDER BY ord) <> seat)::INT::DOUBLE AS c FROM acts) GROUP BY hand_id"""))
def actor_switch_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(Q.switch_rate(B.actions(spark, sf_dir), ["hand_id"], "ord", "seat", "rate"), "hand_id")


@query(B.with_sql("""
SELECT hand_id, ord, coalesce(street <> lag(street) OVER h, true) AS first_in_street, least(row_number() OVER (PARTITION BY hand_id, street ORDER BY ord), 4)::INT AS street_position,
  round((ord - 1) / greatest(count(*) OVER (PARTITION BY hand_id) - 1, 1)::DOUBLE + 1e-9, 6) AS relative FROM acts WINDOW h AS (PARTITION BY hand_id ORDER BY ord)"""))
def action_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Q.in_hand()
    whole, by_street = Window.partitionBy("hand_id"), Window.partitionBy("hand_id", "street").orderBy("ord")
    return B.actions(spark, sf_dir).select(
        "hand_id", F.col("ord").cast("long").alias("ord"), F.coalesce(F.col("street") != F.lag("street").over(w), F.lit(True)).alias("first_in_street"),
        F.least(F.row_number().over(by_street), F.lit(4)).alias("street_position"),
        S.tidy((F.col("ord") - 1) / F.greatest(F.count(F.lit(1)).over(whole) - 1, F.lit(1))).alias("relative"),
    )


SEATS_SQL = """
, acted AS (SELECT hand_id, max(seat) AS s FROM acts GROUP BY hand_id), sat AS (SELECT hand_id, max(seat) AS s FROM players GROUP BY hand_id),
seen AS (SELECT t.*, greatest(hero_seat, button_seat, coalesce(acted.s, 0), coalesce(sat.s, 0)) AS top FROM tables t LEFT JOIN acted USING (hand_id) LEFT JOIN sat USING (hand_id)),
tab AS (SELECT chunk_id, hand_id, hero_seat, button_seat, bb, greatest(1, least(9, CASE WHEN max_seats > 0 THEN max_seats WHEN top > 0 THEN top ELSE 9 END)) AS seats FROM seen)"""
#: One action with its table, its actor's stack and its money in big blinds.
ENCODED_SQL = SEATS_SQL + """
, x AS (
  SELECT a.*, t.bb, t.seats, t.button_seat, coalesce(p.stack, 0) AS stack, coalesce(raise_to, 0) AS raised, coalesce(call_to, 0) AS called,
         row_number() OVER h AS place, count(*) OVER (PARTITION BY a.hand_id) AS total, lag(street) OVER h AS earlier, row_number() OVER (PARTITION BY a.hand_id, street ORDER BY ord) AS nth
  FROM acts a JOIN tab t USING (hand_id) LEFT JOIN players p ON p.hand_id = a.hand_id AND p.seat = a.seat AND p.seat <= t.seats
  WINDOW h AS (PARTITION BY a.hand_id ORDER BY ord)),
y AS (SELECT *, CASE WHEN amount_bb > 0 THEN amount_bb WHEN amount > 0 THEN amount / bb ELSE 0 END AS size_bb, greatest(pot_after - pot_before, 0) / bb AS gain, (seat - button_seat + 7 * seats) % seats AS off FROM x WHERE place <= 64)"""


@query(B.with_sql(ENCODED_SQL + """
, e AS (SELECT unnest([0, 0.5, 1, 1.5, 2, 3, 4, 6, 8, 12, 16, 24, 36, 56, 84, 126])::DOUBLE AS edge, unnest(range(1, 17))::INT AS id),
near AS (SELECT size_bb, arg_min(id, abs(edge - size_bb) * 1000 + id * 1e-9) AS id FROM (SELECT DISTINCT size_bb FROM y), e GROUP BY size_bb)
SELECT hand_id, ord, street, action_type, seat, near.id AS amount_bucket,
  CASE WHEN gain <= 1e-6 THEN 1 WHEN gain <= 1 THEN 2 WHEN gain <= 4 THEN 3 ELSE 4 END AS pot_flow,
  CASE WHEN street = earlier THEN 1 ELSE 2 END AS first_in_street,
  CASE WHEN button_seat <= 0 OR seats <= 1 THEN 1 WHEN off = 0 THEN 2 WHEN off = 1 THEN 3 WHEN off = 2 THEN 4 WHEN seats <= 3 THEN 6
       WHEN 3 * (off - 3) < seats - 3 THEN 5 WHEN 3 * (off - 3) < 2 * (seats - 3) THEN 6 ELSE 7 END AS actor_role,
  least(nth, 4)::INT AS street_position
FROM y JOIN near USING (size_bb)"""))
def action_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed categories of single actions: size, growth of the pot, place on the street and at the table."""
    e = E.encoded_actions(B.tables(spark, sf_dir), B.actions(spark, sf_dir), B.players(spark, sf_dir))
    return e.select("hand_id", F.col("ord").cast("long").alias("ord"), "street", "action_type", "seat", "amount_bucket", "pot_flow", "first_in_street", "actor_role", "street_position")


_LOG = "round(least(ln(1 + greatest({}, 0)) / ln(201.0::DOUBLE), 1) + 1e-9, 6)"
_SHARE = "round(CASE WHEN pot_before > 0 THEN greatest(0, least({} / pot_before, 10)) / 10 ELSE 0 END + 1e-9, 6)"
_IS = "(action_type IN ({}))::INT::DOUBLE"


def _tidied(frame: DataFrame, names) -> list:
    return [S.tidy(n).alias(n) for n in names]


@query(B.with_sql(ENCODED_SQL + f"""
SELECT hand_id, ord, round(CASE WHEN total <= 1 THEN 0 ELSE (place - 1) / (total - 1)::DOUBLE END + 1e-9, 6) AS action_order_norm,
  {_LOG.format("size_bb")} AS amount_bb_scaled, {_LOG.format("raised / bb")} AS raise_to_bb_scaled, {_LOG.format("called / bb")} AS call_to_bb_scaled,
  {_LOG.format("pot_before / bb")} AS pot_before_bb_scaled, {_LOG.format("pot_after / bb")} AS pot_after_bb_scaled,
  round(greatest(-1, least(1, (pot_after - pot_before) / bb / 200)) + 1e-9, 6) AS pot_delta_bb_signed,
  {_SHARE.format("amount")} AS amount_to_pot, {_SHARE.format("raised")} AS raise_to_pot, {_SHARE.format("called")} AS call_to_pot,
  round((amount > 0)::INT + 1e-9::DOUBLE, 6) AS has_amount, round((raise_to IS NOT NULL)::INT + 1e-9::DOUBLE, 6) AS has_raise_to, round((call_to IS NOT NULL)::INT + 1e-9::DOUBLE, 6) AS has_call_to,
  {_IS.format("'big_blind'")} AS is_forced_action, {_IS.format("'big_blind', 'call', 'bet', 'raise'")} AS is_money_action, {_IS.format("'bet', 'raise'")} AS is_aggressive_action,
  {_IS.format("'check', 'call'")} AS is_passive_action, 0.0::DOUBLE AS is_all_in, round(seat / seats::DOUBLE + 1e-9, 6) AS actor_seat_norm, {_LOG.format("stack / bb")} AS actor_stack_bb_scaled,
  round(CASE WHEN stack > 0 THEN greatest(0, least(amount / stack, 1)) ELSE 0 END + 1e-9, 6) AS amount_to_actor_stack,
  CASE street WHEN 'preflop' THEN 0.25 WHEN 'flop' THEN 0.5 WHEN 'turn' THEN 0.75 WHEN 'river' THEN 1 ELSE 0 END::DOUBLE AS street_progress
FROM y"""))
def action_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 22 numbers of single actions: order, sizes, relations to pot and stack, kinds, seat, street."""
    e = E.encoded_actions(B.tables(spark, sf_dir), B.actions(spark, sf_dir), B.players(spark, sf_dir))
    return e.select("hand_id", F.col("ord").cast("long").alias("ord"), *_tidied(e, E.NUMERIC))


@query(B.with_sql(SEATS_SQL + """
, per AS (SELECT hand_id, count(*) FILTER (WHERE street = 'preflop') AS a, count(*) FILTER (WHERE street = 'flop') AS b, count(*) FILTER (WHERE street = 'turn') AS c, count(*) FILTER (WHERE street = 'river') AS d,
            count(DISTINCT seat) AS actors, count(*) FILTER (WHERE seat = hero_seat) AS hero, max(list_position(['preflop', 'flop', 'turn', 'river'], street)) AS deep FROM acts JOIN tables USING (hand_id) GROUP BY hand_id),
l AS (SELECT hand_id, count(*) AS n, arg_max(list_position(['preflop', 'flop', 'turn', 'river'], street), nth) AS last FROM streets GROUP BY hand_id),
h AS (SELECT t.*, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d, coalesce(actors, 0) AS actors, coalesce(hero, 0) AS hero, coalesce(deep, 0) AS deep, coalesce(n, 0) AS n, coalesce(last, 0) AS last, coalesce(stack, 0) AS stack
      FROM tab t LEFT JOIN per USING (hand_id) LEFT JOIN l USING (hand_id) LEFT JOIN players p ON p.hand_id = t.hand_id AND p.seat = t.hero_seat AND p.seat <= t.seats)
SELECT hand_id, round(ln(1 + stack / bb) + 1e-9, 6) AS hero_stack_log, round(least(actors, 10) / 10.0::DOUBLE + 1e-9, 6) AS actors, round(least(n, 4) / 4.0::DOUBLE + 1e-9, 6) AS streets_dealt,
  round(least(a, 64) / 64.0::DOUBLE + 1e-9, 6) AS preflop_actions, round(least(b, 64) / 64.0::DOUBLE + 1e-9, 6) AS flop_actions, round(least(c, 64) / 64.0::DOUBLE + 1e-9, 6) AS turn_actions,
  round(least(d, 64) / 64.0::DOUBLE + 1e-9, 6) AS river_actions, round(CASE WHEN a + b + c + d > 0 THEN hero / (a + b + c + d)::DOUBLE ELSE 0 END + 1e-9, 6) AS hero_share,
  (CASE WHEN deep > 0 THEN deep ELSE last END)::INT AS hand_end, seats
FROM h"""))
def hand_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight context values of a hand, its deepest street and the seats of its table."""
    m = E.hand_meta(B.tables(spark, sf_dir), B.actions(spark, sf_dir), B.players(spark, sf_dir), B.streets(spark, sf_dir))
    return m.select("hand_id", *_tidied(m, E.META), "hand_end", "seats")


@query(B.with_sql("""
, v AS (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY h, o) + 1 AS id FROM (
    SELECT field, value, min(hand_id * 1000 + ord) // 1000 AS h, min(hand_id * 1000 + ord) % 1000 AS o FROM (
      SELECT 'street' AS field, street AS value, hand_id, ord FROM acts UNION ALL SELECT 'action_type', action_type, hand_id, ord FROM acts UNION ALL SELECT 'seat', 'seat_' || seat, hand_id, ord FROM acts)
    GROUP BY field, value HAVING count(*) >= 5))
SELECT hand_id, ord, coalesce(a.id, 1)::INT AS street_id, coalesce(b.id, 1)::INT AS action_type_id, coalesce(c.id, 1)::INT AS seat_id
FROM acts LEFT JOIN v a ON a.field = 'street' AND a.value = street LEFT JOIN v b ON b.field = 'action_type' AND b.value = action_type LEFT JOIN v c ON c.field = 'seat' AND c.value = 'seat_' || seat
QUALIFY row_number() OVER (PARTITION BY hand_id ORDER BY ord) <= 64"""))
def action_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned categories of single actions, by vocabularies fitted on all of them."""
    actions = B.actions(spark, sf_dir)
    e = E.encoded_actions(B.tables(spark, sf_dir), actions, B.players(spark, sf_dir))
    return E.with_ids(e, E.fit_vocabularies(actions, least=5)).select("hand_id", F.col("ord").cast("long").alias("ord"), "street_id", "action_type_id", "seat_id")


@query(B.with_sql("""
SELECT hand_id, list({'kind': coalesce(list_position(['fold', 'check', 'call', 'bet', 'raise'], action_type), 0), 'street': list_position(['preflop', 'flop', 'turn', 'river', 'showdown'], street), 'hero': (seat = hero_seat)::INT,
    'bucket': CASE WHEN amount_bb <= 0 THEN 0 WHEN amount_bb <= 1 THEN 1 WHEN amount_bb <= 2 THEN 2 WHEN amount_bb <= 5 THEN 3 WHEN amount_bb <= 10 THEN 4 WHEN amount_bb <= 25 THEN 5 WHEN amount_bb <= 50 THEN 6 WHEN amount_bb <= 100 THEN 7 ELSE 8 END} ORDER BY ord) AS s,
  round(sum(ln(1 + amount_bb)) + 1e-9, 4) AS amounts, round(sum(ln(1 + greatest(pot_after, 0))) + 1e-9, 4) AS pots
FROM acts JOIN tables USING (hand_id) GROUP BY hand_id""").replace("SELECT hand_id, list(", "SELECT hand_id, amounts, pots, array_to_string(list_transform(s, lambda x: x.kind || '-' || x.street || '-' || x.hero || '-' || x.bucket), ',') AS ids FROM (SELECT hand_id, list(") + ")")
def step_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unpadded steps of a hand for a convolutional model, with the ids as one text and the logs added up."""
    e = E.step_encoding(B.tables(spark, sf_dir), B.actions(spark, sf_dir))
    told = F.array_join(F.transform("steps", lambda x: F.array_join(F.transform(x["ids"], lambda i: i.cast("string")), "-")), ",")
    add = lambda k: F.round(F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["logs"][k]) + 1e-9, 4)
    return e.select("hand_id", add(0).alias("amounts"), add(1).alias("pots"), told.alias("ids"))


CHUNKS_SQL = ", sizes AS (SELECT chunk_id, count(*) AS n_hands FROM hands GROUP BY chunk_id)\n"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hands(spark, sf_dir).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_hands"))


@query(B.with_sql(CHUNKS_SQL + """
SELECT chunk_id, s AS start, s + 4 AS stop FROM (SELECT chunk_id, unnest(range(0, n_hands - 3, 2)) AS s FROM sizes WHERE n_hands >= 4)
UNION ALL SELECT chunk_id, 0, n_hands FROM sizes WHERE n_hands < 4"""))
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.chunk_windows(_sizes(spark, sf_dir), 4, 2, keep_short=True)


@query(B.with_sql(CHUNKS_SQL + """
SELECT chunk_id, unnest(CASE WHEN n_hands - 4 < 8 THEN range(4, n_hands + 1) ELSE list_distinct([(4 + round_even(i * (n_hands - 4) / 7.0::DOUBLE, 0))::BIGINT FOR i IN range(0, 8)]) END) AS length
FROM sizes WHERE n_hands >= 4"""))
def chunk_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.chunk_prefixes(_sizes(spark, sf_dir), 4, 8)


@query(B.with_sql(CHUNKS_SQL + """
SELECT chunk_id, unnest(CASE WHEN n_hands <= 6 THEN range(0, n_hands) ELSE list_distinct([round_even(i * (n_hands - 1) / 5.0::DOUBLE, 0)::BIGINT FOR i IN range(0, 6)]) END)::INT AS hand_idx FROM sizes"""))
def even_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("chunk_id", F.explode(Q.even_span(F.col("n_hands"), 6)).alias("hand_idx"))


@query(B.with_sql("""
, w AS (SELECT chunk_id, unnest(range(0, n_hands - 3, 2)) AS s FROM (SELECT chunk_id, count(*) AS n_hands FROM hands GROUP BY chunk_id) WHERE n_hands >= 4),
sc AS (SELECT w.chunk_id, s, avg((hand_id % 100) / 100.0::DOUBLE) AS v FROM w JOIN hands h ON h.chunk_id = w.chunk_id AND hand_idx >= s AND hand_idx < s + 4 GROUP BY w.chunk_id, s)
SELECT chunk_id, count(*) AS windows, round(avg(v) + 1e-9, 6) AS mean, round(max(v) + 1e-9, 6) AS top, round(list_avg(list_sort(list(v), 'DESC')[1:3]) + 1e-9, 6) AS top3 FROM sc GROUP BY chunk_id"""))
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the windows of a chunk put together again: mean, maximum, mean of the best three."""
    hands = B.hands(spark, sf_dir)
    windows = Q.chunk_windows(_sizes(spark, sf_dir), 4, 2)
    # each hand names the windows it is in, so the join has equal keys and no range condition
    placed = hands.select("chunk_id", ((F.col("hand_id") % 100) / 100.0).alias("s"), F.explode(F.sequence(F.greatest(F.col("hand_idx") - 3, F.lit(0)), F.col("hand_idx"))).alias("start"))
    scores = windows.join(placed, ["chunk_id", "start"]).groupBy("chunk_id", "start").agg(F.avg("s").alias("v"))
    best = F.slice(F.sort_array(F.collect_list("v"), asc=False), 1, 3)
    out = scores.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("windows"), F.avg("v").alias("mean"), F.max("v").alias("top"), best.alias("b"))
    mean3 = F.aggregate("b", F.lit(0.0), lambda a, x: a + x) / F.size("b")
    return out.select("chunk_id", "windows", S.tidy("mean").alias("mean"), S.tidy("top").alias("top"), S.tidy(mean3).alias("top3"))
