"""Queries over scored sets: rewards, curves, thresholds, calibration, drift, result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import bindings as B
from quillon.functions import labels as G
from quillon.functions import scalars as S
from quillon.operators import metrics as M
from quillon.operators import sequences as Q
from quillon.plans.catalog import query

#: ``scored`` and ``responses`` under one name, for metrics by key.
CURVE_SQL = """,
pts AS (SELECT {k}, score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM {t} GROUP BY {k}, score),
crv AS (SELECT *, sum(pos) OVER d AS tp, sum(n) OVER d AS seen, sum(pos) OVER (PARTITION BY {k}) AS total_pos, sum(n) OVER (PARTITION BY {k}) AS total
        FROM pts WINDOW d AS (PARTITION BY {k} ORDER BY score DESC)),
rnk AS (SELECT {k}, coalesce(sum(pos / nullif(total_pos, 0) * tp / seen), 0) AS ap,
               coalesce(sum(pos * (total - total_pos - (seen - tp) + (n - pos) / 2)) / nullif(any_value(total_pos) * any_value(total - total_pos), 0), 0) AS auc FROM crv GROUP BY {k}),
cnf AS (SELECT {k}, count(*) FILTER (WHERE round_even(score, 0) = 1 AND y = 1) AS tp, count(*) FILTER (WHERE round_even(score, 0) = 1 AND y = 0) AS fp,
               count(*) FILTER (WHERE round_even(score, 0) <> 1 AND y = 0) AS tn, count(*) FILTER (WHERE round_even(score, 0) <> 1 AND y = 1) AS fn FROM {t} GROUP BY {k}),
rwd AS (SELECT {k}, fpr, bot_recall, ap AS ap_score, pen AS human_safety_penalty, 0.65 * ap + 0.35 * bot_recall AS base_score, (0.65 * ap + 0.35 * bot_recall) * pen AS reward FROM (
          SELECT *, CASE WHEN fpr >= 0.10 THEN 0 ELSE (1 - fpr) ** 2 END AS pen FROM (
            SELECT {k}, fp / greatest(tn + fp, 1)::DOUBLE AS fpr, tp / greatest(tp + fn, 1)::DOUBLE AS bot_recall, ap FROM cnf JOIN rnk USING ({k}))))
"""
REWARD = ["fpr", "bot_recall", "ap_score", "human_safety_penalty", "base_score", "reward"]
_all = lambda names: ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in names)
ONE = ", one AS (SELECT 1 AS k, * FROM scored)"


def _tidy(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(S.tidy(c).alias(c) for c in df.columns if c not in keys))


@query(B.with_sql(ONE + CURVE_SQL.format(k="k", t="one") + f"SELECT {_all(REWARD)} FROM rwd"))
def reward_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(M.reward(B.scored(spark, sf_dir), []))


@query(B.with_sql(CURVE_SQL.format(k="uid", t="responses") + f"SELECT uid, {_all(REWARD)} FROM rwd"))
def reward_by_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(M.reward(B.responses(spark, sf_dir), ["uid"]), "uid")


@query(B.with_sql(", one AS (SELECT 1 AS k, * FROM responses)" + CURVE_SQL.format(k="k", t="one") + """
SELECT round(ap + 1e-9, 6) AS ap, round(auc + 1e-9, 6) AS auc, round(log_loss + 1e-9, 6) AS log_loss, round(brier + 1e-9, 6) AS brier FROM rnk,
  (SELECT avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss, avg((score - y) ** 2) AS brier FROM (SELECT *, greatest(1e-15, least(score, 1 - 1e-15)) AS p FROM responses))"""))
def ranking_and_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = B.responses(spark, sf_dir)
    return _tidy(M.ranking(r, []).join(F.broadcast(M.losses(r, []))))


@query(B.with_sql("""
SELECT uid, round(human_prob_max + 1e-9, 6) AS human_prob_max, round(bot_prob_min + 1e-9, 6) AS bot_prob_min, round(bot_prob_min - human_prob_max + 1e-9, 6) AS gap,
  round(score_min + 1e-9, 6) AS score_min, round(score_max + 1e-9, 6) AS score_max, round(score_mean + 1e-9, 6) AS score_mean
FROM (SELECT uid, coalesce(max(score) FILTER (WHERE y = 0), 0) AS human_prob_max, coalesce(min(score) FILTER (WHERE y = 1), 0) AS bot_prob_min, min(score) AS score_min, max(score) AS score_max, avg(score) AS score_mean FROM responses GROUP BY uid)"""))
def score_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(M.score_range(B.responses(spark, sf_dir), ["uid"]), "uid")


@query(B.with_sql("""
, thr AS (SELECT (i / 100.0::DOUBLE) AS t FROM range(5, 96) r(i) UNION SELECT score FROM scored),
m AS (SELECT t, count(*) FILTER (WHERE score >= t AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE score >= t AND y = 0)::DOUBLE AS fp, count(*) FILTER (WHERE score < t AND y = 1)::DOUBLE AS fn, count(*)::DOUBLE AS n FROM thr, scored GROUP BY t),
f AS (SELECT t, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, (n - fp - fn) / n AS acc FROM m)
SELECT round(t + 1e-9, 6) AS threshold, round(f1 + 1e-9, 6) AS f1, round(acc + 1e-9, 6) AS accuracy FROM f ORDER BY f1 DESC, acc DESC, t LIMIT 1"""))
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(5, 96).select((F.col("id") / 100.0).alias("score"))
    return _tidy(M.best_threshold(B.scored(spark, sf_dir), grid))


@query(B.with_sql("""
, cand AS (SELECT DISTINCT unnest(quantile_cont(score, [0.40 + 0.599 * i / 79 FOR i IN range(0, 80)])) AS c FROM scored)
SELECT round(c + 1e-9, 6) AS score FROM cand"""))
def candidate_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quantile_candidates(B.scored(spark, sf_dir)).select(S.tidy("score").alias("score"))


@query(B.with_sql(ONE + CURVE_SQL.format(k="k", t="one") + """
, cand AS (SELECT i / 50.0::DOUBLE AS c FROM range(0, 50) r(i)),
m AS (SELECT c, count(*) FILTER (WHERE score > c AND y = 0) / count(*) FILTER (WHERE y = 0)::DOUBLE AS fpr, count(*) FILTER (WHERE score > c AND y = 1) / count(*) FILTER (WHERE y = 1)::DOUBLE AS recall FROM cand, scored GROUP BY c)
SELECT round(c + 1e-9, 6) AS cut, round(fpr + 1e-9, 6) AS fpr, round(recall + 1e-9, 6) AS recall, round((0.65 * ap + 0.35 * recall) * (CASE WHEN fpr >= 0.10 THEN 0 ELSE (1 - fpr) ** 2 END) + 1e-9, 6) AS reward
FROM m, rnk WHERE fpr < 0.3 - 1e-9"""))
def cut_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(50).select((F.col("id") / 50.0).alias("score"))
    return _tidy(M.best_cut(B.scored(spark, sf_dir), grid, 0.3))


@query(B.with_sql("SELECT round(quantile_cont(score, 0.96) + 1e-9, 6) AS cut FROM scored WHERE y = 0"))
def conformal_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(M.conformal_cut(B.scored(spark, sf_dir), 0.04))


@query(B.with_sql("""
SELECT id, round(least(1, greatest(0, CASE WHEN s < 0.3 THEN s / 0.3 * 0.5 ELSE 0.5 + (s - 0.3) / (1 - 0.3) * 0.5 END)) + 1e-9, 6) AS remapped,
  round(lo + (hi - lo) * (s * 255 - i) + 1e-9, 6) AS interpolated, round(ln(p / (1 - p)) + 1e-9, 6) AS logit, round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.5) / 2)) + 1e-9, 6) AS shifted
FROM (SELECT id, s, i, (i / 255.0::DOUBLE) ** 2 AS lo, ((i + 1) / 255.0::DOUBLE) ** 2 AS hi, least(greatest(s, 1e-6), 1 - 1e-6) AS p FROM (SELECT id, score AS s, least(floor(score * 255), 254) AS i FROM scored))"""))
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut sent to one half, an even grid interpolated by index, and a shift with temperature in log-odds."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.pow(i / F.lit(255.0), F.lit(2.0)))
    s = B.scored(spark, sf_dir)
    return s.select(
        "id", S.tidy(S.remap("score", F.lit(0.3))).alias("remapped"), S.tidy(S.grid_interpolate("score", grid)).alias("interpolated"),
        S.tidy(S.logit("score")).alias("logit"), S.tidy(S.sigmoid((S.logit("score") + 0.5) / 2)).alias("shifted"),
    )


@query(B.with_sql("""
SELECT DISTINCT round(score + 1e-9, 6) AS score, round(cume_dist() OVER (ORDER BY score) + 1e-9, 6) AS ecdf, round(max(score * (1 - score)) OVER (ORDER BY score) + 1e-9, 6) AS peak FROM scored"""))
def score_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution function of the scores and a running maximum over them (one row per distinct score)."""
    from pyspark.sql import Window

    c = M.curve(B.scored(spark, sf_dir), [])
    # at most one row per distinct score is left; the scores here are a fixed grid of fifty
    peak = F.max(F.col("score") * (1 - F.col("score"))).over(Window.orderBy("score"))
    return c.select(S.tidy("score").alias("score"), S.tidy((F.col("total") - F.col("seen") + F.col("n")) / F.col("total")).alias("ecdf"), S.tidy(peak).alias("peak"))


@query(B.with_sql("""
SELECT id, y, round(score + 1e-9, 6) AS score, CASE WHEN y = 1 THEN 'bot' ELSE 'human' END AS label_name, round_even(score, 0)::INT AS rounded, (score >= 0.5)::INT AS at_boundary,
  (round_even(score, 0) = y) AS correct, CASE WHEN abs(score - 0.5) >= 0.35 THEN 'high' WHEN abs(score - 0.5) >= 0.15 THEN 'medium' ELSE 'low' END AS confidence, round(abs(score - y) + 1e-9, 6) AS diff FROM scored"""))
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.scored(spark, sf_dir)
    return s.select(
        "id", "y", S.tidy("score").alias("score"), F.when(F.col("y") == 1, "bot").otherwise("human").alias("label_name"), M.decide().cast("int").alias("rounded"),
        M.decide(boundary=0.5).cast("int").alias("at_boundary"), (F.rint("score") == F.col("y")).alias("correct"), S.confidence("score").alias("confidence"),
        S.tidy(F.abs(F.col("score") - F.col("y"))).alias("diff"),
    )


@query(B.with_sql("""
SELECT id, y, round(diff + 1e-9, 6) AS diff, rn AS rank FROM (SELECT id, y, abs(score - y) AS diff, row_number() OVER (PARTITION BY y ORDER BY abs(score - y) DESC, id) AS rn FROM scored WHERE abs(score - y) > 1e-5) WHERE rn <= 10"""))
def hardest_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the ten worst of each class."""
    from pyspark.sql import Window

    s = B.scored(spark, sf_dir).withColumn("diff", F.abs(F.col("score") - F.col("y"))).where("diff > 1e-5")
    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy(F.col("diff").desc(), "id"))).where("rank <= 10")
    return ranked.select("id", "y", S.tidy("diff").alias("diff"), F.col("rank").cast("long").alias("rank"))


@query(B.with_sql("""
SELECT count(*) AS n, count(*) FILTER (WHERE round_even(score, 0) <> y) AS mismatches, round(max(abs(score - y)) + 1e-9, 6) AS worst,
  count(*) FILTER (WHERE y = 1) AS bots, count(*) FILTER (WHERE y = 0) AS humans, round(count(*) FILTER (WHERE y = 0) / greatest(count(*) FILTER (WHERE y = 1), 1)::DOUBLE + 1e-9, 6) AS pos_weight,
  (abs(count(*) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 0)) > 0.1 * count(*)) AS imbalanced FROM scored"""))
def scored_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    return B.scored(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.rint("score") != F.col("y")).alias("mismatches"), S.tidy(F.max(F.abs(F.col("score") - F.col("y")))).alias("worst"),
        pos.alias("bots"), neg.alias("humans"), S.tidy(neg / F.greatest(pos, F.lit(1))).alias("pos_weight"), (F.abs(pos - neg) > 0.1 * F.count(F.lit(1))).alias("imbalanced"),
    )


DRIFT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""
WITH long AS (SELECT * FROM (UNPIVOT (SELECT l_shipdate < TIMESTAMP '1998-01-01' AS e, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE v)),
facts AS (SELECT feature, list_distinct(quantile_cont(v, [i / 10.0::DOUBLE FOR i IN range(0, 11)]) FILTER (WHERE e)) AS ed, min(v) AS lo, max(v) AS hi, count(*) FILTER (WHERE e)::DOUBLE AS ne, count(*) FILTER (WHERE NOT e)::DOUBLE AS na FROM long GROUP BY feature),
f AS (SELECT *, list_sort(ed) AS edges FROM facts),
bins AS (SELECT feature, least(len(list_filter(edges, lambda x: x <= v)), len(edges) - 1) AS b, count(*) FILTER (WHERE e) AS ce, count(*) FILTER (WHERE NOT e) AS ca FROM long JOIN f USING (feature) WHERE len(edges) > 2 AND v >= edges[1] AND v <= edges[-1] GROUP BY 1, 2),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM (SELECT f.feature, greatest(coalesce(ce, 0) / ne, 1e-6) AS e, greatest(coalesce(ca, 0) / na, 1e-6) AS a
          FROM (SELECT *, unnest(range(1, len(edges))) AS b FROM f WHERE len(edges) > 2) f LEFT JOIN bins ON bins.feature = f.feature AND bins.b = f.b) GROUP BY feature),
ks AS (SELECT feature, max(abs(ce / ne - ca / na)) AS ks FROM (SELECT feature, v, sum(e::INT) OVER w AS ce, sum((NOT e)::INT) OVER w AS ca, ne, na FROM long JOIN f USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY v)) GROUP BY feature),
ev AS (SELECT feature, least(floor((v - lo) / ((hi - lo) / 20)), 19) AS b, count(*) FILTER (WHERE e) AS ce, count(*) FILTER (WHERE NOT e) AS ca FROM long JOIN f USING (feature) GROUP BY 1, 2),
js AS (SELECT feature, sqrt(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) AS js FROM (
         SELECT f.feature, (coalesce(ce, 0) + 1e-6) / (ne + 2e-5) AS p, (coalesce(ca, 0) + 1e-6) / (na + 2e-5) AS q FROM (SELECT *, unnest(range(0, 20)) AS b FROM f) f LEFT JOIN ev ON ev.feature = f.feature AND ev.b = f.b) GROUP BY feature)
SELECT feature, round(coalesce(psi, 0) + 1e-9, 6) AS psi, round(ks + 1e-9, 6) AS ks, round(js + 1e-9, 6) AS js, round(me + 1e-9, 6) AS mean_expected, round(ma + 1e-9, 6) AS mean_actual FROM f LEFT JOIN (SELECT feature, avg(v) FILTER (WHERE e) AS me, avg(v) FILTER (WHERE NOT e) AS ma FROM long GROUP BY feature) USING (feature) LEFT JOIN psi USING (feature) JOIN ks USING (feature) JOIN js USING (feature)""")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").select("l_shipdate", *DRIFT)
    before = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return _tidy(M.drift(rows.where(before), rows.where(~before), DRIFT), "feature")


@query("""
WITH s AS (SELECT avg(c_acctbal) AS am, stddev_pop(c_acctbal) AS asd, avg(c_nationkey) AS nm, stddev_pop(c_nationkey) AS nsd FROM customer),
z AS (SELECT c_custkey, 'c_acctbal' AS feature, abs(c_acctbal - am) / asd * 0.75 AS v FROM customer, s UNION ALL SELECT c_custkey, 'c_nationkey', abs(c_nationkey - nm) / nsd * 0.25 FROM customer, s)
SELECT c_custkey, feature, row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC, feature)::INT AS rank, round(v + 1e-9, 6) AS salience FROM z""")
def salient_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return _tidy(M.salient(rows, "c_custkey", {"c_acctbal": 3.0, "c_nationkey": 1.0}, 2), "c_custkey", "feature", "rank")


@query(B.with_sql("SELECT count(*) AS chunks, max(n)::BIGINT AS largest, round(avg(n) + 1e-9, 6) AS mean_size, bool_or(acctbal < 0) AS has_bots FROM (SELECT chunk_id, count(*) AS n, any_value(c_acctbal) AS acctbal FROM hands JOIN customer ON c_custkey = chunk_id GROUP BY chunk_id)"))
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = B.hands(spark, sf_dir).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), "c_acctbal")
    return sizes.join(c, "chunk_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("n").alias("largest"), S.tidy(F.avg("n")).alias("mean_size"), F.bool_or(F.col("c_acctbal") < 0).alias("has_bots"))


BUNDLE = "score_min score_max score_mean score_std human_score_mean bot_score_mean accuracy precision_bot recall_bot f1_bot roc_auc pr_auc log_loss brier".split()


@query(B.with_sql(CURVE_SQL.format(k="uid", t="responses") + f"""
, b AS (SELECT uid, count(*) AS "count", count(*) FILTER (WHERE y = 0) AS human_count, count(*) FILTER (WHERE y = 1) AS bot_count, min(score) AS score_min, max(score) AS score_max, avg(score) AS score_mean, stddev_pop(score) AS score_std,
          avg(score) FILTER (WHERE y = 0) AS human_score_mean, avg(score) FILTER (WHERE y = 1) AS bot_score_mean,
          avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS ll, avg((score - y) ** 2) AS br FROM (SELECT *, greatest(1e-6, least(score, 1 - 1e-6)) AS p FROM responses) GROUP BY uid),
m AS (SELECT b.*, tn, fp, fn, tp, (tn + tp) / "count"::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision_bot, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall_bot,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1_bot, CASE WHEN human_count > 0 AND bot_count > 0 THEN auc END AS roc_auc, CASE WHEN human_count > 0 AND bot_count > 0 THEN ap END AS pr_auc,
        CASE WHEN human_count > 0 AND bot_count > 0 THEN ll END AS log_loss, CASE WHEN human_count > 0 AND bot_count > 0 THEN br END AS brier FROM b JOIN cnf USING (uid) JOIN rnk USING (uid))
SELECT uid, "count", human_count, bot_count, tn, fp, fn, tp, {_all(BUNDLE)} FROM m"""))
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of labelled scores by uid."""
    return _tidy(M.safe_metrics(B.responses(spark, sf_dir), ["uid"]), "uid", "count", "human_count", "bot_count", "tn", "fp", "fn", "tp")


@query(B.with_sql("""
SELECT cycle, count(*) AS "count", round(min(score) + 1e-9, 6) AS score_min, round(max(score) + 1e-9, 6) AS score_max, round(avg(score) + 1e-9, 6) AS score_mean, round(stddev_pop(score) + 1e-9, 6) AS score_std,
  count(*) FILTER (WHERE score >= 0.4) AS pred_bot, count(*) FILTER (WHERE score < 0.4) AS pred_human, round(count(*) FILTER (WHERE score >= 0.4) / count(*)::DOUBLE + 1e-9, 6) AS pred_bot_rate FROM responses GROUP BY cycle"""))
def unlabelled_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scores tell without labels, by cycle, with a boundary of one's own."""
    return _tidy(M.scoring_only_metrics(B.responses(spark, sf_dir), ["cycle"], boundary=0.4), "cycle", "count", "pred_bot", "pred_human")


@query("""
WITH h AS (SELECT c_custkey, c_acctbal < 0 AS y, sha256(c_custkey || ':44') AS k FROM customer)
SELECT c_custkey, (row_number() OVER (PARTITION BY y ORDER BY k) - 1) % 5 AS fold,
  CASE WHEN row_number() OVER (ORDER BY k) <= greatest(1, round_even(0.2 * (SELECT count(*) FROM h), 0)) THEN 'validation' ELSE 'train' END AS split FROM h""")
def folds_and_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of equal size by class, and an exact split of all rows."""
    c = B.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("y"))
    return G.permutation_split(G.equal_folds(c, "c_custkey", "y", 5, 44), "c_custkey", 0.2, 44).select("c_custkey", F.col("fold").cast("long").alias("fold"), "split")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 3")
def first_hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three hands of every chunk."""
    return Q.leading(B.table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")
