"""Queries that train on chunk features. They have no SQL twins; the tests check their invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import bindings as B
from quillon.functions import labels as G
from quillon.functions import scalars as S
from quillon.operators import embedding as E
from quillon.operators import features as X
from quillon.operators import metrics as M
from quillon.operators import models as D
from quillon.plans.catalog import query
from quillon.sources import synthetic
from quillon.sources.shared import kept

NAMES = [f"{k}_mean" for k in ("aggression_ratio", "passive_ratio", "action_type_entropy", "street_jump_ratio", "amount_mean", "fold_ratio", "raise_ratio", "num_actions")]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of some hand features per chunk; the label is a fixed function of them and of the balance, so that there is
    something to learn."""
    features = X.hand_features(B.hands(spark, sf_dir), B.actions(spark, sf_dir))
    means = features.groupBy("chunk_id").agg(*(F.avg(n.removesuffix("_mean")).alias(n) for n in NAMES))
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), "c_acctbal")
    y = F.col("aggression_ratio_mean") + F.col("c_acctbal") / 40000 > 1.05
    return means.join(c, "chunk_id").select("chunk_id", *NAMES, y.cast("int").alias("y"))


@query()
def calibrated_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees on a training split, calibrated on the validation split, scores of all chunks with decisions."""
    rows = G.hash_split(_labelled(spark, sf_dir), "chunk_id", 0.3, 44).persist()
    model = D.train(rows.where("split = 'train'"), NAMES)
    scored = D.score(model, rows.drop("split"))
    calibrator = D.fit_calibrator(D.score(model, rows.where("split = 'validation'")).select("score", "y"))
    out = calibrator.apply(scored)
    return out.select("chunk_id", "y", "score", M.decide().cast("int").alias("flagged"), S.confidence("score").alias("confidence"))


@query()
def blend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold comparison of two learners, their blend and a logistic stack of both."""
    oof = D.out_of_fold(_labelled(spark, sf_dir), NAMES, "chunk_id", k=2, only=("trees", "linear"))
    return D.compare_blends(oof, "trees", "linear").select("name", *(S.tidy(c).alias(c) for c in ("ap", "auc", "reward", "fpr")), "chosen")


@query(B.with_sql("""
, w AS (SELECT hand_id, ord, ((coalesce(list_position(['fold', 'check', 'call', 'bet', 'raise'], action_type), 0) * 6 + list_position(['preflop', 'flop', 'turn', 'river', 'showdown'], street)) * @BUCKETS@
          + CASE WHEN amount_bb <= 0 THEN 0 @EDGES@ ELSE @BUCKETS@ - 1 END)::INT AS word FROM acts),
p AS (SELECT lag(word) OVER (PARTITION BY hand_id ORDER BY ord) AS before, word FROM w)
SELECT before, word, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY before, word"""
    .replace("@BUCKETS@", str(E.BUCKETS)).replace("@EDGES@", " ".join(f"WHEN amount_bb <= {e} THEN {i}" for i, e in enumerate(S.AMOUNT_EDGES, 1)))))
def action_word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an action word follows another: what the embedding is factorised from."""
    return E.word_pairs(E.action_words(B.actions(spark, sf_dir)))


@query()
def embedded_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated scores of all chunks by learned embedding and features; the tests compare it with plain Python."""
    # features, labels and words are read by fitting and by prediction, so each is worked out once and written
    labelled, hands = kept(_labelled(spark, sf_dir), "labelled"), B.hands(spark, sf_dir)
    words = kept(E.action_words(B.actions(spark, sf_dir)), "words")
    detector = E.fit_embedded(hands, None, labelled.drop("y"), labelled.select("chunk_id", "y"), NAMES, words=words)
    chunks = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"))
    return detector.predict(chunks, hands, None, labelled.drop("y"), words=words).select("chunk_id", "raw", "score", F.col("flagged").cast("int").alias("flagged"))


@query()
def synthetic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the archetypes of generated hands act; a hand for every customer."""
    a = synthetic.synthetic_actions(spark, B.table(spark, sf_dir, "customer").count())
    return a.groupBy("archetype", "action_type").agg(F.count(F.lit(1)).alias("n"), S.tidy(F.avg("amount")).alias("mean_amount"))


@query("""
WITH r AS (SELECT greatest(1, ceil(500 / count(*)::DOUBLE))::BIGINT AS units, 500 / count(*)::DOUBLE / greatest(1, ceil(500 / count(*)::DOUBLE)) AS rate FROM customer),
t AS (SELECT k, rate, exp(-rate) * sum(rate ** k / gamma(k + 1)) OVER (ORDER BY k) AS tail FROM r, (SELECT unnest(range(0, 25)) AS k)),
u AS (SELECT c_custkey, (('0x' || substr(sha256(c_custkey || ':7:' || unit), 1, 7))::BIGINT + 0.5) / (1 << 28) AS u FROM customer, r, unnest(range(1, units + 1)) AS x(unit)),
d AS (SELECT c_custkey, u, (SELECT count(*) FROM t WHERE u.u >= t.tail) AS d FROM u)
SELECT c_custkey, unnest(range(1, d + 1))::INT AS copy FROM d""")
def bootstrap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers drawn with replacement, about as many as there are orders per hundred."""
    c = B.table(spark, sf_dir, "customer").select("c_custkey")
    return G.bootstrap(c, 500, "c_custkey", 7)
