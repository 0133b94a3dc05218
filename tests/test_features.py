"""Features against plain loops over small hands."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators import features as X
from quillon.operators import sequences as Q

HAND = "chunk_id long, hand_id long, hand_idx int, hero_seat int, n_players int, max_seats int"
ACT = "hand_id long, ord int, street string, seat int, action_type string, amount_bb double, amount double, pot_before double, pot_after double, raise_to double, call_to double"
HANDS = [(1, 10, 0, 2, 3, 6), (1, 11, 1, 1, 2, 6), (1, 12, 2, 0, 2, 6), (2, 13, 0, 1, 4, 6)]
ACTS = [
    (10, 1, "preflop", 1, "call", 1.0, 1.0, 1.5, 2.5, None, 1.0), (10, 2, "preflop", 2, "raise", 4.0, 4.0, 2.5, 6.5, None, None), (10, 3, "turn", 1, "fold", 0.0, 0.0, 6.5, 6.5, None, None),
    (10, 4, "flop", 1, "bet", 0.0, 0.0, 9.0, 9.0, None, None), (11, 1, "flop", 1, "check", 0.0, 0.0, 1.0, 1.0, None, None), (11, 2, "flop", 1, "check", 0.0, 0.0, 1.0, 1.0, None, None),
    (13, 1, "river", 3, "bet", 30.0, 3.0, 10.0, 40.0, None, None), (13, 2, "showdown", 4, "call", 30.0, 3.0, 39.0, 70.0, None, None),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(HANDS, HAND), spark.createDataFrame(ACTS, ACT)


def test_hand_features_by_hand(small):
    got = {r["hand_id"]: r for r in X.hand_features(*small).collect()}
    h = got[10]
    assert h["num_actions"] == 4 and h["num_streets_observed"] == 3 and h["last_street_rank"] == 2
    assert h["acted_after_fold_ratio"] == 0.25 and h["has_actor_after_fold"] == 1
    assert h["same_actor_consecutive_ratio"] == 0.25
    assert h["street_jump_ratio"] == 0.25 and h["max_street_jump"] == 2 and h["street_regression_ratio"] == 0.25
    assert h["pot_mismatch_ratio"] == pytest.approx(1 / 3) and h["pot_decrease_ratio"] == 0
    assert h["aggression_ratio"] == 2.0 and h["raise_to_missing_ratio"] == 0.25 and h["zero_amount_betraise_ratio"] == 0.25
    assert h["amount_mean"] == 2.5 and h["amount_std"] == 1.5 and h["amount_q75"] == pytest.approx(3.25)
    assert h["action_type_entropy"] == pytest.approx(1.0)
    empty = got[12]
    assert empty["num_actions"] == 0 and empty["ended_preflop"] == 1 and empty["hero_action_ratio"] == 0


def test_chunk_vector_doesnt_depend_on_the_order_of_hands(spark, small):
    hands, acts = small
    chunks = spark.createDataFrame([(1,), (2,), (3,)], "chunk_id long")
    one = X.chunk_vectors(chunks, X.hand_features(hands, acts)).orderBy("chunk_id").collect()
    two = X.chunk_vectors(chunks, X.hand_features(hands.orderBy(F.col("hand_id").desc()), acts.repartition(3))).orderBy("chunk_id").collect()
    assert one == two
    assert len(one[0]) == 2 + 46 * 7 and all(v == 0 for v in one[2][1:])


def test_pooled_features_against_a_loop(small):
    got = {r["chunk_id"]: r for r in X.pooled_features(*small).collect()}
    mine = [a for a in ACTS if a[0] in (10, 11)]
    kinds = Counter(a[4] for a in mine)
    n = len(mine)
    r = got[1]
    assert r["call_rate"] == kinds["call"] / n and r["check_rate"] == kinds["check"] / n
    assert r["bet_raise_rate"] == 2 / n and r["zero_amount_rate"] == 4 / n
    h = -sum(c / n * math.log(c / n) for c in kinds.values()) / math.log(12)
    assert r["action_entropy_norm"] == pytest.approx(h, abs=1e-9)
    assert r["action_signature_unique_share"] == 1.0
    assert r["max_action_type_run_norm"] == pytest.approx((1 / 4 + 2 / 2) / 2)
    assert r["street_coverage"] == pytest.approx((3 / 4 + 1 / 4 + 0) / 3)


def test_ngrams_of_short_arrays(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b", "c"]), (3, [])], "i int, t array<string>")
    got = {r["i"]: [x["gram"] for x in r["g"]] for r in rows.select("i", Q.ngrams(F.col("t")).alias("g")).collect()}
    assert got == {1: ["a"], 2: ["a", "b", "c", "a|b", "b|c", "a|b|c"], 3: []}


def test_gram_tokens_skip_blinds(spark):
    rows = [(1, 1, "preflop", 1, "big_blind", 1.0, 1.0, 1.0, 2.0, None, None), (1, 2, "flop", 2, "bet", 3.0, 3.0, 10.0, 13.0, None, None)]
    got = {r["gram"] for r in X.hand_grams(spark.createDataFrame(rows, ACT)).collect()}
    assert got == {"fBs", "pos2B", "fBs|pos2B"}


def test_standardize_keeps_constant_columns_finite(spark):
    rows = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "k int, a double, b double")
    assert sorted(map(tuple, X.standardize(rows, ["a", "b"]).collect())) == [(1, -1.0, 0.0), (2, 1.0, 0.0)]


def test_hand_features_keep_no_lists_and_tell_odd_symbols(spark, small):
    """F8: sums and counts only. Unknown kinds are symbols of their own, null ones and seats below 0 are none; a hand that
    stands twice is two rows."""
    hands, acts = small
    plan = X.hand_features(hands, acts)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    odd = [(20, 1, "flop", -1, "post", 1.0, 1.0, 1.0, 2.0, None, None), (20, 2, "river", 4, "straddle", 2.0, 2.0, 2.0, 4.0, None, None), (20, 3, "flop", 4, "post", 8.0, 8.0, 4.0, 12.0, None, None), (20, 4, "flop", 5, None, 0.0, 0.0, 12.0, 12.0, None, None)]
    twice = spark.createDataFrame([(1, 20, 0, 4, 3, 6), (1, 20, 0, 4, 3, 6), (2, 20, 0, 5, 3, 6)], HAND)
    got = sorted(X.hand_features(twice, spark.createDataFrame(odd, ACT)).collect())
    entropy = lambda *c: -sum(x / sum(c) * math.log(x / sum(c)) for x in c) / math.log(len(c))
    assert [(r["chunk_id"], r["num_actions"], r["hero_action_ratio"]) for r in got] == [(1, 4, 0.5), (1, 4, 0.5), (2, 4, 0.25)]
    assert got[0]["action_type_entropy"] == pytest.approx(entropy(2, 1)) and got[0]["actor_seat_entropy"] == pytest.approx(entropy(2, 1)) and got[0]["street_entropy"] == pytest.approx(entropy(3, 1))
    assert got[0]["amount_q75"] == 5.0 and got[0]["amount_max"] == 8.0


def _percentiles_begin_dealt(df):
    """Whether no percentile that has begun is shuffled: every aggregate with one has the exchange below it."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    with_one = [i for i, x in enumerate(lines) if "percentile(" in x and "Aggregate" in x]
    return with_one and not any("Exchange" in x for x in lines[with_one[0] : with_one[-1]])


def test_statistics_of_chunks_shuffle_hands_not_percentiles(small):
    """what a percentile has seen is larger than the numbers themselves."""
    stats = X.feature_stats(X.hand_features(*small))
    assert _percentiles_begin_dealt(stats)
    got = {(r["chunk_id"], r["feature"]): r for r in stats.collect()}
    r = got[1, "num_actions"]  # hands of 4, 2 and 0 actions
    assert len(got) == 2 * 46 and (r["mean"], r["min"], r["max"], r["q25"], r["q50"], r["q75"]) == (2.0, 0.0, 4.0, 1.0, 2.0, 3.0)


def test_vectors_of_chunks_shuffle_hands_not_percentiles(spark, small):
    """the same of the wide form."""
    assert _percentiles_begin_dealt(X.chunk_vectors(spark.createDataFrame([(1,), (9,)], "chunk_id long"), X.hand_features(*small)))
