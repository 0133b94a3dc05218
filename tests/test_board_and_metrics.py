"""Tables of cases for weights, epochs, manifests and metrics."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import board as L
from quillon.operators import canonical as C
from quillon.operators import metrics as M
from quillon.operators import sequences as Q


def _map(df, k, v):
    return {r[k]: pytest.approx(r[v]) for r in df.collect()}


@pytest.mark.parametrize(
    ("rewards", "weights"),
    [([(1, 0.25), (2, 0.8), (3, 0.4)], {0: 0.7, 2: 0.15, 3: 0.09, 1: 0.06}), ([(1, 0.0), (2, -0.1), (3, 0.0)], {0: 1.0}), ([(5, 1.0), (4, 1.0)], {0: 0.7, 4: 0.15, 5: 0.09}), ([], {0: 1.0})],
)
def test_podium(spark, rewards, weights):
    assert _map(L.podium(spark.createDataFrame(rewards, "uid long, reward double")), "uid", "weight") == weights


@pytest.mark.parametrize(
    ("entries", "weights"),
    [([(42, 1.0)], {0: 0.7, 42: 0.3}), ([(0, 1.0)], {0: 1.0}), ([(7, 2.0), (11, 1.0)], {0: 0.7, 7: 0.2, 11: 0.1}), ([(42, 0.0), (500, 1.0), (3, float("nan"))], {})],
)
def test_settlement(spark, entries, weights):
    out = L.settlement_vector(spark.createDataFrame(entries, "uid int, weight double"), 128)
    assert _map(out.where("weight > 0"), "uid", "weight") == weights
    assert out.count() == (128 if weights else 0)


@pytest.mark.parametrize(
    ("now", "start", "end"),
    [("2026-04-27 21:15:00", "2026-04-27 20:00:00", "2026-04-28 20:00:00"), ("2026-05-13 21:15:00", "2026-05-12 20:00:00", "2026-05-15 20:00:00"),
     ("2026-05-15 19:59:00", "2026-05-12 20:00:00", "2026-05-15 20:00:00"), ("2026-05-15 20:00:00", "2026-05-15 20:00:00", "2026-05-18 20:00:00")],
)
def test_epochs(spark, now, start, end):
    t = F.lit(now).cast("timestamp")
    row = spark.range(1).select(L.epoch_start(t).cast("string").alias("s"), L.epoch_end(t).cast("string").alias("e")).first()
    assert (row["s"], row["e"]) == (start, end)


MANIFEST = "open_source boolean, repo_url string, repo_commit string, model_name string, model_version string, training_data_statement string, private_data_attestation string, implementation_files array<string>, implementation_sha256 string"


def test_manifests(spark):
    good = (True, "https://x.org/base/", "a" * 40, "base", "1", "t", "p", ["a.py"], "f" * 64)
    rows = [good, (*good[:3], "other", *good[4:]), (*good[:2], "main", *good[3:]), (*good[:7], None, None), (None,) * 9]
    df = spark.createDataFrame(rows, MANIFEST).coalesce(1)
    got = L.compliance(df, reference_repo="https://x.org/base", reference_model="base").collect()
    assert [r["status"] for r in got] == ["transparent"] + ["opaque"] * 4
    assert got[1]["policy_violations"] == ["repo_url_must_point_to_model_repo"]
    assert got[2]["policy_violations"] == ["repo_commit_invalid"]
    assert got[3]["missing_fields"] == ["implementation_files", "implementation_sha256"]
    assert len(got[4]["missing_fields"]) == 9


def test_mixed_keys(spark):
    ids = spark.createDataFrame([("10",), ("9",), ("abc",), ("1",)], "uid string")
    assert [r["uid"] for r in ids.orderBy(*L.numeric_first("uid")).collect()] == ["1", "9", "10", "abc"]


def _brute(rows):
    ranked = sorted(rows, key=lambda r: -r[1])
    pos = sum(y for y, _ in rows)
    ap = tp = seen = 0
    i = 0
    while i < len(ranked):
        j = i
        while j < len(ranked) and ranked[j][1] == ranked[i][1]:
            j += 1
        new = sum(y for y, _ in ranked[i:j])
        tp, seen = tp + new, seen + j - i
        ap += new / pos * tp / seen if pos else 0
        i = j
    pairs = [(a > b) + (a == b) / 2 for ya, a in rows for yb, b in rows if ya and not yb]
    return ap, sum(pairs) / len(pairs) if pairs else 0


@pytest.mark.parametrize("case", ["random", "ties", "one class", "perfect", "none"])
def test_ranking_against_brute_force(spark, case):
    rng = random.Random(3)
    rows = {
        "random": [(rng.randint(0, 1), rng.random()) for _ in range(200)], "ties": [(rng.randint(0, 1), rng.choice([0.1, 0.5, 1.0])) for _ in range(100)],
        "one class": [(0, 0.2), (0, 0.4)], "perfect": [(1, 0.9), (1, 0.8), (0, 0.3)], "none": [(1, 0.5), (0, 0.5)],
    }[case]
    r = M.ranking(spark.createDataFrame(rows, "y int, score double"), []).first()
    assert (r["ap"], r["auc"]) == (pytest.approx(_brute(rows)[0]), pytest.approx(_brute(rows)[1]))


def test_reward_edges(spark):
    # exactly one half is not flagged; a false-positive rate of one tenth loses everything
    half = M.reward(spark.createDataFrame([(0, 0.5), (1, 0.9)], "y int, score double"), []).first()
    assert half["fpr"] == 0 and half["reward"] == pytest.approx(1.0)
    tenth = M.reward(spark.createDataFrame([(0, 0.9)] + [(0, 0.1)] * 9 + [(1, 0.95)], "y int, score double"), []).first()
    assert tenth["fpr"] == pytest.approx(0.1) and tenth["reward"] == 0


def test_ranking_is_unchanged_by_a_monotone_map(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(rng.randint(0, 1), rng.random()) for _ in range(300)], "y int, score double")
    assert M.ranking(rows, []).first()["ap"] == pytest.approx(M.ranking(M.remapped(rows, 0.3), []).first()["ap"])


def test_top_k_flags_exactly_k(spark):
    rows = spark.createDataFrame([(1, i, 0.7) for i in range(9)] + [(2, 0, 0.3)], "key int, idx int, score double")
    out = L.top_k_bands(rows, ["key"], 3).collect()
    assert sum(r["score"] > 0.5 for r in out if r["key"] == 1) == 3
    assert [r["score"] for r in out if r["key"] == 2] == [0.3]


def test_drift_of_equal_and_shifted_samples(spark):
    a = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"))
    same = M.drift(a, a, ["x"]).first()
    assert same["psi"] == 0 and same["ks"] == 0 and same["js"] == 0
    moved = M.drift(a, a.select((F.col("x") + 200).alias("x")), ["x"]).first()
    assert moved["ks"] == pytest.approx(1.0) and moved["psi"] > 5


def test_visible_sample_sizes(spark):
    rows = [(h, i, ["flop", "turn", "preflop"][i % 3], 1, 6, n) for h, n in ((1, 1), (2, 4), (3, 30)) for i in range(1, n + 1)]
    out = C.visible_sample(spark.createDataFrame(rows, "hand_id long, ord int, street string, hero_seat int, max_seats int, n long")).collect()
    sizes = {h: sum(r["hand_id"] == h for r in out) for h in (1, 2, 3)}
    assert sizes[1] == 12 and sizes[2] == 4 and 5 <= sizes[3] <= 8
    assert {1, 30} <= {r["ord"] for r in out if r["hand_id"] == 3}


def test_canonical_hand(spark):
    hands = spark.createDataFrame([(1, 2, 6)], "hand_id long, hero_seat int, max_seats int")
    kind = "hand_id long, ord int, street string, seat int, action_type string, amount_bb double, raise_to double, call_to double, pot_before double, pot_after double"
    acts = [(1, 1, "preflop", 3, "small_blind", 0.5, None, None, 0.0, 0.5), (1, 2, "preflop", 2, "other", 0.0, None, None, 1.5, 1.5), (1, 3, "preflop", 5, "all_in", 0.0, 20.0, None, 1.5, 21.5),
            (1, 4, "flop", 2, "other", 3.0, None, 3.0, 21.5, 24.5)]
    seen = C.visible_sample(C.canonical_actions(hands, spark.createDataFrame(acts, kind)))
    row = C.canonical_hands(hands, seen).first()
    assert [a["action_type"] for a in row["actions"]] == ["raise", "call"]
    assert [a["actor_seat"] for a in row["actions"]] == [3, 2]
    assert row["outcome"]["showdown"] is False and row["metadata"]["button_seat"] == 0


def test_private_fields_go_at_every_depth(spark):
    rows = spark.createDataFrame([((1, 1, [(2, True)]),)], "h struct<a:int,label:int,p:array<struct<b:int,is_bot:boolean>>>")
    assert C.strip_private(rows).schema.simpleString() == "struct<h:struct<a:int,p:array<struct<b:int>>>>"


def test_windows_and_prefixes(spark):
    chunks = spark.createDataFrame([(1, 10), (2, 3), (3, 0)], "chunk_id long, n_hands int")
    got = sorted((r["chunk_id"], r["start"], r["stop"]) for r in Q.chunk_windows(chunks, 4, 3, keep_short=True).collect())
    assert got == [(1, 0, 4), (1, 3, 7), (1, 6, 10), (2, 0, 3)]
    lengths = sorted(r["length"] for r in Q.chunk_prefixes(chunks, 4, 3).collect())
    assert lengths == [4, 7, 10]
