"""From JSON files to features, encodings, the canonical view and scores, on hands that are worked out by hand."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import canonical as C
from quillon.operators import encoding as E
from quillon.operators import features as X
from quillon.operators import models as D
from quillon.sources import chunks as K


def action(i, street, seat, kind, amount=0.0, before=0.0, after=0.0, **more):
    return {"action_id": str(i), "street": street, "actor_seat": seat, "action_type": kind, "amount": amount, "normalized_amount_bb": amount / 0.02, "pot_before": before, "pot_after": after, **more}


def hand(actions, *, hero=2, seats=2, players=(1, 2), streets=("preflop",), **meta):
    return {
        "metadata": {"game_type": "Hold'em", "limit_type": "No Limit", "max_seats": seats, "hero_seat": hero, "button_seat": 1, "sb": 0.01, "bb": 0.02, **meta},
        "players": [{"player_uid": f"p{s}", "seat": s, "starting_stack": 2.0 * s, "hole_cards": ["Ah", "Kh"], "showed_hand": True} for s in players],
        "streets": [{"street": s, "board_cards": ["7s"]} for s in streets], "actions": actions, "outcome": {"winners": ["p1"], "total_pot": 1.0, "showdown": True}, "label": "bot",
    }


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("json")
    one = hand([action(2, " Flop ", 2, "RAISE ", 0.08, 0.06, 0.13, raise_to=0.08), action(1, "preflop", 1, "call", 0.02, 0.03, 0.05, call_to=0.02), action(10, "river", None, "check", 0.0, 0.14, 0.14)])
    items = [{"chunk_id": "a", "is_bot": True, "hands": [one, hand([])]}, {"chunk_id": "b", "label": "human", "hands": [hand([action(1, "preflop", 1, "fold")], streets=())]}, {"chunk_id": "c", "hands": [one]}, {"chunk_id": "d"}]
    with gzip.open(folder / "x.json.gz", "wt") as f:
        json.dump(items, f)
    return K.read_chunks(spark, f"file://{folder}").persist(), f"file://{folder}"


def test_features_of_a_file(chunks):
    rows, _ = chunks
    got = {r["hand_id"]: r for r in X.hand_features(K.hands_of(rows), K.actions_rows(rows)).collect()}
    h = got["a#0"]
    assert h["num_actions"] == 3 and h["num_streets_observed"] == 3 and h["reached_flop"] == 1 and h["raise_ratio"] == pytest.approx(1 / 3)
    assert h["hero_action_ratio"] == pytest.approx(1 / 3) and h["raise_to_missing_ratio"] == 0 and got["a#1"]["num_actions"] == 0
    vectors = X.chunk_vectors(rows.select("chunk_id"), X.hand_features(K.hands_of(rows), K.actions_rows(rows)))
    assert vectors.count() == 3 and {"a", "b", "c"} == {r["chunk_id"] for r in vectors.collect()}


def test_neighbours_without_a_seat_are_one_actor(spark, tmp_path):
    acts = [action(1, "preflop", None, "fold"), action(2, "preflop", None, "call"), action(3, "preflop", 1, "check")]
    (tmp_path / "f.json").write_text(json.dumps([{"id": "x", "label": 1, "hands": [hand(acts)]}]))
    rows = K.read_chunks(spark, f"file://{tmp_path}")
    h = X.hand_features(K.hands_of(rows), K.actions_rows(rows)).first()
    assert h["same_actor_consecutive_ratio"] == pytest.approx(1 / 3) and h["acted_after_fold_ratio"] == pytest.approx(1 / 3)


def test_encoding_by_hand(chunks):
    rows, _ = chunks
    hands, acts, players, streets = K.hands_of(rows), K.actions_rows(rows), K.players_of(rows), K.streets_of(rows)
    got = {(r["hand_id"], r["ord"]): r for r in E.encoded_actions(hands, acts, players).collect()}
    a, b, c = (got["a#0", i] for i in (1, 2, 3))
    assert (a["amount_bucket"], a["pot_flow"], a["first_in_street"], a["actor_role"], a["street_position"]) == (3, 2, 2, 2, 1)
    assert (b["amount_bucket"], b["pot_flow"], b["actor_role"]) == (7, 3, 3) and (c["amount_bucket"], c["pot_flow"], c["actor_role"]) == (1, 1, 1)
    assert b["street"] == "flop" and b["action_type"] == "raise" and b["is_aggressive_action"] == 1 and b["street_progress"] == 0.5
    assert b["amount_bb_scaled"] == pytest.approx(math.log1p(4) / math.log1p(200)) and b["pot_delta_bb_signed"] == pytest.approx(3.5 / 200)
    assert b["actor_stack_bb_scaled"] == pytest.approx(1.0) and b["amount_to_actor_stack"] == pytest.approx(0.02) and b["raise_to_pot"] == pytest.approx(0.08 / 0.06 / 10)
    assert a["actor_seat_norm"] == 0.5 and c["actor_seat_norm"] == 0 and a["has_call_to"] == 1 and a["has_raise_to"] == 0 and b["action_order_norm"] == 0.5
    meta = {r["hand_id"]: r for r in E.hand_meta(hands, acts, players, streets).collect()}
    m = meta["a#0"]
    assert m["hero_stack_log"] == pytest.approx(math.log1p(200)) and m["actors"] == 0.2 and m["hero_share"] == pytest.approx(1 / 3) and m["hand_end"] == 4
    assert meta["a#1"]["hand_end"] == 1 and meta["a#1"]["hero_share"] == 0 and meta["b#0"]["streets_dealt"] == 0
    coded = E.encoded_hands(E.with_ids(E.encoded_actions(hands, acts, players), E.fit_vocabularies(acts)), E.hand_meta(hands, acts, players, streets))
    told = {r["hand_id"]: r for r in coded.collect()}
    assert told["a#1"]["cat"] == [[0] * 8] and len(told["a#0"]["num"]) == 3 and len(told["a#0"]["num"][0]) == 22 and len(told["a#0"]["hand_meta"]) == 8
    assert [x[0] for x in told["a#0"]["cat"]] == [2, 3, 4]  # streets in order of first appearance
    steps = {r["hand_id"]: r["steps"] for r in E.step_encoding(hands, acts).collect()}
    assert steps["a#0"][1]["ids"] == [5, 2, 1, 3] and "a#1" not in steps


@pytest.mark.parametrize(("seats", "want"), [(2, [2, 3]), (3, [2, 3, 4]), (6, [2, 3, 4, 5, 6, 7]), (9, [2, 3, 4, 5, 5, 6, 6, 7, 7])])
def test_roles_around_a_table(spark, seats, want):
    from quillon.functions.scalars import actor_role

    rows = spark.range(1, seats + 1).select(actor_role("id", F.lit(1), F.lit(seats)).alias("r"), "id").orderBy("id").collect()
    assert [r["r"] for r in rows] == want


def view(spark, tmp_path, h):
    (tmp_path / "v.json").write_text(json.dumps([{"id": "x", "label": 1, "hands": [h]}]))
    rows = K.read_chunks(spark, f"file://{tmp_path}")
    hands, acts = K.hands_of(rows), K.actions_rows(rows)
    seen = C.visible_sample(C.canonical_actions(hands, acts.withColumn("amount_bb", F.col("amount")), bb=0.02))
    return C.canonical_hands(hands, seen, acts, K.players_of(rows), K.streets_of(rows)).first()


def test_the_hero_keeps_a_seat(spark, tmp_path):
    v = view(spark, tmp_path, hand([action(1, "preflop", 1, "call", 0.02, 0.03, 0.05)]))
    assert v["metadata"]["hero_seat"] == 2 and v["metadata"]["max_seats"] == 6 and v["metadata"]["button_seat"] == 0
    assert [(p["player_uid"], p["seat"], p["hole_cards"], p["showed_hand"]) for p in v["players"]] == [("seat_1", 1, None, False), ("seat_2", 2, None, False)]
    assert [p["starting_stack"] for p in v["players"]] == [2.0, 4.0] and [s["street"] for s in v["streets"]] == ["preflop"] and v["streets"][0]["board_cards"] == []
    assert v["outcome"]["showdown"] is False and v["outcome"]["winners"] == [] and v["outcome"]["payouts"] == {}


def test_idle_actions_of_no_kind_go_and_a_single_one_repeats(spark, tmp_path):
    acts = [action(1, "preflop", 1, "other", 0.0, 0.03, 0.03), action(2, "preflop", 2, "other", 0.1, 0.03, 0.13, call_to=0.1)]
    v = view(spark, tmp_path, hand(acts))
    assert len(v["actions"]) == 12 and {a["action_type"] for a in v["actions"]} == {"call"} and [a["action_id"] for a in v["actions"]] == [str(i) for i in range(1, 13)]
    assert "label" not in v.asDict()


def test_blinds_go_and_an_all_in_is_a_raise(spark, tmp_path):
    acts = [action(1, "preflop", 1, "small_blind", 0.01, 0, 0.01), action(2, "preflop", 2, "big_blind", 0.02, 0.01, 0.03), action(3, "preflop", 1, "all_in", 1.0, 0.03, 1.03, raise_to=1.0)]
    acts.append(action(4, "preflop", 2, "fold", 0.0, 1.03, 1.03))
    v = view(spark, tmp_path, hand(acts))
    assert [a["action_type"] for a in v["actions"]] == ["raise", "fold"] and v["actions"][0]["raise_to"] > 0


def test_aliases_follow_actions_then_players_then_numbers(spark):
    hands = spark.createDataFrame([(1, 3, 6)], "hand_id long, hero_seat int, max_seats int")
    acts = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, None), (1, 4, 2)], "hand_id long, ord int, seat int")
    players = spark.createDataFrame([(1, 0, 6, 1.0), (1, 1, 2, 1.0)], "hand_id long, nth int, seat int, stack double")
    assert {r["seat"]: r["alias"] for r in C.seat_alias_map(hands, acts, players).collect()} == {5: 1, 2: 2, 6: 3, 1: 4, 3: 5, 4: 6}


def test_scores_without_a_model_by_hand(spark):
    hands = spark.createDataFrame([("c", 1, 4, True), ("c", 2, 0, False)], "chunk_id string, hand_id long, n_players int, showdown boolean")
    acts = spark.createDataFrame([(1, k) for k in ("call", "check", "raise", "fold", "small_blind", "big_blind")], "hand_id long, action_type string")
    streets = spark.createDataFrame([(1, 0, "flop"), (1, 1, "turn")], "hand_id long, nth int, street string")
    one = 0.32 * 2 / 3 + 0.22 + 0.18 * 0.25 / 0.35 + 0.12 * 0.25 / 0.30 + 0.08 * 0.5 - 0.18 * 0.25 / 0.55 - 0.10
    assert C.heuristic_scores(hands, acts, streets).first()["score"] == pytest.approx(one / 2)


def test_defaults_of_typed_hands(spark, tmp_path):
    h = {"players": None, "streets": [{"name": "turn"}], "actions": [{"id": 7, "amount": None}], "outcome": {"hand_result_reason": "fold"}, "label": "AI"}
    (tmp_path / "f.json").write_text(json.dumps([{"id": "x", "label": 1, "hands": [h]}]))
    got = K.decoded(K.read_chunks(spark, f"file://{tmp_path}")).first()["hands"][0]
    a = got["actions"][0]
    assert (a["action_id"], a["street"], a["actor_seat"], a["action_type"], a["amount"], a["raise_to"]) == ("7", "preflop", 0, "", 0.0, None)
    assert got["metadata"]["hero_seat"] == 0 and got["metadata"]["bb"] == 0.0 and got["players"] == [] and got["streets"][0]["street"] == "turn"
    assert got["outcome"]["result_reason"] == "fold" and got["outcome"]["showdown"] is False and got["label_flag"] is True


def test_loaders(spark, chunks, tmp_path):
    _, path = chunks
    raw, told = K.load_samples(spark, path, mode="raw"), K.load_samples(spark, path)
    assert {r["chunk_id"]: r["label"] for r in raw.collect()} == {"a": 1, "b": 0, "c": -1} and {r["chunk_id"] for r in told.collect()} == {"a", "b"}
    items = [{"id": str(i), "label": i % 2, "hands": [hand([])]} for i in range(60)]
    (tmp_path / "all.json").write_text(json.dumps(items))
    split = {r["chunk_id"]: r["split"] for r in K.load_benchmark(spark, f"file://{tmp_path}", ratio=0.3).collect()}
    assert len(split) == 60 and set(split.values()) == {"train", "validation"}
    (tmp_path / "all.json").write_text(json.dumps({"train": items[:50], "validation": items[50:]}))
    split = {r["chunk_id"]: r["split"] for r in K.load_benchmark(spark, f"file://{tmp_path}").collect()}
    assert sum(v == "validation" for v in split.values()) == 10
    (tmp_path / "all.json").write_text("[]")
    with pytest.raises(ValueError):
        K.load_benchmark(spark, f"file://{tmp_path}")


def test_a_promoted_model_comes_back_whole(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("chunk_id"), (F.col("id") % 2).cast("double").alias("y"), ((F.col("id") % 2) * 0.5 + (F.col("id") % 7) / 10).alias("a"), (F.col("id") % 5 / 5).alias("b"))
    model = D.train(rows, ["a", "b"], D.learners(1)["linear"])
    calibrator = D.fit_calibrator(D.score(model, rows))
    served = D.Served(["a", "b"], {"linear": model}, None, calibrator)
    path = f"file://{tmp_path}/m"
    assert D.load_served(spark, path) is None and D.promote(served, path, {"reward": 0.9, "fpr": 0.01}, 3)
    again = D.load_served(spark, path)
    assert again.names == ["a", "b"] and again.calibrator == calibrator
    first, second = (sorted(map(tuple, D.predict_chunks(s, rows).collect())) for s in (served, again))
    assert first == second and any(abs(r[1] - r[2]) > 1e-3 for r in first)
    other = rows.select("chunk_id", F.lit(1.0).alias("other")).where("chunk_id < 100")
    mixed = {r["chunk_id"]: r["raw"] for r in D.predict_chunks(served, rows, blend=other).collect()}
    plain = {r[0]: r[1] for r in first}
    assert mixed[4] == pytest.approx(0.6 * plain[4] + 0.4) and mixed[150] == pytest.approx(plain[150])
    with pytest.raises(ValueError):
        D.predict_chunks(served, rows.drop("b"))


def test_whole_chunk_vector_against_a_loop(spark, tmp_path):
    acts = [
        [action(1, "preflop", 1, "raise", 0.06, 0.03, 0.09), action(2, "preflop", 2, "call", 0.04, 0.09, 0.13), action(3, " Flop", 2, "check", 0.0, 0.13, 0.13), action(4, "flop", 1, "bet", 0.4, 0.13, 0.53)],
        [action(1, "", 1, "small blind", 0.01), action(2, "preflop", None, "fold")], [],
    ]
    hands = [hand(acts[0], streets=("preflop", "turn"), seats=6), hand(acts[1], hero=4, seats=0, players=(1, 3)), hand(acts[2], players=(), streets=())]
    hands[0]["actions"][1]["normalized_amount_bb"] = 0.0  # its amount is in money then
    hands[1]["players"][0] |= {"hole_cards": [], "showed_hand": False, "starting_stack": 0}
    hands[2]["outcome"] = {}
    (tmp_path / "g.json").write_text(json.dumps([{"id": "x", "label": 1, "hands": hands}, {"id": "y", "label": 0, "hands": [hand([], players=())]}]))
    rows = K.read_chunks(spark, f"file://{tmp_path}")
    chunks = rows.select("chunk_id").unionByName(spark.createDataFrame([("none",)], "chunk_id string"))
    out = X.table_features(chunks, K.hands_of(rows), K.actions_rows(rows), K.players_of(rows), K.streets_of(rows))
    got = {r["chunk_id"]: r for r in out.collect()}
    assert len(out.columns) == 52 and len(set(out.columns)) == 52 and all(v == 0 for v in got["none"][1:])

    def log(x, cap=200.0):
        return min(math.log1p(x) / math.log1p(cap), 1)

    def entropy(counts, most):
        return -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts) / math.log(most)

    r = next(v for k, v in got.items() if k not in ("none",) and v["num_hands_scaled"] == pytest.approx(log(3, 32)))
    sizes, pots = [3, 2, 20, 0.5], [1.5, 4.5, 4.5, 6.5, 6.5, 6.5, 6.5, 26.5]
    mean = sum(sizes) / 4
    std = math.sqrt(sum((x - mean) ** 2 for x in sizes) / 4)
    want = {
        "avg_actions_per_hand_scaled": log(2, 64), "avg_players_norm": (2 + 2 + 0) / 3 / 9, "avg_occupied_ratio": (2 / 6 + 2 / 4 + 0) / 3, "showdown_rate": 2 / 3,
        "fold_rate": 1 / 5, "bet_raise_rate": 2 / 5, "blind_rate": 1 / 6, "money_action_rate": 4 / 6, "zero_amount_rate": 2 / 6, "aggression_to_passive": 1 / 5,
        "preflop_action_rate": 4 / 6, "postflop_action_rate": 2 / 6, "street_coverage": (3 / 4 + 1 / 4 + 0) / 3,
        "action_entropy_norm": entropy([1] * 6, 12), "street_entropy_norm": entropy([4, 2], 4), "actor_entropy_norm": entropy([3, 2, 1], 9),
        "mean_amount_bb_scaled": log(mean), "std_amount_bb_scaled": log(std), "max_amount_bb_scaled": log(20), "mean_pot_bb_scaled": log(sum(pots) / 8), "max_pot_bb_scaled": log(26.5),
        "pot_increase_rate": 3 / 6, "mean_amount_to_pot": (0.2 + 0.04 / 0.09 / 10 + 0.4 / 0.13 / 10) / 3,
        "mean_stack_bb_scaled": log((100 + 200 + 300) / 3), "min_stack_bb_scaled": log(100), "max_stack_bb_scaled": 1.0, "stack_spread_bb_scaled": log(200), "short_stack_rate": 0.0, "deep_stack_rate": 3 / 4,
        "hero_present_rate": 1 / 3, "button_present_rate": 2 / 3, "visible_hole_card_rate": 3 / 4, "showed_hand_rate": 3 / 4, "action_signature_top_share": 1 / 3, "action_signature_unique_share": 1.0,
        "low_action_entropy_hand_rate": 1 / 3, "high_aggression_hand_rate": 1 / 3, "amount_cv": std / mean / 3, "actor_switch_rate": (2 / 3 + 1) / 2, "max_actor_run_norm": (2 / 4 + 1 / 2) / 2,
        "max_action_type_run_norm": (1 / 4 + 1 / 2) / 2, "long_action_hand_rate": 0.0,
    }
    assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-6)
