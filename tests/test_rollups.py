"""Roll-ups on small tables worked out by hand."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from quillon.functions.python_json import float_text, json_text
from quillon.operators import rollups as R


def test_json_is_what_python_writes(spark):
    rng = random.Random(6)
    text = lambda: "".join(rng.choice(['"', "\\", "/", "a", " ", "\n", "\t", "\b", "\f", "\r", "\x00", "\x1f", "\x7f", "é", "日", "\U0001f600", "~"]) for _ in range(rng.randint(0, 8)))
    number = lambda: rng.choice([0.0, -0.0, 1.0, -1.5, 1e-5, 1e-4, 0.1 + 0.2, 1e16, 1e15, 123456789012345680.0, 1e22, 1e-7, float("nan"), float("inf"), -float("inf"), 2.0**-44, 2.0**60 + 2**9, rng.random() * 10 ** rng.randint(-12, 18), round(rng.random() * 1000, 2)])
    maybe = lambda f: None if rng.random() < 0.15 else f()
    rows = [{"b": maybe(number), "a": maybe(text), "Z": rng.choice([True, False, None]), "list": maybe(lambda: [maybe(number) for _ in range(rng.randint(0, 3))]), "in": maybe(lambda: {"y": maybe(text), "x": rng.randint(-(2**62), 2**62)}), "m": maybe(lambda: {text(): maybe(number) for _ in range(3)}), "note": maybe(text)} for _ in range(600)]
    kind = "b double, a string, Z boolean, list array<double>, in struct<y:string,x:long>, m map<string,double>, note string"
    df = spark.createDataFrame([tuple(r[k] if k != "in" or r[k] is None else (r[k]["y"], r[k]["x"]) for k in ("b", "a", "Z", "list", "in", "m", "note")) for r in rows], kind)
    got = [r[0] for r in df.select(json_text(F.struct("*"), df.schema, optional=frozenset({"note"}))).collect()]
    for r, g in zip(rows, got, strict=True):
        want = {k: v for k, v in r.items() if k != "note" or v is not None}
        assert g == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def test_numbers_are_pythons_over_their_range(spark):
    rng = random.Random(2)
    values = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-11, 18) for _ in range(60_000)] + [2.0**k for k in range(-39, 63)] + [float(rng.getrandbits(63)) for _ in range(5000)]
    values = [v for v in values if 1e-12 < abs(v) < 9.2e18]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", float_text(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == [repr(r["x"]) for r in got]


def test_fingerprints_of_chunks_are_pythons(spark):
    hands = {"a": [{"x": 1.5, "y": "é"}, {"x": None, "y": ""}], "b": [{"x": 1e-5, "y": None}]}
    df = spark.createDataFrame([(k, i, r["x"], r["y"]) for k, v in hands.items() for i, r in enumerate(v)], "k string, i int, x double, y string")
    told = df.repartition(3).select("k", "i", json_text(F.struct("x", "y"), df.select("x", "y").schema).alias("payload"))
    got = {r["k"]: r["fingerprint"] for r in R.fingerprints(told, ["k"], "i").collect()}
    assert got == {k: hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for k, v in hands.items()}


def test_a_digest_depends_on_content_and_order_alone(spark):
    rows = [("a", 2, "y"), ("a", 1, "x"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "y"), ("c", 2, "x")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    got = {r["k"]: r["digest"] for r in R.content_digest(df.repartition(3), ["k"], "o", ["v"]).collect()}
    one = lambda v: hashlib.sha256(f'{{"v":"{v}"}}'.encode()).hexdigest()
    assert got["a"] == got["b"] == hashlib.sha256(f"{one('x')}\n{one('y')}".encode()).hexdigest() != got["c"]
    assert R.distinct_ids(df, ["k"], F.col("v"), "ids").where("ids <> array('x', 'y')").count() == 0


def test_owners_and_their_scores(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "uid int, owner string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (5, "e")], "uid int, owner string")
    states = R.owner_states(old, new, "uid", "owner")
    assert {r["uid"]: r["state"] for r in states.collect()} == {1: "same", 2: "reset", 3: "same", 4: "gone", 5: "new"}
    scores = spark.createDataFrame([(1, 0.5), (2, 0.7), (4, 0.1)], "uid int, s double")
    assert {r["uid"]: r["s"] for r in R.reset_scores(scores, states, "uid", "s").collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 5: 0.0}


def test_admission_views_and_gates(spark):
    rows = spark.createDataFrame([(1, True, 5.0), (2, False, 9.0), (3, None, 1.0), (4, True, None)], "uid int, permit boolean, stake double")
    allowed = spark.createDataFrame([(1,), (2,), (4,), (4,), (None,)], "uid int")
    assert {r["uid"]: r["priority"] for r in R.admitted(rows, allowed, "uid", permit="permit", stake="stake").collect()} == {1: 5.0, 4: 0.0}
    nested = spark.sql("SELECT 1 AS id, 'secret' AS evidence, named_struct('a', 1, 'b', 2) AS s")
    assert R.public_view(nested, ["evidence", "s.b"]).first().asDict(True) == {"id": 1, "s": {"a": 1}}
    batches = spark.createDataFrame([(1, True, 30), (2, None, 99), (3, True, 5), (4, True, None)], "b int, ok boolean, n_hands int")
    assert [r["b"] for r in R.gated(batches, F.col("ok"), 30).collect()] == [1]


def test_lists_and_sources_that_lack_a_key(spark):
    rows = spark.createDataFrame([("x", 0, 7), ("x", 1, 8), ("y", 0, 9)], "k string, i long, own int")
    lists = spark.createDataFrame([("x", [70]), ("z", [1])], "k string, items array<int>")
    assert sorted((r["k"], r["i"], r["ref"]) for r in R.by_position(rows, lists, "k", "i", "items", "own", "ref").collect()) == [("x", 0, 70), ("x", 1, 8), ("y", 0, 9)]
    report = R.set_report(spark.createDataFrame([("x", "a"), ("x", "z"), ("y", "a"), ("y", "b")], "k string, v string"), "k", "v", required=["a", "b"], wanted=["b", "c"])
    assert {r["k"]: (r["has_all"], r["absent"], r["shared"]) for r in report.collect()} == {"x": (False, ["b", "c"], []), "y": (True, ["c"], ["b"])}
    board = R.leaderboard(rows.select("k").distinct(), [lists.select("k", F.lit(3).alias("n"))], "k", defaults={"n": 0})
    assert {r["k"]: r["n"] for r in board.collect()} == {"x": 3, "y": 0}
