"""The detector on learned embeddings, against plain Python."""

import math
import statistics

import numpy as np
import pytest
from compare import assert_same

import __spark_entry__ as entry
from quillon import bindings as B
from quillon.operators import embedding as E
from quillon.operators import metrics as M

ACTION = "hand_id long, ord int, action_type string, street string, amount_bb double"


def chain(hand, kinds):
    return [(hand, i, k, "flop", 3.0) for i, k in enumerate(kinds)]


def made(spark, n=60):
    """Two kinds of chunks with the same actions in the same numbers; only their order tells them apart."""
    hands, actions, labels = [], [], []
    for c in range(n):
        labels.append((c, c % 2))
        for h in range(3):
            hand = c * 10 + h
            hands.append((c, hand))
            actions += chain(hand, ["call", "raise"] * 4 if c % 2 else ["call"] * 4 + ["raise"] * 4)
    hands.append((1000, 99_999))  # a chunk whose only hand has no action
    return (
        spark.createDataFrame(hands, "chunk_id long, hand_id long"),
        spark.createDataFrame(actions, ACTION),
        spark.createDataFrame([(c, float(c // 2 % 5)) for c, _ in labels], "chunk_id long, size double"),
        spark.createDataFrame(labels, "chunk_id long, y int"),
    )


def test_pairs_against_sql(spark, sf):
    assert_same(spark, sf, entry.queries()["action_word_pairs"], entry.oracle_sql()["action_word_pairs"])


def test_words_of_odd_actions(spark):
    rows = [(1, 1, None, None, None), (1, 2, " RAISE ", "River", 0.0), (1, 3, "muck", "attic", -1.0), (2, 1, "fold", "flop", 1e9)]
    got = {(r["hand_id"], r["ord"]): (r["word"], r["before"]) for r in E.action_words(spark.createDataFrame(rows, ACTION)).collect()}
    raised = (5 * 6 + 4) * E.BUCKETS
    assert got == {(1, 1): (0, None), (1, 2): (raised, 0), (1, 3): (0, raised), (2, 1): ((6 + 2) * E.BUCKETS + E.BUCKETS - 1, None)}
    assert all(0 <= w < E.WORDS for w, _ in got.values())


def test_vectors_give_back_the_information(spark, sf):
    """With all dimensions, the product of two vectors is the pair's positive information."""
    pairs = E.word_pairs(E.action_words(B.actions(spark, sf)))
    v = E.fit_words(pairs, dimensions=E.WORDS)
    before, after = np.array(v.before), np.array(v.after)
    n = {(r["before"], r["word"]): r["n"] for r in pairs.collect()}
    total = sum(n.values())
    first, second = {}, {}
    for (a, b), k in n.items():
        first[a], second[b] = first.get(a, 0) + k, second.get(b, 0) + k
    for (a, b), k in n.items():
        assert before[a] @ after[b] == pytest.approx(max(0.0, math.log(k * total / first[a] / second[b])), abs=1e-8)
    assert E.fit_words(pairs, dimensions=4).before == E.fit_words(pairs.repartition(3), dimensions=4).before


def test_embedding_against_plain_python(spark, sf):
    hands, words = B.hands(spark, sf), E.action_words(B.actions(spark, sf))
    v = E.fit_words(E.word_pairs(words), dimensions=3)
    chunks = B.table(spark, sf, "customer").selectExpr("c_custkey AS chunk_id").unionAll(spark.range(-1, 0).toDF("chunk_id"))
    per = {}
    for r in words.orderBy("hand_id", "ord").collect():
        pair = [0.0] * 3 if r["before"] is None else [x * y for x, y in zip(v.before[r["before"]], v.after[r["word"]], strict=True)]
        per.setdefault(r["hand_id"], []).append([*v.after[r["word"]], *pair])
    means = {}
    for r in hands.collect():
        if r["hand_id"] in per:
            means.setdefault(r["chunk_id"], []).append([statistics.fmean(c) for c in zip(*per[r["hand_id"]], strict=True)])
    got = E.chunk_embedding(chunks, hands, words, v).collect()
    assert len(got) == chunks.count() and any(r["chunk_id"] not in means for r in got)
    for r in got:
        columns = list(zip(*means.get(r["chunk_id"], [[0.0] * 6]), strict=True))
        want = [*map(statistics.fmean, columns), *map(statistics.pstdev, columns)]
        assert list(r)[1:] == pytest.approx(want, abs=1e-9)


def test_detector_learns_order_and_scores_one_as_many(spark, tmp_path):
    hands, actions, features, labels = made(spark)
    detector = E.fit_embedded(hands, actions, features, labels, ["size", "unknown"])
    chunks = hands.select("chunk_id").distinct()
    rows = {r["chunk_id"]: r for r in detector.predict(chunks, hands, actions, features).collect()}
    assert len(rows) == 61 and all(0 <= r["raw"] <= 1 and 0 <= r["score"] <= 1 for r in rows.values())
    scored = spark.createDataFrame([(c % 2, rows[c]["score"]) for c in range(60)], "y int, score double")
    assert M.ranking(scored, []).first()["auc"] == 1.0
    assert [rows[c]["flagged"] for c in (0, 1)] == [False, True]
    for c in (0, 1, 1000):
        assert detector.predict_one(c, hands, actions, features) == rows[c]["score"]
    assert detector.predict_one(5_000, hands, actions, features) == 0.5
    path = f"file://{tmp_path}/detector"
    assert E.load_embedded(spark, path) is None
    assert not E.save_embedded(detector, spark, path, {"reward": 0.1, "fpr": 0.0}, 1)
    assert E.load_embedded(spark, path) is None
    assert E.save_embedded(detector, spark, path, {"reward": 0.9, "fpr": 0.0}, 2)
    again = E.load_embedded(spark, path).predict(chunks, hands, actions, features).collect()
    assert {r["chunk_id"]: r for r in again} == rows


def test_detector_without_rows(spark):
    hands, actions, features, labels = made(spark, 20)
    detector = E.fit_embedded(hands, actions, features, labels, ["size"])
    assert detector.predict(hands.select("chunk_id").limit(0), hands, actions, features).count() == 0
    assert detector.predict(hands.select("chunk_id").distinct(), hands, actions.limit(0), features).count() == 21
    assert E.fit_words(E.word_pairs(E.action_words(actions.limit(0)))).before[0] == [0.0] * E.DIMENSIONS


def test_query_over_all_chunks(spark, sf):
    got = entry.queries()["embedded_detector"](spark, sf).collect()
    assert len(got) == B.table(spark, sf, "customer").count()
    assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got}) > 5
