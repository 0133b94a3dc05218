"""Splits, samples, quantiles, averages and the calibration chain against plain Python."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import labels as G
from quillon.operators import board as L
from quillon.operators import calibration as K
from quillon.operators import features as X
from quillon.operators import metrics as M
from quillon.operators import sequences as Q
from quillon.sources import sinks


def test_stratified_split_against_sorting(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None])) for i in range(3000)]
    got = {r["k"]: r["split"] for r in G.stratified_split(spark.createDataFrame(rows, "k long, c string"), "k", "c", 0.2, 44).collect()}
    for c in ("a", "b", None):
        mine = sorted((k for k, x in rows if x == c), key=lambda k: hashlib.sha256(f"{k}:44".encode()).hexdigest())
        cut = round(0.2 * len(mine))
        assert {k for k in mine if got[k] == "validation"} == set(mine[:cut])


@pytest.mark.parametrize("n", [10, 500, 40_000])
def test_bootstrap_draws_as_many_as_asked_for(spark, n):
    drawn = G.bootstrap(spark.range(1000), n, "id", 5)
    total = drawn.count()
    assert abs(total - n) < 5 * n**0.5 + 1 and sorted(map(tuple, drawn.collect())) == sorted(map(tuple, G.bootstrap(spark.range(1000), n, "id", 5).collect()))
    assert G.bootstrap(spark.range(0), n, "id", 5).count() == 0


@pytest.mark.parametrize("cycle", [1, 2, 3, 7, 50])
def test_rotating_page_goes_round(spark, cycle):
    rows = spark.range(23).select((F.col("id") * 7 % 23).alias("uid"))
    start = (cycle - 1) * 10 % 23
    assert {r["uid"] for r in L.rotating_page(rows, "uid", cycle, 10).collect()} == {(start + i) % 23 for i in range(10)}
    assert L.rotating_page(rows, "uid", cycle, 40).count() == 23


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.random(500), np.repeat(0.25, 100), [0.0, 1.0]])
    probabilities = [0.0, 0.01, 0.25, 0.3, 0.5, 0.977, 1.0]
    got = M.quantile_values(spark.createDataFrame([(float(v),) for v in values], "score double"), probabilities)
    assert got == pytest.approx(np.quantile(values, probabilities).tolist())
    assert M.quantile_values(spark.createDataFrame([], "score double"), [0.5]) == []


def test_a_missed_cycle_ages_an_average(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (1, 3, 1.0), (2, 1, 1.0)], "uid int, cycle int, r double")
    got = {r["uid"]: r["e"] for r in Q.ema(rows, ["uid"], "cycle", "r", 0.5, "e", cycles=spark.range(1, 5).select(F.col("id").cast("int").alias("cycle"))).collect()}
    assert got == {1: 0.5 * 0.125 + 0.5 * 0.5, 2: 0.5 * 0.125}


def test_most_drifted_and_writers(spark, tmp_path):
    report = spark.createDataFrame([(f"f{i:02d}", float(i % 30)) for i in range(60)], "feature string, psi double")
    top = [r["feature"] for r in M.most_drifted(report).collect()]
    assert len(top) == 25 and top[:3] == ["f29", "f59", "f28"]
    sinks.write_metrics({"reward": 0.5, "fpr": 0.01}, f"file://{tmp_path}/m", spark)
    assert json.loads(next((tmp_path / "m").glob("part-*")).read_text()) == {"reward": 0.5, "fpr": 0.01}
    grams = spark.createDataFrame([(1, i, n, g) for i, (n, g) in enumerate([(1, "a"), (1, "c"), (1, "a"), (1, "b"), (2, "a|b"), (7, "x")])], "hand_id long, pos int, n int, gram string")
    vocabulary = X.gram_vocabulary(grams, {1: 2, 2: 5})
    sinks.write_vocabulary(vocabulary, f"file://{tmp_path}/v")
    assert [tuple(r) for r in sinks.read_vocabulary(spark, f"file://{tmp_path}/v").orderBy("n", "rank").collect()] == [(1, 1, "a", 2), (1, 2, "c", 1), (2, 1, "a|b", 1)]  # of b and c, c was seen first
    assert sinks.read_vocabulary(spark, f"file://{tmp_path}/none").count() == 0


def rates(score, y, cut):
    flagged = score > cut
    return (flagged & (y == 0)).sum() / max((y == 0).sum(), 1), (flagged & (y == 1)).sum() / max((y == 1).sum(), 1)


def test_the_chain_of_calibration(spark):
    """Each step against numpy; the fitted chain is monotone, keeps the ceiling, and no candidate is better."""
    rng = np.random.default_rng(7)
    y = (rng.random(600) < 0.4).astype(int)
    raw = np.clip(0.35 + 0.1 * y + 0.08 * rng.standard_normal(600), 0, 1).round(3)
    scored = spark.createDataFrame([(i, int(a), float(s)) for i, (a, s) in enumerate(zip(y, raw, strict=True))], "id int, y int, score double")
    even = np.linspace(0, 1, 256)
    spread = K._spread(scored, 0.9)
    want = np.clip(0.9 * np.searchsorted(np.sort(raw), even, side="right") / len(raw) + 0.1 * even + np.linspace(0, 1e-6, 256), 0, 1)
    assert spread == pytest.approx(want.tolist(), abs=1e-9)
    chain = K.fit_chain(scored)
    out = {r["id"]: r["score"] for r in chain.apply(scored).collect()}
    new = np.array([out[i] for i in range(600)])
    order = np.argsort(raw, kind="stable")
    assert (np.diff(new[order]) >= -1e-12).all() and not chain.is_identity and chain.threshold is not None
    fpr, recall = rates(new, y, 0.5)
    assert fpr < 0.05
    # the best any single cut of the raw scores can do under the ceiling
    best = max(rates(raw, y, c)[1] * 0.35 * (1 - rates(raw, y, c)[0]) ** 2 for c in np.unique(raw) if rates(raw, y, c)[0] < 0.05)
    assert recall * 0.35 * (1 - fpr) ** 2 > 0.6 * best and recall > 0.1
    assert K.fit_chain(scored.where("y = 1")).is_identity
    assert K._spread(scored.limit(5), 0.9) is None


def test_drift_is_exact_on_hot_and_skewed_values(spark):
    """One value in a third of the rows, a long tail, ties on the edges, an empty side: as numpy has it."""
    rng = np.random.default_rng(4)
    e = np.concatenate([np.zeros(700), rng.lognormal(0, 4, 1200), np.repeat(3.0, 101)])
    a = np.concatenate([np.zeros(300), rng.lognormal(1, 3, 900), [1e12, -5.0]])
    rows = lambda x: spark.createDataFrame([(float(v), 1.0) for v in x] + [(None, 1.0)], "x double, flat double")
    got = {r["feature"]: r for r in M.drift(rows(e), rows(a), ["x", "flat"]).collect()}
    edges = np.unique(rows(e).agg(F.percentile("x", [i / 10 for i in range(11)])).first()[0])
    share = lambda v, n: np.maximum(np.histogram(v, edges)[0] / n, 1e-6)
    p, q = share(e, len(e) + 1), share(a, len(a) + 1)  # the null counts in neither bin, but in the sample
    assert got["x"]["psi"] == pytest.approx(float(((q - p) * np.log(q / p)).sum()), rel=1e-9)
    grid = np.sort(np.concatenate([e, a]))
    ks = np.abs(np.searchsorted(np.sort(e), grid, "right") / (len(e) + 1) - np.searchsorted(np.sort(a), grid, "right") / (len(a) + 1)).max()
    assert got["x"]["ks"] == pytest.approx(ks, rel=1e-9) and (got["flat"]["psi"], got["flat"]["js"]) == (0.0, 0.0)
    values = spark.createDataFrame([("k", float(v)) for v in e], "k string, v double").groupBy("k", "v").count().withColumnRenamed("count", "w")
    cuts = spark.createDataFrame([("k", [float(np.quantile(e, i / 8)) for i in range(1, 8)], len(e))], "k string, cuts array<double>, n long")
    ranked = M.ranked_values(values, "k", "v", ["w"], cuts)
    probabilities = [0.0, 0.1, 0.333, 0.35, 0.5, 0.999, 1.0]
    assert M.exact_quantiles(ranked, "k", "v", "w", cuts, probabilities).first()["quantiles"] == pytest.approx(np.quantile(e, probabilities).tolist())


def test_folds_and_exact_splits(spark):
    rows = spark.range(1003).select("id", F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 7 == 0, None).otherwise("b").alias("c"))
    sizes = [r["count"] for r in G.equal_folds(rows, "id", "c", 4, 9).groupBy("c", "fold").count().where("c = 'b'").collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    assert G.permutation_split(rows, "id", 0.2, 9).where("split = 'validation'").count() == 201
    assert G.permutation_split(rows.limit(1), "id", 0.2, 9).first()["split"] == "validation"


def test_a_matrix_has_labels_only_if_all_are_told(spark):
    v = spark.createDataFrame([(1, 1.0, float("nan")), (2, None, float("inf")), (3, -2.0, 3.0)], "chunk_id int, a double, b double")
    some, all_ = ([(1, 0), (2, 1)], [(1, 0), (2, 1), (3, 1)])
    m, told = X.feature_matrix(v, spark.createDataFrame(all_, "chunk_id int, label int"), ["b", "zz", "a"])
    assert told and m.columns == ["chunk_id", "b", "zz", "a", "y"] and sorted(map(tuple, m.collect())) == [(1, 0.0, 0.0, 1.0, 0), (2, 0.0, 0.0, 0.0, 1), (3, 3.0, 0.0, -2.0, 1)]
    m, told = X.feature_matrix(v, spark.createDataFrame(some, "chunk_id int, label int"), ["a"])
    assert not told and m.where("y is not null").count() == 0 and m.count() == 3
    assert X.feature_matrix(v.limit(0), spark.createDataFrame(all_, "chunk_id int, label int"), ["a"])[1] is False


def test_releases_are_taken_up_once(spark, tmp_path):
    path, kind = f"file://{tmp_path}/r", "hash string, source_date string, n int"
    read = lambda: sorted((r["hash"], str(r["source_date"]), r["n"]) for r in spark.read.json(f"{path}/releases").collect())
    assert sinks.write_releases(spark.createDataFrame([("a", "2026-01-01", 1), ("b", "2026-01-01", 2), ("a", "2026-01-01", 1), (None, "2026-01-01", 0)], kind), path) == 2
    more = spark.createDataFrame([("c", "2026-01-01", 9), ("a", "2026-01-02", 3), ("d", "2026-01-02", 4)], kind)  # a date that is there is not written again, a hash that was seen not at all
    assert sinks.write_releases(more, path) == 1 and sinks.write_releases(more, path) == 0
    assert read() == [("a", "2026-01-01", 1), ("b", "2026-01-01", 2), ("d", "2026-01-02", 4)]
    assert {r["hash"] for r in sinks.current(spark, f"{path}/_seen", "hash string, source_date string").collect()} == {"a", "b", "d"}
