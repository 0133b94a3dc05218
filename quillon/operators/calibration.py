"""A chain of monotone calibration steps: quantile spread, isotonic regression, a sigmoid around a cut, a logit shift.

No step reorders scores, so the ranking part of the reward is the same for all candidates and only the rates at the cut
that becomes one half have to be looked up: every search is one curve, not one pass per candidate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import clamp, grid_interpolate, logit, sigmoid
from quillon.operators import metrics as M

KNOTS = 256
# The grids that are searched, and the anchors among the cuts.
HUMAN_QUANTILES = [0.40 + (0.995 - 0.40) * i / 23 for i in range(24)]
BOT_QUANTILES = [0.005 + (0.60 - 0.005) * i / 19 for i in range(20)]
ANCHORS = (0.05, 0.08, 0.10, 0.15, 0.20, 0.25, 0.30)
REMAP_TEMPERATURE = 0.12
BIASES = (-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
CONFORMAL_STEPS = (0.0, 0.25, 0.5, 1.0, 1.5)
SHIFT_TEMPERATURE = 0.6
MOST_BIAS = 5.0


@dataclass(frozen=True)
class Chain:
    """The fitted steps; a step that is None (or a bias of 0 at temperature 1) changes nothing. Among temperatures, which
    move no score over one half, the first of the grid is taken."""

    spread: list[float] | None = None
    isotonic: list[float] | None = None
    threshold: float | None = None
    temperature: float = REMAP_TEMPERATURE
    bias: float = 0.0
    shift_temperature: float = 1.0

    @property
    def is_identity(self) -> bool:
        return self.spread is None and self.isotonic is None and self.threshold is None and abs(self.bias) < 1e-12 and abs(self.shift_temperature - 1) < 1e-12

    def column(self, score: Column) -> Column:
        x = clamp(score)
        for grid in (self.spread, self.isotonic):
            if grid is not None:
                x = clamp(grid_interpolate(x, F.array(*map(F.lit, grid)), KNOTS - 1))
        if self.threshold is not None:
            x = sigmoid((clamp(x, 1e-6, 1 - 1e-6) - self.threshold) / max(self.temperature, 1e-6))
        if abs(self.bias) >= 1e-12 or abs(self.shift_temperature - 1) >= 1e-12:
            x = sigmoid((logit(x) + self.bias) / max(self.shift_temperature, 1e-6))
        return x

    def apply(self, scored: DataFrame) -> DataFrame:
        return scored.withColumn("score", self.column(F.col("score")))


def _spread(scored: DataFrame, blend: float) -> list[float] | None:
    """Mostly the share of scores at or below each knot, the rest the knot itself; from one count per knot."""
    s = clamp("score")
    up = F.ceil(s * (KNOTS - 1))
    knot = F.when((up > 0) & (s <= (up - 1) / F.lit(float(KNOTS - 1))), up - 1).otherwise(up).cast("int")
    rows = scored.where(~F.isnan("score") & (F.abs("score") < float("inf")))
    facts = rows.agg(F.count(F.lit(1)), F.max("score") - F.min("score")).first()
    if facts[0] < 8 or facts[1] < 1e-9:
        return None
    counts = np.zeros(KNOTS)
    for r in rows.groupBy(knot.alias("knot")).count().collect():  # at most one row a knot
        counts[r["knot"]] = r["count"]
    even = np.linspace(0, 1, KNOTS)
    values = np.maximum.accumulate(blend * np.cumsum(counts) / facts[0] + (1 - blend) * even) + np.linspace(0, 1e-6, KNOTS)
    return [float(x) for x in np.clip(values, 0, 1)]


def _isotonic(scored: DataFrame, blend: float) -> list[float]:
    model = IsotonicRegression(featuresCol="score", labelCol="y").fit(scored.select("score", F.col("y").cast("double").alias("y")))
    even = np.linspace(0, 1, KNOTS)
    values = np.clip(np.interp(even, model.boundaries.toArray(), model.predictions.toArray()), 0, 1)
    return [float(x) for x in (1 - blend) * values + blend * even]


def _best(scored: DataFrame, cuts: list[float], max_fpr: float, *, lowest: bool) -> float | None:
    """The admissible cut of best reward, then recall; of equal ones the lowest or highest. None if one half is as good."""
    spark = scored.sparkSession
    table = spark.createDataFrame([(float(c),) for c in sorted({*cuts, 0.5})], "score double")
    found = {r["cut"]: (r["reward"], r["recall"]) for r in M.best_cut(scored, table, max_fpr).collect()}  # a row a candidate
    keys = {c: found[c] for c in cuts if c in found}
    if not keys:
        return None
    best = max(keys.values())
    if 0.5 in found and found[0.5] >= best:
        return None
    return (min if lowest else max)(c for c, k in keys.items() if k == best)


def fit_chain(
    scored: DataFrame, *, use_spread: bool = True, use_isotonic: bool = True, spread_blend: float = 0.9, identity_blend: float = 0.05, target_fpr: float = 0.04, max_fpr: float = 0.05
) -> Chain:
    """Fit the steps one after the other on a calibration table (score, y). With one class only nothing is changed."""
    classes = scored.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if not (classes[0] and classes[1]):
        return Chain()
    spread = _spread(scored, spread_blend) if use_spread else None
    isotonic = _isotonic(Chain(spread).apply(scored), identity_blend) if use_isotonic else None
    shaped = Chain(spread, isotonic).apply(scored)
    cuts = M.quantile_values(shaped.where("y = 0"), HUMAN_QUANTILES) + M.quantile_values(shaped.where("y = 1"), BOT_QUANTILES) + list(ANCHORS)
    threshold = _best(shaped, sorted(set(cuts)), max_fpr, lowest=True)
    remapped = Chain(spread, isotonic, threshold)
    moved = remapped.apply(scored)
    high = min(max(M.quantile_values(moved.where("y = 0"), [1 - min(max(target_fpr, 1e-4), 0.5)])[0], 1e-6), 1 - 1e-6)
    conformal = max(-MOST_BIAS, min(MOST_BIAS, -math.log(high / (1 - high))))
    biases = {1 / (1 + math.exp(b)): b for b in sorted({*BIASES, *(conformal + d for d in CONFORMAL_STEPS)})}
    cut = _best(moved, list(biases), max_fpr, lowest=False)
    if cut is None:
        return remapped
    return Chain(spread, isotonic, threshold, REMAP_TEMPERATURE, biases[cut], SHIFT_TEMPERATURE)
