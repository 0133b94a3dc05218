"""Classifiers over chunk features: training, stacking, calibration, scoring, promotion."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.labels import equal_folds
from quillon.functions.scalars import grid_interpolate, remap
from quillon.operators import metrics as M
from quillon.sources.shared import kept

STEPS = 255


@dataclass(frozen=True)
class Calibrator:
    """An even grid over [0, 1] and the cut that becomes one half."""

    grid: list[float]
    cut: float

    def column(self) -> Column:
        inner = F.greatest(F.lit(0.0), F.least(F.lit(1.0), grid_interpolate("score", F.array(*map(F.lit, self.grid)), STEPS)))
        return F.round(remap(inner, F.lit(self.cut)), 6)

    def apply(self, scored: DataFrame) -> DataFrame:
        return scored.withColumn("score", self.column())


def learners(seed: int) -> dict[str, object]:
    """The base learners that Spark has for the ensemble."""
    return {
        "trees": GBTClassifier(labelCol="y", maxIter=12, maxDepth=4, stepSize=0.2, seed=seed),
        "forest": RandomForestClassifier(labelCol="y", numTrees=30, maxDepth=6, seed=seed),
        "linear": LogisticRegression(labelCol="y", regParam=0.05, maxIter=50),
    }


def train(rows: DataFrame, names: list[str], learner=None, *, seed: int = 44) -> PipelineModel:
    """Fit a learner on the columns ``names`` and the label y."""
    assemble = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assemble, learner or learners(seed)["trees"]]).fit(rows)


def score(model: PipelineModel, rows: DataFrame, name: str = "score") -> DataFrame:
    """``rows`` with the probability of the positive class."""
    out = model.transform(rows)
    return out.select(*rows.columns, vector_to_array("probability")[1].alias(name))


def out_of_fold(rows: DataFrame, names: list[str], key: str, *, k: int = 3, seed: int = 44, only: tuple[str, ...] | None = None) -> DataFrame:
    """key, y and each base learner's score (of ``only``: those named) by the models that did not see the row; folds are of
    equal size by class."""
    base = {n: x for n, x in learners(seed).items() if only is None or n in only}
    # dealing reads the rows several times, and every learner many times over, so both are worked out once and written
    folded = kept(equal_folds(kept(rows.select(key, "y", *names), "rows"), key, "y", k, seed), "folds")
    parts = []
    for fold in range(k):
        held = folded.where(F.col("fold") == fold)
        for name, learner in base.items():
            held = score(train(folded.where(F.col("fold") != fold), names, learner), held, name)
        parts.append(held.select(key, "y", *base))
    return reduce(DataFrame.unionByName, parts)


def stack(rows: DataFrame, names: list[str], key: str, *, k: int = 3, seed: int = 44) -> tuple[dict[str, PipelineModel], PipelineModel, DataFrame]:
    """(base models on all rows, logistic model over their scores, the out-of-fold scores it was fitted on)."""
    oof = out_of_fold(rows, names, key, k=k, seed=seed)
    base = {n: train(rows, names, learner) for n, learner in learners(seed).items()}
    return base, train(oof, list(base), LogisticRegression(labelCol="y", regParam=0.01)), oof


def score_stack(base: dict[str, PipelineModel], meta: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    out = rows
    for n, m in base.items():
        out = score(m, out, n)
    return score(meta, out).select(*rows.columns, "score")


def compare_blends(oof: DataFrame, a: str, b: str, *, share: float = 0.6, margin: float = 1e-3) -> DataFrame:
    """name, ap, auc, reward, fpr of four arms over out-of-fold scores: both scores, their blend, and a logistic regression on
    both. Every arm is calibrated by its own scores before its reward counts. ``chosen`` is the better of blend and stack
    if its reward beats that of ``a`` by the margin, else ``a``."""
    oof = kept(oof.select("y", a, b), "arms")  # the models that score a row are not run again by every pass
    meta = train(oof, [a, b], LogisticRegression(labelCol="y", regParam=0.0, maxIter=1000))
    forms = {a: F.col(a), b: F.col(b), "blend": share * F.col(a) + (1 - share) * F.col(b), "stack": F.col("__stack")}
    each = F.array(*(F.struct(F.lit(i).alias("arm"), c.alias("score")) for i, c in enumerate(forms.values())))
    # all that follows is of the scores' counts, which are made once, and of all arms in the same passes
    arms = kept(M.tallies(score(meta, oof, "__stack").select("y", F.inline(each)), ["arm"]), "tallies")
    calibrators = fit_calibrators(arms, "arm", [*range(len(forms))])
    calibrated = arms.withColumn("score", _by_arm("arm", {i: c.column() for i, c in calibrators.items()}))
    told = M.ranking(arms, ["arm"], counted="n").join(M.reward(calibrated, ["arm"], counted="n").select("arm", "reward", "fpr"), "arm")
    by_arm = {r["arm"]: r for r in told.collect()}  # a row an arm
    found = {n: by_arm[i] for i, n in enumerate(forms)}
    best = max(("blend", "stack"), key=lambda n: (found[n]["reward"], n == "blend"))
    winner = best if found[best]["reward"] - found[a]["reward"] > margin else a
    rows = [(n, x["ap"], x["auc"], x["reward"], x["fpr"], n == winner) for n, x in found.items()]
    return oof.sparkSession.createDataFrame(rows, "name string, ap double, auc double, reward double, fpr double, chosen boolean")


def importances(model: PipelineModel, names: list[str]) -> dict[str, float]:
    """Importances of a tree model, or absolute coefficients, summing to one."""
    last = model.stages[-1]
    raw = (last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray()
    total = sum(map(abs, raw)) or 1.0
    return {n: abs(float(v)) / total for n, v in zip(names, raw, strict=True)}


def top_features(importance: dict[str, float], k: int) -> list[str]:
    """The k most important features, in their original order."""
    best = set(sorted(importance, key=lambda n: (-importance[n], n))[:k])
    return [n for n in importance if n in best]


def _by_arm(arm: str, columns: dict[int, Column]) -> Column:
    """The column of each row's arm."""
    return reduce(lambda x, i: x.when(F.col(arm) == i, columns[i]), columns, F)


def fit_calibrators(
    counted: DataFrame, arm: str, arms: list[int], *, target_fpr: float = 0.04, max_fpr: float = 0.05, blend: float = 0.05
) -> dict[int, Calibrator]:
    """A calibrator for each arm of ``counted`` (arm, score, y, n: see ``tallies``). Isotonic regression on an even grid, a
    little of the identity mixed in so that the order stays strict, then the cut of best reward among score quantiles under
    the false-positive ceiling, else the conformal quantile. The cuts of all arms are searched in the same passes."""
    import numpy as np

    even, grids = np.linspace(0, 1, STEPS + 1), {}
    regression = IsotonicRegression(featuresCol="score", labelCol="y", weightCol="n")
    for i in arms:
        model = regression.fit(counted.where(F.col(arm) == i).select("score", F.col("y").cast("double").alias("y"), F.col("n").cast("double").alias("n")))
        knots, values = model.boundaries.toArray(), model.predictions.toArray()
        grid = (1 - blend) * np.clip(np.interp(even, knots, values), 0, 1) + blend * even
        grids[i] = [float(x) for x in grid]
    inner = counted.withColumn("score", _by_arm(arm, {i: grid_interpolate("score", F.array(*map(F.lit, g)), STEPS) for i, g in grids.items()}))
    cuts = M.quantile_candidates(inner, keys=(arm,), counted="n")
    cuts = cuts.sparkSession.createDataFrame(cuts.collect(), cuts.schema)  # a few rows an arm, which are read twice
    best = M.best_cut(inner, cuts, max_fpr, keys=(arm,), counted="n").groupBy(arm).agg(F.max(F.struct("reward", "recall", (-F.col("cut")).alias("low"))).alias("b"))
    found = {r[arm]: -r["b"]["low"] for r in best.collect()}
    for i in arms:
        if i not in found:
            found[i] = M.conformal_cut(inner.where(F.col(arm) == i), target_fpr, counted="n").first()["cut"] or 0.5
    return {i: Calibrator(grids[i], float(found[i])) for i in arms}


def fit_calibrator(scored: DataFrame, *, target_fpr: float = 0.04, max_fpr: float = 0.05, blend: float = 0.05) -> Calibrator:
    """The calibrator of one table of scores: see ``fit_calibrators``."""
    counted = M.tallies(scored, []).withColumn("arm", F.lit(0)).persist()  # the models that score a row are not run again by every pass
    try:
        return fit_calibrators(counted, "arm", [0], target_fpr=target_fpr, max_fpr=max_fpr, blend=blend)[0]
    finally:
        counted.unpersist()


@dataclass(frozen=True)
class Served:
    """What serving needs: the model or the stack's parts, the features in order, the calibrator."""

    names: list[str]
    base: dict[str, PipelineModel]
    meta: PipelineModel | None = None
    calibrator: Calibrator | None = None


def predict_chunks(served: Served, rows: DataFrame, *, blend: DataFrame | None = None, share: float = 0.6, key: str = "chunk_id") -> DataFrame:
    """key, raw (the model's or stack's score; with ``blend`` (key, other) ``share`` of it and the rest of that score) and
    score (calibrated, six decimals). A chunk that ``blend`` lacks keeps its own score."""
    missing = [c for c in served.names if c not in rows.columns]
    if missing:
        raise ValueError(f"features are missing: {missing[:5]}")
    scored = score_stack(served.base, served.meta, rows, key) if served.meta else score(next(iter(served.base.values())), rows)
    out = scored.select(key, F.col("score").alias("raw"))
    if blend is not None:
        out = out.join(blend.select(key, "other"), key, "left").withColumn("raw", F.coalesce(share * F.col("raw") + (1 - share) * F.col("other"), F.col("raw"))).drop("other")
    out = out.withColumn("score", F.col("raw"))
    return served.calibrator.apply(out) if served.calibrator else out.withColumn("score", F.round("score", 6))


def promote(
    model: PipelineModel | Served, path: str, metrics: dict[str, float], version: int, *, least_reward: float = 0.55, max_fpr: float = 0.05, names: list[str] | None = None
) -> bool:
    """Save a model, with all that serving needs, as a new version if its metrics pass the gate; older versions stay for
    going back. The version counts once its description is there, which is written last."""
    if metrics["reward"] < least_reward or metrics["fpr"] > max_fpr:
        return False
    served = model if isinstance(model, Served) else Served(names or [], {"model": model})
    folder = f"{path}/v={version:012d}"
    for n, m in served.base.items():
        m.write().overwrite().save(f"{folder}/base/{n}")
    if served.meta:
        served.meta.write().overwrite().save(f"{folder}/meta")
    told = {"names": served.names, "base": list(served.base), "stacked": served.meta is not None, "metrics": metrics, "calibrator": asdict(served.calibrator) if served.calibrator else None}
    SparkSession.active().createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/served")
    return True


def newest_version(spark, path: str) -> str | None:
    """The folder of the newest promoted version, None if there is none."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/served/_SUCCESS")
    found = marker.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marker) or []
    return max((x.getPath().getParent().getParent().toString() for x in found), default=None)


def load_served(spark, path: str) -> Served | None:
    """The newest promoted version with its features and calibrator, None if there is none."""
    folder = newest_version(spark, path)
    if folder is None:
        return None
    told = json.loads(spark.read.text(f"{folder}/served").first()["value"])
    base = {n: PipelineModel.load(f"{folder}/base/{n}") for n in told["base"]}
    return Served(told["names"], base, PipelineModel.load(f"{folder}/meta") if told["stacked"] else None, Calibrator(**told["calibrator"]) if told["calibrator"] else None)


def load_latest(spark, path: str) -> PipelineModel | None:
    """The model of the newest promoted version (of a stack the first base model), None if there is none."""
    served = load_served(spark, path)
    return next(iter(served.base.values())) if served else None
