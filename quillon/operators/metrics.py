"""Ranking and classification metrics, threshold search, calibration grids, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import ratio, remap
from quillon.sources.shared import kept

BUCKETS = 1024
MAX_FPR = 0.10


def _count_if(cond: Column, counted: str | None) -> Column:
    return F.count_if(cond) if counted is None else F.coalesce(F.sum(F.when(cond, F.col(counted))), F.lit(0))


def tallies(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, y, n: how many rows have a score and a label. The metrics take it for the rows with ``counted`` n."""
    return scored.groupBy(*keys, "score", "y").agg(F.count(F.lit(1)).alias("n"))


def _points(scored: DataFrame, keys: list[str], thresholds: DataFrame | None, counted: str | None) -> tuple[DataFrame, DataFrame]:
    """Per key and distinct score pos and n; per key and score bucket the sums of the buckets above, bn and the totals.

    Counted rows hardly shrink by one more count, so they are dealt by bucket alone, where they are counted and summed; the
    buckets of their few keys are broadcast."""
    named = [*keys, "score", "pos", "n"]
    bucket = F.floor(F.col("score") * BUCKETS)
    if counted is None:
        at = scored.groupBy(*keys, "score").agg(F.sum("y").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    else:
        at = scored.select(*keys, "score", (F.col("y") * F.col(counted)).cast("double").alias("pos"), F.col(counted).cast("double").alias("n"))
    if thresholds is not None:
        at = at.unionByName(thresholds.select(*keys, F.col("score").cast("double").alias("score"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("n")))
    added = [F.sum("pos").alias("pos"), F.sum("n").alias("n")]
    if counted is not None:
        rows = at.select(*named, bucket.alias("bucket"))
        at = rows.repartition(*keys, "bucket").groupBy(*keys, "bucket", "score").agg(*added)
    else:
        at = rows = (at.groupBy(*keys, "score").agg(*added) if thresholds is not None else at).withColumn("bucket", bucket)
    sums = rows.groupBy(*keys, "bucket").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    over = Window.partitionBy(*keys).orderBy(F.col("bucket").desc())
    above, whole = over.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    zero = F.lit(0.0)
    sums = sums.select(
        *keys, "bucket", F.coalesce(F.sum("bp").over(above), zero).alias("ap"), F.coalesce(F.sum("bn").over(above), zero).alias("an"),
        "bn", F.sum("bp").over(whole).alias("total_pos"), F.sum("bn").over(whole).alias("total"),
    )
    return at, sums if counted is None else F.broadcast(sums)


def _running(at: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    inside = Window.partitionBy(*keys, "bucket").orderBy(F.col("score").desc())
    at = at.join(sums, [*keys, "bucket"])
    return at.select(
        *keys, "bucket", "score", "pos", "n", (F.col("ap") + F.sum("pos").over(inside)).alias("tp"), (F.col("an") + F.sum("n").over(inside)).alias("seen"), "total_pos", "total"
    )


def curve(scored: DataFrame, keys: list[str], *, thresholds: DataFrame | None = None, counted: str | None = None) -> DataFrame:
    """Per key and distinct score: pos and n at the score, tp and seen at or above it, total_pos and total.

    Rows are counted per score first. The running sums are taken within score buckets, to which the sums of the
    higher buckets (at most ``BUCKETS`` + 1 rows a key) are added, so no task sorts all scores. ``thresholds`` (keys, score)
    adds points without rows. A row stands for as many as its column ``counted`` says, if one is named.
    """
    return _running(*_points(scored, keys, thresholds, counted), keys).drop("bucket")


def ranking(scored: DataFrame, keys: list[str], *, counted: str | None = None) -> DataFrame:
    """Per key: ap (steps over groups of equal scores) and auc (rank sum with halves for ties); 0 without positives."""
    return _ranked(curve(scored, keys, counted=counted), keys)


def _ranked(c: DataFrame, keys: list[str]) -> DataFrame:
    precision = F.try_divide("tp", "seen")  # a point without rows adds nothing, also above all scores
    negatives_below = (F.col("total") - F.col("total_pos")) - (F.col("seen") - F.col("tp"))
    won = F.col("pos") * (negatives_below + (F.col("n") - F.col("pos")) / 2)
    return c.groupBy(*keys).agg(
        F.coalesce(F.sum(F.try_divide("pos", "total_pos") * precision), F.lit(0.0)).alias("ap"),
        F.coalesce(F.try_divide(F.sum(won), F.first("total_pos") * (F.first("total") - F.first("total_pos"))), F.lit(0.0)).alias("auc"),
    )


def confusion(keys: list[str], scored: DataFrame, flagged: Column, *, counted: str | None = None) -> DataFrame:
    y = F.col("y") == 1
    cells = {"tp": flagged & y, "fp": flagged & ~y, "tn": ~flagged & ~y, "fn": ~flagged & y}
    return scored.groupBy(*keys).agg(*(_count_if(c, counted).alias(k) for k, c in cells.items()))


def decide(score: str = "score", boundary: float | None = None) -> Column:
    """Flagged at or above the boundary; without one by rounding half to even, so that 0.5 is not flagged."""
    return F.rint(score) == 1 if boundary is None else F.col(score) >= boundary


def reward(scored: DataFrame, keys: list[str], *, boundary: float | None = None, counted: str | None = None) -> DataFrame:
    """Per key: fpr, bot_recall, ap_score, human_safety_penalty, base_score, reward. The penalty is (1 - fpr)^2, and
    everything is lost from a false-positive rate of one tenth on."""
    m = confusion(keys, scored, decide(boundary=boundary), counted=counted)
    r = ranking(scored, keys, counted=counted)
    m = m.join(r, keys) if keys else m.join(F.broadcast(r))
    m = m.withColumns({"fpr": ratio("fp", F.greatest(F.col("tn") + F.col("fp"), F.lit(1))), "bot_recall": ratio("tp", F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))})
    m = m.withColumn("human_safety_penalty", F.when(F.col("fpr") >= MAX_FPR, 0.0).otherwise(F.pow(1 - F.col("fpr"), F.lit(2.0))))
    m = m.withColumn("base_score", 0.65 * F.col("ap") + 0.35 * F.col("bot_recall"))
    return m.select(
        *keys, "fpr", "bot_recall", F.col("ap").alias("ap_score"), "human_safety_penalty", "base_score", (F.col("base_score") * F.col("human_safety_penalty")).alias("reward")
    )


def losses(scored: DataFrame, keys: list[str]) -> DataFrame:
    p = F.greatest(F.lit(1e-15), F.least(F.col("score"), F.lit(1 - 1e-15)))
    return scored.groupBy(*keys).agg(
        F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"), F.avg(F.pow(F.col("score") - F.col("y"), F.lit(2.0))).alias("brier")
    )


def scoring_only_metrics(scored: DataFrame, keys: list[str], *, boundary: float | None = None) -> DataFrame:
    """Per key what scores tell without labels: count, their range, mean and population deviation (0 of none), and how many
    are flagged. Without keys there is one row, also of no scores."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    flagged = F.count_if(decide(boundary=boundary))
    n = F.count("score")
    return scored.groupBy(*keys).agg(
        n.alias("count"), zero(F.min("score")).alias("score_min"), zero(F.max("score")).alias("score_max"), zero(F.avg("score")).alias("score_mean"), zero(F.stddev_pop("score")).alias("score_std"),
        flagged.alias("pred_bot"), (n - flagged).alias("pred_human"), zero(flagged / F.nullif(n, F.lit(0))).alias("pred_bot_rate"),
    )


def safe_metrics(scored: DataFrame, keys: list[str], *, boundary: float | None = None) -> DataFrame:
    """Per key all metrics of labelled scores: class counts, score statistics, accuracy, precision, recall and F1 of bots (0
    where undefined), the confusion matrix, and roc_auc, pr_auc, log_loss, brier (null unless both classes occur)."""
    flag, bot = decide(boundary=boundary), F.col("y") == 1
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("score")))
    base = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(~bot).alias("human_count"), F.count_if(bot).alias("bot_count"),
        zero(F.min("score")).alias("score_min"), zero(F.max("score")).alias("score_max"), zero(F.avg("score")).alias("score_mean"), zero(F.stddev_pop("score")).alias("score_std"),
        F.avg(F.when(~bot, F.col("score"))).alias("human_score_mean"), F.avg(F.when(bot, F.col("score"))).alias("bot_score_mean"),
        F.count_if(~bot & ~flag).alias("tn"), F.count_if(~bot & flag).alias("fp"), F.count_if(bot & ~flag).alias("fn"), F.count_if(bot & flag).alias("tp"),
        F.avg(-F.log(F.when(bot, clipped).otherwise(1 - clipped))).alias("ll"), F.avg(F.pow(F.col("score") - F.col("y"), F.lit(2.0))).alias("br"),
    )
    curve_ = ranking(scored, keys).select(*keys, F.col("auc").alias("__auc"), F.col("ap").alias("__ap"))
    both = (F.col("human_count") > 0) & (F.col("bot_count") > 0)
    joined = base.join(curve_, keys, "left") if keys else base.join(F.broadcast(curve_), how="left")
    part = lambda a, b: zero(F.col(a) / F.nullif(b, F.lit(0)))
    return joined.select(
        *keys, "count", "human_count", "bot_count", "score_min", "score_max", "score_mean", "score_std", "human_score_mean", "bot_score_mean",
        zero((F.col("tn") + F.col("tp")) / F.nullif("count", F.lit(0))).alias("accuracy"), part("tp", F.col("tp") + F.col("fp")).alias("precision_bot"), part("tp", F.col("tp") + F.col("fn")).alias("recall_bot"),
        zero(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f1_bot"), "tn", "fp", "fn", "tp",
        F.when(both, F.col("__auc")).alias("roc_auc"), F.when(both, F.col("__ap")).alias("pr_auc"), F.when(both, F.col("ll")).alias("log_loss"), F.when(both, F.col("br")).alias("brier"),
    )


def score_range(scored: DataFrame, keys: list[str]) -> DataFrame:
    """How far the classes lie apart: human_prob_max, bot_prob_min, gap, and the scores' range."""
    m = scored.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("y") == 0, F.col("score"))), F.lit(0.0)).alias("human_prob_max"),
        F.coalesce(F.min(F.when(F.col("y") == 1, F.col("score"))), F.lit(0.0)).alias("bot_prob_min"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.avg("score").alias("score_mean"),
    )
    return m.withColumn("gap", F.col("bot_prob_min") - F.col("human_prob_max"))


def best_threshold(scored: DataFrame, grid: DataFrame) -> DataFrame:
    """The threshold of best F1 among the grid and all scores; then by accuracy, then the smallest. No cross join:
    every threshold is a point of the curve."""
    c = curve(scored, [], thresholds=grid)
    fp, fn = F.col("seen") - F.col("tp"), F.col("total_pos") - F.col("tp")
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + fp + fn)
    accuracy = (F.col("total") - fp - fn) / F.col("total")
    best = c.agg(F.max(F.struct(f1.alias("f1"), accuracy.alias("accuracy"), (-F.col("score")).alias("low"))).alias("b"))
    return best.select((-F.col("b.low")).alias("threshold"), F.col("b.f1").alias("f1"), F.col("b.accuracy").alias("accuracy"))


def best_cut(scored: DataFrame, candidates: DataFrame, max_fpr: float, *, keys: tuple[str, ...] = (), counted: str | None = None) -> DataFrame:
    """Reward of every candidate cut (keys, score): remapping is monotone, so the ranking part is the same for all and only
    the confusion at the cut changes. Returns keys, cut, fpr, recall, reward of the admissible ones."""
    every = curve(scored, [*keys], thresholds=candidates, counted=counted)
    ap = _ranked(every, [*keys]).select(*keys, "ap")
    c = every.join(candidates.select(*keys, F.col("score").cast("double").alias("score")).distinct(), [*keys, "score"])
    # a remapped score of exactly one half is not flagged, so the rows at the cut are left out
    tp, seen = F.col("tp") - F.col("pos"), F.col("seen") - F.col("n")
    c = (c.join(ap, [*keys]) if keys else c.join(F.broadcast(ap))).select(
        *keys, F.col("score").alias("cut"), ratio(seen - tp, F.greatest(F.col("total") - F.col("total_pos"), F.lit(1.0))).alias("fpr"),
        ratio(tp, F.greatest(F.col("total_pos"), F.lit(1.0))).alias("recall"), "ap",
    )
    penalty = F.when(F.col("fpr") >= MAX_FPR, 0.0).otherwise(F.pow(1 - F.col("fpr"), F.lit(2.0)))
    return c.where(F.col("fpr") < max_fpr - 1e-9).select(*keys, "cut", "fpr", "recall", ((0.65 * F.col("ap") + 0.35 * F.col("recall")) * penalty).alias("reward"))


def quantiles(scored: DataFrame, probabilities: list[float], *, keys: tuple[str, ...] = (), counted: str | None = None) -> DataFrame:
    """keys, p and score of the linearly interpolated quantiles of the column score. They are read off the curve, whose running
    sums no task takes over all scores: a distinct score stands for the ranks from the rows below it on. The ranks that are
    asked for are told to their score buckets, whose sums say which they hold, so a score is only compared with those of its
    own bucket."""
    at, sums = _points(scored.withColumn("y", F.lit(0)), [*keys], None, counted)
    place = lambda p: (F.col("total") - 1) * F.lit(float(p))
    wanted = [F.struct(F.lit(float(p)).alias("p"), (place(p) - F.floor(place(p))).alias("__share"), F.lit(k).alias("__side"), F.least(F.floor(place(p)) + k, F.col("total") - 1).alias("__rank")) for p in probabilities for k in (0, 1)]
    end = F.col("total") - F.col("an")
    asked = sums.select(*keys, "bucket", F.inline(F.filter(F.array(*wanted), lambda w: (w["__rank"] >= end - F.col("bn")) & (w["__rank"] < end))))
    c = _running(at, sums, [*keys]).select(*keys, "bucket", "score", (F.col("total") - F.col("seen")).alias("low"), "n")
    hits = c.join(F.broadcast(asked), [*keys, "bucket"]).where((F.col("__rank") >= F.col("low")) & (F.col("__rank") < F.col("low") + F.col("n")))
    ends = hits.groupBy(*keys, "p").agg(F.max("__share").alias("share"), F.max(F.when(F.col("__side") == 0, F.col("score"))).alias("a"), F.max(F.when(F.col("__side") == 1, F.col("score"))).alias("b"))
    return ends.select(*keys, "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("score"))


def quantile_values(scored: DataFrame, probabilities: list[float]) -> list[float]:
    """The quantiles as a list (of as many numbers as asked for); empty for an empty table."""
    found = {r["p"]: r["score"] for r in quantiles(scored, probabilities).collect()}
    return [found[float(p)] for p in probabilities if float(p) in found]


def quantile_candidates(scored: DataFrame, low: float = 0.40, high: float = 0.999, n: int = 80, *, keys: tuple[str, ...] = (), counted: str | None = None) -> DataFrame:
    """Distinct quantiles of the scores at ``n`` even steps."""
    return quantiles(scored, [low + (high - low) * i / (n - 1) for i in range(n)], keys=keys, counted=counted).select(*keys, "score").distinct()


def conformal_cut(scored: DataFrame, target_fpr: float, *, counted: str | None = None) -> DataFrame:
    """The quantile of human scores above which the target share lies; null without humans."""
    return quantiles(scored.where("y = 0"), [1 - target_fpr], counted=counted).agg(F.max("score").alias("cut"))


def remapped(scored: DataFrame, cut: float) -> DataFrame:
    return scored.withColumn("score", remap("score", F.lit(cut)))


# ---------------------------------------------------------------- drift
def _long(rows: DataFrame, names: list[str], side: str) -> DataFrame:
    return rows.select(F.lit(side).alias("side"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in names))).alias("x")).select("side", "x.*")


#: Pieces into which a feature's values are dealt by approximate quantiles, and the sketch's accuracy.
PIECES, ACCURACY = 128, 1280


def _linear(ranks: Column, position: Column) -> Column:
    """The value at a position between two ranks, of a map from rank to value."""
    low, high = F.floor(position), F.ceil(position)
    a, b = (F.element_at(ranks, k.cast("long")) for k in (low, high))
    return F.when((low == high) | (a == b), a).otherwise((high - position) * a + (position - low) * b)


def ranked_values(values: DataFrame, key: str, value: str, weights: list[str], cuts: DataFrame) -> DataFrame:
    """``values`` (a row for every distinct value of a key, with its weights) with ``<weight>_to``: the sum of the weight up to
    and with the value. ``cuts`` (key, cuts) deals the values into pieces, by a mergeable sketch; sums run within pieces,
    to which the sums of the pieces below are added, so no task holds all values of a key."""
    dealt = values.join(F.broadcast(cuts.select(key, "cuts")), key).withColumn("piece", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    sums = dealt.groupBy(key, "piece").agg(*(F.sum(w).alias(f"{w}_piece") for w in weights))
    below = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "piece", *(F.coalesce(F.sum(f"{w}_piece").over(below), F.lit(0)).alias(f"{w}_below") for w in weights))
    inside = Window.partitionBy(key, "piece").orderBy(value)
    joined = dealt.join(F.broadcast(sums), [key, "piece"])  # at most PIECES rows a key
    return joined.withColumns({f"{w}_to": F.col(f"{w}_below") + F.sum(w).over(inside) for w in weights}).drop("piece", *(f"{w}_below" for w in weights))


def exact_quantiles(ranked: DataFrame, key: str, value: str, weight: str, sizes: DataFrame, probabilities: list[float]) -> DataFrame:
    """key and the linearly interpolated quantiles of the values counted by ``weight``; ``sizes`` has key and n, their number."""
    position = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    needed = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(position(p)).cast("long"), F.ceil(position(p)).cast("long")) for p in probabilities))))
    asked = ranked.where(F.col(weight) > 0).join(F.broadcast(sizes.where("n > 0").select(key, "n", needed.alias("needed"))), key)
    at = F.explode(F.filter("needed", lambda k: (k >= F.col(f"{weight}_to") - F.col(weight)) & (k < F.col(f"{weight}_to"))))
    found = asked.select(key, "n", at.alias("rank"), value).groupBy(key, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("ranks"))
    return found.select(key, F.array(*(_linear(F.col("ranks"), position(p)) for p in probabilities)).alias("quantiles"))


def _kept(small: DataFrame) -> DataFrame:
    """A table of a row for each of the caller's names, worked out now."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def drift(expected: DataFrame, actual: DataFrame, names: list[str], *, bins: int = 10, even_bins: int = 20) -> DataFrame:
    """feature, psi, ks, js, mean_expected, mean_actual of two samples.

    psi: bins between the quantiles of the expected sample, shares at least 1e-6, 0 with fewer than three edges; values
    outside the edges fall in no bin. ks: the largest distance of the two distribution functions. js: the
    Jensen-Shannon distance over even bins of the common range. All are exact: sketches only deal the values out.
    """
    both = _long(expected, names, "e").unionByName(_long(actual, names, "a"))
    is_e = F.col("side") == "e"
    # the samples are read once, to count values: all that follows works on one row per distinct value, and reads it thrice
    values = kept(both.groupBy("feature", "v").agg(F.count_if(is_e).cast("double").alias("e"), F.count_if(~is_e).cast("double").alias("a")), "values")
    cut = F.percentile_approx("v", [i / PIECES for i in range(1, PIECES)], ACCURACY)
    told = lambda w: F.when((F.col(w) > 0) & F.col("v").isNotNull(), F.col(w))
    mean = lambda w: F.try_divide(F.sum(told(w) * F.col("v")), F.sum(told(w)))
    facts = values.groupBy("feature").agg(
        cut.alias("cuts"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.coalesce(F.sum(told("e")), F.lit(0.0)).cast("long").alias("n"),
        F.sum("e").alias("ne"), F.sum("a").alias("na"), mean("e").alias("mean_expected"), mean("a").alias("mean_actual"),
    )
    # facts are a row for each named feature, so they go through the driver; what is read with them stays where it is
    facts = _kept(facts)
    ranked = ranked_values(values.where("v is not null"), "feature", "v", ["e", "a"], facts)
    edges = exact_quantiles(ranked, "feature", "v", "e", facts, [i / bins for i in range(bins + 1)])
    facts = _kept(facts.drop("cuts", "n").join(edges.select("feature", F.array_distinct("quantiles").alias("edges")), "feature", "left"))
    rows = ranked.join(F.broadcast(facts), "feature")
    last = F.size("edges") - 1
    place = F.least(F.size(F.filter("edges", lambda x: x <= F.col("v"))), last)
    inside = (last >= 2) & (F.col("v") >= F.get("edges", F.lit(0))) & (F.col("v") <= F.get("edges", last))
    spread, flat = F.col("hi") - F.col("lo"), F.col("hi") - F.col("lo") < 1e-12
    even = F.least(F.floor((F.col("v") - F.col("lo")) / (F.when(~flat, spread) / even_bins)), F.lit(even_bins - 1)).cast("int")
    distance = F.abs(F.col("e_to") / F.col("ne") - F.col("a_to") / F.col("na"))
    cells = rows.groupBy("feature", F.when(inside, place).alias("bin"), even.alias("even")).agg(F.sum("e").alias("e"), F.sum("a").alias("a"), F.max(distance).alias("d"))

    binned = cells.where("bin is not null").groupBy("feature", "bin").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    every = facts.where("size(edges) > 2").select("feature", "ne", "na", F.explode(F.sequence(F.lit(1), last)).alias("bin"))
    share = lambda c, n: F.greatest(F.coalesce(F.col(c), F.lit(0.0)) / F.greatest(F.col(n), F.lit(1.0)), F.lit(1e-6))
    psi = every.join(binned, ["feature", "bin"], "left").select("feature", share("e", "ne").alias("e"), share("a", "na").alias("a"))
    psi = psi.groupBy("feature").agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))

    counts = cells.where("even is not null").groupBy("feature", F.col("even").alias("bin")).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    grid = facts.where(~flat).select("feature", (F.col("ne") + even_bins * 1e-6).alias("ne"), (F.col("na") + even_bins * 1e-6).alias("na"), F.explode(F.sequence(F.lit(0), F.lit(even_bins - 1))).alias("bin"))
    p = (F.coalesce("e", F.lit(0.0)) + 1e-6) / F.col("ne")
    q = (F.coalesce("a", F.lit(0.0)) + 1e-6) / F.col("na")
    js = grid.join(counts, ["feature", "bin"], "left").select("feature", p.alias("p"), q.alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    js = js.groupBy("feature").agg(F.sqrt(F.sum(F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)) / 2).alias("js"))
    ks = cells.groupBy("feature").agg(F.max("d").alias("ks"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    out = facts.select("feature", "mean_expected", "mean_actual").join(psi, "feature", "left").join(ks, "feature", "left").join(js, "feature", "left")
    return out.select("feature", zero("psi"), zero("ks"), zero("js"), "mean_expected", "mean_actual")


def most_drifted(report: DataFrame, top: int = 25) -> DataFrame:
    """The report's ``top`` features by psi, the largest first, ties by name."""
    return report.orderBy(F.col("psi").desc(), "feature").limit(top)


def salient(rows: DataFrame, key: str, importance: dict[str, float], top: int = 3) -> DataFrame:
    """key, feature, rank, salience: per row the features of largest |z| times normalised importance."""
    names, total = list(importance), sum(importance.values()) or 1.0
    stats = rows.agg(*(F.avg(c).alias(f"{c}__m") for c in names), *(F.stddev_pop(c).alias(f"{c}__s") for c in names))
    z = lambda c: F.abs(F.col(c) - F.col(f"{c}__m")) / F.when(F.col(f"{c}__s") < 1e-6, 1.0).otherwise(F.col(f"{c}__s"))
    told = F.array(*(F.struct((-z(c) * (importance[c] / total)).alias("low"), F.lit(c).alias("feature")) for c in names))
    # a row has few features, so they are ranked within the row: no shuffle
    best = rows.join(F.broadcast(stats)).select(key, F.posexplode(F.slice(F.array_sort(told), 1, top)).alias("i", "x"))
    return best.select(key, "x.feature", (F.col("i") + 1).alias("rank"), (-F.col("x.low")).alias("salience"))
