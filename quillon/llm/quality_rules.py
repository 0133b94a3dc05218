"""Quality rules whose cutoffs are certified on labelled rows: no stratum loses more than a stated share of good texts.

A *setting* gives every rule one of its cutoffs or none. On the labelled texts that pass the base rules, the good ones
that a setting rejects are counted by stratum; the setting is certified there if that count is so low that its exact
binomial (Clopper-Pearson) upper bound stays below ``false_rejection``. The bound's level is ``error`` divided by the
number of settings and of strata (Bonferroni), so with probability 1 - ``error`` every certified setting of every
stratum keeps its promise, and the best of them may be taken: the one that rejects most bad texts less good ones. A
stratum without a certified setting rejects by the base rules alone.

All of it is DataFrame functions. A text is judged within its row, so documents are never shuffled; the statistics are
written once. Labelled rows meet them by doc_id and are then counted by (stratum, label, levels): 4**4 cells at most for
a stratum and label.

Defined results. Null text has no words and fails the base rules. Null stratum is ''. Rows with one doc_id share its
label; a label counts by (stratum, distinct text) once, good if any row of it is; null labels don't count. Null doc_ids
have no label. Empty tables give empty results. Columns of ``docs`` other than those named are not read.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import materialize, scratch

WINDOW = 8
#: What separates words, and what counts as a symbol.
WORDS, SYMBOLS = r"[^\x20\x09-\x0D]+", "#*$%&|<>"
#: Strata whose cutoffs are broadcast; beyond it they are joined with the strata spread over salts.
MOST_BROADCAST, SALTS = 10_000, 64


@dataclass(frozen=True)
class Rule:
    """Rejects where 1000 * ``part`` > cutoff * ``whole``; cutoffs from lax to tight."""

    part: str
    whole: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("n_symbols", "n_words", (2000, 800, 250)),
    Rule("n_dup_lines", "n_lines", (800, 600, 400)),
    Rule("n_repeat_words", "n_words", (250, 180, 120)),
    Rule("word_chars", "n_words", (14000, 11000, 9000)),
)


def settings(rules: tuple[Rule, ...] = RULES) -> list[tuple[int, ...]]:
    """All settings, laxest first: for each rule the number of its cutoff from the lax end (0: off)."""
    return sorted(itertools.product(*(range(len(r.cutoffs) + 1) for r in rules)), key=lambda s: (sum(s), s))


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, text_sha256."""
    text = F.coalesce("text", F.lit(""))
    kept = docs.select(*keep, text.alias("text"))
    # each step is used several times by the next, so the planner keeps them apart
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORDS))
    cut = kept.select(
        *keep, F.array_remove(F.split("text", WORDS.replace("^", "")), "").alias("words"), lines.alias("lines"),
        F.sha2("text", 256).alias("text_sha256"), (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counted = cut.select(
        *keep, "words", "text_sha256", "n_symbols", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    starts = F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1))
    hashed = counted.withColumn("windows", F.when(F.col("n_words") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW)))))
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    numbered = F.transform("windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at")))
    ordered = hashed.withColumn("ordered", F.when(repeats, F.sort_array(numbered))).drop("windows")
    # equal hashes are neighbours now; their words are compared before they count
    window = lambda x: F.slice("words", x["at"] + 1, WINDOW)
    same = lambda x, y: (x["hash"] == y["hash"]) & (window(x) == window(y))
    near = lambda x, i: F.coalesce((i > 0) & same(x, F.get("ordered", i - 1)), F.lit(False)) | F.coalesce(same(x, F.get("ordered", i + 1)), F.lit(False))
    places = ordered.withColumn("places", F.sort_array(F.transform(F.filter("ordered", near), lambda x: x["at"]))).drop("ordered", "words")
    step = lambda i, x: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get("places", i - 1)))
    covered = F.aggregate(F.transform("places", lambda x, i: step(i, x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    done = places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")
    return done.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series beyond 20."""
    x = F.greatest(n, F.lit(21)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of n trials with chance p, where k <= n * p; 1 where k is larger.

    Terms fall from k downwards by a ratio below one, and those beyond twelve standard deviations are nothing in double
    precision: the sum has as many terms as the square root of n."""
    odds = (1 - p) / p
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p) + 60)).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    one = lambda a, i: F.struct((a["term"] * (k - i) / (n - k + i + 1) * odds).alias("term"), (a["total"] + a["term"]).alias("total"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), terms), start, one, lambda a: a["total"])
    at_k = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    return F.when(k > n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(at_k) * total))


def _level(rule: Rule) -> Column:
    """How many of the rule's cutoffs a row exceeds."""
    return sum(((1000 * F.col(rule.part) > c * F.col(rule.whole)).cast("int") for c in rule.cutoffs), F.lit(0))


def _rejects(rule: Rule, level: Column, setting: Column) -> Column:
    """Setting s puts the s-th cutoff from the lax end in force: whoever exceeds it exceeds all tighter ones too."""
    return level + setting > len(rule.cutoffs)


def certified_cutoffs(
    statistics: DataFrame, labels: DataFrame, *, stratum: str = "stratum", rules: tuple[Rule, ...] = RULES, false_rejection: float = 0.05, error: float = 0.05
) -> DataFrame:
    """stratum, n_good, good_rejected, bad_rejected, tail, s0, s1, ... of the strata with a certified setting.

    ``labels`` has doc_id and good (0/1). Strata with too few good texts to be certified even alone are not tested, and so
    take no part in the correction: that depends on their sizes, not on what is rejected."""
    told = labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.max("good").alias("good"))
    names = [f"l{i}" for i in range(len(rules))]
    held = statistics.where("not base_failed").select("doc_id", F.col(stratum).alias("stratum"), "text_sha256", *(_level(r).alias(n) for r, n in zip(rules, names, strict=True)))
    texts = held.join(told, "doc_id").groupBy("stratum", "text_sha256", *names).agg(F.max("good").alias("good"))
    cells = materialize(texts.groupBy("stratum", *names).agg(F.sum((F.col("good") == 1).cast("long")).alias("good"), F.sum((F.col("good") == 0).cast("long")).alias("bad")), "rule-cells")
    sizes = cells.groupBy("stratum").agg(F.sum("good").alias("n_good")).where(F.col("n_good") * math.log1p(-false_rejection) <= math.log(error))
    tested = sizes.count()
    every = settings(rules)
    level = error / max(1, tested * len(every))
    listed = F.array(*(F.struct(F.lit(i).alias("nth"), *(F.lit(v).alias(f"s{j}") for j, v in enumerate(s))) for i, s in enumerate(every)))
    tried = cells.withColumn("s", F.explode(listed)).select("stratum", "good", "bad", *names, "s.*")
    hit = F.lit(False)
    for i, r in enumerate(rules):
        hit = hit | _rejects(r, F.col(f"l{i}"), F.col(f"s{i}"))
    steps = [f"s{i}" for i in range(len(rules))]
    counts = tried.groupBy("stratum", "nth", *steps).agg(F.sum(F.when(hit, F.col("good")).otherwise(0)).alias("good_rejected"), F.sum(F.when(hit, F.col("bad")).otherwise(0)).alias("bad_rejected"))
    sized = counts.where("nth > 0").join(sizes, "stratum")
    passed = sized.withColumn("tail", binomial_tail(F.col("n_good"), F.col("good_rejected"), false_rejection)).where(F.col("tail") <= level)
    gain = (F.col("bad_rejected") - F.col("good_rejected")).alias("gain")
    best = passed.where("bad_rejected > good_rejected").groupBy("stratum").agg(F.max(F.struct(gain, (-F.col("nth")).alias("lax"), "n_good", "good_rejected", "bad_rejected", "tail", *steps)).alias("x"))
    return best.select("stratum", *(f"x.{c}" for c in ("n_good", "good_rejected", "bad_rejected", "tail", *steps)))


def judge(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, false_rejection: float = 0.05, error: float = 0.05) -> DataFrame:
    """doc_id, stratum, the statistics, base_failed and kept of every row of ``docs`` (doc_id, text and ``stratum``)."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        named = docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
        rows = materialize(text_statistics(named, "doc_id", "stratum"), "rule-statistics")
        cutoffs = materialize(certified_cutoffs(rows, labels, rules=rules, false_rejection=false_rejection, error=error), "rule-cutoffs")
        keep(rows)
        keep(cutoffs)
    steps = [f"s{i}" for i in range(len(rules))]
    chosen = cutoffs.select("stratum", *steps)
    if chosen.count() <= MOST_BROADCAST:
        met = rows.join(F.broadcast(chosen), "stratum", "left")
    else:
        salted = chosen.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(SALTS)).cast("int")).join(salted, ["stratum", "__salt"], "left").drop("__salt")
    rejected = F.lit(False)
    for i, r in enumerate(rules):
        rejected = rejected | F.coalesce(_rejects(r, _level(r), F.col(f"s{i}")), F.lit(False))
    return met.withColumn("kept", ~F.col("base_failed") & ~rejected).drop(*steps)
