"""Feature vectors of hands and chunks."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import (
    STREETS, amount_bucket, amount_label, capped_ratio, entropy, finite, norm_text, ratio, scaled_log, size_code, symbol_counts,
)
from quillon.operators.sequences import with_anomalies

ACTION_TYPES = ("fold", "check", "call", "bet", "raise")
#: The hand features in their canonical order.
HAND_FEATURES = (
    "acted_after_fold_ratio", "action_type_entropy", "actor_seat_entropy", "aggression_ratio", "amount_log_mean", "amount_max",
    "amount_mean", "amount_negative_ratio", "amount_q75", "amount_std", "bet_ratio", "call_ratio", "call_to_missing_ratio", "check_ratio",
    "ended_preflop", "flop_action_ratio", "fold_ratio", "has_actor_after_fold", "hero_action_ratio", "hero_seat_norm", "last_street_rank",
    "max_street_jump", "nonzero_amount_ratio", "num_actions", "num_players", "num_streets_observed", "passive_ratio", "pot_decrease_ratio",
    "pot_mismatch_ratio", "pot_negative_ratio", "preflop_action_ratio", "raise_ratio", "raise_to_missing_ratio", "reached_flop",
    "reached_river", "reached_showdown", "reached_turn", "river_action_ratio", "same_actor_consecutive_ratio", "seat_utilization",
    "showdown_action_ratio", "street_entropy", "street_jump_ratio", "street_regression_ratio", "turn_action_ratio",
    "zero_amount_betraise_ratio",
)
STATS = ("mean", "std", "min", "max", "q25", "q50", "q75")
CHUNK_ONLY = (
    "unique_action_pattern_ratio", "top_action_pattern_share", "unique_amount_pattern_ratio", "top_amount_pattern_share",
    "chunk_aggression_dispersion", "chunk_action_entropy_mean", "chunk_anomaly_load",
)


#: What is told of the symbols of a hand: the action's kind, its seat if it has one, its street.
SYMBOLS = {"kind": "action_type", "actor": "seat", "street": "street"}


def _symbol(kind: str) -> Column:
    return F.when(F.col("seat") >= 0, F.col("seat")) if kind == "actor" else F.col(SYMBOLS[kind])


def _with_sizes(actions: DataFrame) -> DataFrame:
    """``with_anomalies``, and for each action how many of its hand's have its symbol and how many have one at all, and the
    paid amount with its place among those of the hand: sums over a hand's rows then need no lists."""
    a = actions.withColumn("paid", F.when(F.col("amount_bb") > 0, F.col("amount_bb")))
    told = {"n_paid": F.count("paid"), **{f"all_{k}": F.count(_symbol(k)) for k in SYMBOLS}}
    a = with_anomalies(a, hand=told, seat={"like_actor": F.count(_symbol("actor"))})
    for k in ("kind", "street"):
        a = a.withColumn(f"like_{k}", F.count(_symbol(k)).over(Window.partitionBy("hand_id", SYMBOLS[k])))
    return a.withColumn("paid_at", F.row_number().over(Window.partitionBy("hand_id").orderBy(F.col("paid").asc_nulls_last())) - 1)


def hand_features(hands: DataFrame, actions: DataFrame) -> DataFrame:
    """chunk_id, hand_id and the 46 hand features. One shuffle of the actions serves windows, join and aggregate; the
    aggregate has sums and counts only, so that it runs in hash tables of plain numbers."""
    kind, amount, paid = F.col("action_type"), F.col("amount_bb"), F.col("paid")
    count = lambda cond: F.count_if(cond).cast("double")
    at = 0.75 * (F.col("n_paid") - 1)  # the quartile lies between the values at its two neighbours' places
    q75 = F.when(F.col("paid_at") == F.floor(at), paid * (1 - (at - F.floor(at)))).when(F.col("paid_at") == F.ceil(at), paid * (at - F.floor(at)))
    aggregates = {
        "n": F.count("acted").cast("double"),
        **{f"n_{t}": count(kind == t) for t in ACTION_TYPES},
        **{f"s_{s}": count(F.col("street") == s) for s in STREETS},
        **{c: F.sum(c).cast("double") for c in ("after_fold", "same_actor", "regression", "jump", "pot_mismatch", "pot_decrease")},
        "max_jump": F.max(F.when(F.col("step") > 1, F.col("step"))),
        "pot_negative": count(F.col("pot_after") < 0),
        "negative": count(amount < 0),
        "no_raise_to": count((kind == "raise") & F.col("raise_to").isNull()),
        "no_call_to": count((kind == "call") & F.col("call_to").isNull()),
        "zero_bets": count(kind.isin("bet", "raise") & (amount <= 0)),
        "n_paid": count(amount > 0),
        "paid_mean": F.avg(paid),
        "paid_std": F.stddev_pop(paid),
        "paid_max": F.max(paid),
        "paid_q75": F.sum(q75),
        "paid_log": F.avg(F.log1p(paid)),
        "hero": count(F.col("seat") == F.col("hero_seat")),
    }
    for k in SYMBOLS:
        c, share = _symbol(k), F.col(f"like_{k}") / F.col(f"all_{k}")
        aggregates[f"h_{k}"] = F.sum(F.when(c.isNotNull(), -F.log(share + 1e-12) / F.col(f"all_{k}")))
        aggregates[f"k_{k}"] = F.rint(F.sum(F.when(c.isNotNull(), 1 / F.col(f"like_{k}"))))
    told = _with_sizes(actions).withColumn("acted", F.lit(1))
    # a hand that stands twice in ``hands`` is two rows
    own = ["chunk_id", "hand_id", "hero_seat", "n_players", "max_seats", "copy"]
    h = hands.withColumn("copy", F.row_number().over(Window.partitionBy("hand_id").orderBy("chunk_id"))).select(*own)
    h = h.join(told, "hand_id", "left").groupBy(*own).agg(*(v.alias(k) for k, v in aggregates.items()))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    d, pairs = F.greatest(zero("n"), F.lit(1.0)), F.greatest(zero("n") - 1, F.lit(1.0))
    rank = F.greatest(*(F.when(zero(f"s_{s}") > 0, float(i)).otherwise(0.0) for i, s in enumerate(STREETS)))
    of = lambda c: ratio(zero(c), d)
    ent = lambda k: F.when(F.col(f"k_{k}") > 1, F.col(f"h_{k}") / F.log(F.when(F.col(f"k_{k}") > 1, F.col(f"k_{k}")))).otherwise(0.0)
    values: dict[str, Column] = {
        "num_players": F.col("n_players").cast("double"),
        "seat_utilization": ratio("n_players", "max_seats"),
        "hero_seat_norm": ratio("hero_seat", "max_seats"),
        "num_actions": zero("n"),
# the function of an array keeps this projection out of the generated loop, where it would be one method too long to compile
        "num_streets_observed": F.size(F.filter(F.array(*(F.col(f"s_{s}") for s in STREETS)), lambda n: n > 0)).cast("double"),
        "last_street_rank": rank,
        "ended_preflop": (rank == 0).cast("double"),
        **{f"reached_{s}": (zero(f"s_{s}") > 0).cast("double") for s in STREETS[1:]},
        "aggression_ratio": ratio(zero("n_bet") + zero("n_raise"), F.greatest(zero("n_check") + zero("n_call"), F.lit(1.0))),
        "passive_ratio": ratio(zero("n_check") + zero("n_call"), d),
        "hero_action_ratio": F.when(F.col("hero_seat") != 0, ratio("hero", d)).otherwise(0.0),
        "action_type_entropy": ent("kind"),
        "actor_seat_entropy": ent("actor"),
        "street_entropy": ent("street"),
        "acted_after_fold_ratio": of("after_fold"),
        "has_actor_after_fold": (zero("after_fold") > 0).cast("double"),
        "same_actor_consecutive_ratio": of("same_actor"),
        "street_regression_ratio": of("regression"),
        "street_jump_ratio": of("jump"),
        "max_street_jump": F.coalesce(F.col("max_jump").cast("double"), F.lit(0.0)),
        "pot_mismatch_ratio": ratio(zero("pot_mismatch"), pairs),
        "pot_decrease_ratio": ratio(zero("pot_decrease"), pairs),
        "pot_negative_ratio": of("pot_negative"),
        "amount_negative_ratio": of("negative"),
        "raise_to_missing_ratio": of("no_raise_to"),
        "call_to_missing_ratio": of("no_call_to"),
        "zero_amount_betraise_ratio": of("zero_bets"),
        **{f"{t}_ratio": of(f"n_{t}") for t in ACTION_TYPES},
        **{f"{s}_action_ratio": of(f"s_{s}") for s in STREETS},
        "amount_mean": zero("paid_mean"),
        "amount_std": zero("paid_std"),
        "amount_max": zero("paid_max"),
        "amount_q75": zero("paid_q75"),
        "amount_log_mean": zero("paid_log"),
        "nonzero_amount_ratio": of("n_paid"),
    }
    return h.select("chunk_id", "hand_id", *(values[k].alias(k) for k in HAND_FEATURES))


def _by_chunk(features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """chunk_id, num_hands and for every name a struct of mean, std, min, max and q, the three quartiles. The rows of hands
    are dealt by chunk before the exact percentiles are begun: what a percentile has seen of a chunk is larger than the
    numbers themselves while it is spread over tasks, and is never shuffled."""
    q = lambda k: F.percentile(k, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    parts = lambda k: F.struct(F.avg(k).alias("mean"), F.stddev_pop(k).alias("std"), F.min(k).alias("min"), F.max(k).alias("max"), q(k).alias("q"))
    dealt = features.select("chunk_id", *names).repartition("chunk_id")
    return dealt.groupBy("chunk_id").agg(F.count(F.lit(1)).cast("double").alias("num_hands"), *(parts(k).alias(k) for k in names))


def feature_stats(features: DataFrame, names: tuple[str, ...] = HAND_FEATURES) -> DataFrame:
    """chunk_id, feature and its seven statistics over the chunk's hands, in long form."""
    each = F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("s")) for k in names))
    s = _by_chunk(features, names).select("chunk_id", F.explode(each).alias("x")).select("chunk_id", "x.feature", "x.s.*")
    return s.select("chunk_id", "feature", "mean", "std", "min", "max", *(F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("q25", "q50", "q75"))))


def chunk_vectors(chunks: DataFrame, features: DataFrame) -> DataFrame:
    """One wide row per chunk: num_hands and the seven statistics of every hand feature, 0 for chunks without hands."""
    wide = chunks.select("chunk_id").join(_by_chunk(features, HAND_FEATURES), "chunk_id", "left")
    out = [F.coalesce("num_hands", F.lit(0.0)).alias("num_hands")]
    for k in HAND_FEATURES:
        out += [F.coalesce(F.col(k)[s], F.lit(0.0)).alias(f"{k}_{s}") for s in STATS[:4]]
        out += [F.coalesce(F.get(F.col(k)["q"], F.lit(i)), F.lit(0.0)).alias(f"{k}_{s}") for i, s in enumerate(STATS[4:])]
    return wide.select("chunk_id", *out)


def feature_matrix(vectors: DataFrame, labels: DataFrame, names: list[str], key: str = "chunk_id") -> tuple[DataFrame, bool]:
    """(key, the features in the order of ``names``, y; whether there are labels). Features that ``vectors`` lacks, and
    values that are null or not finite, are 0; y (of ``labels``: key, label) is null everywhere unless every row has one."""
    have = set(vectors.columns)
    told = [(F.coalesce(finite(F.col(n).cast("double")), F.lit(0.0)) if n in have else F.lit(0.0)).alias(n) for n in names]
    rows = vectors.select(key, *told).join(labels.select(key, F.col("label").cast("int").alias("y")), key, "left")
    state = rows.agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("told")).first()
    full = 0 < state["n"] == state["told"]
    return (rows if full else rows.withColumn("y", F.lit(None).cast("int"))), full


def signatures(hands: DataFrame, actions: DataFrame) -> DataFrame:
    """chunk_id, hand_id, the sequence of its action types and that of its amount buckets, as texts."""
    told = F.struct("ord", F.col("action_type").cast("string").alias("kinds"), amount_bucket("amount_bb").cast("string").alias("amounts"))
    per = actions.groupBy("hand_id").agg(F.array_sort(F.collect_list(told)).alias("told"))
    text = lambda c: F.coalesce(F.array_join(F.col("told")[c], ","), F.lit("")).alias(c)
    return hands.select("chunk_id", "hand_id").join(per, "hand_id", "left").select("chunk_id", "hand_id", text("kinds"), text("amounts"))


def pattern_shares(signed: DataFrame, names: dict[str, str]) -> DataFrame:
    """chunk_id and for each signature (a column and its name) the share of distinct ones and of the most frequent one among
    the chunk's hands. Hands are dealt by chunk once, where all signatures are counted in one pass."""
    dealt = signed.select("chunk_id", *names).repartition("chunk_id")
    each = F.array(*(F.struct(F.lit(i).alias("of"), F.col(c).alias("text")) for i, c in enumerate(names)))
    counts = dealt.select("chunk_id", F.inline(each)).groupBy("chunk_id", "of", "text").agg(F.count(F.lit(1)).alias("c"))
    shares = []
    for i, name in enumerate(names.values()):
        c = F.when(F.col("of") == i, F.col("c"))
        shares += [ratio(F.count(c), F.sum(c)).alias(f"unique_{name}_pattern_ratio"), ratio(F.max(c), F.sum(c)).alias(f"top_{name}_pattern_share")]
    return counts.groupBy("chunk_id").agg(*shares)


def chunk_patterns(hands: DataFrame, actions: DataFrame, features: DataFrame) -> DataFrame:
    """The seven chunk-only features."""
    load = F.col("street_jump_ratio") + F.col("street_regression_ratio") + F.col("acted_after_fold_ratio") + F.col("pot_mismatch_ratio")
    # three numbers a hand are less than the sums and counts that a task would begin for its few hands of a chunk
    dealt = features.select("chunk_id", "aggression_ratio", "action_type_entropy", load.alias("load")).repartition("chunk_id")
    behaviour = dealt.groupBy("chunk_id").agg(
        F.stddev_pop("aggression_ratio").alias("chunk_aggression_dispersion"),
        F.avg("action_type_entropy").alias("chunk_action_entropy_mean"),
        F.avg("load").alias("chunk_anomaly_load"),
    )
    return pattern_shares(signatures(hands, actions), {"kinds": "action", "amounts": "amount"}).join(behaviour, "chunk_id")


# ---------------------------------------------------------------- n-grams
#: One-letter codes of streets and actions, and grams kept per order.
STREET_CODES = {"preflop": "p", "flop": "f", "turn": "t", "river": "r", "showdown": "s"}
ACTION_CODES = {"fold": "F", "check": "C", "call": "K", "bet": "B", "raise": "R", "small_blind": "b", "big_blind": "b", "ante": "b"}
TOP_GRAMS = {1: 80, 2: 160, 3: 90}


def _code(c: str, codes: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in codes.items():
        out = F.when(F.lower(c) == k, v).otherwise(out)
    return out


def hand_grams(actions: DataFrame) -> DataFrame:
    """hand_id, pos, n, gram: every n-gram of the hand's tokens, pos growing with the place of its first token; an action gives
    its token and the actor's, if it has one, blinds none. A token's followers are those of its own action and the next two, so
    a gram is put together of neighbouring rows, without the hand's tokens as a list."""
    act = _code("action_type", ACTION_CODES, "X")
    token = F.concat(_code("street", STREET_CODES, "x"), act, size_code("amount", "pot_before", "amount_bb"))
    seat = F.when(F.col("seat").isNotNull(), F.concat(F.lit("pos"), F.col("seat").cast("string"), act))
    told = actions.where(act != "b").select("hand_id", "ord", token.alias("t"), seat.alias("s"))
    w = Window.partitionBy("hand_id").orderBy("ord", "t", "s")
    told = told.select("hand_id", "t", "s", F.row_number().over(w).alias("row"), F.lead("t").over(w).alias("t1"), F.lead("s").over(w).alias("s1"), F.lead("t", 2).over(w).alias("t2"))
    t, s, t1 = F.col("t"), F.col("s"), F.col("t1")
    after_t1 = F.coalesce("s1", "t2")
    gram = lambda pos, *parts: F.struct(pos.alias("pos"), F.lit(len(parts)).alias("n"), reduce(lambda x, y: F.concat(x, F.lit("|"), y), parts).alias("gram"))
    at_t, at_s = 2 * F.col("row") - 1, 2 * F.col("row")
    third = F.when(s.isNotNull(), t1).otherwise(after_t1)
    every = [gram(at_t, t), gram(at_t, t, F.coalesce(s, t1)), gram(at_t, t, F.coalesce(s, t1), third), gram(at_s, s), gram(at_s, s, t1), gram(at_s, s, t1, after_t1)]
    return told.select("hand_id", F.inline(F.array(*every))).where("gram is not null").select("hand_id", "pos", "n", "gram")


def _place(grams: DataFrame, seen: tuple[str, ...]) -> Column:
    """The columns ``seen`` as one value of their order. A long and an int are a decimal, which a hash aggregate can hold; it
    would have to sort all rows for a struct."""
    if [grams.schema[c].dataType.simpleString() for c in seen] != ["bigint", "int"]:
        return F.struct(*seen)
    high, low = (F.coalesce(F.col(c).cast("decimal(20,0)"), F.lit(Decimal(-(2**k) - 1)).cast("decimal(20,0)")) for c, k in zip(seen, (63, 31), strict=True))
    return high * F.lit(Decimal(2**33)) + low


def gram_vocabulary(grams: DataFrame, top: dict[int, int] = TOP_GRAMS, *, seen: tuple[str, ...] = ("hand_id", "pos")) -> DataFrame:
    """n, rank, gram, cnt: the most frequent grams of each order; of equally frequent ones those that were seen first, in the
    order of the columns ``seen``.

    One pass: grams are counted and placed once, by partial aggregates, and the ranks' bound holds in every task before
    the orders' heads meet, so no task ranks more than a head from each other task."""
    counts = grams.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("cnt"), F.min(_place(grams, seen)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.col("cnt").desc(), "first"))
    most = F.coalesce(*(F.when(F.col("n") == n, k) for n, k in top.items()))
    ranked = counts.where(F.col("n").isin(*top)).withColumn("rank", rank).where(F.col("rank") <= max(top.values()))
    return ranked.where(F.col("rank") <= most).select("n", "rank", "gram", "cnt")


def gram_means(hands: DataFrame, grams: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """chunk_id, gram, mean count per hand, for the vocabulary's grams that the chunk has (absent means 0).

    The vocabulary has at most a few hundred rows, as its ranks are bounded, so it is broadcast. A chunk's hands lie in
    many tasks, where few of its grams meet, so they are dealt by chunk before they are counted.
    """
    used = grams.join(F.broadcast(vocabulary.select("gram")), "gram")
    dealt = used.join(hands.select("chunk_id", "hand_id"), "hand_id").select("chunk_id", "gram").repartition("chunk_id")
    counts = dealt.groupBy("chunk_id", "gram").agg(F.count(F.lit(1)).alias("c"))
    sizes = hands.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(sizes, "chunk_id").select("chunk_id", "gram", ratio("c", "n").alias("mean_count"))


def gram_columns(means: DataFrame, chunks: DataFrame, grams: list[str]) -> DataFrame:
    """Wide form: one column per gram of a known vocabulary, 0 where a chunk lacks it."""
    wide = means.groupBy("chunk_id").pivot("gram", grams).agg(F.first("mean_count"))
    named = {g: F.coalesce(F.col(f"`{g}`"), F.lit(0.0)).alias("schema_ngram_" + g.replace("|", "__")) for g in grams}
    return chunks.select("chunk_id").join(wide, "chunk_id", "left").select("chunk_id", *named.values())


# ---------------------------------------------------------------- pooled chunk features
def pooled_features(hands: DataFrame, actions: DataFrame, *, streets: DataFrame | None = None, bb: float = 0.02) -> DataFrame:
    """The chunk features that pool all its actions: mixes, rates, entropies, sizes, signatures and rhythms.

    A big blind is that of ``hands`` where it has bb (0: unknown, then pots have no size), else ``bb``. An action without
    amount_bb has its amount in big blinds. ``hands`` may have seated, the number of taken seats. A street counts as covered
    if an action or ``streets`` (hand_id, street) names it."""
    blind = F.coalesce(F.col("bb").cast("double"), F.lit(0.0)) if "bb" in hands.columns else F.lit(bb)
    taken = F.col("seated" if "seated" in hands.columns else "n_players")
    main = ("preflop", "flop", "turn", "river")
    own = ["chunk_id", "hand_id", "n_players", "occupied"]
    h = hands.select(*own[:3], (taken / F.greatest("max_seats", F.lit(1))).alias("occupied"), F.when(blind > 0, blind).alias("blind"))
    if streets is not None:
        listed = streets.select("hand_id", norm_text("street").alias("street")).where(F.col("street").isin(*main))
        h = h.join(listed.groupBy("hand_id").agg(F.collect_set("street").alias("listed")), "hand_id", "left")
    told = actions.select(
        "hand_id", F.lit(1).alias("acted"), "ord", norm_text("action_type").alias("kind"), norm_text("street", "preflop").alias("street"),
        F.greatest(F.coalesce("seat", F.lit(0)), F.lit(0)).alias("seat"), "amount_bb", "amount", "pot_before", "pot_after",
    )
    # rows are dealt by chunk once, also those of hands without actions; all that follows stays where they are
    dealt = h.join(told, "hand_id", "left").repartition("chunk_id")
    a = dealt.where("acted = 1")
    a = a.withColumn("amount_bb", F.when(F.col("amount_bb") > 0, F.col("amount_bb")).otherwise(F.greatest(F.coalesce(F.col("amount") / F.col("blind"), F.lit(0.0)), F.lit(0.0))))
    is_in = lambda *names: F.count_if(F.col("kind").isin(*names)).cast("double")
    amount = F.col("amount_bb")
    pots = [F.when(F.col(c) > 0, F.col(c) / F.col("blind")) for c in ("pot_before", "pot_after")]
    n_pots = F.count(pots[0]) + F.count(pots[1])
    added = reduce(lambda x, y: x + y, (F.coalesce(F.sum(x), F.lit(0.0)) for x in pots))
    paid = F.when(amount > 0, amount)
    chunk = a.groupBy("chunk_id").agg(
        F.count(F.lit(1)).cast("double").alias("total"),
        is_in("fold").alias("folds"), is_in("check").alias("checks"), is_in("call").alias("calls"),
        is_in("bet", "raise", "all_in", "allin").alias("bets"), is_in("all_in", "allin").alias("all_ins"),
        is_in("small_blind", "big_blind", "ante", "straddle", "bring_in").alias("blinds"),
        is_in("call", "bet", "raise", "all_in", "allin", "small_blind", "big_blind", "ante", "straddle", "bring_in").alias("moneys"),
        F.count_if(amount <= 0).cast("double").alias("zeros"),
        F.count_if(F.col("street") == "preflop").cast("double").alias("preflops"),
        F.count_if(F.col("street").isin("flop", "turn", "river")).cast("double").alias("postflops"),
        F.avg(paid).alias("paid_mean"), F.stddev_pop(paid).alias("paid_std"), F.max(paid).alias("paid_max"), F.count(paid).alias("n_paid"),
        F.percentile(paid, F.array(F.lit(0.25), F.lit(0.75), F.lit(0.9))).alias("paid_q"),
        F.count_if(F.col("pot_after") - F.col("pot_before") > 1e-9).cast("double").alias("rises"),
        F.avg(F.when((F.col("amount") > 0) & (F.col("pot_before") > 0), F.least(F.col("amount") / F.col("pot_before"), F.lit(10.0)) / 10)).alias("to_pot"),
        ratio(added, n_pots).alias("pot_mean"), F.max(F.greatest(*pots)).alias("pot_max"),
    )
    symbols = a.groupBy("chunk_id").agg(F.lit(1).alias("one"))
    for c, scale in (("kind", 12), ("street", 4), ("seat", 9)):
        per = a.groupBy("chunk_id", c).agg(F.count(F.lit(1)).cast("double").alias("c"))
        symbols = symbols.join(per.groupBy("chunk_id").agg(entropy(F.collect_list("c"), scale=scale).alias(f"h_{c}")), "chunk_id")
    # one pass over a hand's actions: a run's length at an action is counted from the last one that differs from its neighbour
    w = Window.partitionBy("chunk_id", "hand_id").orderBy("ord")
    size = F.when(F.col("amount_bb") > 0, F.col("amount_bb")).otherwise(F.greatest(F.coalesce(F.col("amount") / F.col("blind"), F.lit(0.0)), F.lit(0.0)))
    p = dealt.withColumns({"size": amount_label(size), "row": F.row_number().over(w), **{f"new_{c}": F.coalesce(F.lag(c).over(w) != F.col(c), F.lit(True)) for c in ("seat", "kind")}})
    p = p.withColumns({f"from_{c}": F.max(F.when(F.col(f"new_{c}"), F.col("row"))).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in ("seat", "kind")})
    run = lambda c: F.max(F.when(F.col("acted") == 1, F.col("row") - F.col(f"from_{c}") + 1))
    in_order = F.array_sort(F.collect_list(F.when(F.col("acted") == 1, F.struct("ord", "kind", "size"))))
    seen = F.collect_set(F.when(F.col("street").isin(*main), F.col("street")))
    if streets is not None:
        seen = F.array_union(seen, F.coalesce(F.first("listed"), F.array().cast("array<string>")))
    switched = F.coalesce(F.avg(F.when(F.col("row") > 1, F.col("new_seat").cast("double"))), F.lit(0.0))
    per_hand = p.groupBy(*own).agg(
        F.nullif(F.count("acted"), F.lit(0)).alias("n"), is_in("bet", "raise", "all_in", "allin").alias("aggressive"), F.size(seen).alias("streets"),
        switched.alias("switches"), run("seat").alias("seat_run"), run("kind").alias("kind_run"), in_order.alias("in_order"),
    )
    per_hand = per_hand.withColumns(
        {"kinds": F.transform("in_order", lambda x: x["kind"]), "order": F.array_join(F.transform("in_order", lambda x: x["kind"]), ","), "sizes": F.array_join(F.transform("in_order", lambda x: x["size"]), ",")}
    ).drop("in_order")
    # how many of the chunk's hands have a hand's signature
    signed = {"order": "action_signature", "sizes": "amount_bucket_signature"}
    per_hand = per_hand.withColumns({f"like_{c}": F.count(F.lit(1)).over(Window.partitionBy("chunk_id", c)) for c in signed})
    low = entropy(symbol_counts(F.col("kinds")), scale=12)
    count, hands_in = F.coalesce("n", F.lit(0)), F.count(F.lit(1)).cast("double")
    shares = [x for c, name in signed.items() for x in (ratio(F.max(f"like_{c}"), hands_in).alias(f"{name}_top_share"), ratio(F.rint(F.sum(1 / F.col(f"like_{c}"))), hands_in).alias(f"{name}_unique_share"))]
    per_chunk = per_hand.groupBy("chunk_id").agg(
        hands_in.alias("num_hands"), F.avg(count).alias("acts_mean"), F.stddev_pop(count).alias("acts_std"),
        F.avg("n_players").alias("players"), F.avg("occupied").alias("occupied"),
        F.avg(F.col("streets") / 4).alias("coverage"), F.avg(F.when(F.col("n") > 0, F.col("switches"))).alias("switches"),
        F.avg(F.col("seat_run") / F.col("n")).alias("seat_run"), F.avg(F.col("kind_run") / F.col("n")).alias("kind_run"),
        F.count_if(F.col("n").isNotNull() & (low <= 0.35)).cast("double").alias("lows"), F.count_if(F.col("aggressive") / F.col("n") >= 0.35).cast("double").alias("highs"),
        F.count_if(F.col("n") >= 12).cast("double").alias("longs"), *shares,
    )
    out = per_chunk.join(chunk, "chunk_id", "left").join(symbols.drop("one"), "chunk_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = F.greatest(zero("total"), F.lit(1.0))
    playable = F.greatest(zero("folds") + zero("checks") + zero("calls") + zero("bets"), F.lit(1.0))
    q = lambda i: F.coalesce(F.get("paid_q", F.lit(i)), F.lit(0.0))
    values = {
        "num_hands_scaled": scaled_log("num_hands", 32),
        "avg_actions_per_hand_scaled": scaled_log("acts_mean", 64),
        "std_actions_per_hand_scaled": scaled_log("acts_std", 32),
        "avg_players_norm": F.least(F.col("players") / 9, F.lit(1.0)),
        "avg_occupied_ratio": F.col("occupied"),
        "fold_rate": zero("folds") / playable, "check_rate": zero("checks") / playable, "call_rate": zero("calls") / playable,
        "bet_raise_rate": zero("bets") / playable, "all_in_rate": zero("all_ins") / playable,
        "blind_rate": zero("blinds") / total, "money_action_rate": zero("moneys") / total, "zero_amount_rate": zero("zeros") / total,
        "aggression_to_passive": capped_ratio(zero("bets"), zero("checks") + zero("calls"), 5.0),
        "preflop_action_rate": zero("preflops") / total, "postflop_action_rate": zero("postflops") / total,
        "street_coverage": F.col("coverage"),
        "action_entropy_norm": zero("h_kind"), "street_entropy_norm": zero("h_street"), "actor_entropy_norm": zero("h_seat"),
        "mean_amount_bb_scaled": scaled_log(zero("paid_mean")), "std_amount_bb_scaled": scaled_log(zero("paid_std")), "max_amount_bb_scaled": scaled_log(zero("paid_max")),
        "mean_pot_bb_scaled": scaled_log(zero("pot_mean")), "max_pot_bb_scaled": scaled_log(zero("pot_max")),
        "pot_increase_rate": zero("rises") / total, "mean_amount_to_pot": zero("to_pot"),
        "action_signature_top_share": F.col("action_signature_top_share"), "action_signature_unique_share": F.col("action_signature_unique_share"),
        "amount_bucket_signature_top_share": F.col("amount_bucket_signature_top_share"), "amount_bucket_signature_unique_share": F.col("amount_bucket_signature_unique_share"),
        "low_action_entropy_hand_rate": F.col("lows") / F.col("num_hands"), "high_aggression_hand_rate": F.col("highs") / F.col("num_hands"),
        "amount_cv": F.when((F.col("n_paid") >= 2) & (zero("paid_mean") > 1e-9), F.least(zero("paid_std") / F.when(zero("paid_mean") > 1e-9, zero("paid_mean")), F.lit(3.0)) / 3).otherwise(0.0),
        "amount_iqr_bb_scaled": F.when(F.col("n_paid") >= 2, scaled_log(q(1) - q(0))).otherwise(0.0), "amount_p90_bb_scaled": scaled_log(q(2)),
        "actor_switch_rate": zero("switches"), "max_actor_run_norm": zero("seat_run"), "max_action_type_run_norm": zero("kind_run"),
        "long_action_hand_rate": F.col("longs") / F.col("num_hands"),
    }
    return out.select("chunk_id", *(v.alias(k) for k, v in values.items()))


def stack_features(players: DataFrame, bb: float) -> DataFrame:
    """Per chunk the starting stacks in big blinds (chunk_id, hand_id, stack) and how many are short or deep."""
    s = F.when(F.col("stack") > 0, F.col("stack") / bb)
    p = players.groupBy("chunk_id").agg(
        F.avg(s).alias("mean"), F.min(s).alias("low"), F.max(s).alias("high"), F.count(F.lit(1)).alias("n"), F.count_if(s <= 20).alias("short"), F.count_if(s >= 100).alias("deep")
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return p.select(
        "chunk_id", scaled_log(z("mean")).alias("mean_stack_bb_scaled"), scaled_log(z("low")).alias("min_stack_bb_scaled"), scaled_log(z("high")).alias("max_stack_bb_scaled"),
        scaled_log(z("high") - z("low")).alias("stack_spread_bb_scaled"), ratio("short", "n").alias("short_stack_rate"), ratio("deep", "n").alias("deep_stack_rate"),
    )


#: The pooled chunk features in their canonical order.
TABLE_FEATURES = tuple(
    "num_hands_scaled avg_actions_per_hand_scaled std_actions_per_hand_scaled avg_players_norm avg_occupied_ratio showdown_rate"
    " fold_rate check_rate call_rate bet_raise_rate all_in_rate blind_rate money_action_rate zero_amount_rate aggression_to_passive"
    " preflop_action_rate postflop_action_rate street_coverage action_entropy_norm street_entropy_norm actor_entropy_norm"
    " mean_amount_bb_scaled std_amount_bb_scaled max_amount_bb_scaled mean_pot_bb_scaled max_pot_bb_scaled pot_increase_rate"
    " mean_amount_to_pot mean_stack_bb_scaled min_stack_bb_scaled max_stack_bb_scaled stack_spread_bb_scaled short_stack_rate"
    " deep_stack_rate hero_present_rate button_present_rate visible_hole_card_rate showed_hand_rate action_signature_top_share"
    " action_signature_unique_share amount_bucket_signature_top_share amount_bucket_signature_unique_share"
    " low_action_entropy_hand_rate high_aggression_hand_rate amount_cv amount_iqr_bb_scaled amount_p90_bb_scaled"
    " actor_switch_rate max_actor_run_norm max_action_type_run_norm long_action_hand_rate".split()
)


def _at_table(hands: DataFrame, players: DataFrame) -> DataFrame:
    """Per hand: listed players, taken seats, the highest one, whether hero and button are taken, cards seen and shown."""
    p = players.join(hands.select("hand_id", "hero_seat", "button_seat"), "hand_id")
    seat = F.when(F.col("seat") > 0, F.col("seat"))
    return p.groupBy("hand_id").agg(
        F.count(F.lit(1)).alias("listed"), F.countDistinct(seat).alias("seated"), F.max(seat).alias("top"),
        F.coalesce(F.max(seat == F.col("hero_seat")), F.lit(False)).alias("hero"), F.coalesce(F.max(seat == F.col("button_seat")), F.lit(False)).alias("button"),
        F.count_if("visible").alias("visible"), F.count_if("showed").alias("showed"),
    )


def player_features(hands: DataFrame, players: DataFrame) -> DataFrame:
    """Per chunk how often there is a showdown and hero and button are taken seats (of its hands), and how often cards are
    seen and shown (of its listed players). ``hands``: chunk_id, hand_id, hero_seat, button_seat, showdown; ``players``:
    hand_id, seat, visible, showed."""
    h = hands.select("chunk_id", "hand_id", "showdown").join(_at_table(hands, players), "hand_id", "left")
    per = h.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("listed"), F.lit(0)).alias("listed"), *(F.count_if(c).alias(c) for c in ("showdown", "hero", "button")),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("visible", "showed")),
    )
    return per.select(
        "chunk_id", ratio("showdown", "n").alias("showdown_rate"), ratio("hero", "n").alias("hero_present_rate"), ratio("button", "n").alias("button_present_rate"),
        ratio("visible", "listed").alias("visible_hole_card_rate"), ratio("showed", "listed").alias("showed_hand_rate"),
    )


def table_features(chunks: DataFrame, hands: DataFrame, actions: DataFrame, players: DataFrame, streets: DataFrame) -> DataFrame:
    """All of ``TABLE_FEATURES`` for every row of ``chunks`` (chunk_id), 0 for chunks without hands.

    ``hands``, ``actions``, ``players`` and ``streets`` are as the readers' ``hands_of``, ``actions_rows``, ``players_of``
    and ``streets_of`` give them. Seats of a table: max_seats where it is told, else the highest seat of hero, button,
    players and actions, at least 1. Players of a hand: its taken seats, or the listed ones if none has a seat."""
    at = _at_table(hands, players).select("hand_id", "listed", "seated", "top")
    acted = actions.groupBy("hand_id").agg(F.max("seat").alias("acted"))
    h = hands.drop("n_players", "seated").join(at, "hand_id", "left").join(acted, "hand_id", "left")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0))
    seen = F.greatest(*(whole(c) for c in ("hero_seat", "button_seat", "top", "acted")), F.lit(1))
    h = h.withColumns({"seated": whole("seated"), "n_players": F.coalesce(F.nullif("seated", F.lit(0)), whole("listed")), "max_seats": F.when(F.col("max_seats") > 0, F.col("max_seats")).otherwise(seen)})
    stacks = players.join(hands.select("chunk_id", "hand_id", "bb"), "hand_id").select("chunk_id", F.when(F.col("bb") > 0, F.col("stack") / F.nullif("bb", F.lit(0.0))).alias("stack"))
    out = chunks.select("chunk_id").distinct()
    for part in (pooled_features(h, actions, streets=streets), stack_features(stacks, 1.0), player_features(hands, players)):
        out = out.join(part, "chunk_id", "left")
    return out.select("chunk_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in TABLE_FEATURES))


def standardize(rows: DataFrame, names: list[str]) -> DataFrame:
    """Population z-scores of the columns; a spread below 1e-6 counts as 1. The one-row statistics are broadcast."""
    stats = rows.agg(*(F.avg(c).alias(f"{c}__m") for c in names), *(F.stddev_pop(c).alias(f"{c}__s") for c in names))
    spread = lambda c: F.when(F.col(f"{c}__s") < 1e-6, 1.0).otherwise(F.col(f"{c}__s"))
    kept = [c for c in rows.columns if c not in names]
    return rows.join(F.broadcast(stats)).select(*kept, *(((F.col(c) - F.col(f"{c}__m")) / spread(c)).alias(c) for c in names))


def value_vocabulary(rows: DataFrame, column: str, least: int = 1, *, counted: str | None = None) -> DataFrame:
    """value, id: ids from 2 in order of first appearance (column ``at``), after the padding 0 and the unknown 1. A row stands
    for as many as its column ``counted`` says, if one is named."""
    n = F.count(F.lit(1)) if counted is None else F.sum(counted)
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(n.alias("n"), F.min("at").alias("first"))
    kept = counts.where(F.col("n") >= least)
    # one row per distinct value is left to be numbered
    return kept.select("value", (F.row_number().over(Window.orderBy("first", "value")) + 1).alias("id"))
