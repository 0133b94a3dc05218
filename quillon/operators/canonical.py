"""The canonical view of a hand: units, buckets, aliases, resolved types, collapsed repeats, a deterministic sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import clamp, coarse, direct_type, from_blinds, in_blinds, nearest_bucket, noise, resolved_type, seat_or_zero, seeded, tidy, window_size
from quillon.operators.sequences import collapse_noops, in_hand

#: Fields that tell the label; bounds in big blinds.
PRIVATE = ("label", "label_flag", "is_bot", "bot_family_id", "bot_version")
MAX_ACTION, MAX_POT, MAX_STACK = 200.0, 1000.0, 500.0
FORCED = ("small_blind", "big_blind", "ante")
#: A table has six seats at least; seats beyond ten are none. Weights of the score without a model, with the
#: ratios at which each part is full.
LEAST_SEATS, MOST_SEATS = 6, 10
DEPTH, SHOWDOWN, CALLS, CHECKS, PLAYERS, FOLDS, RAISES = 0.32, 0.22, (0.18, 0.35), (0.12, 0.30), 0.08, (0.18, 0.55), (0.10, 0.20)


def visible_seats() -> Column:
    """The seats of the visible table, from max_seats."""
    return F.greatest(F.lit(LEAST_SEATS), seat_or_zero("max_seats", MOST_SEATS))


def seat_alias_map(hands: DataFrame, actions: DataFrame, players: DataFrame) -> DataFrame:
    """hand_id, seat, alias: the seats of every hand numbered by their first action, then in the order of the players, then
    by number, until each seat of the table has an alias. Seats that the table lacks have none."""
    table = hands.select("hand_id", visible_seats().alias("__seats"))
    told = actions.select("hand_id", F.col("seat").try_cast("int").alias("seat"), F.struct(F.lit(0).alias("kind"), F.col("ord").cast("long").alias("at")).alias("place"))
    sat = players.select("hand_id", F.col("seat").try_cast("int").alias("seat"), F.struct(F.lit(1).alias("kind"), F.col("nth").cast("long").alias("at")).alias("place"))
    rest = table.select("hand_id", F.explode(F.sequence(F.lit(1), F.col("__seats"))).alias("seat")).select("hand_id", "seat", F.struct(F.lit(2).alias("kind"), F.col("seat").cast("long").alias("at")).alias("place"))
    seats = told.unionByName(sat).unionByName(rest).join(table, "hand_id").where(F.col("seat").between(F.lit(1), F.col("__seats")))
    first = seats.groupBy("hand_id", "seat").agg(F.min("place").alias("place"))
    return first.select("hand_id", "seat", F.row_number().over(Window.partitionBy("hand_id").orderBy("place")).alias("alias"))


def visible_players(hands: DataFrame, players: DataFrame, aliases: DataFrame) -> DataFrame:
    """hand_id, seat (the alias), starting_stack in visible money, of every seated player; of two on one seat the last.
    ``hands`` has bb (the hand's own big blind), ``players``: hand_id, nth, seat, stack."""
    p = players.join(hands.select("hand_id", "bb", visible_seats().alias("__seats")), "hand_id")
    p = p.withColumn("seat", seat_or_zero("seat", F.col("__seats"))).where("seat > 0")
    last = p.groupBy("hand_id", "seat").agg(F.max_by(in_blinds("stack", "bb", MAX_STACK), "nth").alias("stack"))
    named = last.join(_alias_maps(aliases), "hand_id").withColumn("alias", F.try_element_at("__aliases", "seat")).where("alias is not null")
    return named.select("hand_id", F.col("alias").alias("seat"), from_blinds("stack").alias("starting_stack"))


def _alias_maps(aliases: DataFrame) -> DataFrame:
    """hand_id, __aliases: a hand's aliases by seat. A join by hand alone leaves rows where they are; one by hand and seat
    deals them once more."""
    return aliases.groupBy("hand_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("seat").cast("int"), "alias"))).alias("__aliases"))


def strip_private(rows: DataFrame) -> DataFrame:
    """Drop the private fields at every depth, by rewriting the schema: Catalyst then prunes them from the scan."""
    from pyspark.sql import Column
    from pyspark.sql import types as T

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            fields = [clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in PRIVATE]
            return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, (T.StructType, T.ArrayType)):
            return F.transform_values(c, lambda _, v: clean(v, kind.valueType))
        return c

    return rows.select(*(clean(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in PRIVATE))


def canonical_actions(hands: DataFrame, actions: DataFrame, *, bb: float = 1.0) -> DataFrame:
    """Actions in coarse big blinds with aliases for seats; forced actions and untyped ones without money are gone,
    repeats of an idle action collapsed, the rest numbered anew (``ord``, ``n``).

    ``hands``: hand_id, hero_seat, max_seats. Amounts are noised by a seed of hand, action and field, so the view is
    the same in every run.
    """
    a = actions.join(hands.select("hand_id", "hero_seat", "max_seats"), "hand_id")
    unit = F.lit(bb)

    sources = {"amount": ("amount_bb", MAX_ACTION), "raise_to": ("raise_to", MAX_POT), "call_to": ("call_to", MAX_POT), "pot_before": ("pot_before", MAX_POT), "pot_after": ("pot_after", MAX_POT)}
    # in steps: every step reads plain columns, so that no expression is copied into the next one over and over
    a = a.withColumns({f"u_{k}": in_blinds(c, unit, upper) for k, (c, upper) in sources.items()})
    a = a.withColumns({f"z_{k}": noise(seeded("hero_seat", "max_seats", "street", "seat", "ord", F.lit(k))) for k in sources})
    early = [k for k in sources if k != "pot_after"]
    a = a.withColumns({f"b_{k}": nearest_bucket(f"u_{k}") for k in early})
    a = a.withColumns({f"v_{k}": coarse(f"u_{k}", f"b_{k}", f"z_{k}") for k in early})
    # a pot never shrinks before the noise is added
    a = a.withColumn("u_pot_after", F.greatest("v_pot_before", "u_pot_after"))
    a = a.withColumn("b_pot_after", nearest_bucket("u_pot_after"))
    a = a.withColumn("v_pot_after", coarse("u_pot_after", "b_pot_after", "z_pot_after"))
    a = a.select(
        "hand_id", "ord", "street", "seat", "action_type", "hero_seat", "max_seats", F.col("v_amount").alias("amount_bb"), F.col("v_raise_to").alias("raise_bb"),
        F.col("v_call_to").alias("call_bb"), F.col("v_pot_before").alias("before_bb"), F.col("v_pot_after").alias("after_bb"),
    )
    a = a.withColumns({"direct": direct_type("action_type"), "kind": resolved_type("action_type", "amount_bb", "raise_bb", "call_bb", "before_bb", "after_bb")})
    # aliases by windows: they also keep the filter below from being pushed into, and copied over, the steps above
    a = a.withColumn("seat", seat_or_zero("seat", visible_seats()))
    a = a.withColumn("first", F.min("ord").over(Window.partitionBy("hand_id", "seat")))
    rank = F.dense_rank().over(Window.partitionBy("hand_id").orderBy(F.col("seat") == 0, "first"))
    a = a.withColumn("alias", F.when(F.col("seat") == 0, 0).otherwise(rank))
    idle = (F.col("amount_bb") <= 0) & (F.col("raise_bb") <= 0) & (F.col("call_bb") <= 0) & (F.col("after_bb") <= F.col("before_bb"))
    a = a.where(~F.col("kind").isin(*FORCED) & ~((F.col("direct") == "") & idle))
    a = a.select(
        "hand_id", "ord", "street", F.col("alias").alias("seat"), F.col("kind").alias("action_type"), "amount_bb", F.when(F.col("raise_bb") > 0, from_blinds("raise_bb")).alias("raise_to"),
        F.when(F.col("call_bb") > 0, from_blinds("call_bb")).alias("call_to"), from_blinds("before_bb").alias("pot_before"), from_blinds("after_bb").alias("pot_after"),
        "hero_seat", "max_seats",
    )
    a = collapse_noops(a)
    whole = Window.partitionBy("hand_id")
    return a.withColumn("ord", F.row_number().over(in_hand())).withColumn("n", F.count(F.lit(1)).over(whole))


def visible_sample(actions: DataFrame, *, repeat_single: int = 12) -> DataFrame:
    """Five to eight actions of every hand (hand_id, ord from 1, n, street, hero_seat, max_seats): all if there are no
    more, else the first, the last, one inner action per street by hash (streets in alphabetical order, while there
    is room), then inner ones by hash. A single action is repeated ``repeat_single`` times. New numbers in ``place``.
    """
    whole = Window.partitionBy("hand_id")
    a = actions.withColumn("opened", F.min(F.when(F.col("ord") == 1, F.col("street"))).over(whole))
    seed = seeded("hero_seat", "max_seats", "opened", "n")
    a = a.withColumns({"window": F.least(F.col("n"), window_size(seed)), "inner": (F.col("ord") > 1) & (F.col("ord") < F.col("n"))})
    # a key stands in the rows of one sort only, and as bytes: they sort as their hexadecimal text does
    key = lambda *last: F.unhex(F.sha2(F.concat(seed, F.lit(":"), (F.col("ord") - 1).cast("string"), F.lit(":"), *last).cast("binary"), 256))
    within = Window.partitionBy("hand_id", "inner", "street").orderBy("key")
    a = a.withColumn("key", key(F.lower("street"))).withColumn("first_of_street", F.col("inner") & (F.row_number().over(within) == 1))
    # the streets' rows are counted in the order of the same sort
    nth = F.count_if("first_of_street").over(Window.partitionBy("hand_id", "inner").orderBy("street", "key").rowsBetween(Window.unboundedPreceding, 0))
    a = a.withColumn("nth", nth).drop("key")
    a = a.withColumn("picked", (~F.col("inner")) | (F.col("first_of_street") & (F.col("nth") + 2 <= F.col("window")))).drop("nth", "first_of_street")
    a = a.withColumn("taken", F.count_if("picked").over(whole))
    rest = Window.partitionBy("hand_id", "picked").orderBy("key")
    a = a.withColumn("key", key()).withColumn("chosen", F.col("picked") | (F.row_number().over(rest) <= F.col("window") - F.col("taken"))).drop("key")
    a = a.where("chosen")
    copies = F.when(F.col("n") == 1, repeat_single).otherwise(1)
    a = a.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    a = a.withColumn("place", F.row_number().over(Window.partitionBy("hand_id").orderBy("ord", "copy")))
    return a.drop("opened", "window", "inner", "picked", "taken", "chosen", "copy")


def canonical_hands(hands: DataFrame, visible: DataFrame, actions: DataFrame | None = None, players: DataFrame | None = None, streets: DataFrame | None = None) -> DataFrame:
    """The whole view, one nested record per hand: metadata with the hero's alias, fixed blinds and no button; players by
    alias without cards; streets without boards; the visible actions; a blank outcome.

    ``hands``: hand_id, hero_seat, max_seats, bb, and game_type and limit_type where there are any; ``actions`` (the raw
    ones: hand_id, ord, seat) and ``players`` (hand_id, nth, seat, stack) give the aliases, ``streets`` (hand_id, nth,
    street) the streets. Without these tables a hand has no players and no streets.
    """
    action = F.struct(
        F.col("place").alias("at"), F.col("place").cast("string").alias("action_id"), "street", F.col("seat").alias("actor_seat"), "action_type", from_blinds("amount_bb").alias("amount"),
        "raise_to", "call_to", F.col("amount_bb").alias("normalized_amount_bb"), "pot_before", "pot_after",
    )
    told = visible.groupBy("hand_id").agg(F.transform(F.array_sort(F.collect_list(action)), lambda x: x.dropFields("at")).alias("actions"))
    spark = hands.sparkSession
    players = players if players is not None else spark.createDataFrame([], "hand_id long, nth int, seat int, stack double")
    streets = streets if streets is not None else spark.createDataFrame([], "hand_id long, nth int, street string")
    acted = (actions if actions is not None else visible).select("hand_id", "ord", "seat")
    aliases = seat_alias_map(hands, acted, players)
    bb = hands if "bb" in hands.columns else hands.withColumn("bb", F.lit(1.0))
    player = F.struct(
        F.col("seat").alias("at"), F.concat(F.lit("seat_"), F.col("seat").cast("string")).alias("player_uid"), "seat", "starting_stack",
        F.lit(None).cast("array<string>").alias("hole_cards"), F.lit(False).alias("showed_hand"),
    )
    sat = visible_players(bb, players, aliases).groupBy("hand_id").agg(F.transform(F.array_sort(F.collect_list(player)), lambda x: x.dropFields("at")).alias("players"))
    street = F.struct(F.col("nth").alias("at"), F.coalesce("street", F.lit("")).alias("street"), F.array().cast("array<string>").alias("board_cards"))
    dealt = streets.groupBy("hand_id").agg(F.transform(F.array_sort(F.collect_list(street)), lambda x: x.dropFields("at")).alias("streets"))
    hero = F.try_element_at("__aliases", seat_or_zero("hero_seat", visible_seats()))
    h = hands.join(_alias_maps(aliases), "hand_id", "left").withColumn("__alias", hero)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in hands.columns else F.lit("")
    meta = F.struct(
        text("game_type").alias("game_type"), text("limit_type").alias("limit_type"), visible_seats().alias("max_seats"), F.coalesce("__alias", F.lit(0)).alias("hero_seat"),
        F.lit("").alias("hand_ended_on_street"), F.lit(0).alias("button_seat"), F.lit(0.01).alias("sb"), F.lit(0.02).alias("bb"), F.lit(0.0).alias("ante"),
        F.lit(None).cast("string").alias("rng_seed_commitment"),
    )
    outcome = F.struct(
        F.array().cast("array<string>").alias("winners"), F.create_map().cast("map<string,double>").alias("payouts"), F.lit(0.0).alias("total_pot"), F.lit(0.0).alias("rake"),
        F.lit("").alias("result_reason"), F.lit(False).alias("showdown"),
    )
    out = h.select("hand_id", meta.alias("metadata"))
    for part in (sat, dealt, told):
        out = out.join(part, "hand_id", "left")
    filled = {c: F.coalesce(c, F.array().cast(t.schema[c].dataType)).alias(c) for c, t in (("players", sat), ("streets", dealt), ("actions", told))}
    return out.select("hand_id", "metadata", *filled.values(), outcome.alias("outcome"))


def chunk_signature(hands: DataFrame, visible: DataFrame, streets: DataFrame, players: DataFrame) -> DataFrame:
    """Per chunk the averages per hand of calls, checks, raises, folds, actions, streets, players, amounts and pots; a
    chunk without hands has no row. ``players`` and ``streets`` have a row each (hand_id)."""
    is_kind = lambda k: F.count_if(F.col("action_type") == k)
    per = visible.groupBy("hand_id").agg(
        is_kind("call").alias("calls"), is_kind("check").alias("checks"), is_kind("raise").alias("raises"), is_kind("fold").alias("folds"),
        F.count(F.lit(1)).alias("actions"), F.sum("amount_bb").alias("amount"), F.sum("pot_after").alias("pot"),
    )
    names = ["calls", "checks", "raises", "folds", "actions", "streets", "players", "amount", "pot"]
    h = hands.select("chunk_id", "hand_id").join(per, "hand_id", "left")
    for t, c in ((streets, "streets"), (players, "players")):
        h = h.join(t.groupBy("hand_id").agg(F.count(F.lit(1)).alias(c)), "hand_id", "left")
    return h.groupBy("chunk_id").agg(*(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in names))


def heuristic_scores(hands: DataFrame, actions: DataFrame, streets: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """chunk_id, score: without a model, weighted bounded ratios per hand, averaged over the chunk's hands. With ``chunks``
    (chunk_id) every chunk has a score of six decimals, as it is served; one without hands has one half.

    ``hands``: chunk_id, hand_id, n_players, showdown. Ratios are over calls, checks, bets, raises and folds only, the
    depth is a third of the listed streets, and the showdown is what the outcome says.
    """
    kinds = ("call", "check", "bet", "raise", "fold")
    per = actions.groupBy("hand_id").agg(*(F.count_if(F.col("action_type") == k).cast("double").alias(k) for k in kinds))
    listed = streets.groupBy("hand_id").agg(F.count(F.lit(1)).alias("listed"))
    h = hands.join(per, "hand_id", "left").join(listed, "hand_id", "left")
    n = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    meaningful = F.greatest(sum((n(k) for k in kinds[1:]), n("call")), F.lit(1.0))
    full = lambda k, at: clamp(n(k) / meaningful / at)
    sat = F.coalesce("n_players", F.lit(0))
    players = F.when(sat > 0, clamp((6 - F.least(sat, F.lit(6))) / 4)).otherwise(0.0)
    score = DEPTH * F.coalesce("listed", F.lit(0)) / 3 + SHOWDOWN * F.coalesce(F.col("showdown").cast("int"), F.lit(0)) + PLAYERS * players
    score = score + CALLS[0] * full("call", CALLS[1]) + CHECKS[0] * full("check", CHECKS[1]) - FOLDS[0] * full("fold", FOLDS[1]) - RAISES[0] * full("raise", RAISES[1])
    told = h.groupBy("chunk_id").agg(F.avg(clamp(score)).alias("score"))
    if chunks is None:
        return told
    return chunks.select("chunk_id").join(told, "chunk_id", "left").select("chunk_id", tidy(F.coalesce("score", F.lit(0.5))).alias("score"))
