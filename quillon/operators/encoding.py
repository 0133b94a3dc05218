"""Numeric and categorical encodings of single actions and the context of their hand, for sequence models.

Ids keep 0 for padding. Everything is a column expression over windows of one hand, so actions are shuffled once, by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import STREETS, actor_role, amount_bucket, amount_id, capped_ratio, clamp, norm_text, pot_flow, scaled_log
from quillon.operators.features import ACTION_TYPES, value_vocabulary
from quillon.operators.sequences import in_hand

# Kinds of action, how far a street is, and the names of the numbers in their order.
FORCED = ("small_blind", "big_blind", "ante", "straddle", "bring_in")
AGGRESSIVE = ("bet", "raise", "all_in", "allin")
PASSIVE = ("check", "call")
MONEY = (*FORCED, "call", *AGGRESSIVE)
MAIN_STREETS = ("preflop", "flop", "turn", "river")
NUMERIC = (
    "action_order_norm", "amount_bb_scaled", "raise_to_bb_scaled", "call_to_bb_scaled", "pot_before_bb_scaled", "pot_after_bb_scaled", "pot_delta_bb_signed",
    "amount_to_pot", "raise_to_pot", "call_to_pot", "has_amount", "has_raise_to", "has_call_to", "is_forced_action", "is_money_action", "is_aggressive_action",
    "is_passive_action", "is_all_in", "actor_seat_norm", "actor_stack_bb_scaled", "amount_to_actor_stack", "street_progress",
)
META = ("hero_stack_log", "actors", "streets_dealt", "preflop_actions", "flop_actions", "turn_actions", "river_actions", "hero_share")


def _money(x: str) -> Column:
    return F.coalesce(F.col(x).cast("double"), F.lit(0.0))


def _seat(x: str) -> Column:
    return F.coalesce(F.col(x).cast("int"), F.lit(0))


def table_seats(hands: DataFrame, actions: DataFrame, players: DataFrame, *, most: int = 9) -> DataFrame:
    """``hands`` with seats: the told max_seats where it is positive, else the highest seat of hero, button, players and
    actions, else ``most``; between 1 and ``most``."""
    acted = actions.groupBy("hand_id").agg(F.max("seat").alias("__acted"))
    sat = players.groupBy("hand_id").agg(F.max("seat").alias("__sat"))
    rows = hands.join(acted, "hand_id", "left").join(sat, "hand_id", "left")
    seen = F.greatest(_seat("hero_seat"), _seat("button_seat"), _seat("__acted"), _seat("__sat"))
    told = F.when(_seat("max_seats") > 0, _seat("max_seats")).when(seen > 0, seen).otherwise(most)
    return rows.withColumn("seats", F.greatest(F.lit(1), F.least(told, F.lit(most)))).drop("__acted", "__sat")


def seated(hands: DataFrame, players: DataFrame) -> DataFrame:
    """hand_id, seat, stack: of players (hand_id, nth, seat, stack) with one seat the last; seats beyond the table's are
    left out. ``hands`` has seats."""
    sat = players.join(hands.select("hand_id", "seats"), "hand_id").where((F.col("seat") >= 1) & (F.col("seat") <= F.col("seats")))
    return sat.groupBy("hand_id", "seat").agg(F.max_by(_money("stack"), "nth").alias("stack"))


def _with_stack(rows: DataFrame, sat: DataFrame, seat: str, name: str) -> DataFrame:
    """``rows`` with the stack that ``sat`` (of ``seated``) has for their ``seat``, null where it has none. A hand's stacks are
    one map, so that the join is by hand, as everything around it: by hand and seat the rows would be dealt twice more."""
    stacks = sat.groupBy("hand_id").agg(F.map_from_entries(F.collect_list(F.struct("seat", "stack"))).alias("__stacks"))
    found = F.try_element_at("__stacks", F.col(seat).cast(sat.schema["seat"].dataType))
    return rows.join(stacks, "hand_id", "left").withColumn(name, found).drop("__stacks")


def encoded_actions(hands: DataFrame, actions: DataFrame, players: DataFrame, *, most_actions: int = 64, most_seats: int = 9) -> DataFrame:
    """hand_id, ord, street, action_type and seat (normalised, as keys of the learned vocabularies), the fixed categories
    amount_bucket (1 to 17), pot_flow, first_in_street (2 first, 1 not), actor_role, street_position (1 to 4), and the 22
    numbers of ``NUMERIC``, of the first ``most_actions`` actions of every hand.

    ``hands``: hand_id, hero_seat, button_seat, max_seats, bb; ``actions``: hand_id, ord, street, action_type, seat,
    amount, raise_to, call_to, amount_bb, pot_before, pot_after; ``players``: hand_id, nth, seat, stack. Nulls count as 0.
    """
    table = table_seats(hands, actions, players, most=most_seats)
    a = _with_stack(actions.join(table.select("hand_id", "button_seat", "bb", "seats"), "hand_id"), seated(table, players), "seat", "stack")
    whole, by_street = Window.partitionBy("hand_id"), Window.partitionBy("hand_id", "street").orderBy("ord")
    a = a.withColumns({"street": norm_text("street"), "action_type": norm_text("action_type"), "seat": _seat("seat")})
    a = a.withColumns(
        {
            "place": F.row_number().over(in_hand()), "total": F.count(F.lit(1)).over(whole),
            "first_in_street": F.when(F.lag("street").over(in_hand()) == F.col("street"), 1).otherwise(2),
            "street_position": F.least(F.row_number().over(by_street), F.lit(4)),
            **{c: _money(c) for c in ("amount", "amount_bb", "pot_before", "pot_after", "stack", "bb")}, "raised": _money("raise_to"), "called": _money("call_to"),
        }
    ).where(F.col("place") <= most_actions)

    def blinds(x: str) -> Column:
        return F.when((F.col(x) > 0) & (F.col("bb") > 0), F.col(x) / F.when(F.col("bb") > 0, F.col("bb"))).otherwise(0.0)

    a = a.withColumns({f"{c}__": blinds(c) for c in ("amount", "raised", "called", "pot_before", "pot_after", "stack")})
    a = a.withColumn("amount__", F.when(F.col("amount_bb") > 0, F.col("amount_bb")).otherwise(F.col("amount__")))
    kind, flag = F.col("action_type"), lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    delta = F.when(F.col("bb") > 0, (F.col("pot_after") - F.col("pot_before")) / F.when(F.col("bb") > 0, F.col("bb"))).otherwise(0.0)
    progress = F.lit(0.0)
    for i, s in enumerate(MAIN_STREETS, 1):
        progress = F.when(F.col("street") == s, i / 4).otherwise(progress)
    numbers = {
        "action_order_norm": F.when(F.col("total") <= 1, 0.0).otherwise((F.col("place") - 1) / F.greatest(F.col("total") - 1, F.lit(1))),
        "amount_bb_scaled": scaled_log("amount__"), "raise_to_bb_scaled": scaled_log("raised__"), "call_to_bb_scaled": scaled_log("called__"),
        "pot_before_bb_scaled": scaled_log("pot_before__"), "pot_after_bb_scaled": scaled_log("pot_after__"), "pot_delta_bb_signed": clamp(delta / 200, -1.0, 1.0),
        "amount_to_pot": capped_ratio("amount", "pot_before"), "raise_to_pot": capped_ratio("raised", "pot_before"), "call_to_pot": capped_ratio("called", "pot_before"),
        "has_amount": flag(F.col("amount") > 0), "has_raise_to": flag(F.col("raise_to").isNotNull()), "has_call_to": flag(F.col("call_to").isNotNull()),
        "is_forced_action": flag(kind.isin(*FORCED)), "is_money_action": flag(kind.isin(*MONEY)), "is_aggressive_action": flag(kind.isin(*AGGRESSIVE)),
        "is_passive_action": flag(kind.isin(*PASSIVE)), "is_all_in": flag(kind.isin("all_in", "allin")),
        "actor_seat_norm": F.when(F.col("seat") > 0, F.col("seat") / F.col("seats")).otherwise(0.0),
        "actor_stack_bb_scaled": scaled_log("stack__"), "amount_to_actor_stack": capped_ratio("amount", "stack", 1.0), "street_progress": progress,
    }
    return a.select(
        "hand_id", "ord", "street", "action_type", "seat", amount_id("amount__").alias("amount_bucket"), pot_flow("pot_before__", "pot_after__").alias("pot_flow"),
        "first_in_street", actor_role("seat", "button_seat", "seats").alias("actor_role"), "street_position", *(numbers[n].alias(n) for n in NUMERIC),
    )


def hand_meta(hands: DataFrame, actions: DataFrame, players: DataFrame, streets: DataFrame, *, cap: int = 64, most_seats: int = 9) -> DataFrame:
    """hand_id, the eight numbers of ``META`` and hand_end (1 preflop to 4 river, 0 unknown: the deepest street of an
    action, else the last known one that ``streets`` (hand_id, nth, street) lists)."""
    table = table_seats(hands, actions, players, most=most_seats)
    street = norm_text("street")
    a = actions.join(hands.select("hand_id", "hero_seat"), "hand_id")
    per = a.groupBy("hand_id").agg(
        *(F.count_if(street == s).alias(f"n_{s}") for s in MAIN_STREETS),
        F.countDistinct(F.when(F.col("seat") > 0, F.col("seat"))).alias("n_actors"), F.count_if((F.col("seat") > 0) & (F.col("seat") == F.col("hero_seat"))).alias("n_hero"),
    )
    known = F.array_position(F.array(*map(F.lit, MAIN_STREETS)), street).cast("int")
    listed = streets.groupBy("hand_id").agg(
        F.count_if(F.trim("street") != "").alias("n_dealt"), F.max_by(F.when(known > 0, known), F.when(known > 0, F.col("nth"))).alias("last_listed")
    )
    h = _with_stack(table.join(per, "hand_id", "left").join(listed, "hand_id", "left"), seated(table, players), "hero_seat", "hero_stack")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = sum((n(f"n_{s}") for s in MAIN_STREETS[1:]), n("n_preflop"))
    deepest = F.lit(0)
    for i, s in enumerate(MAIN_STREETS, 1):
        deepest = F.when(n(f"n_{s}") > 0, i).otherwise(deepest)
    stack = F.when((F.col("hero_stack") > 0) & (F.col("bb") > 0), F.col("hero_stack") / F.when(F.col("bb") > 0, F.col("bb"))).otherwise(0.0)
    values = {
        "hero_stack_log": F.log1p(stack), "actors": F.least(n("n_actors"), F.lit(10)) / 10, "streets_dealt": F.least(n("n_dealt"), F.lit(4)) / 4,
        **{f"{s}_actions": F.least(n(f"n_{s}"), F.lit(cap)) / cap for s in MAIN_STREETS},
        "hero_share": F.when(total > 0, n("n_hero") / F.greatest(total, F.lit(1))).otherwise(0.0),
    }
    end = F.when(deepest > 0, deepest).otherwise(n("last_listed")).cast("int")
    return h.select("hand_id", *(values[m].alias(m) for m in META), end.alias("hand_end"), "seats")


def fit_vocabularies(actions: DataFrame, *, least: int = 1) -> DataFrame:
    """field (street, action_type, seat), value, id: the learned vocabularies of ``actions``, ids from 2 in order of first
    appearance by hand and place. One row per distinct value is all that is numbered; the actions are read once, for the
    combinations of the three fields, which are few."""
    seat = F.when(_seat("seat") > 0, F.concat(F.lit("seat_"), _seat("seat").cast("string"))).otherwise("seat_unknown")
    fields = {"street": norm_text("street"), "action_type": norm_text("action_type"), "seat": seat}
    told = actions.groupBy(*(v.alias(k) for k, v in fields.items())).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("hand_id", "ord")).alias("at"))
    parts = [value_vocabulary(told.select(F.col(k).alias("value_of"), "at", "n"), "value_of", least, counted="n").select(F.lit(k).alias("field"), "value", "id") for k in fields]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def with_ids(encoded: DataFrame, vocabulary: DataFrame, *, most_values: int = 100_000) -> DataFrame:
    """``encoded`` actions with street_id, action_type_id and seat_id; a value that the vocabulary lacks is 1. The
    vocabulary is made once, and broadcast, while it has no more than ``most_values`` rows."""
    told = vocabulary.limit(most_values + 1).collect()
    small = len(told) <= most_values
    vocabulary = vocabulary.sparkSession.createDataFrame(told, vocabulary.schema) if small else vocabulary
    out = encoded.withColumn("seat_key", F.when(F.col("seat") > 0, F.concat(F.lit("seat_"), F.col("seat").cast("string"))).otherwise("seat_unknown"))
    for field, column in (("street", "street"), ("action_type", "action_type"), ("seat", "seat_key")):
        mine = vocabulary.where(F.col("field") == field).select(F.col("value").alias(column), F.col("id").cast("int").alias(f"{field}_id"))
        out = out.join(F.broadcast(mine) if small else mine, column, "left").withColumn(f"{field}_id", F.coalesce(f"{field}_id", F.lit(1)))
    return out.drop("seat_key")


def encoded_hands(encoded: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per hand: cat (array of eight ids an action), num (array of 22 numbers an action), meta and hand_end. A hand
    without actions has one row of zeros; lists are not padded, a loader does that for its batch."""
    cats = ["street_id", "action_type_id", "seat_id", "amount_bucket", "pot_flow", "first_in_street", "actor_role", "street_position"]
    row = F.struct("ord", F.array(*(F.col(c).cast("int") for c in cats)).alias("cat"), F.array(*map(F.col, NUMERIC)).alias("num"))
    lists = encoded.groupBy("hand_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lists = lists.select("hand_id", F.transform("rows", lambda x: x["cat"]).alias("cat"), F.transform("rows", lambda x: x["num"]).alias("num"))
    zero = lambda n, v: F.array(F.array_repeat(F.lit(v), n))
    out = meta.join(lists, "hand_id", "left")
    return out.select("hand_id", F.coalesce("cat", zero(len(cats), 0)).alias("cat"), F.coalesce("num", zero(len(NUMERIC), 0.0)).alias("num"), F.array(*map(F.col, META)).alias("hand_meta"), "hand_end")


def step_encoding(hands: DataFrame, actions: DataFrame, *, most_actions: int = 64) -> DataFrame:
    """hand_id and steps for a convolutional model, of the first ``most_actions`` actions of every hand that has any: per
    action the ids of kind (1 to 5) and street (1 to 5), each 0 where it is unknown, whether the hero acts and the amount's
    bucket (0 to 8), and log1p of the amount and of the pot after it. Not padded; a loader pads and masks its batch."""
    place = lambda names, c: F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.lower(F.trim(c))), F.lit(0)).cast("int")
    a = actions.join(hands.select("hand_id", "hero_seat"), "hand_id").withColumn("place", F.row_number().over(in_hand())).where(F.col("place") <= most_actions)
    amount = F.greatest(_money("amount_bb"), F.lit(0.0))
    hero = ((_seat("hero_seat") != 0) & (_seat("seat") == _seat("hero_seat"))).cast("int")
    ids = F.array(place(ACTION_TYPES, "action_type"), place(STREETS, "street"), hero, amount_bucket(amount).cast("int"))
    logs = F.array(F.log1p(amount), F.log1p(F.greatest(_money("pot_after"), F.lit(0.0))))
    rows = a.groupBy("hand_id").agg(F.array_sort(F.collect_list(F.struct("place", ids.alias("ids"), logs.alias("logs")))).alias("r"))
    return rows.select("hand_id", F.transform("r", lambda x: F.struct(x["ids"].alias("ids"), x["logs"].alias("logs"))).alias("steps"))
