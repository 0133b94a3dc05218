"""Synthetic hands with a consistent betting engine, seeded per row: any partitioning gives the same hands."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.chunks import HAND

#: Chances of folding, checking or calling, and raising, and the size of raises against the pot.
ARCHETYPES = {"tight": (0.55, 0.35, 0.10, 0.5), "loose": (0.20, 0.60, 0.20, 0.6), "aggressive": (0.25, 0.30, 0.45, 0.9), "passive": (0.30, 0.65, 0.05, 0.4)}
STREETS = ("preflop", "flop", "turn", "river")
ACTIONS = "hand_id long, archetype string, ord int, street string, seat int, action_type string, amount double, pot_before double, pot_after double, amount_bb double, raise_to double, call_to double"


def hand(hand_id: int, archetype: str, seats: int, seed: int) -> list[tuple]:
    """The actions of one hand, in big blinds, from the blinds of seats 1 and 2 on. Nobody acts after folding, pots never
    shrink, and a round ends when all have matched."""
    rng = random.Random(f"{seed}:{hand_id}:{archetype}")
    fold, call, _, size = ARCHETYPES[archetype]
    live, pot, out = list(range(1, seats + 1)), 0.0, []

    def act(street: str, seat: int, kind: str, amount: float, raise_to: float | None = None, call_to: float | None = None) -> None:
        nonlocal pot
        out.append((hand_id, archetype, len(out) + 1, street, seat, kind, round(amount, 2), round(pot, 2), round(pot + amount, 2), round(amount, 2), raise_to and round(raise_to, 2), call_to and round(call_to, 2)))
        pot += amount

    act("preflop", 1, "small_blind", 0.5)
    act("preflop", 2, "big_blind", 1.0)
    for street in STREETS:
        first = street == "preflop"
        level = 1.0 if first else 0.0
        owed = {s: level for s in live} | ({1: 0.5, 2: 0.0} if first else {})
        waiting, raises = (live[2:] + live[:2] if first else list(live)), 0
        while waiting and len(live) > 1:
            seat = waiting.pop(0)
            draw, due = rng.random(), owed[seat]
            if due > 0 and draw < fold:
                act(street, seat, "fold", 0.0)
                live.remove(seat)
            elif draw < fold + call or raises >= 2:
                act(street, seat, "call" if due > 0 else "check", due, None, level or None if due > 0 else None)
                owed[seat] = 0.0
            else:
                extra = max(1.0, pot * size * (0.8 + 0.4 * rng.random()))
                act(street, seat, "raise" if level > 0 else "bet", due + extra, level + extra)
                level += extra
                raises += 1
                owed = {s: owed[s] + extra for s in live} | {seat: 0.0}
                waiting = [s for s in live if s != seat]
        if len(live) < 2:
            break
    return out


def synthetic_actions(spark: SparkSession, hands: int, *, seats: int = 6, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """The exploded actions of ``hands`` hands, archetypes in turn."""
    names = list(ARCHETYPES)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([a for i in b["id"] for a in hand(int(i), names[int(i) % len(names)], seats, seed)], columns=[x.split()[0] for x in ACTIONS.split(", ")])

    return spark.range(0, hands, 1, partitions or spark.sparkContext.defaultParallelism).mapInPandas(make, ACTIONS)


def synthetic_chunks(spark: SparkSession, hands: int, *, per_chunk: int = 40, seats: int = 6, seed: int = 7, bb: float = 0.02, partitions: int | None = None) -> DataFrame:
    """chunk_id, archetype, label (1) and the whole hands of ``hands`` generated hands, as the readers give chunks: each
    chunk is up to ``per_chunk`` hands of one archetype. Money is in ``bb``, stacks are 80 to 160 big blinds by a hash of
    hand and seat, the winner is the first seat that has not folded."""
    money = lambda c: F.round(F.col(c) * bb, 4)
    a = synthetic_actions(spark, hands, seats=seats, seed=seed, partitions=partitions)
    act = F.struct(
        F.col("ord").cast("string").alias("action_id"), "street", F.col("seat").alias("actor_seat"), "action_type", money("amount").alias("amount"), money("raise_to").alias("raise_to"),
        money("call_to").alias("call_to"), F.col("amount_bb").alias("normalized_amount_bb"), money("pot_before").alias("pot_before"), money("pot_after").alias("pot_after"),
        F.lit(None).cast("string").alias("timestamp_action"), F.lit(None).cast("string").alias("id"),
    )
    per = a.groupBy("hand_id", "archetype").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", act.alias("a")))), lambda x: x["a"]).alias("actions"), F.max(F.struct("ord", "street"))["street"].alias("last"),
        F.max(money("pot_after")).alias("pot"), F.collect_set(F.when(F.col("action_type") == "fold", F.col("seat"))).alias("folded"),
    )
    table = F.sequence(F.lit(1), F.lit(seats))
    name = lambda s: F.concat(F.lit("seat_"), s)
    stack = lambda s: F.round((80 + F.pmod(F.xxhash64(F.lit(seed), "hand_id", s), F.lit(8001)) / 100) * bb, 2)
    winner = name(F.array_min(F.array_except(table, F.col("folded"))))
    reached = F.filter(F.array(*map(F.lit, STREETS)), lambda s: F.exists("actions", lambda x: x["street"] == s))
    whole = F.struct(
        F.struct(
            F.lit("Hold'em").alias("game_type"), F.lit("No Limit").alias("limit_type"), F.lit(seats).alias("max_seats"), F.pmod(F.xxhash64(F.lit(seed), "hand_id"), F.lit(seats)).cast("int").alias("hero") + 1,
            F.col("last"), F.lit(seats), F.lit(bb / 2), F.lit(bb), F.lit(0.0), F.lit(None).cast("string"),
        ).alias("metadata"),
        F.transform(table, lambda s: F.struct(name(s), s, stack(s), F.lit(None).cast("array<string>"), F.lit(False))).alias("players"),
        F.transform(reached, lambda s: F.struct(s, F.array().cast("array<string>"), F.lit(None).cast("string"))).alias("streets"),
        F.col("actions"),
        F.struct(F.array(winner), F.create_map(winner, F.col("pot")), F.col("pot"), F.lit(0.0), F.lit(""), F.lit(False), F.lit(None).cast("string")).alias("outcome"),
        F.lit("bot").alias("label"),
    ).cast(HAND)
    nth = F.floor(F.col("hand_id") / len(ARCHETYPES))
    dealt = per.select("archetype", "hand_id", F.floor(nth / per_chunk).alias("nth"), whole.alias("hand"))
    chunks = dealt.groupBy("archetype", "nth").agg(F.array_sort(F.collect_list(F.struct("hand_id", "hand")), lambda x, y: F.signum(x["hand_id"] - y["hand_id"]).cast("int")).alias("x"))
    return chunks.select(F.concat_ws("-", "archetype", "nth").alias("chunk_id"), "archetype", F.lit(1).alias("label"), F.col("x.hand").alias("hands"))


def register_udtf(spark: SparkSession, name: str = "synthetic_hand") -> None:
    """``SELECT * FROM synthetic_hand(hand_id, archetype, seats, seed)`` in SQL, also as a lateral join."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=ACTIONS)
    class SyntheticHand:
        def eval(self, hand_id: int, archetype: str, seats: int, seed: int):
            yield from hand(hand_id, archetype, seats, seed)

    spark.udtf.register(name, SyntheticHand)
