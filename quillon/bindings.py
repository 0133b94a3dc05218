"""Stand-ins for the nested records: the star-schema and event tables read as hands, actions and scores.

An order is a hand of its customer's chunk and a line item is an action. ``SQL`` holds the same definitions as
common table expressions, for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What the flags of a line item stand for.
TYPES = {"AF": "fold", "AO": "check", "NF": "call", "NO": "bet", "RF": "raise", "RO": "big_blind"}
STREETS = ("preflop", "flop", "turn", "river", "showdown")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per action, numbered within its hand. Partitioned by hand once; windows and aggregates reuse that. The table's
    own columns are shuffled: what is computed of them is longer, and is made behind the numbering."""
    flags = F.concat("l_returnflag", "l_linestatus")
    kind = F.lit("big_blind")
    for k, v in TYPES.items():
        kind = F.when(flags == k, v).otherwise(kind)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(order))
    street = F.element_at(F.array(*map(F.lit, STREETS)), (F.col("l_partkey") % 5 + 1).cast("int"))
    still = kind.isin("fold", "check")
    return li.select(
        F.col("l_orderkey").alias("hand_id"), kind.alias("action_type"), street.alias("street"),
        (F.col("l_suppkey") % 6 + 1).cast("int").alias("seat"),
        F.when(still, 0.0).otherwise(F.col("l_quantity")).alias("amount_bb"),
        F.when(still, 0.0).otherwise(F.col("l_extendedprice") * F.col("l_discount") * 10).alias("amount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pot_before"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("pot_after"),
        F.when(F.col("l_discount") != 0, F.col("l_quantity") * 2).alias("raise_to"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity")).alias("call_to"),
        "ord",
    )


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hand of a chunk, in order; some hands have no actions."""
    o = table(spark, sf_dir, "orders")
    within = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.col("o_custkey").alias("chunk_id"), F.col("o_orderkey").alias("hand_id"), (F.row_number().over(within) - 1).alias("hand_idx"),
        (F.col("o_orderkey") % 6 + 1).cast("int").alias("hero_seat"), (F.col("o_orderkey") % 5 + 2).cast("int").alias("n_players"), F.lit(6).alias("max_seats"),
    )


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hands with what the encoders need: a button (0 for none), a told number of seats (0 for none), a big blind."""
    seats = F.when(F.col("hand_id") % 3 == 0, 0).otherwise(6)
    return hands(spark, sf_dir).select("chunk_id", "hand_id", "hero_seat", (F.col("hand_id") % 7).cast("int").alias("button_seat"), seats.alias("max_seats"), F.lit(97.0).alias("bb"))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The players of every hand with their starting stacks. Hands are dealt, and their players made where they are."""
    h = hands(spark, sf_dir).select("hand_id", "n_players").repartition("hand_id").select("hand_id", F.explode(F.sequence(F.lit(1), F.col("n_players"))).alias("seat"))
    return h.select("hand_id", F.col("seat").alias("nth"), "seat", ((F.col("hand_id") * 7 + F.col("seat") * 13) % 150 * 48.5).alias("stack"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streets that a hand lists: none to four, made where the hand was dealt to."""
    n = (F.col("hand_id") % 5).cast("int")
    h = hands(spark, sf_dir).select("hand_id").repartition("hand_id").select("hand_id", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("nth"))
    return h.select("hand_id", "nth", F.element_at(F.array(*map(F.lit, STREETS)), F.col("nth")).alias("street"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y (0/1) and a score in [0, 1) of labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("y"), ((F.col("n_chars") % 50) / 50.0).alias("score")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of miners by cycle: uid, cycle (day), event_id, score, y."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("uid"), F.to_date("ts").alias("cycle"), "event_id", "ts",
        F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y"),
    )


SQL = """
acts AS (
  SELECT *, CASE WHEN action_type IN ('fold', 'check') THEN 0.0 ELSE l_quantity END AS amount_bb,
         CASE WHEN action_type IN ('fold', 'check') THEN 0.0 ELSE l_extendedprice * l_discount * 10 END AS amount,
         l_extendedprice * (1 - l_discount) AS pot_before, l_extendedprice * (1 + l_tax) AS pot_after,
         CASE WHEN l_discount <> 0 THEN l_quantity * 2 END AS raise_to, CASE WHEN l_tax <> 0 THEN l_quantity END AS call_to
  FROM (SELECT l_orderkey AS hand_id, (l_suppkey % 6 + 1)::INT AS seat,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS ord,
               CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'fold' WHEN 'AO' THEN 'check' WHEN 'NF' THEN 'call' WHEN 'NO' THEN 'bet' WHEN 'RF' THEN 'raise' ELSE 'big_blind' END AS action_type,
               ['preflop', 'flop', 'turn', 'river', 'showdown'][(l_partkey % 5 + 1)::INT] AS street,
               l_quantity, l_extendedprice, l_discount, l_tax
        FROM lineitem)),
hands AS (
  SELECT o_custkey AS chunk_id, o_orderkey AS hand_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS hand_idx,
         (o_orderkey % 6 + 1)::INT AS hero_seat, (o_orderkey % 5 + 2)::INT AS n_players, 6 AS max_seats
  FROM orders),
tables AS (SELECT chunk_id, hand_id, hero_seat, (hand_id % 7)::INT AS button_seat, CASE WHEN hand_id % 3 = 0 THEN 0 ELSE 6 END AS max_seats, 97.0::DOUBLE AS bb FROM hands),
players AS (SELECT hand_id, seat::INT AS seat, (hand_id * 7 + seat * 13) % 150 * 48.5::DOUBLE AS stack FROM (SELECT hand_id, unnest(range(1, n_players + 1)) AS seat FROM hands)),
streets AS (SELECT hand_id, nth, ['preflop', 'flop', 'turn', 'river'][nth] AS street FROM (SELECT hand_id, unnest(range(1, (hand_id % 5) + 1)) AS nth FROM hands)),
scored AS (SELECT labels.doc_id AS id, toxic AS y, (n_chars % 50) / 50.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
responses AS (SELECT user_id AS uid, ts::DATE AS cycle, event_id, ts, least(value / 100, 1.0) AS score, (event_type = 'purchase')::INT AS y FROM events)
"""


def with_sql(body: str) -> str:
    """A SQL twin on top of the shared definitions; ``body`` may begin with further expressions and a comma."""
    return f"WITH {SQL.strip()}{body}"
