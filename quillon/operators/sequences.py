"""Order-aware operators over actions: lag and lead anomalies, runs, n-grams, collapsing, windows over a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import street_rank


def in_hand() -> Window:
    return Window.partitionBy("hand_id").orderBy("ord")


def with_anomalies(actions: DataFrame, *, hand: dict[str, Column] | None = None, seat: dict[str, Column] | None = None) -> DataFrame:
    """Adds what each action shows against the ones around it in its hand (columns hand_id, ord, seat, street, ...), and
    the aggregates ``hand`` and ``seat`` over all rows of its hand and of its seat there, in the same passes."""
    w = in_hand()
    by_seat = Window.partitionBy("hand_id", "seat").orderBy("ord")
    earlier = by_seat.rowsBetween(Window.unboundedPreceding, -1)
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    a = actions.withColumn("rank", street_rank("street"))
    a = a.withColumns(
        {
            "after_fold": F.coalesce(F.max((F.col("action_type") == "fold").cast("int")).over(earlier), F.lit(0)),
            "same_actor": F.coalesce((F.lag("seat").over(w) == F.col("seat")).cast("int"), F.lit(0)),
            "step": F.coalesce(F.col("rank") - F.lag("rank").over(w), F.lit(0)),
            "gap": F.lead("pot_before").over(w) - F.col("pot_after"),
            **{k: c.over(w.rowsBetween(*whole)) for k, c in (hand or {}).items()},
            **{k: c.over(by_seat.rowsBetween(*whole)) for k, c in (seat or {}).items()},
        }
    )
    return a.withColumns(
        {
            "regression": (F.col("step") < 0).cast("int"),
            "jump": (F.col("step") > 1).cast("int"),
            "pot_mismatch": F.coalesce((F.abs("gap") > 0.01).cast("int"), F.lit(0)),
            "pot_decrease": F.coalesce((F.col("gap") < -0.01).cast("int"), F.lit(0)),
        }
    )


def longest_runs(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Per key the longest run of equal consecutive values: gaps and islands, no state beyond two row numbers."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = Window.partitionBy(*keys, value).orderBy(order)
    marked = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(v))
    return marked.groupBy(*keys, value, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias(name))


def switch_rate(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Per key the share of neighbours that differ; 0 for a single row."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = rows.withColumn("changed", (F.lag(value).over(w) != F.col(value)).cast("double"))
    return changed.groupBy(*keys).agg(F.coalesce(F.avg("changed"), F.lit(0.0)).alias(name))


def ngrams(tokens: Column, orders: tuple[int, ...] = (1, 2, 3)) -> Column:
    """All n-grams of an array of tokens as structs (n, gram); orders longer than the array give none."""

    def of(n: int) -> Column:
        last = F.size(tokens) - n + 1
        return F.when(
            last >= 1,
            F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(tokens, i, n), "|").alias("gram"))),
        ).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))

    return F.flatten(F.array(*(of(n) for n in orders)))


def collapse_noops(actions: DataFrame) -> DataFrame:
    """Drop a check or fold without money that repeats the action before it. The row before is enough to compare
    with: a dropped row equals the kept one in everything compared."""
    w = in_hand()
    idle = (F.col("amount_bb") <= 0) & (F.col("pot_after") <= F.col("pot_before"))
    same = idle & F.col("action_type").isin("check", "fold")
    for c in ("action_type", "seat", "street"):
        same = same & (F.lag(c).over(w) == F.col(c))
    marked = actions.withColumn("dup", F.coalesce(same & F.lag(idle).over(w), F.lit(False)))
    return marked.where(~F.col("dup")).drop("dup")


def seat_aliases(actions: DataFrame) -> DataFrame:
    """hand_id, seat, alias: seats numbered by their first action."""
    first = actions.where("seat > 0").groupBy("hand_id", "seat").agg(F.min("ord").alias("first"))
    return first.select("hand_id", "seat", F.row_number().over(Window.partitionBy("hand_id").orderBy("first")).alias("alias"))


def chunk_windows(chunks: DataFrame, size: int, stride: int, *, keep_short: bool = False) -> DataFrame:
    """chunk_id, start, stop (exclusive) of all full windows over n_hands (columns chunk_id, n_hands); a remainder
    is left out, a chunk shorter than one window is a window only with ``keep_short``."""
    last = F.col("n_hands") - size
    full = chunks.where(last >= 0).select("chunk_id", "n_hands", F.explode(F.sequence(F.lit(0), last, F.lit(stride))).alias("start"))
    out = full.select("chunk_id", "start", (F.col("start") + size).alias("stop"))
    if keep_short:
        short = chunks.where((last < 0) & (F.col("n_hands") > 0)).select("chunk_id", F.lit(0).alias("start"), F.col("n_hands").alias("stop"))
        out = out.unionByName(short.select("chunk_id", F.col("start").cast(out.schema["start"].dataType).alias("start"), F.col("stop").cast(out.schema["stop"].dataType).alias("stop")))
    return out


def chunk_prefixes(chunks: DataFrame, least: int = 4, most: int = 32) -> DataFrame:
    """Prefix lengths of every chunk from ``least`` to its whole, at most ``most`` evenly spread ones."""
    span = F.col("n_hands") - least
    every = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (F.lit(least) + F.rint(i * span / F.lit(float(most - 1)))).cast("long"))
    some = F.when(span < most, F.sequence(F.lit(least).cast("long"), F.col("n_hands").cast("long"))).otherwise(F.array_distinct(every))
    return chunks.where(F.col("n_hands") >= least).select("chunk_id", F.explode(some).alias("length"))


def even_span(n: Column, cap: int) -> Column:
    """Indices of at most ``cap`` of n rows, evenly spread, ends included."""
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.rint(i * (n - 1) / F.lit(float(cap - 1))).cast("int")))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= cap, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(spread)


def trailing(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of every key."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def leading(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of every key: the plain limit of batches, releases, hands or actions. A task hands on no more
    than ``n`` rows a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= n).drop("__place")


def ema(rows: DataFrame, keys: list[str], order: str, value: str, alpha: float, name: str, *, cycles: DataFrame | None = None) -> DataFrame:
    """Exponential moving average from zero, by its closed form: one window and one sum, no fold. A key ages by its own
    rows only, or, with ``cycles`` (all values of ``order``), by every cycle: one that it misses counts as a zero."""
    if cycles is None:
        w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        aged = rows.withColumn("age", F.row_number().over(w) - 1)
    else:  # a row a cycle, so their number is that of days or hours
        ages = cycles.select(order).distinct().withColumn("age", F.row_number().over(Window.orderBy(F.col(order).desc())) - 1)
        aged = rows.join(F.broadcast(ages), order)
    return aged.groupBy(*keys).agg(F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("age")) * F.col(value)).alias(name))
