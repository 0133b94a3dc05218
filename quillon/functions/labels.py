"""Labels, ids and nested metrics of loosely structured items; dataset splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def label_value(x: Column) -> Column:
    """1 for a bot, 0 for a human, null for anything else; words, booleans and numbers are understood."""
    t = F.lower(F.trim(x.cast("string")))
    number = t.try_cast("double")
    return F.when(t.isin("bot", "ai", "true", "yes"), 1).when(t.isin("human", "person", "false", "no"), 0).when(number.isin(0.0, 1.0), number.cast("int"))


def label_of(*, is_bot: str | None = None, is_human: str | None = None, labels: list[str]) -> Column:
    """The first of: a flag for bots, a flag for humans, any of the label fields."""
    tried = []
    if is_bot:
        tried.append(label_value(F.col(is_bot)))
    if is_human:
        tried.append(1 - label_value(F.col(is_human)))
    return F.coalesce(*tried, *(label_value(F.col(c)) for c in labels))


def first_id(fields: list[str], otherwise: Column) -> Column:
    return F.coalesce(*(F.col(c).cast("string") for c in fields), otherwise)


def flatten(rows: DataFrame) -> DataFrame:
    """Structs as columns named by their path with slashes, booleans as integers, lists as their length (``_count``)."""

    def leaves(c: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in leaves(c[f.name], f.dataType, f"{name}/{f.name}")]
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return [F.size(c).alias(f"{name}_count")]
        return [(c.cast("int") if isinstance(kind, T.BooleanType) else c).alias(name)]

    return rows.select(*(x for f in rows.schema.fields for x in leaves(F.col(f.name), f.dataType, f.name)))


def parse_spec(x: Column) -> Column:
    """``name:weight,...`` as an array of structs; a missing weight is 1."""
    one = lambda s: F.struct(F.trim(F.element_at(F.split(s, ":"), 1)).alias("name"), F.coalesce(F.get(F.split(s, ":"), F.lit(1)).try_cast("double"), F.lit(1.0)).alias("weight"))
    return F.transform(F.filter(F.split(x, ","), lambda s: F.trim(s) != ""), one)


#: The hash order of a class is cut into so many ranges, which are sorted each on its own.
SPLIT_RANGES = 4096
BROADCAST_ROWS = 400_000


def hash_places(rows: DataFrame, key: str, label: str | None, seed: int) -> DataFrame:
    """``rows`` with __place (from 1) and __size of each class in the order of a hash of key and seed.

    Rows are counted by class and range of the hash; a row's place is that within its range plus the counts of the ranges
    before, so no task sorts a class. A null label is a class; without a label all rows are one."""
    order = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"), 256)
    hashed = rows.withColumn("__order", order).withColumn("__range", F.conv(F.substring("__order", 1, 3), 16, 10).cast("int")).withColumn("__class", F.col(label) if label else F.lit(0))
    counts = hashed.groupBy(F.col("__class").alias("__label"), F.col("__range").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__label")
    before = F.coalesce(F.sum("__n").over(w.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"__before": before, "__size": F.sum("__n").over(w)})
    if counts.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    placed = hashed.join(counts, F.col("__class").eqNullSafe(F.col("__label")) & (F.col("__range") == F.col("__of")))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__class", "__range").orderBy("__order"))
    return placed.select(*rows.columns, place.alias("__place"), "__size")


def stratified_split(rows: DataFrame, key: str, label: str, ratio: float, seed: int) -> DataFrame:
    """Adds split: the first ``ratio`` of each class by hash of key and seed is validation."""
    placed = hash_places(rows, key, label, seed)
    return placed.select(*rows.columns, F.when(F.col("__place") <= F.rint(ratio * F.col("__size")), "validation").otherwise("train").alias("split"))


def permutation_split(rows: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """Adds split: exactly the share ``ratio`` of all rows, one at least, is validation."""
    placed = hash_places(rows, key, None, seed)
    most = F.greatest(F.lit(1), F.rint(ratio * F.col("__size")))
    return placed.select(*rows.columns, F.when(F.col("__place") <= most, "validation").otherwise("train").alias("split"))


def equal_folds(rows: DataFrame, key: str, label: str | None, k: int, seed: int) -> DataFrame:
    """Adds fold (0 to k - 1): of each class every fold has as many rows as every other, or one more."""
    return hash_places(rows, key, label, seed).select(*rows.columns, ((F.col("__place") - 1) % k).cast("int").alias("fold"))


def hash_split(rows: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """Adds split by the hash alone: no shuffle, shares approximate."""
    share = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return rows.withColumn("split", F.when(share < ratio, "validation").otherwise("train"))


def bootstrap(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """About ``n`` rows drawn with replacement: every row draws its own Poisson count from a hash of its key and ``seed``.
    Where more rows are drawn than there are, a row draws once for each unit of the rate. Adds copy (from 1)."""
    total = rows.count()
    if not total:
        return rows.withColumn("copy", F.lit(1))
    units = max(1, math.ceil(n / total))
    rate = n / total / units
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.col("__unit").cast("string"))
    u = (F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 7), 16, 10).cast("double") + 0.5) / (1 << 28)
    draws, term, tail, k = F.lit(0), math.exp(-rate), math.exp(-rate), 0
    while 1 - tail > 2.0**-29:  # the inverse of the distribution function, until no hash lies beyond
        k += 1
        draws = F.when(u >= tail, k).otherwise(draws)
        term *= rate / k
        tail += term
    drawn = rows.withColumn("__unit", F.explode(F.sequence(F.lit(1), F.lit(units)))).withColumn("__d", draws).where("__d > 0")
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__d")))).drop("__unit", "__d")
