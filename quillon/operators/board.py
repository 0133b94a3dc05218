"""Leaderboards, weights, registries and the joins that feed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import is_commit, repo_url, truth

BURN_UID = 0
BURN = 0.70
PODIUM = (0.5, 0.3, 0.2)


# ---------------------------------------------------------------- weights
def podium(rewards: DataFrame, *, burn: float = BURN, shares: tuple[float, ...] = PODIUM) -> DataFrame:
    """uid, weight: the burn to uid 0 and the rest in fixed shares to the best positive rewards (ties: smaller uid);
    everything to uid 0 if none is positive. Only the best few rows leave the partitions."""
    top = rewards.where("reward > 0").orderBy(F.col("reward").desc(), "uid").limit(len(shares))
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("reward")).alias("low"), F.col("uid").cast("long").alias("uid")))).alias("best"))
    share = F.array(*map(F.lit, shares))
    winners = F.transform("best", lambda x, i: F.struct(x["uid"].alias("uid"), (F.get(share, i) * (1 - burn)).alias("weight")))
    first = F.struct(F.lit(BURN_UID).cast("long").alias("uid"), F.when(F.size("best") > 0, burn).otherwise(1.0).alias("weight"))
    return ranked.select(F.explode(F.concat(F.array(first), winners)).alias("x")).select("x.uid", "x.weight").where("weight > 0")


def settlement_vector(weights: DataFrame, size: int, *, burn: float = BURN) -> DataFrame:
    """uid, weight for every uid below ``size``: valid entries as they are if uid 0 is among them, else rescaled to
    leave the burn to uid 0. No rows if no entry is valid."""
    good = weights.select(F.col("uid").try_cast("int").alias("uid"), F.col("weight").try_cast("double").alias("weight"))
    finite = ~F.isnan("weight") & (F.abs("weight") != float("inf"))
    good = good.where((F.col("uid") >= 0) & (F.col("uid") < size) & finite & (F.col("weight") > 0))
    facts = good.agg(F.sum("weight").alias("total"), F.bool_or(F.col("uid") == BURN_UID).alias("own"))
    last = good.groupBy("uid").agg(F.last("weight").alias("weight"))
    spread = weights.sparkSession.range(size).select(F.col("id").cast("int").alias("uid")).join(last, "uid", "left").join(F.broadcast(facts))
    scaled = F.when(F.col("own"), F.col("weight")).otherwise(F.col("weight") * (1 - burn) / F.col("total"))
    value = F.when((F.col("uid") == BURN_UID) & ~F.col("own"), burn).otherwise(F.coalesce(scaled, F.lit(0.0)))
    return spread.where("total is not null").select("uid", value.alias("weight"))


def emitted(weights: DataFrame) -> DataFrame:
    """uid, weight as 16-bit shares of the largest weight; negatives are 0."""
    w = F.greatest(F.col("weight"), F.lit(0.0))
    top = weights.agg(F.max(w).alias("top"))
    return weights.join(F.broadcast(top)).select("uid", F.when(F.col("top") > 0, F.floor(w / F.when(F.col("top") > 0, F.col("top")) * 65535)).otherwise(0).cast("int").alias("weight"))


def normalized(rows: DataFrame, value: str) -> DataFrame:
    """The value divided by the sum of absolute values (0 if that is 0)."""
    total = rows.agg(F.sum(F.abs(value)).alias("__t"))
    return rows.join(F.broadcast(total)).withColumn(value, F.coalesce(F.try_divide(value, "__t"), F.lit(0.0))).drop("__t")


#: Ranges into which rows are counted before a page is cut out of them.
PAGE_RANGES = 256


def rotating_page(rows: DataFrame, order: str, cycle: int, k: int) -> DataFrame:
    """The k rows of this cycle's turn in the order of a number or time: from the place where the last cycle's page ended,
    going on at the first row after the last.

    Rows are counted by ranges that a sketch gives; of each piece of the page only the ranges that it touches are sorted,
    so no task sees the rows before it."""
    n = rows.count()
    if n <= k:
        return rows
    cuts = rows.agg(F.percentile_approx(order, [i / PAGE_RANGES for i in range(1, PAGE_RANGES)], 10 * PAGE_RANGES)).first()[0]
    placed = rows.withColumn("__range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))))
    sizes = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}  # a row a range

    def piece(start: int, length: int) -> DataFrame:
        first = last = before = seen = 0
        for of in sorted(sizes):
            if seen <= start:
                first, before = of, seen
            if seen < start + length:
                last = of
            seen += sizes[of]
        touched = placed.where(F.col("__range").between(first, last)).drop("__range")
        return touched.orderBy(order).offset(start - before).limit(length)

    start = (cycle - 1) * k % n
    page = piece(start, min(k, n - start))
    return page if start + k <= n else page.unionByName(piece(0, start + k - n))


def top_k_bands(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Exactly k scores per key above one half (ties: larger idx), both bands rescaled to their own range."""
    w = Window.partitionBy(*keys)
    s = scored.withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), F.col("idx").desc()))).withColumn("n", F.count(F.lit(1)).over(w))
    s = s.withColumn("flagged", F.col("rank") <= k)
    band = Window.partitionBy(*keys, "flagged")
    lo, hi = F.min("score").over(band), F.max("score").over(band)
    s = s.withColumn("part", F.coalesce(F.try_divide(F.col("score") - lo, hi - lo), F.lit(0.0)))
    banded = F.when(F.col("flagged"), 0.5 + 1e-6 + F.col("part") * (0.5 - 1e-6)).otherwise(F.col("part") * (0.5 - 1e-6))
    return s.select(*keys, "idx", F.when(F.col("n") <= k, F.col("score")).otherwise(F.round(banded, 6)).alias("score"))


# ---------------------------------------------------------------- candidates and manifests
def eligible_miners(nodes: DataFrame) -> DataFrame:
    """Nodes (uid, permit, ip, port) that can be asked: not uid 0, without permit, reachable."""
    reachable = ~F.coalesce("ip", F.lit("")).isin("", "0.0.0.0", "::", "[::]") & (F.coalesce("port", F.lit(0)) > 0)
    return nodes.where((F.col("uid") != BURN_UID) & ~F.col("permit") & reachable)


#: What a manifest must tell.
REQUIRED = ("open_source", "repo_url", "repo_commit", "model_name", "model_version", "training_data_statement", "private_data_attestation")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def normalized_manifest(rows: DataFrame) -> DataFrame:
    """Texts trimmed, blank ones null, lists without blanks, open_source as a boolean."""
    out = {}
    for f in rows.schema.fields:
        kind = f.dataType.simpleString()
        if f.name == "open_source":
            out[f.name] = truth(F.col(f.name).cast("string"))
        elif kind == "string":
            out[f.name] = F.nullif(F.trim(f.name), F.lit(""))
        elif kind == "array<string>":
            clean = F.filter(F.transform(f.name, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
            out[f.name] = F.when(F.size(clean) > 0, clean)
        else:
            out[f.name] = F.col(f.name)
    return rows.select(*(v.alias(k) for k, v in out.items()))


def compliance(rows: DataFrame, *, reference_repo: str, reference_model: str) -> DataFrame:
    """Adds missing_fields, policy_violations and status (transparent or opaque)."""
    lacks = lambda c: ~F.coalesce(F.col(c), F.lit(False)) if c == "open_source" else _blank(c)
    files = F.size(F.filter(F.coalesce("implementation_files", F.array().cast("array<string>")), lambda x: F.trim(x) != "")) <= 0
    missing = [F.when(lacks(c), c) for c in REQUIRED] + [F.when(files, "implementation_files"), F.when(_blank("implementation_sha256"), "implementation_sha256")]
    foreign = (repo_url("repo_url") == reference_repo) & (F.coalesce(F.trim("model_name"), F.lit("")) != reference_model)
    broken = [F.when(~is_commit("repo_commit"), "repo_commit_invalid"), F.when(foreign, "repo_url_must_point_to_model_repo")]
    out = rows.withColumns({"missing_fields": F.array_compact(F.array(*missing)), "policy_violations": F.array_compact(F.array(*broken))})
    clean = (F.size("missing_fields") == 0) & (F.size("policy_violations") == 0)
    return out.withColumn("status", F.when(clean, "transparent").otherwise("opaque"))


def suspicion(rows: DataFrame) -> Column:
    """The reasons to doubt a manifest."""
    told = ("repo_url", "repo_commit", "training_data_statement", "private_data_attestation")
    return F.array_compact(F.array(F.when(~F.coalesce("open_source", F.lit(False)), "manifest_not_open_source"), *(F.when(_blank(c), f"manifest_missing_{c}") for c in told)))


def stable_digest(*parts: Column) -> Column:
    """SHA-256 of values in a fixed order, each behind a unit separator; null differs from the empty text."""
    told = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *told).cast("binary"), 256)


# ---------------------------------------------------------------- joins and registries
def zip_ordinal(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Entries of two arrays paired by position; the shorter side decides, as an inner join on the position."""
    x = left.select(*keys, F.posexplode(a).alias("pos", a))
    return x.join(right.select(*keys, F.posexplode(b).alias("pos", b)), [*keys, "pos"])


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not seen; null keys always count as unseen."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def coverage(expected: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """expected, received and their ratio per key, 0 where nothing came."""
    got = received.groupBy(*keys).agg(F.count(F.lit(1)).alias("received"))
    out = expected.join(got, keys, "left").withColumn("received", F.least(F.coalesce("received", F.lit(0)), F.col("expected")))
    return out.withColumn("coverage", F.coalesce(F.try_divide("received", "expected"), F.lit(0.0)))


def changes(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the key's value before; the first counts as changed."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__b", before).where(~F.col("__b").eqNullSafe(F.col(value)) | F.col("__b").isNull()).drop("__b")


def served_registry(rows: DataFrame, key: str, cycle: str) -> DataFrame:
    """Per key first and last cycle, times served, and how often it came again."""
    return rows.groupBy(key).agg(F.min(cycle).alias("first_seen"), F.max(cycle).alias("last_seen"), F.count(F.lit(1)).alias("times"), (F.count(F.lit(1)) - 1).alias("repeats"))


def numeric_first(c: str) -> list[Column]:
    """Sort keys for mixed ids: numbers by value, then everything else."""
    number = F.col(c).try_cast("long")
    return [number.isNull().cast("int"), number, F.col(c)]


def epoch_start(ts: Column, *, anchor: str = "2026-05-12 20:00:00", days: int = 3) -> Column:
    """Start of the epoch of a timestamp: daily at the anchor's hour before the anchor, every ``days`` days after it."""
    a = F.unix_timestamp(F.lit(anchor).cast("timestamp"))
    t = F.unix_timestamp(ts)
    day = a + F.floor((t - a) / 86400) * 86400
    long = a + F.floor((t - a) / (86400 * days)) * (86400 * days)
    return F.timestamp_seconds(F.when(t < a, day).otherwise(long))


def epoch_end(ts: Column, *, anchor: str = "2026-05-12 20:00:00", days: int = 3) -> Column:
    a = F.unix_timestamp(F.lit(anchor).cast("timestamp"))
    length = F.when(F.unix_timestamp(ts) < a, 86400).otherwise(86400 * days)
    return F.timestamp_seconds(F.unix_timestamp(epoch_start(ts, anchor=anchor, days=days)) + length)
