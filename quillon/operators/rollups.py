"""Joins, roll-ups and set tests over registries, reports and leaderboards, on anybody's tables.

Key columns are named by the caller. Large tables meet by keys only; counts are combined before they move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.python_json import json_text
from quillon.operators.sequences import trailing


def network_snapshot(nodes: DataFrame, *, burn_uid: int, miner_from: int = 1) -> DataFrame:
    """One row of counts over nodes (uid, permit, active, balance): all, active ones, permits, validators, miners, and
    the balance of the burn's own node (null if there is none)."""
    permit, active = F.col("permit"), F.col("active")
    return nodes.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(active).alias("active"), F.count_if(permit).alias("permits"), F.count_if(permit & active).alias("active_validators"),
        F.count_if(~permit & active & (F.col("uid") >= miner_from)).alias("active_miners"), F.max(F.when(F.col("uid") == burn_uid, F.col("balance"))).alias("burn_balance"),
    )


def admitted(rows: DataFrame, allowed: DataFrame, key: str, *, permit: str | None = None, stake: str | None = None) -> DataFrame:
    """The rows whose key is in ``allowed`` (column key) and, where it is named, whose permit is true; with ``stake`` they
    get a priority, that value or 0."""
    out = rows.join(allowed.select(key).distinct(), key, "left_semi")
    if permit:
        out = out.where(F.coalesce(F.col(permit), F.lit(False)))
    return out.withColumn("priority", F.coalesce(F.col(stake).cast("double"), F.lit(0.0))) if stake else out


def leaderboard(uids: DataFrame, sources: list[DataFrame], key: str, *, defaults: dict[str, object] | None = None) -> DataFrame:
    """One row per row of ``uids`` with the columns of every source (a row a key at most), each of which may lack the key:
    missing columns are null or take their default."""
    out = reduce(lambda a, b: a.join(b, key, "left"), sources, uids)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def owner_states(old: DataFrame, new: DataFrame, key: str, owner: str) -> DataFrame:
    """key and state of every key of either table (key, owner): new, gone, same, or reset where the owner changed."""
    both = old.select(key, F.col(owner).alias("__old"), F.lit(True).alias("__was")).join(new.select(key, F.col(owner).alias("__new"), F.lit(True).alias("__is")), key, "full")
    state = F.when(F.col("__was").isNull(), "new").when(F.col("__is").isNull(), "gone").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("reset")
    return both.select(key, state.alias("state"))


def reset_scores(scores: DataFrame, states: DataFrame, key: str, score: str) -> DataFrame:
    """key and score after a change of owners: reset and new keys start at 0, gone ones leave."""
    out = states.where("state <> 'gone'").join(scores.select(key, score), key, "left")
    return out.select(key, F.when(F.col("state") == "same", F.coalesce(F.col(score), F.lit(0.0))).otherwise(0.0).alias(score))


def union_of(sources: dict[str, DataFrame], name: str = "origin") -> DataFrame:
    """All rows of the sources, which have the same columns, each with the name of its source."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias(name), "*") for k, df in sources.items()])


def set_report(rows: DataFrame, key: str, value: str, *, required: list, wanted: list) -> DataFrame:
    """key, has_all (whether its values hold every required one), absent (the wanted ones that it lacks, sorted), shared
    (the wanted ones that it has, sorted). Only required and wanted values are gathered, so a key's list is bounded."""
    named = list(dict.fromkeys([*required, *wanted]))
    got = rows.groupBy(key).agg(F.collect_set(F.when(F.col(value).isin(*named), F.col(value))).alias("__s"))
    need, more = F.array(*map(F.lit, required)), F.array(*map(F.lit, wanted))
    return got.select(
        key, (F.size(F.array_except(need, "__s")) == 0).alias("has_all"), F.array_sort(F.array_except(more, "__s")).alias("absent"), F.array_sort(F.array_intersect(more, "__s")).alias("shared")
    )


def content_digest(rows: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """keys and digest: SHA-256 over the digests of each row's canonical JSON in the order of ``order``. What is gathered
    per key is 64 characters a row, whatever the rows hold."""
    told = rows.select(*keys, order, F.sha2(json_text(F.struct(*fields), rows.select(*fields).schema), 256).alias("__d"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "__d"))), lambda x: x["__d"])
    return told.groupBy(*keys).agg(F.sha2(F.array_join(listed, "\n").cast("binary"), 256).alias("digest"))


def fingerprints(rows: DataFrame, keys: list[str], order: str, text: str = "payload") -> DataFrame:
    """keys and fingerprint: SHA-256 of the JSON list of a key's records (column ``text``: their canonical JSON) in order,
    as Python's ``json.dumps`` writes it. A key's texts are put together, so a key is one chunk, of a bounded number of
    records; ``content_digest`` has no such bound."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(*keys).agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256).alias("fingerprint"))


def distinct_ids(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """keys and their distinct values, sorted. For keys of a bounded number of values."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(name))


def cycle_summary(rows: DataFrame, keys: list[str], value: str, who: str, expected: int | Column) -> DataFrame:
    """keys, n, lowest, highest, mean, nonzero of a value, and the share of the ``expected`` participants that took part."""
    total = F.lit(expected) if isinstance(expected, int) else expected
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.avg(value).alias("mean"), F.count_if(F.col(value) > 0).alias("nonzero"),
        (F.countDistinct(who) / F.nullif(total, F.lit(0))).alias("response_rate"),
    )


def with_last(rows: DataFrame, listed: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with the value of the last entry of ``listed`` under their keys, null where there is none."""
    last = listed.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))
    return rows.join(last, keys, "left")


def by_position(rows: DataFrame, lists: DataFrame, key: str, place: str, items: str, own: str, name: str) -> DataFrame:
    """``rows`` (key, place from 0, own) with the entry of their key's list (key, items) at their place, or their own value
    where the list is too short or missing."""
    given = lists.select(key, F.posexplode(items).alias(place, "__given")).withColumn(place, F.col(place).cast(rows.schema[place].dataType))
    return rows.join(given, [key, place], "left").withColumn(name, F.coalesce("__given", F.col(own))).drop("__given")


def degraded(keys: DataFrame, key: str, sources: list[tuple[str, DataFrame]], constant: float = 0.5) -> DataFrame:
    """key, score, origin: the score (column score) of the first source that has the key, else the constant."""
    out = keys.select(key)
    for name, df in sources:
        out = out.join(df.select(key, F.col("score").alias(f"__{name}")), key, "left")
    origin = reduce(lambda a, n: a.when(F.col(f"__{n}").isNotNull(), n), [n for n, _ in sources[1:]], F.when(F.col(f"__{sources[0][0]}").isNotNull(), sources[0][0]))
    return out.select(key, F.coalesce(*(F.col(f"__{n}") for n, _ in sources), F.lit(constant)).alias("score"), origin.otherwise("constant").alias("origin"))


def audit_report(rows: DataFrame, keys: list[str], order: list[str], status: str, statuses: dict[str, str], *, last: int = 32, worst: str | None = None) -> DataFrame:
    """Per key over its ``last`` reports: reports, a count for each of ``statuses`` (name of the count to status), and the
    largest value of ``worst``. Evidence and all other columns stay behind."""
    recent = trailing(rows.select(*keys, *order, status, *([worst] if worst else [])), keys, order, last)
    counts = [F.count_if(F.col(status) == v).alias(k) for k, v in statuses.items()]
    return recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("reports"), *counts, *([F.max(worst).alias("worst")] if worst else []))


def audit_status(provider: Column, mode: Column, configured: Column, error: Column, proof: Column, *, supported: str) -> tuple[Column, Column]:
    """(status, status_reason) of a report by what was asked of the provider and what came back."""
    name, how = F.lower(F.trim(F.coalesce(provider, F.lit("none")))), F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    ready, failed = F.coalesce(configured, F.lit(False)), error.isNotNull()
    status = (
        F.when(name == "none", "local_only").when(name != supported, "provider_unsupported").when(how == "disabled", "provider_disabled").when(~ready, "provider_unconfigured")
        .when(failed, "provider_failed").when(F.coalesce(proof, F.lit(False)), "verified").otherwise("provider_completed")
    )
    short = F.trim(error)
    reason = (
        F.when(status == "local_only", "audit provider disabled").when(status == "provider_unsupported", F.concat(F.lit("unsupported provider: "), name)).when(status == "provider_disabled", "audit mode disabled")
        .when(status == "provider_unconfigured", "missing provider configuration").when(status == "provider_failed", F.when(F.length(short) <= 300, short).otherwise(F.concat(F.substring(short, 1, 300), F.lit("..."))))
    )
    return status, F.coalesce(reason, F.lit(""))


def audit_lane(reports: DataFrame, keys: list[str], order: list[str], *, last: int = 32) -> DataFrame:
    """``reports`` (status, proof_verified) with previous_status and, over the key's ``last`` reports up to each,
    recent_reports, verified_reports and failed_reports: what a provider did not do, or did wrong. The stream's form is
    ``streaming.buffers.audit_lane``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    recent = w.rowsBetween(1 - last, 0)
    verified = F.coalesce(F.col("proof_verified"), F.lit(False))
    failed = F.col("status").startswith("provider_") & (F.col("status") != "provider_completed")
    return reports.withColumns({
        "previous_status": F.lag("status").over(w), "recent_reports": F.count(F.lit(1)).over(recent),
        "verified_reports": F.count_if(verified).over(recent), "failed_reports": F.count_if(failed).over(recent),
    })


def public_view(rows: DataFrame, hidden: list[str]) -> DataFrame:
    """``rows`` without the evidence: the hidden columns, or fields of structs named with dots."""
    tops = [c for c in hidden if "." not in c]
    inner: dict[str, list[str]] = {}
    for c in hidden:
        if "." in c:
            inner.setdefault(c.split(".", 1)[0], []).append(c.split(".", 1)[1])
    return rows.select(*((F.col(c).dropFields(*inner[c]).alias(c) if c in inner else F.col(c)) for c in rows.columns if c not in tops))


def gated(batches: DataFrame, healthy: Column, least: int, size: str = "n_hands") -> DataFrame:
    """The batches that may be fetched: their source is healthy and they have at least ``least`` hands."""
    return batches.where(F.coalesce(healthy, F.lit(False)) & (F.coalesce(F.col(size), F.lit(0)) >= least))
