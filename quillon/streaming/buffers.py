"""Append buffers, audit lanes and epochs as stream state, with snapshots that another stream can begin from.

The state of a stream is read as a table by Spark's state reader (``saved_*``), kept by version
(``sources.sinks.publish``) and given to a new stream as its ``initial`` rows: it then goes on as if it had never stopped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.board import epoch_start


class _Newest:
    """The newest n values by (at, id, place), whatever order they come in."""

    def __init__(self, n: int):
        self.n, self.heap = n, []

    def add(self, order: tuple, value) -> None:
        (heapq.heappushpop if len(self.heap) >= self.n else heapq.heappush)(self.heap, (order, value))

    def values(self) -> list:
        return [v for _, v in sorted(self.heap, key=lambda x: x[0])]


class AppendBuffers(StatefulProcessor):
    """Per key the last ``window`` predictions with labels, coverages and latencies, in lists that are appended to.

    A list is cut back to its last ``window`` entries when it holds ``slack`` times as many, so an entry is rewritten
    once in a while and not for every row. However many rows of a key come at once, no more than the newest ``window``
    of each list are held."""

    LISTS = {"predictions": "nth long, value double, label int", "coverages": "nth long, value double, label int", "latencies": "nth long, value double, label int"}

    def __init__(self, window: int, slack: int = 4, ttl_ms: int | None = None):
        self.window, self.slack, self.ttl_ms = window, slack, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lists = {k: handle.getListState(k, schema, self.ttl_ms) for k, schema in self.LISTS.items()}
        self.counts = handle.getValueState("counts", "predictions long, coverages long, latencies long, held_predictions int, held_coverages int, held_latencies int")

    def _append(self, new: dict[str, list], totals: dict[str, int]) -> None:
        """``new``: the last values of each list; ``totals``: how many there were of them in all."""
        was = list(self.counts.get()) if self.counts.exists() else [0] * 6
        for i, (name, state) in enumerate(self.lists.items()):
            rows, base = new[name], was[i] + totals[name] - len(new[name])
            entries = [(base + k + 1, float(v), None if y is None else int(y)) for k, (v, y) in enumerate(rows)]
            was[i], was[3 + i] = was[i] + totals[name], was[3 + i] + len(rows)
            if was[3 + i] > self.slack * self.window:
                old = list(state.get()) if state.exists() else []
                entries = (old + entries)[-self.window :]
                state.put(entries)
                was[3 + i] = len(entries)
            elif entries:
                state.appendList(entries)
        self.counts.update(tuple(was))

    def _told(self, key) -> pd.DataFrame:
        held = {k: (list(s.get()) if s.exists() else [])[-self.window :] for k, s in self.lists.items()}
        mean = lambda rows: sum(r[1] for r in rows) / len(rows) if rows else None
        p = held["predictions"]
        return pd.DataFrame({
            "key": [key[0]], "sample_count": [len(p)], "total": [self.counts.get()[0]], "scores": [[r[1] for r in p]], "labels": [[r[2] for r in p]],
            "coverage_rate": [mean(held["coverages"]) or 0.0], "latency_mean": pd.Series([mean(held["latencies"])], dtype="float64"),
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, totals = {k: _Newest(self.window) for k in self.LISTS}, dict.fromkeys(self.LISTS, 0)
        for part in rows:
            for at, nth, scores, labels, coverage, latency in zip(*(part[c] for c in ("at", "nth", "scores", "labels", "coverage", "latency")), strict=True):
                order = (pd.Timestamp(at).value, int(nth))
                for i, (s, y) in enumerate(zip(scores if scores is not None else (), labels if labels is not None else ())):  # the shorter one counts
                    newest["predictions"].add((*order, i), (s, y))
                    totals["predictions"] += 1
                for name, value in (("coverages", coverage), ("latencies", latency)):
                    if value is not None and not pd.isna(value):
                        newest[name].add((*order, 0), (value, None))
                        totals[name] += 1
        self._append({k: n.values() for k, n in newest.items()}, totals)
        yield self._told(key)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        new, counts = {}, {}
        for name in self.LISTS:
            rows = initialState[initialState["list"] == name].sort_values("nth").tail(self.window)
            new[name] = [(v, None if pd.isna(y) else y) for v, y in zip(rows["value"], rows["label"], strict=True)]
            counts[name] = int(rows["nth"].max()) if len(rows) else 0
        self._append(new, counts)

    def close(self) -> None:
        pass


def append_buffers(stream: DataFrame, window: int, *, slack: int = 4, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """key, sample_count, total, scores, labels, coverage_rate, latency_mean from answers (key, at, nth, scores, labels,
    coverage, latency), in the order of at and nth within a batch and of arrival between batches. ``initial``: the rows of
    ``saved_buffers``. With ``ttl_ms`` entries end so long after they were written."""
    kind = stream.schema["key"].dataType.simpleString()
    return stream.groupBy("key").transformWithStateInPandas(
        AppendBuffers(window, slack, ttl_ms), outputStructType=f"key {kind}, sample_count long, total long, scores array<double>, labels array<int>, coverage_rate double, latency_mean double",
        outputMode="Update", timeMode="None" if ttl_ms is None else "ProcessingTime", initialState=None if initial is None else initial.groupBy("key"),
    )


def read_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The entries of one state variable of a stream, as its last batch left them: key and the fields of its entries."""
    state = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    key = state.schema["key"].dataType.fields[0].name
    entry = next(c for c in ("value", "list_element", "user_map_value") if c in state.columns)
    return state.select(F.col("key")[key].alias("key"), f"{entry}.*")


def saved_buffers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, list, nth, value, label of all append buffers."""
    parts = [read_state(spark, checkpoint, k).select("key", F.lit(k).alias("list"), "nth", "value", "label") for k in AppendBuffers.LISTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- audit lanes

#: The statuses of a report.
LOCAL, UNSUPPORTED, DISABLED, UNCONFIGURED = "local_only", "provider_unsupported", "provider_disabled", "provider_unconfigured"
VERIFIED, COMPLETED, FAILED = "verified", "provider_completed", "provider_failed"
#: What a public report keeps; the evidence stays behind.
REPORT = "created_at timestamp, nth long, status string, status_reason string, input_hash string, proof_verified boolean"
LANE = "key string, nth long, created_at timestamp, status string, previous_status string, status_reason string, input_hash string, chain string, recent_reports long, verified_reports long, failed_reports long"


class AuditLane(StatefulProcessor):
    """Per key a ring of the last ``recent`` reports, the latest status and a hash chained over all inputs."""

    def __init__(self, recent: int):
        self.recent = recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "slot long", REPORT)
        self.latest = handle.getValueState("latest", "reports long, status string, chain string, verified long, failed long")

    @staticmethod
    def _failed(status: str | None) -> bool:
        return bool(status) and status.startswith("provider_") and status != COMPLETED

    def _add(self, reports: list[tuple], link) -> list[tuple]:
        """For each of ``reports``, in order: the status before it, the chain with it, and the counts of the ring, in which the
        oldest report makes room. State is read once and written once, however many reports there are."""
        n, before, chain, verified, failed = self.latest.get() if self.latest.exists() else (0, None, "", 0, 0)
        ring = {k[0]: (bool(v[5]), self._failed(v[2])) for k, v in self.ring.iterator()} if n else {}
        out = []
        for i, report in enumerate(reports, n):
            gone = ring.get(i % self.recent, (False, False))
            here = ring[i % self.recent] = (bool(report[5]), self._failed(report[2]))
            verified, failed = verified + here[0] - gone[0], failed + here[1] - gone[1]
            chain = link(chain, i - n)
            out.append((before, chain, min(i + 1, self.recent), verified, failed))
            before = report[2]
        for i, report in list(enumerate(reports, n))[-self.recent :]:
            self.ring.updateValue((i % self.recent,), report)
        self.latest.update((n + len(reports), before, chain, verified, failed))
        return out

    @staticmethod
    def _reports(rows: pd.DataFrame) -> list[tuple]:
        told = zip(*(rows[c] for c in ("created_at", "nth", "status", "status_reason", "input_hash", "proof_verified")), strict=True)
        return [(pd.Timestamp(at).to_pydatetime(), int(nth), status, reason, digest, bool(proof)) for at, nth, status, reason, digest, proof in told]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import hashlib

        every = pd.concat(list(rows)).sort_values(["created_at", "nth"], kind="stable")
        reports = self._reports(every)
        told = self._add(reports, lambda chain, i: hashlib.sha256((chain + (reports[i][4] or "")).encode()).hexdigest())
        out = [(key[0], nth, at, status, before, reason, digest, *rest) for at, (_, nth, status, reason, digest, _), (before, *rest) in zip(every["created_at"], reports, told, strict=True)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LANE.split(", ")])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = initialState.sort_values(["created_at", "nth"], kind="stable").tail(self.recent)
        chains = list(last["chain"])
        self._add(self._reports(last), lambda _, i: chains[i] or "")

    def close(self) -> None:
        pass


def audit_lane(reports: DataFrame, *, recent: int = 32, initial: DataFrame | None = None) -> DataFrame:
    """One row a report (key, created_at, nth, status, status_reason, input_hash, proof_verified), with the key's status
    before, the chain and the counts over its last ``recent`` reports. ``initial``: rows of ``migrated_reports``."""
    return reports.groupBy("key").transformWithStateInPandas(AuditLane(recent), outputStructType=LANE, outputMode="Append", timeMode="None", initialState=None if initial is None else initial.groupBy("key"))


def saved_reports(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, the public fields of every report in a ring, chain (of the key's latest report; null before it)."""
    ring = read_state(spark, checkpoint, "ring")
    last = read_state(spark, checkpoint, "latest").select("key", F.col("chain").alias("latest_chain"))
    newest = ring.groupBy("key").agg(F.max(F.struct("created_at", "nth")).alias("newest"))
    at_end = F.struct("created_at", "nth") == F.col("newest")
    return ring.join(last, "key").join(newest, "key").select("key", *(c.split()[0] for c in REPORT.split(", ")), F.when(at_end, F.col("latest_chain")).alias("chain"))


def migrated_reports(old: DataFrame) -> DataFrame:
    """Reports of an older form in the form of ``saved_reports``: fields that it lacks are null, all others (evidence above
    all) stay behind; rows without a key or a time are no reports."""
    have = set(old.columns)
    kinds = dict(x.split() for x in [*REPORT.split(", "), "chain string"])
    fields = [(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items() if c not in ("nth", "proof_verified")]
    nth = (F.col("nth") if "nth" in have else F.lit(0)).cast("long").alias("nth")
    proof = F.coalesce(F.col("proof_verified").cast("boolean") if "proof_verified" in have else F.lit(None).cast("boolean"), F.lit(False)).alias("proof_verified")
    return old.where("key is not null and created_at is not null").select("key", *fields, nth, proof)


# -- epochs


def corrected_epochs(stream: DataFrame, *, anchor: str, days: int = 3) -> DataFrame:
    """start, n, total, newest of every epoch of (at, value) that a batch touched: rows of any lateness are in their epoch,
    which then comes again, corrected. There is no watermark: the state is one row an epoch."""
    rows = stream.withColumn("start", epoch_start(F.col("at"), anchor=anchor, days=days))
    return rows.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("at").alias("newest"))
