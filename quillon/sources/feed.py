"""A polled HTTP feed as a streaming data source: numbered items, read in ranges, acknowledged after the sink.

    spark.dataSource.register(FeedStream)
    stream = spark.readStream.format("paged_feed").options(urls="http://a/x http://a/y", health="http://a/health").load()

The feed numbers the items of every url from 1. ``health`` answers ``{"ok": true, "available": n, "latest": {url: last}}``;
``<url>?after=a&limit=n`` answers ``{"items": [...]}``, the items from number a + 1 on; ``ack`` takes the last numbers that
were dealt with, by POST. A batch is the range from one set of last numbers to the next, so the same batch reads the same
items however often it is tried. Ranges are cut into tasks of ``perTask`` items; a task holds one page at a time.

No batch begins unless the feed is healthy and at least ``least`` items are available. A stream that has just begun doesn't
know where it stands, so it fails with ``FEED_NOT_READY`` instead of waiting; ``poll`` tries again after its pause.
"""

from __future__ import annotations

import ast
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NOT_READY = "FEED_NOT_READY"


def request_json(url: str, *, body: dict | None = None, tries: int = 3, pause: float = 0.5, timeout: float = 60.0):
    """The decoded answer, without its envelope ``{"success": true, "data": ...}``; a failed call is repeated."""
    data = None if body is None else json.dumps(body, sort_keys=True).encode()
    for left in range(tries - 1, -1, -1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=data, headers={"content-type": "application/json"}), timeout=timeout) as r:
                raw = r.read()
            answer = json.loads(raw) if raw else None
            return answer["data"] if isinstance(answer, dict) and answer.get("success") is True and "data" in answer else answer
        except OSError:
            if not left:
                raise
            time.sleep(pause)
    raise AssertionError


class _Range(InputPartition):
    def __init__(self, url: str, after: int, until: int):
        super().__init__((url, after))
        self.url, self.after, self.until = url, after, until


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.urls, self.health, self.ack = options["urls"].split(), options["health"], options.get("ack")
        self.least, self.page, self.per_task = int(options.get("least", "1")), int(options.get("page", "500")), int(options.get("perTask", "50000"))
        self.http = {"tries": int(options.get("tries", "3")), "pause": float(options.get("pause", "0.5")), "timeout": float(options.get("timeout", "60"))}
        self.seen: dict | None = None

    def initialOffset(self) -> dict:
        return {u: 0 for u in self.urls}

    def latestOffset(self) -> dict:
        state = request_json(self.health, **self.http)
        if state.get("ok") and int(state.get("available") or 0) >= self.least:
            self.seen = {u: int(state.get("latest", {}).get(u, 0)) for u in self.urls}
        elif self.seen is None:
            raise RuntimeError(f"{NOT_READY}: ok {state.get('ok')}, {state.get('available')} items available, {self.least} needed")
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = self.seen or dict(end)
        return [_Range(u, a, min(a + self.per_task, end[u])) for u in self.urls for a in range(start.get(u, 0), end.get(u, 0), self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at = partition.after
        while at < partition.until:
            query = urllib.parse.urlencode({"after": at, "limit": min(self.page, partition.until - at)})
            items = request_json(f"{partition.url}{'&' if '?' in partition.url else '?'}{query}", **self.http)["items"]
            if not items:
                raise ValueError(f"{partition.url} has no item {at + 1}, which its health promised")
            for item in items[: partition.until - at]:
                at += 1
                yield partition.url, at, json.dumps(item, separators=(",", ":"))

    def commit(self, end: dict) -> None:
        """A lost acknowledgement is made good by the next one: each covers all before it."""
        if self.ack:
            try:
                request_json(self.ack, body={"latest": end}, **self.http)
            except OSError:
                pass


class FeedStream(DataSource):
    """url, number, item (JSON text)."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "url string, number long, item string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(dict(self.options))


def poll(
    spark: SparkSession, options: dict[str, str], sink: Callable[[DataFrame, int], None], checkpoint: str, *, every: float = 300.0, cycles: int | None = None, pause: Callable[[float], None] = time.sleep
) -> list[str]:
    """Fetch what there is, hand it to ``sink`` (rows, number of the batch), acknowledge it, pause; ``cycles`` times or
    for ever. Tells what became of each cycle: ok, empty, not ready, or the error.

    A batch whose sink failed is the first of the next cycle, under its number and with the same items; it is acknowledged
    only after the sink has returned. The place in the feed is in ``checkpoint``, so another process may go on."""
    spark.dataSource.register(FeedStream)
    told: list[str] = []
    while cycles is None or len(told) < cycles:
        if told:
            pause(every)
        query = None
        try:
            stream = spark.readStream.format("paged_feed").options(**options).load()
            query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
            done = [p for p in query.recentProgress if p["numInputRows"] > 0]
            if done:
                end = done[-1]["sources"][0]["endOffset"]
                FeedReader(options).commit(ast.literal_eval(str(end)))  # told as the text of a dictionary
            told.append("ok" if done else "empty")
        except Exception as e:  # a cycle that fails is told and tried again, as a loop without an operator must
            told.append("not ready" if NOT_READY in str(e) else f"failed: {str(e).splitlines()[0][:200]}")
        finally:
            if query is not None and query.isActive:
                query.stop()
        told = told[-1000:] if cycles is None else told
    return told
