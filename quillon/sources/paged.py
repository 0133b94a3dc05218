"""A data source for paginated HTTP interfaces: one partition per start address, pages followed within it.

    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").option("urls", "http://a/x?split=train http://a/x?split=validation").load()
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Start(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = options["urls"].split()
        self.items, self.cursor = options.get("items", "data.chunks"), options.get("cursor", "data.nextCursor")
        self.most = int(options.get("maxPages", "1000"))
        self.tries, self.pause, self.timeout = int(options.get("tries", "3")), float(options.get("pause", "0.5")), float(options.get("timeout", "60"))

    def partitions(self) -> list[InputPartition]:
        return [_Start(u) for u in self.urls]

    def _fetch(self, url: str) -> dict:
        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as r:
                    return json.load(r)
            except OSError:
                if not left:
                    raise
                time.sleep(self.pause)
        raise AssertionError

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        def at(value, path: str):
            for k in path.split("."):
                value = value.get(k) if isinstance(value, dict) else None
            return value

        url = partition.url
        for page in range(self.most):
            answer = self._fetch(url)
            for n, item in enumerate(at(answer, self.items) or []):
                yield partition.url, page, n, json.dumps(item, separators=(",", ":"))
            cursor = at(answer, self.cursor)
            if not cursor:
                return
            base, _, query = partition.url.partition("?")
            url = base + "?" + "&".join(x for x in (query, "cursor=" + urllib.parse.quote(str(cursor))) if x)
        raise ValueError(f"{partition.url} has more than {self.most} pages")


class PagedJson(DataSource):
    """url, page, nth, item (JSON text)."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "url string, page int, nth int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
