"""Items of JSON documents of any size: a row an item, parsed as the text comes.

Spark's text reader cuts a document behind every closing brace, so gzip, any file system and its retries are Spark's own
and no text longer than what stands between two closing braces is ever held. The pieces of a document pass through one
task in order (a gzip file is one task as it stands; the pieces of other files are sorted by their place), and the parser
keeps the item it is in and nothing else. A document that ends before its brackets close gives the items before its end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'
_ALL = re.compile(_STRING + r'|[{}\[\],:]|"', re.DOTALL)
_DEEP = re.compile(_STRING + r'|[{}\[\]]|"', re.DOTALL)
ITEMS = "file string, path string, nth long, text string"


class ItemParser:
    """Takes a document in pieces, gives (path, nth, text) of the elements of every array that no other array holds, and
    (path, -1, null) where such an array begins. The path is the keys that lead to it, joined by dots."""

    def __init__(self):
        self.stack: list[str] = []  # '{', and '[' at most at the end: the array whose elements are items
        self.keys: list[str | None] = []  # the key that leads into the container at that place
        self.key: str | None = None
        self.depth = 0  # open brackets inside the item
        self.parts: list[str] | None = None  # the item so far
        self.nth, self.carry, self.last = 0, "", ""

    def _path(self) -> str:
        return ".".join(k for k in self.keys if k is not None)

    def open(self) -> bool:
        return bool(self.stack) or self.depth > 0

    def feed(self, text: str) -> Iterator[tuple]:
        text, self.carry = self.carry + text, ""
        at = begun = 0
        while m := (_DEEP if self.depth else _ALL).search(text, at):
            token = m.group()
            kind = token[0]
            if token == '"':  # a string that goes on in the next piece
                self.carry = text[m.start() :]
                text = text[: m.start()]
                break
            at = m.end()
            if self.depth:
                self.depth += (kind in "{[") - (kind in "}]")
            elif self.parts is not None and kind in "{[":
                self.depth = 1
            elif kind == '"':
                self.last = token
            elif kind == ":":
                self.key = json.loads(self.last)
            elif kind in "{[":
                self.stack.append(kind)
                self.keys.append(self.key)
                self.key = None
                if kind == "[":
                    self.nth, self.parts, begun = 0, [], at
                    yield self._path(), -1, None
            elif self.parts is not None and kind in ",]":
                item = "".join([*self.parts, text[begun : m.start()]]).strip()
                if item:
                    yield self._path(), self.nth, item
                    self.nth += 1
                self.parts, begun = ([], at) if kind == "," else (None, at)
                if kind == "]":
                    self.stack.pop()
                    self.keys.pop()
            elif kind in "}]" and self.stack:
                self.stack.pop()
                self.keys.pop()
        if self.parts is not None:
            self.parts.append(text[begun:])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size, name, parser, held = 0, None, ItemParser(), None

    def take(file, found):
        nonlocal size
        for path, nth, text in found:
            out.append((file, path, nth, text))
            size += len(text or "") + 64

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 4
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["file", "path", "nth", "text"])
        out.clear()
        return made

    def finish():
        """The last piece has lost a brace only if the document is still open without it."""
        if held is not None:
            take(name, parser.feed(held))
            if parser.open():
                take(name, parser.feed("}"))

    for b in batches:
        for file, value in zip(b.column("file"), b.column("value"), strict=True):
            file, value = file.as_py(), value.as_py()
            if file != name:
                finish()
                name, parser, held = file, ItemParser(), None
            if held is not None:
                take(name, parser.feed(held + "}"))
            held = value
            if size > 4 << 20:
                yield batch()
                size = 0
    finish()
    yield batch()


def read_arrays(spark: SparkSession, path: str, *, glob: str = "*.json*") -> DataFrame:
    """file, path, nth, text of every element of every document's outermost arrays; nth is -1 for the arrays themselves."""
    pieces = spark.read.option("lineSep", "}").option("pathGlobFilter", glob).text(path)
    zipped = all(f.endswith(".gz") for f in pieces.inputFiles())
    rows = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    if not zipped:  # a file may be read in several splits
        rows = rows.repartition("file").sortWithinPartitions("file", "block", "id")
    return rows.select("file", "value").mapInArrow(_parsed, ITEMS)
