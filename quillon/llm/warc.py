"""WARC archives as seekable Zstandard bundles.

A bundle is one file: a skippable frame that names the bundle, independent Zstandard frames of whole WARC records,
a skippable frame that maps every record identifier to its frame and its offset within the frame, and the footer
seek table of the Zstandard seekable format (skippable frame, magic number last). Any Zstandard tool decompresses
it; a reader of one record decompresses one frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.store import bounded_batches, fresh_path, materialize, scratch, write_binary_files

# Fixed values of the Zstandard frame and seekable formats.
SKIPPABLE_NAME = 0x184D2A50
SKIPPABLE_INDEX = 0x184D2A51
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = b"\xb1\xea\x92\x8f"

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEAST_REVISIT = 100
#: A digest with its response takes some 200 bytes, so this many stay below 32 MB when sent to every executor.
BROADCAST_DIGESTS = 150_000
# Fixed value: what may stand in a URI besides letters and digits; a per cent sign is taken for an escape already there.
URI_BYTES = "-._~:/?#[]@!$&'()*+,;=%"


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def uri_of(url: str | None, record_id: str) -> str:
    """``url`` as a URI: other characters are escaped; without a url the record's own identifier."""
    return quote(url, safe=URI_BYTES) if url else record_id


def record(
    kind: str, record_id: str, url: str | None, date: str, digest: str, length: int, payload: bytes, page_id: int | None,
    refers_to: tuple[int, str | None, str | None] | None = None,
) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its headers still tell length and digest of the full payload, and
    the response (``refers_to``: its page_id, url, and record identifier where only one row has that page and payload).
    A url that is no URI is kept, as JSON, in a field of our own."""
    uri = uri_of(url, record_id)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", length)]
    if uri != url:
        fields.append(("WARC-Page-Url", json.dumps(url)))
    if page_id is not None:
        fields.append(("WARC-Page-Id", page_id))
    if kind == "revisit":
        page, url, named = refers_to
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if named:
            fields.append(("WARC-Refers-To", f"<{named}>"))
        if url:
            fields.append(("WARC-Refers-To-Target-URI", uri_of(url, record_id)))
        fields += [("WARC-Refers-To-Date", date), ("WARC-Refers-To-Page-Id", page)]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at : body - 4].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    end = body + int(headers["Content-Length"])
    return headers, data[body:end], end + 4


class BundleWriter:
    """Collects records into frames; ``close`` gives the file without its last four bytes (the format's magic)."""

    def __init__(self, level: int = 3):
        self._pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self._index: list[tuple[str, int, int, int]] = []
        self._open: list[bytes] = []
        self._filled = self.bytes = 0

    @property
    def records(self) -> int:
        return len(self._index)

    def add(self, record_id: str, data: bytes) -> None:
        self._index.append((record_id, len(self._frames), self._filled, len(data)))
        self._open.append(data)
        self._filled += len(data)
        if self._filled >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self._open:
            frame = self._pack.compress(b"".join(self._open))
            self._frames.append(frame)
            self._sizes.append((len(frame), self._filled))
            self.bytes += len(frame)
            self._open, self._filled = [], 0

    def close(self) -> bytes:
        self._flush()
        index = self._pack.compress("\n".join(f"{i}\t{f}\t{at}\t{n}" for i, f, at, n in self._index).encode())
        name = hashlib.sha256(b"".join(self._frames)).hexdigest()[:32]
        before = _skippable(SKIPPABLE_NAME, name.encode())
        after = _skippable(SKIPPABLE_INDEX, index)
        # the table must count every frame before it, the skippable ones with no content of their own
        entries = [(len(before), 0), *self._sizes, (len(after), 0)]
        table = b"".join(struct.pack("<II", *x) for x in entries) + struct.pack("<IB", len(entries), 0) + SEEKABLE_MAGIC
        return (before + b"".join(self._frames) + after + _skippable(SKIPPABLE_SEEK, table))[: -len(SEEKABLE_MAGIC)]


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of every frame, read from the end of the file."""
    if data[-4:] != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    count, flags = struct.unpack("<IB", data[-9:-4])
    width = 12 if flags & 0x80 else 8
    start = len(data) - 9 - count * width
    out, at = [], 0
    for i in range(count):
        packed, size = struct.unpack("<II", data[start + i * width : start + i * width + 8])
        out.append((at, packed, size))
        at += packed
    return out


def _data_frames(data: bytes) -> list[tuple[int, int, int]]:
    return [x for x in seek_table(data) if x[2]]


def bundle_name(data: bytes) -> str:
    magic, n = struct.unpack("<II", data[:8])
    if magic != SKIPPABLE_NAME:
        raise ValueError("no bundle")
    return data[8 : 8 + n].decode()


def bundle_index(data: bytes) -> list[tuple[str, int, int, int]]:
    """(record identifier, frame, offset within the frame, length) of every record."""
    at, n, _ = seek_table(data)[-1]
    lines = zstandard.decompress(data[at + 8 : at + n]).decode()
    return [(i, int(f), int(o), int(k)) for i, f, o, k in (x.split("\t") for x in lines.split("\n") if x)]


def frame(data: bytes, number: int) -> bytes:
    at, packed, size = _data_frames(data)[number]
    return zstandard.decompress(data[at : at + packed], max_output_size=size)


def _urn(*parts) -> str:
    unique = hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()
    return f"urn:uuid:{unique[:8]}-{unique[8:12]}-{unique[12:16]}-{unique[16:20]}-{unique[20:32]}"


def _bundles(date: str):
    names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_url", "single")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, nth = BundleWriter(), 0
        task = TaskContext.get().partitionId()
        made = lambda: pa.RecordBatch.from_arrays([pa.array([out.close()], pa.binary())], ["value"])
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, length, digest, kind, refers, refers_url, single = (batch.column(c)[i].as_py() for c in names)
                # the one response that others revisit has an identifier they can tell; all others are numbered
                record_id = _urn("response", page, digest) if single and kind == "response" else _urn(page, url, digest, kind, task, nth)
                nth += 1
                other = None if kind == "response" else (refers, refers_url, _urn("response", refers, digest) if single else None)
                out.add(record_id, record(kind, record_id, url, date, digest, length, payload or b"", page, other))
                if out.bytes >= BUNDLE_BYTES:
                    yield made()
                    out = BundleWriter()
        if out.records:
            yield made()

    return run


def with_revisits(pages: DataFrame) -> DataFrame:
    """payload, payload_bytes, payload_digest, record_type, refers_to (page_id of the response), refers_url (its url) and
    single (one row only has the response's page_id and payload) beside page_id and url of pages (page_id, url, html).

    A null html is the empty payload. Of equal payloads of at least 100 bytes the one with the smallest page_id is
    the response; rows that repeat that page_id and payload are all responses. A null page_id is no candidate unless
    no row of its payload has an id; then all those rows are responses. Payloads are not shuffled: only digests that
    repeat are joined, from a broadcast where their number is small.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    per_page = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n", F.col("url"))))
    again = per_page.groupBy("payload_digest").agg(first.alias("first"), F.sum("n").alias("total")).where("total > 1 and first is not null")
    again = again.select("payload_digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), (F.col("first.n") == 1).alias("single"))
    with scratch(pages.sparkSession) as keep:
        again = materialize(again, "repeated-payloads")
        keep(again)
    if again.count() <= BROADCAST_DIGESTS:
        again = F.broadcast(again)
    rows = rows.join(again, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("refers_url"), F.coalesce("single", F.lit(False)).alias("single"),
    )


def write_archives(pages: DataFrame, path: str, *, date: str | None = None) -> None:
    """Write pages (page_id, url, html; other columns are ignored) as WARC bundles below ``path``. ``date`` is the
    records' WARC-Date, by default the time of the call."""
    bounded_batches(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    bundles = with_revisits(pages).mapInArrow(_bundles(date), "value binary")
    write_binary_files(bundles, path, SEEKABLE_MAGIC)


_READ = "bundle string, record_id string, frame int, frame_offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _READ.split(", ")]
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for data in batch.column("content"):
            data = data.as_py()
            name, current, text = bundle_name(data), -1, b""
            rows = []
            for record_id, k, at, length in bundle_index(data):
                if k != current:
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    current, text, rows = k, frame(data, k), []
                head, block, end = parse_record(text, at)
                if end != at + length or head["WARC-Record-ID"] != f"<{record_id}>":
                    raise ValueError(f"record {record_id} is not where the index says")
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if head["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"record {record_id} is damaged")
                url = json.loads(head["WARC-Page-Url"]) if "WARC-Page-Url" in head else head["WARC-Target-URI"]
                rows.append((name, record_id, k, at, head["WARC-Type"], number(head.get("WARC-Page-Id")), url,
                             int(head["WARC-Payload-Length"]), digest, number(head.get("WARC-Refers-To-Page-Id")), block))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles below ``path`` with its place; each response's payload is checked by its digest.
    Null urls and page_ids come back as nulls; a folder without records gives no rows."""
    return _files(spark, path).mapInArrow(_read, _READ)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """path, bundle, record_id, frame, frame_offset, length of every record; no data frame is decompressed. Identifiers are
    unique, also among repeated rows; a folder without records gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = data.as_py()
                rows = [(file, bundle_name(data), *x) for x in bundle_index(data)]
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "bundle", "record_id", "frame", "frame_offset", "length"])

    return _files(spark, path).mapInArrow(run, "path string, bundle string, record_id string, frame int, frame_offset long, length long")


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The raw records of ``wanted`` (rows of ``read_index``): record_id, record. Only their frames are decompressed.
    A row wanted twice is given twice; an empty ``wanted`` gives no rows."""
    spots = wanted.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("frame", "frame_offset", "length", "record_id"))).alias("spots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, places in zip(batch.column("content"), batch.column("spots").to_pylist(), strict=True):
                data, current, text, out = data.as_py(), -1, b"", []
                for x in places:
                    if x["frame"] != current:
                        current, text = x["frame"], frame(data, x["frame"])
                    out.append((x["record_id"], text[x["frame_offset"] : x["frame_offset"] + x["length"]]))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary())], ["record_id", "record"])

    return _files(spark, path).join(spots, "path").mapInArrow(run, "record_id string, record binary")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to,
    and where the record lies (bundle, record_id, frame, frame_offset). An empty table gives an empty result."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "record_id", "frame", "frame_offset"
    )
