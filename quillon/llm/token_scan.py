"""Documents' token counts from flat token files, found by their separators.

A token file is flat: 16-bit ids, little-endian, one document after another, each closed by the end-of-document id.
There is no index. Files of any size are read by byte ranges: Spark's text reader splits them, and its line feeds are
only where a range may begin. Within a range the bytes are put together again as blocks; each block is searched for the
separator with one vectorised comparison. A prefix scan over ranges and blocks then tells at which byte of the file each
block lies (and so which hits stand on a token's boundary), where a document that began in an earlier block started, and
how many documents came before.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.store import bounded_batches, fresh_path, materialize, pieces, scratch, write_binary_files

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level merge vocabularies cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = 50256
FILE_TOKENS = 4 << 20
BLOCK_BYTES = 1 << 19
#: Fixed value: what a text reader takes off the start of a file.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    if max(ranks.values()) >= 1 << 16 or SEPARATOR in ranks.values():
        raise ValueError(f"the ids of the vocabulary must be below {1 << 16} and other than {SEPARATOR}")
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, *, vocabulary: str = VOCABULARY, file_tokens: int = FILE_TOKENS) -> None:
    """Write docs (doc_id, text) as token files of about ``file_tokens`` each; null is an empty document.

    Behind every token file (even number in its name) comes one with the documents' ids in order (odd number; a byte
    that tells null and a 64-bit id each); it is read for the report only, never to find a boundary.
    """
    bounded_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([SEPARATOR], "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value)
        held: list[np.ndarray] = []
        ids: list[bytes] = []
        size = 0

        def made() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(held).tobytes()[:-2]  # the writer adds the last separator
            for value in (flat, b"".join(ids)):
                yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])

        for batch in batches:
            for part in pieces(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    tokens = encoding.encode_to_numpy(text or "", disallowed_special=()).astype("<u2")
                    held += (tokens, end)
                    ids.append(b"\x00" + bytes(8) if doc_id is None else b"\x01" + int(doc_id).to_bytes(8, "little", signed=True))
                    size += len(tokens) + 1
                    if size >= file_tokens:
                        yield from made()
                        held, ids, size = [], [], 0
        if held:
            yield from made()

    rows = docs.select("doc_id", F.col("text")).mapInArrow(run, "value binary")
    write_binary_files(rows, path, end.tobytes())


def _line_end(separator: int) -> bytes:
    """A byte that is no part of the separator: no separator reaches over a place where ranges are cut."""
    return next(bytes([x]) for x in (0x0A, 0x0D, 0x0B) if x not in separator.to_bytes(2, "little"))


def read_ranges(spark: SparkSession, path: str, *, separator: int = SEPARATOR) -> DataFrame:
    """file (hash of its path), size, start (of the byte range) and bytes of every line of the files below ``path``,
    without its end."""
    text = spark.read.option("lineSep", _line_end(separator).decode()).text(path)
    meta = F.col("_metadata")
    return text.select(F.xxhash64(meta.file_path).alias("file"), meta.file_size.alias("size"), meta.file_block_start.alias("start"), F.col("value").cast("binary").alias("bytes"))


_BLOCKS = "file long, size long, start long, block long, n long, places array<long>"


def scan_blocks(ranges: DataFrame, *, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, size, start, block (from 0 in its range), n (bytes) and places (bytes of the block at which the separator's
    two bytes stand, on a token's boundary or not) of every block of about ``block_bytes``; a longer line is a block."""
    end = _line_end(separator)
    low, high = separator.to_bytes(2, "little")
    names = [x.split()[0] for x in _BLOCKS.split(", ")]

    def scanned(key: tuple, block: int, held: list[bytes]) -> pa.RecordBatch:
        raw = np.frombuffer(end.join(held) + end, np.uint8)
        places = np.flatnonzero((raw[:-1] == low) & (raw[1:] == high))
        lists = pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), pa.array(places))
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*key, block, len(raw))), lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, held, size = None, 0, [], 0
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("file", "size", "start")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                now = tuple(keys[a].tolist())
                if now != key:
                    if held:
                        yield scanned(key, block, held)
                    key, block, held, size = now, 0, [], 0
                for line in batch.column("bytes").slice(a, b - a).to_pylist():
                    if size >= block_bytes:
                        yield scanned(key, block, held)
                        block, held, size = block + 1, [], 0
                    held.append(line)
                    size += len(line) + 1
        if held:
            yield scanned(key, block, held)

    return ranges.mapInArrow(run, _BLOCKS)


def stitch(blocks: DataFrame) -> DataFrame:
    """file, document (from 0 in its file), start (token) and n_tokens of every document, from the blocks' separators. A
    document that the file's end leaves without a separator is not counted.

    The prefix scan runs over a few numbers a block: its length, and for either parity of its place in the file how many
    separators it holds and the last one."""
    parity = [F.filter("places", lambda p: p % 2 == 0), F.filter("places", lambda p: p % 2 == 1)]
    slim = blocks.select("file", "size", "start", "block", "n", *(F.size(x).alias(f"count_{k}") for k, x in enumerate(parity)), *(F.when(F.size(x) > 0, F.element_at(x, -1)).alias(f"last_{k}") for k, x in enumerate(parity)))
    before = Window.partitionBy("file").orderBy("start", "block").rowsBetween(Window.unboundedPreceding, -1)
    # a text reader drops a byte order mark at the start; the last line has no end unless the file closes with one
    read = slim.groupBy("file").agg(F.when(F.sum("n") <= F.first("size") - 2, len(BYTE_ORDER_MARK)).otherwise(0).alias("mark"))
    slim = slim.join(read, "file").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("mark"))
    even = F.col("base") % 2 == 0
    slim = slim.withColumns({"count": F.when(even, F.col("count_0")).otherwise(F.col("count_1")), "last": F.col("base") + F.when(even, F.col("last_0")).otherwise(F.col("last_1"))})
    slim = slim.withColumns({"open": F.coalesce(F.max("last").over(before) + 2, F.lit(0)), "earlier": F.coalesce(F.sum("count").over(before), F.lit(0))})
    placed = blocks.select("file", "start", "block", "places").join(slim.select("file", "start", "block", "base", "open", "earlier"), ["file", "start", "block"])
    ends = F.filter(F.transform("places", lambda p: p + F.col("base")), lambda p: p % 2 == 0)
    placed = placed.select("file", "open", "earlier", ends.alias("ends"))
    each = F.transform("ends", lambda p, i: F.struct(F.when(i == 0, F.col("open")).otherwise(F.get(F.col("ends"), i - 1) + 2).alias("start"), p.alias("end")))
    each = placed.select("file", "earlier", F.posexplode(each).alias("i", "x"))
    half = lambda c: F.shiftright(c, 1)
    return each.select("file", (F.col("earlier") + F.col("i")).alias("document"), half(F.col("x.start")).alias("start"), half(F.col("x.end") - F.col("x.start")).alias("n_tokens"))


def _named(spark: SparkSession, path: str) -> DataFrame:
    """file, part, nth, content of the files that ``write_token_files`` made; part and nth stand in their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    name = F.col("_metadata.file_path")
    return files.select(F.xxhash64(name).alias("file"), F.regexp_extract(name, r"part-(\d+)-", 1).cast("int").alias("part"), F.regexp_extract(name, r"-c(\d+)\.", 1).cast("int").alias("nth"), "content")


def _ids(files: DataFrame) -> DataFrame:
    kind = np.dtype([("known", "u1"), ("id", "<i8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                listed = np.frombuffer(batch.column("content")[i].as_py()[:-2], kind)
                n = len(listed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(c)[i].as_py(), np.int32)) for c in ("part", "nth")]
                    + [pa.array(np.arange(n)), pa.array(listed["id"].astype(np.int64), mask=listed["known"] == 0)],
                    ["part", "nth", "document", "doc_id"],
                )

    return files.mapInArrow(run, "part int, nth int, document long, doc_id long")


def count_tokens(docs: DataFrame, path: str | None = None, *, vocabulary: str = VOCABULARY, file_tokens: int = FILE_TOKENS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text; other columns are ignored) as token files and count each document's tokens by
    scanning them: doc_id, n_tokens, file (number of the file), start (token of the file at which it starts).

    Null and empty texts have no tokens; null ids and repeated rows are documents of their own; an empty table gives
    an empty result. A doc_id that is no number of 64 bits is an error, as is a vocabulary that uses the separator's id.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write_token_files(docs, path, vocabulary=vocabulary, file_tokens=file_tokens)
    with scratch(spark) as keep:
        blocks = materialize(scan_blocks(read_ranges(spark, path), block_bytes=block_bytes), "token-blocks")
        keep(blocks)
    names = _named(spark, path).select("file", "part", "nth").where("nth % 2 = 0")
    counts = stitch(blocks).join(names, "file").select("part", "nth", "document", "start", "n_tokens")
    ids = _ids(_named(spark, path).where("nth % 2 = 1").select("part", (F.col("nth") - 1).alias("nth"), "content"))
    out = counts.join(ids, ["part", "nth", "document"])
    return out.select("doc_id", "n_tokens", F.format_string("%05d-%03d", "part", (F.col("nth") / 2).cast("int")).alias("file"), "start")
