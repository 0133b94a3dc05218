"""Near-duplicate lines by a segment-partition edit join.

Two lines at most TAU edits apart have one of TAU + 1 segments in common: each line is cut into that many even
segments, which are indexed under its length, and every line looks up the substrings of itself that such a segment
could have become (a few starting places per segment and length). Pairs that meet are verified with a banded
bit-parallel automaton: one bit per diagonal of the band and one word per number of edits.
Lengths and edits are counted in UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import connected_components
from quillon.llm.store import bounded_batches, materialize, pieces, row_keys, scratch
from quillon.llm.textarrays import mix, prefix_sums, rolling_hashes, utf8

TAU = 2
#: Default of ``edits_from``: shorter lines (in bytes) are not compared by edits, as two edits would be more than a tenth
#: of the line, and lines of a few bytes would all be linked. The method itself needs TAU + 1 bytes. Whether exact repeats
#: of shorter lines count is the caller's ``least``.
LEAST = 20
BUCKET = 64
#: Lines and bytes of a block of a crowded key.
BLOCK = 1024
BLOCK_BYTES = 8 << 20
BROADCAST_IDS = 400_000
#: One line in so many is looked at to find crowded keys before the shuffle, and their rows are dealt over so many
#: tasks. This only places rows: a crowded key that the look misses is found when its rows meet.
LOOK = 16
SPREAD = 64


def segments(length: np.ndarray, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the tau + 1 segments of lines of the given lengths; the last ones take the remainder."""
    parts = tau + 1
    size = length[:, None] // parts + (np.arange(parts)[None, :] >= parts - (length % parts)[:, None])
    return np.cumsum(size, axis=1) - size, size


def _keys(length: np.ndarray, i: int, hashes: np.ndarray) -> np.ndarray:
    return mix(hashes + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((i + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))


def lookups(raw: np.ndarray, offsets: np.ndarray, tau: int = TAU) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, is index entry): every line's own segments and the other substrings that it looks up.

    A line of length L looks among lines of length L - tau .. L. Segment i of a line shorter by d can begin at most i
    places off its own place, and at most tau - i places off it plus d, so that neither side of it needs more edits.
    """
    prefix = prefix_sums(raw)
    begin, length = offsets[:-1], np.diff(offsets)
    keys, lines, kinds = [], [], []
    for d in range(tau + 1):
        start, size = segments(length - d, tau)
        for i in range(tau + 1):
            for at in range(max(-i, d - (tau - i)), min(i, d + tau - i) + 1):
                place = start[:, i] + at
                fits = np.flatnonzero((place >= 0) & (place + size[:, i] <= length) & (length - d >= tau + 1))
                first = begin[fits] + place[fits]
                keys.append(_keys(length[fits] - d, i, rolling_hashes(raw, first, first + size[fits, i], prefix)))
                lines.append(fits)
                kinds.append(np.full(len(fits), d == 0 and at == 0))
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(kinds)


def within(a: list[bytes], b: list[bytes], tau: int = TAU) -> np.ndarray:
    """For each pair the edit distance if it is at most ``tau``, else tau + 1.

    Bit k of state e says that some alignment with at most e edits ends on diagonal k - tau. A step keeps the
    diagonals where the bytes match, and moves on from one edit less by a substitution, a deletion or an insertion.
    """
    out = np.full(len(a), tau + 1)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    order = np.argsort(la)
    order = order[np.abs(la - lb)[order] <= tau]
    full = np.uint8((1 << (2 * tau + 1)) - 1)
    at = 0
    while at < len(order):
        room = np.arange(1, len(order) - at + 1) * (la[order[at:]] + 2 * tau + 1)
        part = order[at : at + max(1, int(np.searchsorted(room, 4_000_000)))]
        at += len(part)
        width = int(la[part].max())
        # one pad byte that no text has, on both sides of b and behind a: equal tails add no edits
        left = np.frombuffer(b"".join(a[i].ljust(width, b"\xff") for i in part), np.uint8).reshape(len(part), width)
        right = np.frombuffer(b"".join((b"\xfe" * tau + b[i]).ljust(width + 2 * tau, b"\xff")[: width + 2 * tau] for i in part), np.uint8)
        right = right.reshape(len(part), width + 2 * tau)
        match = np.zeros((width, len(part)), np.uint8)
        for k in range(2 * tau + 1):
            match |= (left == right[:, k : k + width]).T.astype(np.uint8) << np.uint8(k)
        state = [np.full(len(part), ((1 << (e + 1)) - 1) << tau & int(full), np.uint8) for e in range(tau + 1)]
        for row in match:
            below = new = None
            for e in range(tau + 1):
                old = state[e]
                new_e = old & row
                if e:
                    new_e |= below | (below >> 1) | (new << np.uint8(1))
                    new_e &= full
                below, new = old, new_e
                state[e] = new_e
        end = (np.uint8(1) << (lb[part] - la[part] + tau).astype(np.uint8)).astype(np.uint8)
        for e in range(tau, -1, -1):
            out[part[(state[e] & end) > 0]] = e
    return out


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "line"):
            key, line, own = lookups(*utf8(part.column("line")))
            ids = part.column("id").to_numpy()[line]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(own)], ["key", "id", "own"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of an index entry and a lookup with one key; rows of a crowded key go on as (key, id) alone. Rows
    of keys that are known to be crowded (spread) may be in any partition and go on as they come."""
    names = ["a", "b", "crowded"]

    def pairs(key, ident, own) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        size = np.diff(np.append(first, len(key)))
        crowded = np.repeat(size > BUCKET, size)
        found = [np.zeros((2, 0), np.int64)]
        k, x, o = key[~crowded], ident[~crowded], own[~crowded]
        for d in range(1, BUCKET):
            if len(k) <= d or not (same := k[d:] == k[:-d]).any():
                break
            same &= (o[d:] | o[:-d]) & (x[d:] != x[:-d])
            p, q = x[:-d][same], x[d:][same]
            found.append(np.stack([np.minimum(p, q), np.maximum(p, q)]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(np.zeros(both.shape[1], bool))], names)
        if crowded.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[crowded]), pa.array(ident[crowded]), pa.array(np.ones(int(crowded.sum()), bool))], names)

    rest, flowing = None, None  # flowing: a crowded key whose rows still come
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "own", "spread")]
        if (known := now.pop()).any():
            yield pa.RecordBatch.from_arrays([pa.array(now[0][known]), pa.array(now[1][known]), pa.array(np.ones(int(known.sum()), bool))], names)
            now = [x[~known] for x in now]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        rest = None
        if flowing is not None and len(now[0]):
            n = int(np.searchsorted(now[0], flowing, "right"))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(now[0][:n]), pa.array(now[1][:n]), pa.array(np.ones(n, bool))], names)
            if n < len(now[0]):
                flowing = None
            now = [x[n:] for x in now]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        yield from pairs(*(x[:cut] for x in now))
        rest = [x[cut:] for x in now]
        if len(rest[0]) > BUCKET:
            flowing = rest[0][0]
            yield pa.RecordBatch.from_arrays([pa.array(rest[0]), pa.array(rest[1]), pa.array(np.ones(len(rest[0]), bool))], names)
            rest = None
    if rest is not None:
        yield from pairs(*rest)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([x.encode() for x in batch.column(c).to_pylist()] for c in ("line_a", "line_b"))
        good = pa.array(within(a, b) <= TAU)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], ["a", "b"])


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within a crowded key between two blocks of its lines, as edges to a local root."""
    rows = rows.drop_duplicates("id").sort_values("id", ignore_index=True)
    lines, block = [x.encode() for x in rows["line"]], rows["block"].to_numpy()
    root = np.arange(len(rows))
    for i in range(len(rows)):  # a row at a time keeps the pairs in memory few
        others = np.flatnonzero((np.arange(len(rows)) > i) & (root != root[i]))
        if rows["i"].iloc[0] != rows["j"].iloc[0]:
            others = others[block[others] != block[i]]
        near = others[within([lines[i]] * len(others), [lines[k] for k in others]) <= TAU]
        for k in near:
            root[root == max(root[i], root[k])] = min(root[i], root[k])
    ids = rows["id"].to_numpy()
    moved = root != np.arange(len(rows))
    return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})


def _near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        line, pivot = ([(x or "").encode() for x in batch.column(c).to_pylist()] for c in ("line", "pivot"))
        core = pa.array(within(line, pivot) <= TAU)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "line", "root")), core], ["key", "id", "line", "root", "core"])


def _crowded_links(crowded: DataFrame) -> DataFrame:
    """Links (a, b) that connect the lines (key, id, line) of crowded keys as all their links would. In a key of more
    lines than a block has, those within reach of its first line are one class through it and are not compared with each
    other; the others are compared with all, in blocks."""
    size = F.octet_length("line")
    sizes = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.sum(size).alias("bytes"), F.min(F.struct("id", "line")).alias("first"))
    sizes = materialize(sizes.select("key", ((F.col("lines") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).alias("big"), F.col("first.id").alias("root"), F.col("first.line").alias("pivot")), "crowded-sizes")
    held = sizes.where("big").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("pivot")), F.lit(0))).first()
    bounded = F.broadcast if held[0] <= BROADCAST_IDS and held[1] <= 32 * BROADCAST_IDS else (lambda x: x)
    big = crowded.join(bounded(sizes.where("big").drop("big")), "key")
    told = big.select("key", "id", "line", "root", "pivot").mapInArrow(_near_pivot, "key long, id long, line string, root long, core boolean")
    rest = crowded.join(bounded(sizes.where("big").select("key")), "key", "left_anti").select("key", "id", "line", F.lit(None).cast("long").alias("root"), F.lit(False).alias("core"))
    told = materialize(told.unionByName(rest), "crowded-told")

    def blocks(kind: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(kind) / BLOCK, F.coalesce(F.sum(F.when(kind, size)), F.lit(0)) / BLOCK_BYTES)).cast("int")

    dealt = told.groupBy("key").agg(blocks(~F.col("core")).alias("rest"), blocks(F.col("core")).alias("cores")).where("rest > 0")
    if (dealt := materialize(dealt, "crowded-blocks")).count() <= BROADCAST_IDS:
        dealt = F.broadcast(dealt)
    spot = F.xxhash64("id")
    block = F.when(F.col("core"), F.col("rest") + F.pmod(spot, F.greatest("cores", F.lit(1)))).otherwise(F.pmod(spot, F.col("rest")))
    last = F.when(F.col("core"), F.col("rest")).otherwise(F.col("rest") + F.col("cores")) - 1
    dealt = told.join(dealt, "key").select("key", "id", "line", block.cast("int").alias("block"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "line")
    compared = dealt.groupBy("key", "i", "j").applyInPandas(_block, "a long, b long")
    return compared.unionByName(told.where("core and id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.col("__key").alias("key"), F.col("nth"))


def _occurrences(docs: DataFrame, least: int, edits_from: int) -> DataFrame:
    lines = docs.select("doc_id", "__key", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    size = F.octet_length("line")
    lines = lines.where((size >= max(edits_from, least)) | (size >= least) & F.col("line").rlike(r"\S"))
    return lines.select("doc_id", "__key", "nth", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def line_classes(docs: DataFrame, *, least: int = LEAST, edits_from: int = LEAST) -> DataFrame:
    """Distinct lines of ``row_keys`` that repeat or have a near duplicate: h1, h2 (hashes of the line), first (place of
    the class's first line, by doc_id, key and line number; a null doc_id is the last). ``least`` and
    ``edits_from`` are those of ``line_dedup_report``."""
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        found = _line_classes(docs, least, edits_from)
        keep(found)
    return found


def _line_classes(docs: DataFrame, least: int, edits_from: int) -> DataFrame:
    distinct = _occurrences(docs, least, edits_from).groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n"), F.first("line").alias("line"))
    distinct = materialize(distinct.select(F.monotonically_increasing_id().alias("id"), "*"), "distinct-lines")
    emitted = "key long, id long, own boolean"
    long = distinct.where(F.octet_length("line") >= max(edits_from, TAU + 1))
    look = long.where(F.pmod(F.xxhash64("id"), F.lit(LOOK)) == 0).select("id", "line").mapInArrow(_emit, emitted)
    known = materialize(look.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("key", F.lit(True).alias("spread")), "crowded-keys")
    if known.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    rows = long.select("id", "line").mapInArrow(_emit, emitted).join(known, "key", "left").withColumn("spread", F.coalesce("spread", F.lit(False)))
    place = F.when(F.col("spread"), F.pmod(F.xxhash64("id"), F.lit(SPREAD))).otherwise(0)
    rows = rows.withColumn("place", place).repartition("key", "place").sortWithinPartitions("key").select("key", "id", "own", "spread")
    met = materialize(rows.mapInArrow(_meet, "a long, b long, crowded boolean"), "line-pairs")
    pairs = materialize(met.where("not crowded").select("a", "b").distinct(), "line-candidates")
    crowded = met.where("crowded").select(F.col("a").alias("key"), F.col("b").alias("id")).distinct()
    crowded = materialize(crowded, "crowded-lines")

    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(crowded.select("id")).distinct()
    needed = materialize(needed, "needed-lines")
    wanted = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    texts = materialize(distinct.select("id", "line").join(wanted, "id", "left_semi"), "needed-texts")
    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("id").alias(end), F.col("line").alias(f"line_{end}")), end)
    links = pairs.mapInArrow(_verify, "a long, b long")

    crowded = materialize(crowded.join(texts, "id"), "crowded-texts")
    links = materialize(links.unionByName(_crowded_links(crowded)), "line-links")

    parts = connected_components(links).select(F.col("node").alias("id"), "component")
    slim = distinct.select("id", "h1", "h2", "first", "n")
    classed = slim.join(parts, "id")
    firsts = classed.groupBy("component").agg(F.min("first").alias("first"))
    near = classed.drop("first").join(firsts, "component").select("h1", "h2", "first")
    same = slim.where("n > 1").join(parts.select("id"), "id", "left_anti").select("h1", "h2", "first")
    return materialize(near.unionByName(same).select("h1", "h2", "first"), "line-classes")


def dropped_lines(docs: DataFrame, *, least: int = LEAST, edits_from: int = LEAST) -> DataFrame:
    """doc_id, __key and the sorted numbers (from 0) of the lines that repeat an earlier line, for rows of ``row_keys``
    that have any."""
    seen = _occurrences(docs, least, edits_from).select("doc_id", "__key", "nth", "h1", "h2").join(line_classes(docs, least=least, edits_from=edits_from), ["h1", "h2"])
    again = seen.where(_place() != F.col("first"))
    return again.groupBy("doc_id", "__key").agg(F.sort_array(F.collect_set("nth")).alias("dropped"))


def line_dedup_report(docs: DataFrame, *, least: int = LEAST, edits_from: int = LEAST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_lines, n_dropped, dropped.

    Lines end at line feeds. A line of at least ``edits_from`` bytes is dropped if an equal line, or one linked to it through
    lines at most two edits apart, comes earlier by (doc_id, line number); a null doc_id comes last. A shorter line is
    dropped if an equal line comes earlier, it has at least ``least`` bytes and is not blank; with least = 1 that is
    every exact repeat. Null text has no lines, the empty text one. Rows that share doc_id and text are one document: its
    lines are no repetitions of each other's copy. Rows that share a doc_id only come one after the other, and so do rows
    without one; each is a document of its own. An empty table gives an empty result.
    """
    rows, _ = row_keys(docs.select("doc_id", "text"))
    out = rows.select("doc_id", "__key", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    lost = dropped_lines(rows, least=least, edits_from=edits_from).select(F.col("doc_id").alias("of"), F.col("__key").alias("key"), "dropped")
    out = out.join(lost, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("__key") == F.col("key")), "left")
    none = F.array().cast("array<int>")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, *, least: int = LEAST, edits_from: int = LEAST) -> DataFrame:
    """``docs`` (doc_id, text) with the lines that ``line_dedup_report`` names taken out of their texts. A row
    that loses lines and has nothing but blanks left goes, as all it said stands elsewhere; other rows and all columns
    stay, and n_chars, where there is one, counts what is left of a shortened text."""
    rows, _ = row_keys(docs)
    lost = dropped_lines(rows.select("doc_id", "__key", "text"), least=least, edits_from=edits_from).select(F.col("doc_id").alias("__of"), F.col("__key").alias("__of_key"), F.col("dropped").alias("__dropped"))
    joined = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("__of")) & (F.col("__key") == F.col("__of_key")), "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("__dropped"), i))
    short = F.col("__dropped").isNotNull() & F.col("text").isNotNull()
    joined = joined.withColumn("__new", F.when(short, F.array_join(kept, "\n")).otherwise(F.col("text")))
    joined = joined.where(~short | (F.trim(F.regexp_replace("__new", r"\s+", " ")) != ""))
    made = {"text": F.col("__new")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(short, F.length("__new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(made[c].alias(c) if c in made else rows[c] for c in docs.columns))
