"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

A text is cut before every run of blanks; no piece reaches over such a cut, so each distinct unit of a batch is
segmented once and all its occurrences share the result. The trie is walked from every byte of all units at once;
the best segmentation is then found position by position, again for all units at once. A character without a piece
becomes its bytes. Blanks stand for the whitespace marker inside; a real marker character has no piece and survives
as bytes, so decoding gives every text back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import bounded_batches, pieces
from quillon.llm.textarrays import span_hashes, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: Longer units are segmented one by one; their number of steps would hold up all others.
LONG = 64
BATCH_BYTES = 1 << 19

# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


@dataclass(frozen=True)
class Trie:
    """A double array: the child of state s by byte b is base[s] + b, if check there is s; value is a piece or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(keys: dict[bytes, int]) -> Trie:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys.items():
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][b]
            values[node] = value
        size = len(children) * 2 + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        low, slot = 1, {0: 0}
        value[0] = values[0]
        queue = [0]
        for node in queue:
            kids = sorted(children[node])
            if not kids:
                continue
            at = low
            while True:  # the first place where all children fit
                at = taken.index(0, at)
                start = at - kids[0]
                if start >= 0 and not any(taken[start + b] for b in kids):
                    break
                at += 1
            if len(kids) == 1 and at == low:
                low = at
            while low < size and taken[low]:
                low += 1
            here = slot[node]
            base[here] = start
            for b in kids:
                kid = children[node][b]
                taken[start + b] = 1
                slot[kid] = start + b
                check[start + b] = here
                value[start + b] = values[kid]
                queue.append(kid)
            if start + 512 > size - 256:
                grown = size
                base, check, value = (np.concatenate([x, np.full(grown, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                taken.extend(bytes(grown))
                size += grown
        return Trie(base, check, value)


@dataclass(frozen=True)
class Vocabulary:
    trie: Trie
    score: np.ndarray  # log score of each piece
    fallback: float  # log score of a character that becomes bytes
    byte_piece: np.ndarray  # the piece of each byte
    start: np.ndarray  # of each piece in ``text``; one more for the end
    text: np.ndarray  # the bytes of all pieces


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field, wire type, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, kind, data[at : at + n]
            at += n


def read_pieces(model: bytes) -> tuple[list[tuple[str, float, int]], bool]:
    """((piece, score, type) in order of id, whether the scores are unigram log probabilities)."""
    out, unigram = [], True
    for field, _, value in _fields(model):
        if field == 1:
            piece, score, kind = "", 0.0, NORMAL
            for f, _, v in _fields(value):
                if f == 1:
                    piece = v.decode()
                elif f == 2:
                    score = float(np.frombuffer(v, np.float32)[0])
                elif f == 3:
                    kind = v
            out.append((piece, score, kind))
        elif field == 2:
            unigram = next((v for f, _, v in _fields(value) if f == 3), 1) == 1
    return out, unigram


def vocabulary(entries: list[tuple[str, float, int]], unigram: bool) -> Vocabulary:
    """Pieces of a unigram model keep their scores. Those of a merge model are ranks, not log scores: piece number r
    gets the log of Zipf's law, 1 / (r + 3), normalised; whitespace runs, which have no rank, come last."""
    usable = [k in (NORMAL, USER) for _, _, k in entries]
    score = np.array([s for _, s, _ in entries], np.float64)
    if not unigram:
        rank = np.where(score < -1e8, len(entries), -score)
        mass = 1 / (rank + 3)
        score = np.log(mass / mass[usable].sum())
    inner = [p.replace(MARKER, " ").encode() for p, _, _ in entries]
    byte_piece = np.full(256, -1, np.int64)
    for i, (piece, _, kind) in enumerate(entries):
        if kind == BYTE:
            byte_piece[int(piece[3:5], 16)] = i
            inner[i] = bytes([int(piece[3:5], 16)])
        elif kind in (CONTROL, UNKNOWN):
            inner[i] = b""
    if (byte_piece < 0).any():
        raise ValueError("the model has no byte fallback")
    if any(b" " in p.lstrip(b" ") for p, u in zip(inner, usable, strict=True) if u):
        raise ValueError("a piece reaches over a blank")
    trie = Trie.of({p: i for i, (p, u) in enumerate(zip(inner, usable, strict=True)) if u and p})
    start = np.concatenate([[0], np.cumsum([len(p) for p in inner])])
    return Vocabulary(trie, score, float(score[usable].min()) - 10, byte_piece, start, np.frombuffer(b"".join(inner), np.uint8))


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each span."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _edges(v: Vocabulary, raw: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte, length, piece or -1) of all pieces that begin at any byte, and of characters without a piece."""
    at = np.arange(len(raw))
    state = np.zeros(len(raw), np.int64)
    size = np.minimum(1 + (raw >= 0xC0).astype(np.int64) + (raw >= 0xE0) + (raw >= 0xF0), stop - at)
    alone = (raw & 0xC0) != 0x80
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = 0
    while len(at):
        below = v.trie.base[state] + raw[at + depth]
        good = v.trie.check[below] == state
        at, state = at[good], below[good].astype(np.int64)
        depth += 1
        piece = v.trie.value[state]
        ends = piece >= 0
        found.append((at[ends], np.full(int(ends.sum()), depth), piece[ends]))
        alone[at[ends & (size[at] == depth)]] = False
        more = at + depth < stop[at]
        at, state = at[more], state[more]
    bare = np.flatnonzero(alone)
    found.append((bare, size[bare], np.full(len(bare), -1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _best(v: Vocabulary, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all units in order, first of every unit) of the best segmentations."""
    unit = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at, size, piece = _edges(v, raw, offsets[1:][unit])
    gain = np.where(piece >= 0, v.score[piece], v.fallback)
    node = at + unit[at]  # a unit of n bytes has n + 1 nodes
    best = np.full(len(raw) + len(offsets) - 1, -np.inf)
    first = offsets[:-1] + np.arange(len(offsets) - 1)
    best[first] = 0.0
    step, name = np.zeros(len(best), np.int64), np.full(len(best), -1, np.int64)
    within = at - offsets[unit[at]]
    is_long = np.diff(offsets)[unit[at]] > LONG
    short = np.flatnonzero(~is_long)
    rank = within[short] * 64 + size[short]  # no piece is longer than a short unit
    short = short[np.argsort(rank, kind="stable")]
    rank = within[short] * 64 + size[short]
    cuts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else np.zeros(0, int)
    for a, b in zip(cuts, np.append(cuts[1:], len(rank)), strict=False):  # without short units there are no cuts
        e = short[a:b]
        to = node[e] + size[e]
        value = best[node[e]] + gain[e]
        better = value > best[to]
        to, e = to[better], e[better]
        best[to], step[to], name[to] = value[better], size[e], piece[e]
    long = np.flatnonzero(is_long)
    long = long[np.lexsort((size[long], at[long]))]
    score = dict.fromkeys(node[long].tolist(), -np.inf)
    for u in np.unique(unit[at[long]]):
        score[int(first[u])] = 0.0
    for n, s, p, g in zip(node[long].tolist(), size[long].tolist(), piece[long].tolist(), gain[long].tolist(), strict=True):
        value = score[n] + g
        if value > score.get(n + s, -np.inf):
            score[n + s] = value
            step[n + s], name[n + s] = s, p
    # walk back from every unit's end
    live = np.flatnonzero(np.diff(offsets) > 0)
    cursor = offsets[1:][live] + live
    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    while len(live):
        s, p = step[cursor], name[cursor]
        cursor = cursor - s
        spans.append((cursor - live, s, p))
        more = cursor > first[live]
        live, cursor = live[more], cursor[more]
    at, size, piece = (np.concatenate(x) for x in zip(*spans, strict=True))
    order = np.argsort(at)
    at, size, piece = at[order], size[order], piece[order]
    count = np.where(piece >= 0, 1, size)
    out = np.repeat(piece, count)
    bare = np.repeat(piece < 0, count)
    out[bare] = v.byte_piece[raw[_ragged(at[piece < 0], size[piece < 0])]]
    per_unit = np.bincount(unit[at], weights=count, minlength=len(offsets) - 1).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(per_unit)])


def encode_batch(v: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first id of every row, and the bytes that were encoded, with offsets: each text behind one blank)."""
    raw, offsets = utf8(column)
    n = np.diff(offsets)
    filled = n > 0
    shifted = np.concatenate([[0], np.cumsum(n + filled)])
    data = np.full(shifted[-1], 32, np.uint8)  # a text that is not empty gets a blank before it
    data[_ragged(shifted[:-1] + filled, n)] = raw
    blank = data == 32
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = blank[1:] & ~blank[:-1]
    cut[shifted] = True
    edge = np.flatnonzero(cut)
    begin, end = edge[:-1], edge[1:]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64), data, shifted
    _, one, which = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
    # units that share a hash share a segmentation only if their bytes are equal
    length = end - begin
    other = length != length[one][which]
    there = np.flatnonzero(~other)
    unequal = data[_ragged(begin[there], length[there])] != data[_ragged(begin[one][which[there]], length[there])]
    other[np.repeat(there, length[there])[unequal]] = True
    apart = np.flatnonzero(other)
    which[apart] = len(one) + np.arange(len(apart))
    one = np.concatenate([one, apart])
    size = length[one]
    unit_raw = data[_ragged(begin[one], size)]
    ids, first = _best(v, unit_raw, np.concatenate([[0], np.cumsum(size)]))
    per = np.diff(first)[which]
    tokens = ids[_ragged(first[which], per)]
    return tokens, np.concatenate([[0], np.cumsum(per)])[np.searchsorted(begin, shifted)], data, shifted


def decode_batch(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, the blank before each still there."""
    size = (v.start[1:] - v.start[:-1])[ids]
    return v.text[_ragged(v.start[ids], size)], np.concatenate([[0], np.cumsum(size)])[first]


def load(path: str = MODEL) -> Vocabulary:
    with open(path, "rb") as f:
        return vocabulary(*read_pieces(f.read()))


def encode(docs: DataFrame, *, model: str = MODEL, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array<int> column of piece ids; null and empty texts have no ids. Other columns stay."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    kept = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, BATCH_BYTES):
                tokens, first, _, _ = encode_batch(shared.value, part.column(text))
                made = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), made], [*kept, ids])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept).mapInArrow(run, f"{kinds}, `{ids}` array<int>")


def decode(tokens: DataFrame, *, model: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the text of its id column; a null list gives the empty text. Other columns stay."""
    bounded_batches(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(load(model))
    kept = [c for c in tokens.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            n = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            data, ends = decode_batch(shared.value, lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(n)]))
            texts = [bytes(data[a + 1 : b]).decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, text])

    kinds = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in kept)
    return tokens.select(*kept).mapInArrow(run, f"{kinds}, `{text}` string")


def round_trip(docs: DataFrame, *, model: str = MODEL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_tokens, ids_sha256 (of the ids
    as little-endian 32-bit integers), text_sha256 (of the decoded text), exact (decoding gave the text back).

    Null counts as the empty text, which has no tokens. Repeated rows are encoded each; null ids stay null; an empty
    table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for part in pieces(batch, "text", BATCH_BYTES):
                tokens, first, data, offsets = encode_batch(v, part.column("text"))
                back, ends = decode_batch(v, tokens, first)
                flat = tokens.astype("<i4")
                exact = np.array([bool(np.array_equal(back[a:b], data[c:d])) for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:], strict=True)])
                named = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)]
                said = [hashlib.sha256(back[a + 1 : b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first)), pa.array(named), pa.array(said), pa.array(exact, pa.bool_())],
                    ["doc_id", "n_tokens", "ids_sha256", "text_sha256", "exact"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, text_sha256 string, exact boolean")
