"""Vectorised words and hashes over the bytes of an Arrow string column."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Bytes of a word: digits, lower-case letters, everything beyond ASCII (after lower-casing A-Z).
WORD_BYTE = np.zeros(256, np.bool_)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        n = max(n, 1 << 20)
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (rows + 1) of a string or binary column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: Spans longer than this are hashed one by one.
_LONG_SPAN = 512
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span: equal bytes have equal hashes wherever they stand.

    Eight bytes at a time are mixed into the state, for all spans at once, so no pattern of letters cancels out;
    two different spans share a hash with a chance of 2**-64."""
    size = ends - starts
    state = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(_MULTIPLIER))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))  # the eight bytes from every place
    live = np.flatnonzero((size > 0) & (size <= _LONG_SPAN))
    at, left = starts[live], size[live]
    while len(live):
        block = eights[at] & _TAILS[np.minimum(left, 8)]
        state[live] = mix((state[live] ^ block) * np.uint64(_MULTIPLIER))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG_SPAN):
        state[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return state


def rolling_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """A weaker hash of each span from one prefix sum, cheap where spans overlap. Long periodic texts can collide, so
    it may only propose candidates whose bytes are compared afterwards."""
    _, down = _power_tables(len(raw) + 1)
    prefix = prefix_sums(raw) if prefix is None else prefix
    value = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    up, _ = _power_tables(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, first word of every row: rows + 1 entries)."""
    raw, offsets = utf8(column)
    raw = LOWER[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = WORD_BYTE[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a word may not reach over the end of a row: cut the spans at row boundaries
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    if len(cuts) and len(starts):
        cuts = np.unique(cuts)
        k = np.searchsorted(starts, cuts, "left") - 1
        cuts = cuts[(k >= 0) & (ends[np.maximum(k, 0)] > cuts)]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return span_hashes(raw, starts, ends), np.searchsorted(starts, offsets, "left")


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of every element, from the rows' first elements."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
