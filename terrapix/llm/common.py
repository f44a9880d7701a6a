"""Helpers that the training-data operators share: shared folders, Arrow byte views, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import prepare, release, stored  # noqa: F401  the operators take them from here

#: Bytes of text that a task looks at in one numpy pass; a longer document is a pass of its own.
PASS_BYTES = 1 << 19
#: Prime modulus and base of the polynomial hashes, and the constants that mix 64-bit numbers.
PRIME, BASE = (1 << 61) - 1, 0x1B3F72E4A9C5D687 % ((1 << 61) - 1)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P, _S29, _S30, _S31, _S32, _S61 = np.uint64(PRIME), *(np.uint64(x) for x in (29, 30, 31, 32, 61))
_LOW29, _LOW30, _LOW31, _LOW32 = (np.uint64((1 << x) - 1) for x in (29, 30, 31, 32))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just id and text (null: empty), whatever else the table holds. Rows without an id can't be named: they are left out."""
    some = df.where(F.col(id_col).isNotNull())
    return some.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column without a copy, and the offsets (n + 1) of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """Modulo the prime, of any 64-bit numbers."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    middle = reduced(a1 * b0 + a0 * b1)
    return reduced(((a1 * b1) << np.uint64(1)) + (middle >> _S30) + ((middle & _LOW30) << _S31) + reduced(a0 * b0))


_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo the prime for i < n; what a usual pass needs is kept."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        made = []
        for x in (BASE, pow(BASE, -1, PRIME)):
            p = np.ones(1, np.uint64)
            while len(p) < max(n, 1 << 16):
                p = np.concatenate([p, times(p, np.full(1, pow(x, len(p), PRIME), np.uint64))])
            made.append(p)
        if n > 4 * PASS_BYTES:
            return made[0], made[1]
        _powers = made[0], made[1]
    return _powers


class Rolling:
    """Polynomial hashes, modulo a prime of 61 bits, of any byte range of one buffer."""

    STEP = 1 << 23  # bytes whose sums can't pass 64 bits


    def __init__(self, raw: np.ndarray):
        p, self.inverse = powers(len(raw) + 1)
        p, x = p[: len(raw)], raw.astype(np.uint64) + np.uint64(1)
        # Sums of products by the low 32 and the high 29 bits of each power: neither can pass 64 bits.
        self.low, self.high = np.zeros(len(raw) + 1, np.uint64), np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(x * (p & _LOW32), out=self.low[1:])
        np.cumsum(x * (p >> _S32), out=self.high[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), their lengths mixed in."""
        low = high = np.zeros(len(start), np.uint64)
        for k in range(0, int((end - start).max(initial=1)), self.STEP):
            a, z = np.minimum(start + k, end), np.minimum(start + k + self.STEP, end)
            low, high = reduced(low + reduced(self.low[z] - self.low[a])), reduced(high + reduced(self.high[z] - self.high[a]))
        total = reduced(low + (high >> _S29) + ((high & _LOW29) << _S32))
        return mix(times(total, self.inverse[start]) + (end - start).astype(np.uint64) * MIX2)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges in order, neither starts nor ends falling; taken together some PASS_BYTES at a time."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, a + PASS_BYTES)))
        out[i:j] = Rolling(raw[a : ends[j - 1]]).ranges(starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive keys (block prefix and suffix minima)."""
    n = len(keys) - w + 1
    if n <= 0:
        return keys[:0]
    blocks = -(-len(keys) // w)
    padded = np.full(blocks * w, np.iinfo(keys.dtype).max, keys.dtype)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs; touching intervals join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.ones(len(s), bool)
    first[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(first)
    return s[at], e[np.append(at[1:], len(s)) - 1]


#: Byte classes: what belongs to a word of letters, digits and everything past ASCII; and ASCII white space.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[9:14] = NOT_SPACE[32] = False


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that don't cross rows, and each one's row."""
    is_word = np.zeros(len(raw) + 2, bool)
    is_word[1:-1] = inside[raw]
    change = is_word[1:] != is_word[:-1]
    starts_at = is_word[1:] & change
    ends_at = is_word[:-1] & change
    edges = offsets[1:-1]
    edges = np.unique(edges[(edges > 0) & (edges < len(raw))])
    both = edges[is_word[edges] & is_word[edges + 1]]  # a row ends in a word and the next begins with one
    starts_at[both] = True
    ends_at[both] = True
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
