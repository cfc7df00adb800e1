"""Vectorised kernels over Arrow text columns.

A batch's texts are one run of UTF-8 bytes with offsets; the kernels below work on the run as a whole, so the cost per
document is the cost of its bytes. A null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2**64
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows (null as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and the n + 1 bounds of each row's words."""
    word = ~SPACE[raw]
    first = np.empty(len(raw) + 1, dtype=bool)
    first[-1] = False
    first[:-1] = word
    first[1:-1] &= ~word[:-1]
    inner = off[1:-1]
    inner = inner[inner < len(raw)]
    first[inner] = word[inner]                  # a row's first byte starts a word of its own
    last = np.empty(len(raw) + 1, dtype=bool)   # last[i]: a word ends before byte i
    last[0] = False
    last[1:] = word
    last[1:-1] &= ~word[1:]
    ends_at = off[1:-1]
    ends_at = ends_at[ends_at > 0]
    last[ends_at] = word[ends_at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, off)


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words `[^\\x20\\x09-\\x0D]+` of each text."""
    raw, off = text_bytes(column)
    return np.diff(word_spans(raw, off)[2]).astype(np.int64)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    key = "inv" if inverse else "pow"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        step = np.full(max(n, _BLOCK), _BASE_INV if inverse else _BASE, dtype=np.uint64)
        step[0] = 1
        have = _POWERS[key] = np.multiply.accumulate(step)
    return have[:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (ascending, disjoint); equal spans have equal hashes.

    A span's polynomial is read off running sums over blocks of the bytes, so no span is visited by itself.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        lo = int(starts[done])
        upto = int(np.searchsorted(ends, lo + _BLOCK, side="right"))
        upto = max(upto, done + 1)              # a span longer than a block has a block of its own
        hi = int(ends[upto - 1])
        n = hi - lo
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(n, False), out=total[1:])
        s, e = starts[done:upto] - lo, ends[done:upto] - lo
        out[done:upto] = (total[e] - total[s]) * _powers(n + 1, True)[s] + (e - s).astype(np.uint64)
        done = upto
    return mix(out)


def shingle_hashes(column: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each lower-cased text, in text order, and the n + 1 bounds of the rows.

    A text with fewer words than `words` has its whole word sequence as its one shingle; one without words has none.
    """
    raw, off = text_bytes(column)
    starts, ends, bounds = word_spans(raw, off)
    h = span_hashes(LOWER[raw], starts, ends)
    return windows_of(h, bounds, words)


def windows_of(h: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(bounds)
    many = np.where(n >= words, n - words + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(many)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    row = np.repeat(np.arange(len(n)), many)
    first = bounds[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    left = np.minimum(words, n)[row]            # words in each shingle
    out = left.astype(np.uint64)
    for i in range(words):
        inside = left > i
        nxt = mix(out * _BASE + h[np.minimum(first + i, len(h) - 1)])
        out = nxt if inside.all() else np.where(inside, nxt, out)
    return out, at


def bounded(batches, column: str = "text", most: int = 2 << 20):
    """The record batches cut into runs of rows with about `most` bytes in `column` (one row may hold more)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(size)]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
