"""Vectorised words, hashes and windows over Arrow text columns.

Every function works on the UTF-8 bytes of a whole Arrow batch, so cost is linear in
bytes and memory is bounded by SLICE_BYTES, however long or many the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are hashed in runs of rows of about this many bytes.
SLICE_BYTES = 500_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1

#: Words are what lies between these bytes: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For matching despite punctuation: ASCII letters, digits and all non-ASCII characters make words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, cached and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(16, int(n).bit_length())
        have = np.full(size + 1, base & (2**64 - 1), _U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=_U)
        if size <= 1 << 21:
            _powers[base] = have
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to, bytes, offsets) of at most about size bytes, one row at least."""
    raw, bounds = texts(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to, raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


@dataclass
class Words:
    """Words of some rows: byte spans, hashes, and first[i]:first[i+1] for row i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, _U)
        np.cumsum(raw.astype(_U) * powers(_BASE, len(raw))[:-1], out=total[1:])
        h = (total[ends] - total[starts]) * powers(pow(_BASE, -1, 2**64), len(raw))[starts]
        return mix(h + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def words(raw: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = SPACE) -> Words:
    """The words of each row, split at the bytes marked in gaps, with 64-bit hashes."""
    if not len(raw):
        return Words(*(np.zeros(0, np.int64),) * 2, np.zeros(0, _U), np.zeros(len(bounds), np.int64))
    word = ~gaps[raw]
    full = bounds[:-1] < bounds[1:]
    begin, fin = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    fin[:-1] &= ~word[1:]
    head, tail = bounds[:-1][full], bounds[1:][full] - 1
    begin[head], fin[tail] = word[head], word[tail]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(fin) + 1
    return Words(starts, ends, span_hashes(raw, starts, ends), np.searchsorted(starts, bounds))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k in h, across rows; those that cross a row's end must be ignored."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, _U)
        np.cumsum(h * powers(_WORD_BASE, len(h))[:-1], out=total[1:])
        return mix((total[k:] - total[:-k]) * powers(pow(_WORD_BASE, -1, 2**64), len(h))[:n] + _U(k))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all rows, row by row, and offsets.

    A row of 1 to k - 1 words has one shingle, of all its words; a row without words has none.
    """
    n = w.counts
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    every = windows(w.hashes, k)
    out = np.empty(offsets[-1], _U)
    at = np.repeat(w.first[:-1] - offsets[:-1], size) + np.arange(offsets[-1])
    long = np.repeat(n >= k, size)
    out[long] = every[at[long]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        out[offsets[i]] = windows(w.hashes[w.first[i] : w.first[i + 1]], int(n[i]))[0]
    return out, offsets


def batches(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """slices() with the rows themselves."""
    for at, to, raw, bounds in slices(batch.column(batch.schema.get_field_index(column)), size):
        yield batch.slice(at, to - at), raw, bounds


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return np.ascontiguousarray(h).view(np.int64)
