"""Vectorised work on UTF-8 text: Arrow buffers, words, hashes, comparison of spans.

A word's hash takes its bytes eight at a time through a mixing function.  A window's
hash comes from prefix sums of a polynomial modulo 2**64, so one pass gives that of
every window; chosen texts can make such hashes meet (long words that differ by a
Thue-Morse pattern do so for every base), so they only propose what may be equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 1 << 20
U = np.uint64


def _class(text: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[int(x, 16) for x in text.split()]] = True
    return table


#: Bytes that end a word: space and 09 to 0D.
SPACE = _class("20 09 0a 0b 0c 0d")
#: Bytes of alphanumeric words: digits, a to z, and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that their texts hold about ``limit`` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        begin = 0
        while begin < len(sizes):
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, one after the other, and n + 1 offsets; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(column: pa.Array) -> list[bytes]:
    """Each text as bytes; null is empty."""
    raw, offsets = buffer(column)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class, never across texts: starts, ends, first run of each text (n + 1)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    m = inside[raw]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    edge = offsets[1:-1]
    at = edge[(edge > 0) & (edge < len(raw))]
    first[at] = m[at]
    last[at - 1] = m[at - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _odd(seed: int) -> int:
    return int(mix(np.array([seed * 7919 + 17], dtype=U))[0]) | 5


@lru_cache(maxsize=8)
def _bytes_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(_odd(seed + 100)))


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand; one base for all seeds keeps workers small."""

    def __init__(self) -> None:
        self.base = _odd(1)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n // (1 << 18)) << 18
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, x, U)])) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _sums(values: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.to(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def prefix(values: np.ndarray, seed: int) -> np.ndarray:
    """Prefix sums of values that the seed has changed."""
    return _sums(mix(values * U(_odd(seed + 200)) + U(seed)))


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each span from its prefix sums."""
    _, down = _POWERS.to(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(_odd(seed + 300)))


def byte_sums(raw: np.ndarray, seed: int) -> np.ndarray:
    return _sums(_bytes_table(seed)[raw])


#: Spans of more bytes are hashed and compared one by one.
LONG = 1 << 10
#: Keeps the first so many bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; beyond the end stand zeros."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of the bytes of each span."""
    size = ends - starts
    out = mix(size.astype(U) * U(_odd(seed + 400)) + U(seed))
    eights = _eights(raw)
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[todo], size[todo]
    while len(todo):
        out[todo] = mix(out[todo] ^ (eights[at] & _FIRST[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].data, seed)
    return out


def same_spans(raw: np.ndarray, starts: np.ndarray, other: np.ndarray, places: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes of ``raw`` from each start are those of ``other`` from each place."""
    out = np.ones(len(size), dtype=bool)
    one, two = _eights(raw), _eights(other)
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    a, b, left = starts[todo], places[todo], size[todo]
    while len(todo):
        same = (one[a] ^ two[b]) & _FIRST[np.minimum(left, 8)] == 0
        out[todo[~same]] = False
        more = same & (left > 8)
        todo, a, b, left = todo[more], a[more] + 8, b[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.array_equal(raw[starts[i] : starts[i] + size[i]], other[places[i] : places[i] + size[i]])
    return out


def numbered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An example of each distinct span and the number of each span's; hashes only propose, bytes decide."""
    _, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    of = example[which]
    if not ((size == size[of]) & same_spans(raw, starts, raw, starts[of], size)).all():
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(raw[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        example = np.unique(which, return_index=True)[1]
    return example, which


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, first word of each text (n + 1) and a hash of each word."""
    starts, ends, first = spans(raw, offsets, inside)
    return starts, ends, first, span_hashes(raw, starts, ends)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    total = int(first[-1])
    if total < width:
        return np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return np.flatnonzero(left >= width)


def covered(total: int, starts: np.ndarray, widths) -> np.ndarray:
    """Mask of the positions in any of [start, start + width)."""
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + widths, -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a mask, broken at the starts in ``first``."""
    if not mask.any():
        none = np.zeros(0, np.int64)
        return none, none
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    edge = first[(first > 0) & (first < len(mask))]
    begin[edge] = mask[edge]
    end[edge - 1] = mask[edge - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of so many items: the row and the place in its row of every item."""
    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - begin[row]
