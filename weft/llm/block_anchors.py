"""Repeated passages of a fixed number of words, by fixed-block anchors.

In a shard, non-overlapping blocks of every stretch are indexed by hash and every
rolling window of a block's size probes the index.  Hits are compared word by word
and extended, all those of a block together: step by step they part by the next word
to the right and to the left, until each is alone or reaches as far as a repeat can
matter.  A window is repeated where a hit has company for all that lies left and right
of it within the window: it lies in a maximal exact repeat through that anchor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .repeats import Words, repeats
from .text import between, numbered, prefix, window_starts


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair that occurs more than once; -1 for the others and where a or b is -1."""
    out = np.full(len(a), -1, np.int64)
    some = np.flatnonzero((a >= 0) & (b >= 0))
    if not len(some):
        return out
    a, b = a[some], b[some]
    bits = [int(x).bit_length() for x in (len(some), b.max(), a.max())]
    if sum(bits) < 63:
        packed = np.sort(a << (bits[0] + bits[1]) | b << bits[0] | np.arange(len(some)))
        by = packed & ((1 << bits[0]) - 1)
        new = np.append(True, np.diff(packed >> bits[0]) != 0)
    else:
        by = np.lexsort((b, a))
        new = np.append(True, (np.diff(a[by]) != 0) | (np.diff(b[by]) != 0))
    size = np.diff(np.append(np.flatnonzero(new), len(some)))
    out[some[by]] = np.where(np.repeat(size > 1, size), np.cumsum(new) - 1, -1)
    return out


def _hits(number: np.ndarray, first: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of blocks' words that an indexed block equals, itself included, and the number of each one's block."""
    at = window_starts(first, block)
    probe = between(prefix(number.astype(np.uint64), 4), at, at + block, 4)
    own = np.repeat(first[:-1], np.diff(first))[at]
    index = np.unique(probe[(at - own) % block == 0])
    if not len(index):
        return at[:0], at[:0]
    hit = index[np.minimum(np.searchsorted(index, probe), len(index) - 1)] == probe
    at = at[hit]
    _, example, which = np.unique(probe[hit], return_index=True, return_inverse=True)
    like = at[example][which]
    if not all((number[at + k] == number[like + k]).all() for k in range(block)):  # hashes met by chance
        which = np.unique(number[at[:, None] + np.arange(block)], axis=0, return_inverse=True)[1].ravel()
    return at, which


def repeated(units: Words, counts: np.ndarray, width: int) -> np.ndarray:
    """Mask of the window starts whose window is that of another; there are ``counts`` windows in each stretch."""
    first = units.first
    out = np.zeros(int(first[-1]), dtype=bool)
    block = (width + 1) // 2  # every window of ``width`` words holds a whole block, wherever the blocks begin
    _, number = numbered(units.raw, units.starts, units.ends, units.hashes)
    at, which = _hits(number, first, block)
    if not len(at):
        return out
    row = np.searchsorted(first, at, "right") - 1
    low, high = first[row], first[row + 1]

    def word(place: np.ndarray) -> np.ndarray:
        inside = (place >= low) & (place < high)
        return np.where(inside, number[np.clip(place, 0, len(number) - 1)], -1)

    right = [_named(which, which)]
    for k in range(width - block):
        right.append(_named(right[-1], word(at + block + k)))
    left = right[0]
    for k in range(width - block + 1):
        if k:
            left = _named(left, word(at - k))
        company = _named(left, right[width - block - k])
        out[at[company >= 0] - k] = True
    return out


def block_repeats(docs: DataFrame, width: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``repeats`` of words: (key, source, n, n_removed, spans, kept_sha256); see there for odd inputs."""
    return repeats(docs, Words, width, repeated, text, key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, F.col("n").alias("n_words"), "n_removed", "kept_sha256")
