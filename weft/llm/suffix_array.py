"""Repeated passages of a fixed number of bytes, by suffix arrays of bounded shards.

A shard's suffix array is built by bucket-pointer refinement.  Suffixes are first
sorted into buckets of a common q-gram.  Then one group of buckets after the other is
refined: its suffixes are sorted by the bucket pointers of the places just behind what
they are known to share, pointers are updated, and the parts are refined in the same
way, until each is a single suffix or agrees on a whole window.  Later groups meet the
pointers of finished ones, which stand for whole windows, so they need few steps.
Neighbours in the suffix array that parted are compared byte by byte, since a pointer
may part them behind the window's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .repeats import Bytes, repeats
from .text import same_spans, slices

#: Bytes of the first buckets.
FIRST = 7
#: Groups of buckets that are refined one after another.
GROUPS = 16
#: Bits of a position in a packed sort key.
PACK = 21


def refine(raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose ``width`` bytes occur more than once, in suffix order, and a number for those bytes."""
    n = len(raw)
    wide = np.concatenate([raw, np.zeros(FIRST, np.uint8)])
    key = np.zeros(n, np.int64)
    for k in range(min(FIRST, width)):
        key = key << 8 | wide[k : k + n]
    order = np.argsort(key)
    key = key[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, n))
    # a pointer is the place of the bucket's first suffix; shared is how many bytes the bucket agrees on
    pointer, shared = np.full(n + 1, -1, np.int64), np.full(n + 1, width, np.int64)
    pointer[order] = np.repeat(cut, size)
    several = np.repeat(size > 1, size)
    shared[order[several]] = min(FIRST, width)
    order = order[several]
    edge = cut[size > 1]
    bucket = pointer[order]
    for low, high in _groups(np.searchsorted(bucket, edge), len(order)):
        active = order[low:high]
        while len(active):
            depth = shared[active]
            active, depth = active[depth < width], depth[depth < width]
            later = np.minimum(active + depth, n)
            old, next_ = pointer[active], pointer[later] + 1
            if n < (1 << PACK) - 1:
                packed = np.sort(old << 2 * PACK | next_ << PACK | np.arange(len(active)))
                by = packed & ((1 << PACK) - 1)
                both = packed >> PACK
                fresh = np.append(True, both[1:] != both[:-1])[: len(by)]
            else:
                by = np.lexsort((next_, old))
                fresh = np.append(True, (old[by][1:] != old[by][:-1]) | (next_[by][1:] != next_[by][:-1]))[: len(by)]
            active, depth, old, later = active[by], depth[by], old[by], later[by]
            reach = np.minimum(depth + shared[later], width)
            part = np.flatnonzero(fresh)
            size = np.diff(np.append(part, len(active)))
            parent = np.flatnonzero(np.append(True, old[1:] != old[:-1])[: len(old)])
            first = np.repeat(parent, np.diff(np.append(parent, len(active))))
            pointer[active] = old + np.repeat(part, size) - first
            alone = np.repeat(size == 1, size)
            shared[active] = np.where(alone, width, reach)
            active = active[~alone]
    found = order[order <= n - width]
    found = found[np.argsort(pointer[found])]
    same = np.append(False, pointer[found[1:]] == pointer[found[:-1]])[: len(found)]
    parted = np.flatnonzero(~same)[1:]
    same[parted] = same_spans(raw, found[parted], raw, found[parted - 1], np.full(len(parted), width))
    more = same | np.append(same[1:], False)
    return found[more], np.cumsum(~same)[more]


def _groups(edges: np.ndarray, total: int) -> Iterator[tuple[int, int]]:
    """Ranges of about equal size that begin at edges."""
    ends = np.unique(np.append(edges, total)[np.searchsorted(edges, np.linspace(0, total, GROUPS + 1)[1:])])
    low = 0
    for high in ends.tolist():
        if high > low:
            yield low, high
            low = high


def repeated(units: Bytes, counts: np.ndarray, width: int) -> np.ndarray:
    """Mask of the window starts (so many from each stretch's first byte) whose window is that of another."""
    raw, starts = units.raw, units.first[:-1]
    is_start = np.zeros(len(raw) + 1, np.int64)
    np.add.at(is_start, starts, 1)
    np.add.at(is_start, starts + counts, -1)
    is_start = np.cumsum(is_start[:-1]) > 0
    position, number = refine(raw, width)
    own = is_start[position]
    position, number = position[own], number[own]
    out = np.zeros(len(raw), dtype=bool)
    if len(position):
        # equal windows still stand together: dropping positions kept their order
        same = number[1:] == number[:-1]
        more = np.append(False, same) | np.append(same, False)
        out[position[more]] = True
    return out


def suffix_repeats(docs: DataFrame, width: int = 200, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``repeats`` of bytes: (key, source, n, n_removed, spans, kept_sha256); see there for odd inputs."""
    return repeats(docs, Bytes, width, repeated, text, key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, F.col("n").alias("n_bytes"), "n_removed", (F.size("spans") / 2).cast("bigint").alias("n_spans"), "kept_sha256")


def without_repeats(docs: DataFrame, width: int = 200, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with every repeated passage taken out of its text, all its places included.

    Characters of which only a part is repeated stay whole.  Null texts stay null;
    repeated rows stay; columns may have any names.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"))
    found = suffix_repeats(packed, width, "text", "key").where("n_removed > 0").select("source", "spans").dropDuplicates(["source"])
    joined = packed.withColumn("own", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).join(found, F.col("own") == F.col("source"), "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if not spans or not out[i]:
                    continue
                b, kept, last = out[i].encode(), [], 0
                for x, y in zip(spans[::2], spans[1::2]):
                    while x < y and b[x] & 0xC0 == 0x80:
                        x += 1
                    while y > x and y < len(b) and b[y] & 0xC0 == 0x80:
                        y -= 1
                    kept.append(b[last:x])
                    last = y
                out[i] = b"".join([*kept, b[last:]]).decode()
            yield pa.record_batch([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    cleaned = joined.mapInArrow(run, StructType([joined.schema["row"], StructField("text", StringType())]))
    return cleaned.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names])
