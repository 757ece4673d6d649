"""Windows of units (bytes or words) that occur more than once, found shard by shard.

Equal windows have equal least gram hashes, so the windows of a text are cut into
runs of one least hash, and only runs whose hash another run shares (or which may
repeat within themselves) go on.  Each distinct stretch of text under such a run is
dealt to a shard by its hash; what happens in a shard is the operator's own method.

A hash with more text than a shard should hold is split further, again so that equal
windows stay together: by how far into the window its first least gram stands, and by
what all windows with so similar a distance have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import drop_table, table
from .text import SPACE, U, between, buffer, byte_sums, prefix, runs as mask_runs, slices, window_starts, words

#: Most bytes of distinct stretches under one key that go to a shard together; shards aim at a quarter.
SHARD = 1 << 20
#: A crowded hash is split by distances in so many parts; what is still crowded, by single windows.
SPLITS = 16


class Bytes:
    """Texts as bytes."""

    gram = 24

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.raw, self.first = raw, offsets

    def sums(self, seed: int) -> np.ndarray:
        return byte_sums(self.raw, seed)

    def bytes_of(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return begin, end

    def content(self, i: int, keep: np.ndarray | None = None) -> bytes:
        own = self.raw[self.first[i] : self.first[i + 1]]
        return (own if keep is None else own[keep]).tobytes()


class Words:
    """Texts as words between white space; ``raw`` has one space after each."""

    gram = 18

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        inside = ~SPACE[raw]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        self.raw = np.where(inside, raw, 32).astype(np.uint8)[keep]
        self.starts, self.ends, self.first, self.hashes = words(self.raw, np.concatenate([[0], np.cumsum(keep)])[offsets], ~SPACE)

    def sums(self, seed: int) -> np.ndarray:
        return prefix(self.hashes, seed)

    def bytes_of(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[begin], self.ends[end - 1]

    def content(self, i: int, keep: np.ndarray | None = None) -> bytes:
        own = slice(self.first[i], self.first[i + 1])
        a, b = self.starts[own], self.ends[own]
        if not len(a):
            return b""
        whole = self.raw[a[0] : b[-1]].tobytes()
        if keep is None:
            return whole
        begin, end = mask_runs(keep, np.zeros(0, np.int64))
        return b" ".join([whole[x:y] for x, y in zip((a[begin] - a[0]).tolist(), (b[end - 1] - a[0]).tolist())])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from block-wise running minima of both directions."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def least_runs(units, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and least hash of each run, and whether it may repeat within itself."""
    none = np.zeros(0, np.int64)
    offsets = units.first
    starts = window_starts(offsets, width)
    if not len(starts):
        return none, none, none.view(U), none.astype(bool)
    gram = min(units.gram, width)
    wide = width - gram + 1
    at = np.arange(int(offsets[-1]) - gram + 1)
    hashes = between(units.sums(1), at, at + gram, 1)
    least = sliding_least(hashes, wide)
    value = least[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)
    new[1:] |= np.isin(starts[1:], offsets)
    first = np.flatnonzero(new)
    begin = starts[first]
    count = np.diff(np.append(first, len(starts)))
    # where a window repeats within a run, its least gram stands early in one and again late in another
    early = np.append(np.flatnonzero(hashes[starts] == value), len(starts))
    late = np.flatnonzero(hashes[starts + wide - 1] == value)
    lowest = early[np.searchsorted(early, first)]
    highest = np.append(-width, late)[np.searchsorted(late, first + count - 1, "right")]
    own = (lowest < first + count) & (highest >= first) & (highest + wide - 1 > lowest)
    return begin, count, value[first], own


def _profile(docs: DataFrame, unit: type, width: int, text: str, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = buffer(batch.column("text"))
            whole = memoryview(raw)
            source = [hashlib.sha256(whole[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            units = unit(raw, offsets)
            offsets = units.first
            digest = source if unit is Bytes else [hashlib.sha256(units.content(i)).digest() for i in range(batch.num_rows)]
            begin, count, value, own = least_runs(units, width)
            cut = pa.array(np.searchsorted(begin, offsets), pa.int32())
            of = np.searchsorted(offsets, begin, "right") - 1
            columns = [value.view(np.int64), (begin - offsets[of]).astype(np.int32), count.astype(np.int32), own]
            yield pa.record_batch([batch.column("key"), pa.array(digest, pa.binary()), pa.array(source, pa.binary()), pa.array(np.diff(offsets)), *(pa.ListArray.from_arrays(cut, pa.array(c)) for c in columns)], names=["key", "sha", "source", "n", "value", "begin", "count", "own"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, sha binary, source binary, n bigint, value array<bigint>, begin array<int>, count array<int>, own array<boolean>")


def _extract(found: DataFrame, unit: type, width: int) -> DataFrame:
    """Of each candidate text: text, and start, windows, hash and digest of each stretch that goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            units = unit(*buffer(batch.column("text")))
            offsets = units.first
            values = [np.array(v, np.int64) for v in batch.column("shared").to_pylist()]
            parts = []
            for name, kind in (("value", np.int64), ("begin", np.int64), ("count", np.int64), ("own", bool)):
                column = batch.column(name)
                parts.append(np.asarray(column.flatten()).astype(kind))
            sizes = np.array([len(x) for x in batch.column("value")], np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)])
            keep = parts[3].copy()
            for i, v in enumerate(values):
                keep[first[i] : first[i + 1]] |= np.isin(parts[0][first[i] : first[i + 1]], v)
            of = np.repeat(np.arange(len(sizes)), sizes)[keep]
            value, begin, count = (p[keep] for p in parts[:3])
            at = begin + offsets[of]
            digests = pa.array(_digests(units, at, at + count + width - 1), pa.binary())
            cut = pa.array(np.searchsorted(of, np.arange(len(sizes) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, c) for c in (pa.array(value), pa.array(begin), pa.array(count), digests)]
            yield pa.record_batch([batch.column("sha"), batch.column("text"), *lists], names=["sha", "text", "value", "begin", "count", "digest"])

    return found.mapInArrow(run, "sha binary, text string, value array<bigint>, begin array<bigint>, count array<bigint>, digest array<binary>")


def _digests(units, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """128 bits of the bytes of each span of units."""
    whole = memoryview(np.ascontiguousarray(units.raw))
    digest = xxhash.xxh3_128_digest
    return [digest(whole[a:b]) for a, b in zip(*(x.tolist() for x in units.bytes_of(begin, end)))]


def _stretches(texts: DataFrame, unit: type, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            units = unit(*buffer(batch.column("text")))
            sizes = np.array([len(x) for x in batch.column("value")], np.int64)
            value, begin, count = (np.asarray(batch.column(c).flatten()) for c in ("value", "begin", "count"))
            at = begin + np.repeat(units.first[:-1], sizes)
            yield pa.record_batch([value, batch.column("digest").flatten(), count, pa.array(_parts(units, at, at + count + width - 1), pa.binary())], names=["value", "digest", "count", "part"])

    return texts.mapInArrow(run, "value bigint, digest binary, count bigint, part binary")


def _parts(units, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    whole = units.raw.tobytes()
    return [whole[a:b] for a, b in zip(*(x.tolist() for x in units.bytes_of(begin, end)))]


def _split(level: DataFrame, unit: type, width: int, step: int) -> DataFrame:
    """Stretches cut where the distance of a window's first least gram leaves a range of ``step`` distances.

    (parent, key, value, digest, begins, count, part): begins are the first windows within the parent of all
    equal pieces.  Windows that are equal have equal distances, so the same range, and in common all that
    every window of that range holds: both make the key.  A piece has no two equal windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "part", 1 << 18):
            units = unit(*buffer(batch.column("part")))
            offsets = units.first
            gram = min(units.gram, width)
            wide = width - gram + 1
            at = np.arange(int(offsets[-1]) - gram + 1)
            value = np.repeat(batch.column("value").to_numpy(), np.diff(offsets))
            least = np.flatnonzero(between(units.sums(1), at, at + gram, 1).view(np.int64) == value[at])
            start = window_starts(offsets, width)
            where = least[np.searchsorted(least, start)]
            part = (where - start) // step
            new = np.ones(len(start), dtype=bool)
            new[1:] = (where[1:] != where[:-1]) | (part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1) | np.isin(start[1:], offsets)
            first = np.flatnonzero(new)
            begin, count, where, part = start[first], np.diff(np.append(first, len(start))), where[first], part[first]
            low, high = part * step, np.minimum(part * step + step, wide) - 1
            of = np.searchsorted(offsets, begin, "right") - 1
            core = _digests(units, where - low, where - high + width)
            digests = _digests(units, begin, begin + count + width - 1)
            values = batch.column("value").to_numpy()[of]
            seen: dict[tuple[int, bytes], list[int]] = {}
            for i, place, digest in zip(of.tolist(), range(len(of)), digests):
                seen.setdefault((i, digest), []).append(place)
            one = np.array([p[0] for p in seen.values()], np.int64)
            keys = [xxhash.xxh3_64_intdigest(core[p] + int(part[p]).to_bytes(4) + int(values[p]).to_bytes(8, signed=True)) for p in one.tolist()]
            begins = [(begin[p] - offsets[of[p[0]]]).astype(np.int32) for p in seen.values()]
            parts = _parts(units, begin[one], begin[one] + count[one] + width - 1)
            yield pa.record_batch([batch.column("digest").take(pa.array(of[one])), np.array(keys, U).view(np.int64), values[one], pa.array([digests[p] for p in one.tolist()], pa.binary()), pa.array(begins, pa.list_(pa.int32())), count[one], pa.array(parts, pa.binary())], names=["parent", "key", "value", "digest", "begins", "count", "part"])

    return level.select("digest", "value", "part").mapInArrow(run, "parent binary, key bigint, value bigint, digest binary, begins array<int>, count bigint, part binary")


def _settle(parts: DataFrame, unit: type, width: int, repeated: Callable) -> tuple[DataFrame, list[DataFrame]]:
    """(digest, marks) of every distinct stretch that has repeated windows, and the tables that it is made from.

    marks are (first window, windows) pairs, one after the other.
    """
    made = [table(parts.groupBy("value", "digest").agg(F.count("*").alias("copies"), F.first("count").alias("count"), F.first("part").alias("part")).withColumn("key", F.col("value")), "stretches")]
    wide = width - min(unit.gram, width) + 1
    cold, several, links = [], [], []
    for depth, step in enumerate((-(-wide // SPLITS), 1, 0)):
        level = made[-1]
        # with copies, a stretch as a whole is settled, yet others are compared with it
        several.append(level.where("copies > 1").select(F.lit(depth).alias("depth"), "digest", F.array(F.lit(0), F.col("count").cast("int")).alias("marks")))
        sizes = level.groupBy("key").agg(F.sum(F.length("part").cast("bigint")).alias("bytes"), F.count("*").alias("n"))
        if depth:  # a piece repeats nothing within itself
            sizes = sizes.where("n > 1")
        keys = table(sizes.select("key", (F.col("bytes") > SHARD).alias("crowded")), "keys")
        made.insert(0, keys)
        crowded = step and not keys.where("crowded").isEmpty()
        cold.append(level.join(keys.where("not crowded") if crowded else keys, "key", "left_semi").select(F.lit(depth).alias("depth"), "key", "digest", "part"))
        if not crowded:
            break
        pieces = table(_split(level.join(keys.where("crowded"), "key", "left_semi"), unit, width, step), "pieces")
        links.append(pieces.select("parent", "digest", "begins"))
        made.insert(0, pieces)
        made.append(table(pieces.groupBy("key", "value", "digest").agg(F.sum(F.size("begins")).alias("copies"), F.first("count").alias("count"), F.first("part").alias("part")), "stretches"))
    every = cold[0]
    for more in cold[1:]:
        every = every.unionByName(more)
    total = every.agg(F.sum(F.length("part").cast("bigint")).alias("n")).first()["n"] or 0
    shards = 1 + 4 * total // SHARD

    def shard(group: pa.Table) -> pa.Table:
        units = unit(*buffer(group.column("part").combine_chunks()))
        offsets = units.first
        hit = repeated(units, np.diff(offsets) - width + 1, width)
        begin, end = mask_runs(hit, offsets[:-1])
        of = np.searchsorted(offsets, begin, "right") - 1
        flat = np.stack([begin - offsets[of], end - begin], axis=1).astype(np.int32).ravel()
        cut = pa.array(2 * np.searchsorted(of, np.arange(len(offsets))), pa.int32())
        marks = pa.ListArray.from_arrays(cut, pa.array(flat))
        out = pa.table({"depth": group.column("depth"), "digest": group.column("digest"), "marks": marks})
        return out.filter(pa.array(np.diff(np.asarray(cut)) > 0))

    dealt = every.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "depth", "digest", "part")
    found = table(dealt.groupBy("shard").applyInArrow(shard, "depth int, digest binary, marks array<int>"), "found")
    made.append(found)
    marks = None
    for depth in range(len(several) - 1, -1, -1):
        own = several[depth].unionByName(found.where(F.col("depth") == depth)).select("digest", "marks")
        if marks is not None:  # those of pieces, where the pieces stand in their parents
            moved = F.flatten(F.transform("begins", lambda b: F.transform("marks", lambda m, i: F.when(i % 2 == 0, m + b).otherwise(m))))
            own = own.unionByName(links[depth].join(marks, "digest").select(F.col("parent").alias("digest"), moved.alias("marks")))
        marks = own.groupBy("digest").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    return marks, made


def _spans(texts: DataFrame, unit: type, width: int) -> DataFrame:
    """(sha, n_removed, spans, kept_sha256) of texts with marks of their stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed, spans, kept = [], [], []
            units = unit(*buffer(batch.column("text")))
            offsets = units.first
            for i, marked in enumerate(batch.column("marked").to_pylist()):
                change = np.zeros(int(offsets[i + 1] - offsets[i]) + 1, np.int64)
                for m in marked:
                    pairs = np.array(m["marks"], np.int64).reshape(-1, 2)
                    np.add.at(change, m["begin"] + pairs[:, 0], 1)
                    np.add.at(change, m["begin"] + pairs.sum(1) + width - 1, -1)
                mask = np.cumsum(change[:-1]) > 0
                begin, end = mask_runs(mask, np.zeros(0, np.int64))
                removed.append(int(mask.sum()))
                spans.append(np.stack([begin, end], axis=1).ravel())
                kept.append(hashlib.sha256(units.content(i, ~mask)).hexdigest())
            yield pa.record_batch([batch.column("sha"), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept)], names=["sha", "n_removed", "spans", "kept_sha256"])

    return texts.mapInArrow(run, "sha binary, n_removed bigint, spans array<bigint>, kept_sha256 string")


def repeats(docs: DataFrame, unit: type, width: int, repeated: Callable, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What is repeated in each row's text: (key, source, n, n_removed, spans, kept_sha256).

    source is SHA-256 of the text and n its units.  spans holds first and last + 1
    unit of each maximal run covered by windows of ``width`` units that start
    anywhere else too, the same text included.  A null text is empty; a text shorter
    than ``width`` keeps all; repeated rows are copies of each other, so all of them
    lose everything if they have ``width`` units.

    ``repeated`` gets the units of a shard's stretches and the number of windows of
    each stretch, and gives a mask of the starts of windows that occur again.
    """
    profile = table(_profile(docs, unit, width, text, key), "profile")
    distinct = table(profile.groupBy("sha").agg(F.min(F.struct("source", "key")).alias("low"), F.count("*").alias("rows"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in ("value", "begin", "count", "own"))), "distinct")
    slim = table(profile.select("key", "sha", "source", "n"), "profile")
    drop_table(profile)
    some = distinct.where(F.size("value") > 0)
    each = some.select("sha", F.explode("value").alias("value"))
    shared = each.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    wanted = each.join(shared, "value").groupBy("sha").agg(F.collect_set("value").alias("shared"))
    named = some.select("sha", "low.*", "value", "begin", "count", "own").join(wanted, "sha", "left").where(F.col("shared").isNotNull() | F.exists("own", lambda x: x))
    named = named.withColumn("shared", F.coalesce("shared", F.array().cast("array<bigint>")))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") >= width).withColumn("source", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # one row of each text: two with the same key as well are harmless copies, told apart below
    joined = rows.join(named, (rows.source == named.source) & rows.key.eqNullSafe(named.key)).select("sha", "text", "value", "begin", "count", "own", "shared")
    texts = table(_extract(joined, unit, width), "candidates")
    counted = table(distinct.select("sha", "rows", "n"), "counted")
    drop_table(distinct)
    marks, made = _settle(_stretches(texts, unit, width), unit, width, repeated)
    places = texts.select("sha", F.explode(F.arrays_zip("begin", "digest")).alias("s")).select("sha", "s.*").distinct()
    marked = places.join(marks, "digest").groupBy("sha").agg(F.collect_list(F.struct("begin", "marks")).alias("marked"))
    found = table(_spans(texts.select("sha", "text").join(marked, "sha"), unit, width), "spans")
    for used in (texts, *made):
        drop_table(used)
    found = found.dropDuplicates(["sha"])
    empty = hashlib.sha256(b"").hexdigest()
    copied = (F.col("rows") > 1) & (F.col("n") >= width)
    result = counted.join(found, "sha", "left").select(
        "sha",
        F.when(copied, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(copied, F.array(F.lit(0).cast("bigint"), F.col("n"))).otherwise(F.coalesce("spans", F.array().cast("array<bigint>"))).alias("spans"),
        F.when(copied, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
    # written, so that Spark can split the join where many rows are copies of one text
    return slim.join(table(result, "result"), "sha").drop("sha").withColumnRenamed("key", key)
