"""SimHash fingerprints and exact Hamming joins by vantage-point trees.

A vantage-point tree over a bounded sample of fingerprints cuts Hamming space into
regions.  Every fingerprint has one home region; by the triangle bound it visits as
a guest each other region that may hold a partner within the radius.  Regions are
dealt to tasks, which go on with smaller trees of their own and compare what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import table
from .text import slices, strings

#: Fingerprints that the driver sees to choose vantage points.
SAMPLE = 1 << 14
#: Fingerprints of a region: at least, and beyond ``MANY`` regions at most.
REGION, MANY, REGION_MOST = 1 << 10, 1 << 8, 1 << 20
#: A task's own tree ends at so many.
LEAF = 1 << 10

U = np.uint64


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64, seed 42, of each shingle of the lower-cased words, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, 42)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())]


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit; a tie is 0, and so is no hash at all."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp bigint) of each row.  Null and empty texts get zero; repeated rows are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [fingerprint(np.array(shingle_hashes(t, width), dtype=U)) for t in strings(batch.column("text"))]
            yield pa.record_batch([batch.column("key"), pa.array(got, pa.int64())], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp bigint").withColumnRenamed("key", key)


def _distance(x: np.ndarray, v: int) -> np.ndarray:
    return np.bitwise_count(x ^ U(v)).astype(np.int16)


def _split(points: np.ndarray) -> tuple[int, int] | None:
    """The vantage point, of some tried, that spreads the points most, and the median distance from it."""
    best = None
    for v in points[np.linspace(0, len(points) - 1, 12).astype(int)]:
        d = _distance(points, v)
        cut = int(np.median(d))
        if cut == d.max():
            cut -= 1
        inner = int((d <= cut).sum())
        # what must visit the other side is near the boundary: prefer few there, then even halves
        if 0 < inner < len(points):
            cost = (abs(2 * inner - len(points)) + int((d == cut).sum())) / len(points)
            if best is None or cost < best[0]:
                best = cost, int(v), cut
    return best and best[1:]


def plan(sample: np.ndarray, depth: int):
    """Nested (vantage point, distance, inner, outer); None is a region."""
    if not depth or len(sample) < 2 or (found := _split(sample)) is None:
        return None
    d = _distance(sample, found[0])
    return (*found, plan(sample[d <= found[1]], depth - 1), plan(sample[d > found[1]], depth - 1))


def route(node, fps: np.ndarray, homes: np.ndarray, guests: np.ndarray, radius: int, at: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(region, indices at home, indices of guests): two within the radius meet once, where one of them is at home."""
    if not len(homes) and not len(guests):
        return
    if node is None:
        yield at, homes, guests
        return
    v, cut, inner, outer = node
    dh, dg = _distance(fps[homes], v), _distance(fps[guests], v)
    yield from route(inner, fps, homes[dh <= cut], guests[dg <= cut + radius], radius, 2 * at)
    near = homes[(dh <= cut) & (dh > cut - radius)]
    yield from route(outer, fps, homes[dh > cut], np.concatenate([near, guests[dg > cut - radius]]), radius, 2 * at + 1)


def _forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what chains of distance up to ``radius`` connect.

    Takes nodes off a list of unvisited ones, so memory stays linear even where all are close.
    """
    left = np.arange(len(points))
    a, b = [], []
    while len(left) > 1:
        block = left[: max(1, min(256, (1 << 22) // len(left)))]
        near = np.bitwise_count(points[block][:, None] ^ points[left][None, :]) <= radius
        lone = near.sum(1) == 1
        if lone.all():
            left = left[len(block) :]
            continue
        # grow one component from the first node that has a partner
        if lone.any():
            gone = np.zeros(len(left), dtype=bool)
            gone[: len(block)] = lone
            left = left[~gone]
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found = np.zeros(len(left), dtype=bool)
            parent = np.zeros(len(left), dtype=np.int64)
            for k in range(0, len(front), 64):
                part = front[k : k + 64]
                hit = np.bitwise_count(points[part][:, None] ^ points[left][None, :]) <= radius
                new = hit.any(0) & ~found
                parent[new] = part[hit[:, new].argmax(0)]
                found |= new
            a.append(parent[found])
            b.append(left[found])
            front, left = left[found], left[~found]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _search(homes: np.ndarray, guests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of one region, by a tree of its own."""
    fps = np.concatenate([homes, guests])
    # leaves are found for homes; a split that gains nothing falls back to the whole
    tree = plan(homes, max(0, int(np.ceil(np.log2(max(1, len(homes)) / LEAF)))))
    a, b = [], []
    for _, h, g in route(tree, fps, np.arange(len(homes)), np.arange(len(homes), len(fps)), radius):
        if len(h):
            both = np.concatenate([h, g])
            x, y = _forest(fps[both], radius)
            a.append(fps[both[x]])
            b.append(fps[both[y]])
    none = np.zeros(0, U)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) bigint: links within ``radius`` that connect whatever all such links connect.

    ``fps`` has distinct bigint fingerprints in column fp (and optionally ``part``: an
    int within which to compare).  Only a sample of ``SAMPLE`` rows goes to the driver.
    """
    has_part = "part" in fps.columns
    fps = fps if has_part else fps.withColumn("part", F.lit(0))
    n = fps.count()
    sample = np.array([r.fp for r in fps.select("fp").orderBy(F.xxhash64(F.col("fp"), F.lit(7)), "fp").limit(SAMPLE).collect()], dtype=np.int64).view(U)
    regions = max(1, min(MANY, n // REGION), n // REGION_MOST)
    tree = plan(sample, max(0, int(np.ceil(np.log2(regions)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy().view(U)
            part = batch.column("part").to_numpy()
            none = np.zeros(0, np.int64)
            for region, homes, guests in route(tree, x, np.arange(len(x)), none, radius):
                at = np.concatenate([homes, guests])
                yield pa.record_batch([np.full(len(at), region, np.int64), part[at], x[at].view(np.int64), np.arange(len(at)) < len(homes)], names=["region", "part", "fp", "home"])

    def near(group: pa.Table) -> pa.Table:
        home = group.column("home").to_numpy()
        x = group.column("fp").to_numpy().view(U)
        a, b = _search(x[home], x[~home], radius) if home.any() else (x[:0], x[:0])
        return pa.table({"part": np.full(len(a), group.column("part")[0].as_py(), np.int32), "a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.select("part", "fp").mapInArrow(deal, "region bigint, part int, fp bigint, home boolean")
    found = dealt.groupBy("region", "part").applyInArrow(near, "part int, a bigint, b bigint")
    return found if has_part else found.drop("part")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    Null and empty texts have fingerprint zero and link like any other; a null key is
    passed over when the smallest key of a component is sought; repeated rows stay.
    """
    fps = table(fingerprints(docs, width, text, key).withColumnRenamed(key, "key"), "fingerprints")
    distinct = table(fps.groupBy("fp").agg(F.min("key").alias("low")), "distinct")
    roots = table(components(links(distinct.select("fp"), radius)), "roots")
    joined = roots.join(distinct, roots.node == distinct.fp).groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(joined, "root").select(F.col("node").alias("fp"), "component_id")
    # written, so that Spark can split the join where many rows share a fingerprint
    of_fp = table(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "components")
    return fps.join(of_fp, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
