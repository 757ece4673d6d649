"""Near copies by word shingles: SimHash trees first, then an exact join on rare shingles.

SimHash of all shingles of two texts with a similarity of 0.8 differs in some ten of
64 bits, a radius at which triangle bounds prune nothing.  The trees of ``simhash.links``
therefore propose the closest copies only, and a second path, which misses no pair,
proposes the rest: with all shingles in one order, two texts alike to ``least`` share one
of the first ``1 - least`` of their shingles and stand far enough in front of their ends
there.  The order, frequent shingles last, makes such meetings few.  Texts that meet
are first compared with one centre of each meeting, which joins large groups of copies
in linear time, then all those that still are in two components with each other.

Every proposed pair is decided by its whole shingle sets, told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import components
from .shared import drop_table, table
from .simhash import U, fingerprint, links
from .text import LOWER, SPACE, buffer, mix, slices, words

#: How many of the most frequent shingles come last in the order of all; it moves work, never a result.
KNOWN = 1 << 18
#: 64-bit parts of a text's parity map: how often, modulo two, its shingles fall on each bit.
PARTS = 8
MAP = [f"m{k}" for k in range(PARTS)]


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of lower-cased words and the first of each text (n + 1); a shorter text is one shingle."""
    raw, offsets = buffer(column)
    _, _, first, hashes = words(LOWER[raw], offsets, ~SPACE)
    count = np.diff(first)
    own = np.repeat(count, count)
    size = np.minimum(own, width)
    at = np.flatnonzero(np.repeat(first[1:], count) - np.arange(len(hashes)) >= size)
    size = size[at]
    out = mix(hashes[at] ^ size.astype(U))
    for k in range(1, width):
        if (more := size > k).all():
            out = mix(out ^ hashes[at + k])
        else:
            out[more] = mix(out[more] ^ hashes[at[more] + k])
    return out, np.searchsorted(at, first)


def _sets(hashes: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        own = np.sort(hashes[a:b])
        yield own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def _frequent(docs: DataFrame, width: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the shingles that all documents together repeat most within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, n = np.unique(shingles(batch.column("text"), width)[0], return_counts=True)
            yield pa.record_batch([found[n > 1].view(np.int64), n[n > 1]], names=["hash", "n"])

    texts = docs.select(F.col(text).alias("text")).where("text is not null")
    known = texts.mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(KNOWN).toArrow()
    hashes = known.column("hash").to_numpy().view(U)
    order = np.argsort(hashes)
    return hashes[order], known.column("n").to_numpy()[order]


class _Order:
    """A shingle's place in the order of all: by how often it is known to occur, in powers of two, then by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes, self.power = hashes, np.frexp(counts.astype(float))[1].astype(U)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[hashes >> U(42)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        power = np.zeros(len(hashes), U)
        some = np.flatnonzero(self.maybe[hashes >> U(42)])
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
            power[some] = np.where(self.hashes[at] == hashes[some], self.power[at], U(0))
        return (power << U(57)) | (mix(hashes) >> U(7))


def _profile(docs: DataFrame, width: int, least: float, text: str, key: str) -> DataFrame:
    """(key, source, print, fp, size, front, MAP): source and print are digests of the text and of its words in order.

    fp is the SimHash of all shingles and size that of their set; front are the first of them in the order of all.
    """
    hashes, counts = _frequent(docs, width, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(hashes, counts)
        for batch in slices(batches):
            raw, offsets = buffer(batch.column("text"))
            whole = raw.tobytes()
            texts = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            every, first = shingles(batch.column("text"), width)
            sets = list(_sets(order(every), first))
            prints = [hashlib.sha256(b" ".join(t.lower().split())).digest() for t in texts]
            fps = [fingerprint(every[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            fronts = [s[: len(s) - math.ceil(least * len(s) - 1e-6) + 1].view(np.int64) for s in sets]
            bit = np.concatenate([np.zeros(0, np.int64), *[(mix(s) >> U(55)).astype(np.int64) + 64 * PARTS * i for i, s in enumerate(sets)]])
            odd = np.bincount(bit, minlength=64 * PARTS * len(sets)).astype(np.uint8) & 1
            maps = np.packbits(odd).view(np.int64).reshape(-1, PARTS)
            columns = [pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(prints, pa.binary()), pa.array(fps, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fronts, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(PARTS))]
            yield pa.record_batch([batch.column("key"), *columns], names=["key", "source", "print", "fp", "size", "front", *MAP])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, source binary, print binary, fp bigint, size int, front array<bigint>" + "".join(f", {m} bigint" for m in MAP))


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of (a, b) whose shingle sets are alike."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("s"))
    return both.where(F.col("c") >= least * (F.col("s") - F.col("c")) - 1e-9).select("a", "b")


def _can(least: float, a: str = "a", b: str = "b") -> Column:
    """Whether two texts that meet may be alike, by sizes, by what follows the shingle they share, and by their maps.

    Every bit that differs between two parity maps stands for a shingle that only one of the texts has.
    """
    total = F.col(f"{a}.size") + F.col(f"{b}.size")
    rest = F.least(f"{a}.rest", f"{b}.rest") * (1 + least) >= least * total - 1e-6
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}"))) for m in MAP])
    return rest & (differ * (1 + least) <= (1 - least) * total + 1e-6)


def _fronts(texts: DataFrame) -> DataFrame:
    """(hash, node, size, rest, MAP) of the shingles that are among the first of two texts or more."""
    rows = texts.select("node", F.posexplode("front").alias("at", "hash"))
    shared = rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    met = rows.join(shared, "hash").join(texts.select("node", "size", *MAP), "node")
    return met.select("hash", "node", "size", (F.col("size") - F.col("at")).alias("rest"), *MAP)


def _around(fronts: DataFrame, least: float) -> DataFrame:
    """(a, b): each text with the centre of each meeting, the text with most meetings."""
    weight = fronts.groupBy("node").agg(F.count("*").alias("w"))
    centres = fronts.join(weight, "node").groupBy("hash").agg(F.max_by(F.struct("node", "size", "rest", *MAP), F.struct("w", "node")).alias("c")).select("hash", "c.*")
    centres = table(centres, "centres")  # written, so that Spark can split the join at a hash that many texts share
    return fronts.alias("a").join(centres.alias("b"), "hash").where("a.node <> b.node").where(_can(least)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _apart(fronts: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs that meet in two components.

    Members of the component that is most frequent at a meeting are not compared with each other.
    """
    rooted = fronts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = rooted.groupBy("hash", "root").agg(F.count("*").alias("n"))
    most = of_root.groupBy("hash").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("n")).where("n > 1").select("hash", "most")
    rows = table(rooted.join(most, "hash"), "meetings")
    less = rows.where("root <> most").alias("a")
    met = less.join(rows.alias("b"), "hash").where("a.root <> b.root and (b.root = b.most or a.node < b.node)").where(_can(least))
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, root) of the pairs (a, b) in two components; root is that of b."""
    for side in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
    pairs = pairs.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("root"))
    return pairs.where("ra <> root").select("a", "b", "root")


def _closest(texts: DataFrame) -> DataFrame:
    """(a, b): texts whose fingerprints are equal or linked by the tree."""
    heads = table(texts.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = texts.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    linked = links(heads.select("fp"), 2)
    for side in "ab":
        linked = linked.join(heads.select(F.col("fp").alias(side), F.col("head").alias(f"h{side}")), side)
    return same.union(linked.select("ha", "hb"))


def without_copies(docs: DataFrame, width: int = 5, least: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row, that of the smallest key, of each group of exact and near copies.

    Texts are alike if the Jaccard similarity of their sets of ``width``-word shingles
    (lower-cased; a shorter text is one shingle) is at least ``least``; groups are what
    chains of alike texts connect.  Null texts and texts without words all stay.
    Of repeated rows one stays.  Columns may have any names.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"))
    rows = table(_profile(packed, width, least, "text", "key").where("size > 0"), "profile")
    carried = ["fp", "size", "front", *MAP]
    texts = rows.groupBy("print").agg(F.min(F.struct("key", "source")).alias("rep"), *[F.first(c).alias(c) for c in carried])
    texts = table(texts.select("print", F.col("rep.key").alias("low"), F.col("rep.source").alias("source"), *carried).withColumn("node", F.monotonically_increasing_id()), "texts")
    slim = table(rows.select("key", "source", "print"), "profile")
    drop_table(rows)
    named = packed.where("text is not null").withColumn("source", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Shingle sets of the texts of (a, b), from the texts themselves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                sets = [s.view(np.int64) for s in _sets(*shingles(batch.column("text"), width))]
                yield pa.record_batch([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = texts.join(nodes, "node").select("node", "low", F.col("source").alias("own"))
        company = named.join(wanted, (F.col("source") == F.col("own")) & F.col("key").eqNullSafe(F.col("low"))).select("node", "text").dropDuplicates(["node"])
        return table(company.mapInArrow(run, "node bigint, shingles array<bigint>"), "sets")

    fronts = table(_fronts(texts), "fronts")
    pairs = table(_closest(texts).union(_around(fronts, least)).distinct(), "pairs")
    sets = sets_of(pairs)
    edges = table(_alike(pairs, sets, least), "alike")
    whole = table(components(edges), "roots")
    drop_table(sets)
    apart = table(_apart(fronts, whole, least), "apart")
    if not apart.isEmpty():
        sets = sets_of(apart)
        # a text and a component first by one pair, then by all pairs, where that pair doesn't join them
        first = F.row_number().over(Window.partitionBy("a", "root").orderBy("b")) == 1
        for chosen in (first, F.lit(True)):
            left = _rooted(apart, whole).withColumn("chosen", chosen).where("chosen").select("a", "b")
            more = table(_alike(left, sets, least), "alike")
            if more.isEmpty():
                continue
            edges = edges.union(more)
            whole = table(components(edges), "roots")
        drop_table(sets)
    drop_table(fronts)
    of = texts.select("node", "print", "low").join(whole, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = of.groupBy("root").agg(F.min(F.struct("low", "print")).alias("best")).select("best.*")
    # of the rows of the text that stays, the one with the smallest key (and of equal rows one)
    chosen = slim.join(best, "print").where(F.col("key").eqNullSafe(F.col("low")))
    kept = table(chosen.groupBy("print").agg(F.min("source").alias("own"), F.first("low").alias("low"), F.count("*").alias("n")), "kept")
    blank = packed.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = named.join(kept, (F.col("source") == F.col("own")) & F.col("key").eqNullSafe(F.col("low")))
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates(["key", "source"])
    return out.select("row").unionByName(blank.select("row")).select("row.*")
