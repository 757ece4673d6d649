"""Best-fit packing of token sequences by patterns of lengths.

Only the histogram of piece lengths, at most one row for each length, reaches the
driver.  Patterns of a few lengths that fill a sequence are enumerated, beside those that
best fit makes of the histogram; non-negative least squares, from best fit's counts on,
fits how often to use each and how little room to waste; the counts are rounded, and best
fit packs what is left.  The plan is a short list of ranges of ranks
within each length; pieces get their ranks by counts of salted groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import table, tasks
from .text import slices


def pieces(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of the pieces of each row's ids, ``end_id`` appended.

    A null or empty text has the end id alone.  Repeated rows are each cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordpieces import load

        pieces_of = load(tokenizer)
        last = np.array([end_id], "<u4")
        for batch in slices(batches):
            owner, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(pieces_of.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids = np.concatenate([ids, last]).astype("<u4")
                for k, a in enumerate(range(0, len(ids), room)):
                    part = ids[a : a + room]
                    owner.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.record_batch([batch.column("key").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("key", key)


def nnls(row: np.ndarray, column: np.ndarray, value: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 4000, near: float = 1e-5) -> np.ndarray:
    """Non-negative x that minimises ||a x - b||, by projected steps with momentum from the x given.

    ``a`` has ``value`` at (row, column).  Ends when a round moves x by less than ``near`` of its size.
    """
    times = lambda x: np.bincount(row, value * x[column], len(b))
    back = lambda r: np.bincount(column, value * r[row], len(x))
    v, size = np.ones(len(x)), 1.0
    for _ in range(30):
        w = back(times(v))
        size = float(np.linalg.norm(w))
        if not size:
            return x
        v = w / size
    step = 1 / (1.05 * size)
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - b))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        moved = np.linalg.norm(new - x)
        x, t = new, t2
        if moved <= near * np.linalg.norm(new):
            break
    return x


def _patterns(lengths: np.ndarray, counts: np.ndarray, room: int, most: int) -> list[tuple[int, ...]]:
    """Up to four lengths, largest first, the last the largest that fits: fullest patterns first."""
    found = {(int(n),) for n in lengths}
    have = np.zeros(room + 1, np.int64)
    have[lengths] = lengths
    fit = np.maximum.accumulate(have)  # largest length present up to each
    for n in lengths[::-1].tolist():
        rest = room - n
        if fit[rest]:
            found.add((n, min(n, int(fit[rest]))))
        # third and fourth parts: spread second parts over the range
        second = lengths[lengths <= min(n, rest)]
        for m in second[np.unique(np.linspace(0, len(second) - 1, 12).astype(int))].tolist() if len(second) else []:
            left = rest - m
            third = int(fit[left])
            if third:
                found.add(tuple(sorted((n, m, third), reverse=True)))
                half = int(fit[left // 2])
                fourth = int(fit[left - half]) if half else 0
                if fourth:
                    found.add(tuple(sorted((n, m, half, fourth), reverse=True)))
    single = [p for p in found if len(p) == 1]
    rest = sorted((p for p in found if len(p) > 1), key=lambda p: (room - sum(p), -p[0], p))
    # fullest first, yet every length keeps its own best patterns
    taken, uses = [], dict.fromkeys(lengths.tolist(), 0)
    for p in rest:
        if uses[p[0]] < 3:
            uses[p[0]] += 1
            taken.append(p)
        if len(taken) >= most:
            break
    return taken + [p for p in single if 2 * p[0] > room]


class _Left:
    """Pieces of each length that have no place yet, and the patterns used so far."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.left = {n: c for n, c in histogram.items() if c}
        self.used: list[tuple[tuple[int, ...], int]] = []

    def possible(self, pattern: tuple[int, ...]) -> int:
        return min(self.left.get(n, 0) // pattern.count(n) for n in set(pattern))

    def use(self, pattern: tuple[int, ...], times: int) -> None:
        self.used.append((pattern, times))
        for n in pattern:
            self.left[n] -= times
            if not self.left[n]:
                del self.left[n]

    def best_fit(self, room: int) -> None:
        """Largest first: each pattern is repeated as long as its lengths last."""
        left = self.left
        while left:
            have = np.array(sorted(left), np.int64)
            taken: dict[int, int] = {}
            space = room
            while space:
                k = int(np.searchsorted(have, space, "right")) - 1
                while k >= 0 and taken.get(int(have[k]), 0) >= left[int(have[k])]:
                    k -= 1
                if k < 0:
                    break
                n = int(have[k])
                # leave room for a pair that fills the rest exactly, if the largest doesn't
                if taken and space - n and space - n < have[0]:
                    small = have[have < space]
                    other = space - small
                    at = np.minimum(np.searchsorted(small, other), len(small) - 1) if len(small) else other
                    exact = np.flatnonzero(small[at] == other) if len(small) else other
                    for e in exact[::-1].tolist():
                        x, y = int(small[e]), int(other[e])
                        if all(taken.get(z, 0) + 1 + (x == y) <= left[z] for z in (x, y)):
                            n = max(x, y)
                            break
                taken[n] = taken.get(n, 0) + 1
                space -= n
            pattern = tuple(n for n, c in sorted(taken.items(), reverse=True) for _ in range(c))
            self.use(pattern, max(1, self.possible(pattern)))


def _count(used: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(times for _, times in used)


def plan(histogram: dict[int, int], room: int = 4096, most: int = 1500, full: float = 0.98) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): together they use every piece once.

    The number of entries depends on the number of distinct lengths only.  Best fit's own
    patterns and counts are where the least squares begin; where rounding what they end
    with needs more sequences than that, the beginning stands.
    """
    start = _Left(histogram)
    start.best_fit(room)
    if not start.used:
        return []
    lengths = np.array(sorted(n for n, c in histogram.items() if c), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], float)
    before: dict[tuple[int, ...], int] = {}
    for pattern, times in start.used:
        before[pattern] = before.get(pattern, 0) + times
    short = lengths[lengths < room]
    more = [p for p in _patterns(short, counts[lengths < room], room, most) if sum(p) > full * room] if len(short) else []
    patterns = [*before, *(p for p in more if p not in before)]
    place = {n: k for k, n in enumerate(lengths.tolist())}
    cells = [(place[n], j, p.count(n)) for j, p in enumerate(patterns) for n in set(p)]
    # the last row: room that is wasted, in sequences, and should be none
    cells += [(len(lengths), j, (room - sum(p)) / room) for j, p in enumerate(patterns)]
    row, column, value = (np.array(c) for c in zip(*cells))
    x = nnls(row, column, value.astype(float), np.append(counts, 0.0), np.array([before.get(p, 0) for p in patterns], float))
    best = start
    for half in (0.0, 0.5):  # rounded down, or to the nearest
        rounded = _Left(histogram)
        for j in np.argsort(-x, kind="stable").tolist():
            if (times := min(int(x[j] + half + 1e-6), rounded.possible(patterns[j]))) > 0:
                rounded.use(patterns[j], times)
        rounded.best_fit(room)
        if _count(rounded.used) <= _count(best.used):
            best = rounded
    return best.used


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset): a slot takes the ranks up to the next row's."""
    next_rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in planned:
        offset = 0
        for n in pattern:
            rank = next_rank.get(n, 0)
            rows.setdefault(n, []).append((rank, sequence, offset))
            next_rank[n] = rank + times
            offset += n
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def ranked(cut: DataFrame, key: str) -> DataFrame:
    """Adds ``rank``, numbering the pieces of each length from 0, without one task for a frequent length."""
    salts = max(32, 4 * tasks(cut.sparkSession))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy(key, "piece", "ids_crc32")
    numbered = salted.withColumn("within", F.row_number().over(within) - 1)
    return numbered.join(sizes, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within")).drop("salt", "before", "within")


def pack(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Place of every piece: (key, piece, start, length, ids_crc32, sequence_id, offset).

    An empty table packs to an empty one.  Rows that repeat a key and a text are
    packed as often as they occur.
    """
    cut = table(pieces(docs, tokenizer, room, end_id, text, key), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spots = slots(plan(histogram, room))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                rows = spots[int(length[own[0]])]
                at = np.searchsorted(rows[:, 0], rank[own], "right") - 1
                sequence[own] = rows[at, 1] + rank[own] - rows[at, 0]
                offset[own] = rows[at, 2]
            yield pa.record_batch([batch.column(c) for c in range(5)] + [pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    named = ranked(cut, key).select(key, "piece", "start", "length", "ids_crc32", "rank")
    kind = cut.schema[key].dataType.simpleString()
    return named.mapInArrow(place, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
