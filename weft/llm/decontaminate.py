"""Benchmark decontamination by an FM-index over each shard of training text.

The benchmark gives windows of words.  A shard keeps the runs of benchmark words that
are long enough to hold a window (no other place can match), indexes them with a
wavelet matrix over the Burrows-Wheeler transform and a sampled suffix array, and
searches all windows backwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .text import ALNUM, LOWER, buffer, covered, numbered, runs, same_spans, slices, span_hashes, spans, words

#: Most bytes of benchmark text that the driver holds and one pass takes to the tasks; more text takes more passes.
BLOCK = 16 << 20


class FMIndex:
    """Words of one shard: ``text`` holds numbers from 1; 0 separates runs.

    Within, all numbers are one higher, and a single 0 ends the text.
    """

    def __init__(self, text: np.ndarray, step: int = 8) -> None:
        text = np.concatenate([text + 1, [0]]).astype(np.int64)
        n = len(text)
        order = self._sort(text)
        self.n = n
        last = text[order - 1]
        top = int(text.max()) if n else 0
        self.before = np.searchsorted(np.sort(text), np.arange(top + 2))
        self._build(last, max(1, top.bit_length()))
        self.last = last
        marked = order % step == 0
        self.rank_marked = np.concatenate([[0], np.cumsum(marked)])
        self.marked, self.sample = marked, order[marked]

    @staticmethod
    def _sort(text: np.ndarray) -> np.ndarray:
        """All suffixes in order: stepping back from row to row needs the order to be complete."""
        n = len(text)
        _, rank = np.unique(text, return_inverse=True)
        reach = 1
        while rank.max() < n - 1:
            later = np.zeros(n, np.int64)
            later[: n - reach] = rank[reach:] + 1
            key = rank * (int(later.max()) + 1) + later
            _, rank = np.unique(key, return_inverse=True)
            reach *= 2
        return np.argsort(rank)

    def _build(self, column: np.ndarray, bits: int) -> None:
        """Wavelet matrix: for each bit from the highest, the count of ones before each place."""
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in range(bits - 1, -1, -1):
            one = (column >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one)]))
            self.zeros.append(len(column) - int(one.sum()))
            column = np.concatenate([column[one == 0], column[one == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        low = np.zeros_like(place)
        high = place
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of rows for each phrase (rows of equal length), words taken from the last to the first."""
        phrases = phrases + 1
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            known = c < len(self.before) - 1
            low[alive[~known]] = high[alive[~known]] = 0
            alive, c = alive[known], c[known]
            low[alive] = self.before[c] + self.rank(c, low[alive])
            high[alive] = self.before[c] + self.rank(c, high[alive])
            alive = alive[high[alive] > low[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the text of each row: steps back to the next sampled place."""
        out = np.full(len(rows), -1, np.int64)
        todo, row, walked = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.marked[row]
            out[todo[done]] = self.sample[self.rank_marked[row[done]]] + walked
            todo, row = todo[~done], row[~done]
            c = self.last[row]
            row = self.before[c] + self.rank(c, row)
            walked += 1
        return out


class Phrases:
    """Windows of a block of benchmark items: ``width`` words each, or a whole shorter item."""

    def __init__(self, items: list[tuple[str, str]], width: int) -> None:
        column = pa.array([t for _, t in items], pa.string())
        raw, offsets = buffer(column)
        self.raw = LOWER[raw]
        starts, ends, first, hashes = words(self.raw, offsets, ALNUM)
        example, number = numbered(self.raw, starts, ends, hashes)
        # a seed that tells all distinct words apart
        for self.seed in count(1):
            own = span_hashes(self.raw, starts[example], ends[example], self.seed)
            if len(np.unique(own)) == len(own):
                break
        order = np.argsort(own)
        self.vocabulary, self.at, self.size = own[order], starts[example][order], (ends - starts)[example][order]
        self.numbers = np.argsort(order)[number] + 1
        self.names = [n for n, _ in items]
        counts = np.diff(first)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(np.minimum(counts, width)).tolist():
            if not size:
                continue
            own = np.flatnonzero((counts == size) if size < width else (counts >= width))
            where = np.concatenate([np.arange(first[i], first[i + 1] - size + 1) for i in own])
            owner = np.repeat(own, [counts[i] - size + 1 for i in own])
            phrases, which = np.unique(self.numbers[where[:, None] + np.arange(size)], axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            begin = np.searchsorted(which.ravel()[order], np.arange(len(phrases) + 1))
            self.groups.append((size, phrases, owner[order], begin))
        self.least = min((g[0] for g in self.groups), default=0)


def _shard(raw: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[int]]]:
    """Word starts and ends, first word of each text, mask of hit words, items of each text."""
    low = LOWER[raw]
    starts, ends, first = spans(low, offsets, ALNUM)
    hit = np.zeros(len(starts), dtype=bool)
    items: list[set[int]] = [set() for _ in range(len(offsets) - 1)]
    if not phrases.groups or not len(starts):
        return starts, ends, first, hit, items
    hashes = span_hashes(low, starts, ends, phrases.seed)
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = (phrases.vocabulary[at] == hashes) & (phrases.size[at] == ends - starts)
    maybe = np.flatnonzero(known)
    known[maybe] = same_spans(low, starts[maybe], phrases.raw, phrases.at[at[maybe]], phrases.size[at[maybe]])
    begin, end = runs(known, first)
    long = end - begin >= phrases.least
    begin, end = begin[long], end[long]
    if not len(begin):
        return starts, ends, first, hit, items
    sizes = end - begin + 1
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    text = np.append(at, 0)[np.minimum(place, len(at))] + 1
    text[np.cumsum(sizes) - 1] = 0
    index = FMIndex(text)
    found_start, found_size, pairs = [], [], []
    for size, rows, owner, of in phrases.groups:
        low, high = index.search(rows)
        some = np.flatnonzero(high > low)
        if not len(some):
            continue
        counts = (high - low)[some]
        which = np.repeat(some, counts)
        row = np.repeat(low[some] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        word = place[index.locate(row)]
        found_start.append(word)
        found_size.append(np.full(len(word), size))
        text_of = np.searchsorted(first, word, "right") - 1
        pair = np.unique(text_of * len(rows) + which)
        for t, w in zip((pair // len(rows)).tolist(), (pair % len(rows)).tolist()):
            items[t].update(owner[of[w] : of[w + 1]].tolist())
    if found_start:
        hit = covered(len(starts), np.concatenate(found_start), np.concatenate(found_size))
    return starts, ends, first, hit, items


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Items in lists of about ``BLOCK`` bytes of text, one list at a time, at least one."""
    block: list[tuple[str, str]] = []
    held = 0
    for r in items.toLocalIterator():
        block.append((r.name, r.text))
        held += len(r.text.encode())
        if held >= BLOCK:
            yield block
            block, held = [], 0
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", key: str = "doc_id", clean: bool = False) -> DataFrame:
    """Where windows of benchmark items occur in texts.

    Returns (key, n_words, hit_spans, item_ids): hit_spans are [first word, last word + 1,
    first byte, last byte + 1] of each maximal run of hit words, item_ids the items
    whose windows occur, as strings in their order.  With ``clean`` also ``text``
    without the bytes of those runs.

    A null or empty text has no words; items without words or id find nothing; an
    item given twice counts once.  Items beyond ``BLOCK`` bytes are searched in
    further passes over the same rows.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("name"), "text")
    context = docs.sparkSession.sparkContext
    shipped_blocks = [context.broadcast(Phrases(block, width)) for block in _blocks(items)]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("mask", F.lit(None).cast("binary")).withColumn("item_ids", F.array().cast("array<string>"))
    own = rows.schema["key"]
    for k, shipped in enumerate(shipped_blocks):
        final = k == len(shipped_blocks) - 1

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, final=final) -> Iterator[pa.RecordBatch]:
            phrases = shipped.value
            for batch in slices(batches):
                raw, offsets = buffer(batch.column("text"))
                starts, ends, first, hit, found = _shard(raw, offsets, phrases)
                names = [sorted({phrases.names[i] for i in own}.union(old)) if own or old else [] for own, old in zip(found, batch.column("item_ids").to_pylist())]
                for i, old in enumerate(batch.column("mask").to_pylist()):
                    if old:
                        hit[first[i] : first[i + 1]] |= np.frombuffer(old, dtype=bool)
                names = pa.array(names, pa.list_(pa.string()))
                if not final:
                    mask = [hit[a:b].tobytes() if hit[a:b].any() else None for a, b in zip(first[:-1], first[1:])]
                    yield pa.record_batch([batch.column("key"), batch.column("text"), pa.array(mask, pa.binary()), names], names=["key", "text", "mask", "item_ids"])
                    continue
                begin, end = runs(hit, first)
                of = np.searchsorted(first, begin, "right") - 1
                begin_byte, end_byte = starts[begin] - offsets[of], ends[end - 1] - offsets[of]
                quad = np.stack([begin - first[of], end - first[of], begin_byte, end_byte], axis=1).astype(np.int64) if len(begin) else np.zeros((0, 4), np.int64)
                cut = np.searchsorted(of, np.arange(len(first)))
                spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(quad.ravel()), 4).cast(pa.list_(pa.int64())))
                columns, labels = [batch.column("key"), pa.array(np.diff(first)), spans, names], ["key", "n_words", "hit_spans", "item_ids"]
                if clean:
                    texts = batch.column("text").to_pylist()
                    for i in np.unique(of).tolist():
                        b, kept, last = texts[i].encode(), [], 0
                        for _, _, x, y in quad[cut[i] : cut[i + 1]].tolist():
                            kept.append(b[last:x])
                            last = y
                        texts[i] = b"".join([*kept, b[last:]]).decode()
                    columns.append(pa.array(texts, pa.string()))
                    labels.append("text")
                yield pa.record_batch(columns, names=labels)

        made = "n_words bigint, hit_spans array<array<bigint>>, item_ids array<string>" + ", text string" * clean if final else "text string, mask binary, item_ids array<string>"
        rows = rows.mapInArrow(run, StructType([own, *StructType.fromDDL(made).fields]))
    return rows.withColumnRenamed("key", key)


def without_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text") -> DataFrame:
    """``docs`` with the hit words of each text taken out, from a run's first byte to its last.

    All columns stay, whatever their names; null texts stay null.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("own"))
    cleaned = contaminated(packed, benchmark, width, "own", "row", clean=True)
    changed = F.size("hit_spans") > 0
    return cleaned.select(*[F.when(changed, F.col("text")).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names])


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and a digest of what ``contaminated`` found."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return found.select(key, "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)
