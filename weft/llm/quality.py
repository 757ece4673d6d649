"""Supervised subword embeddings: a text's class from its words and character n-grams.

Each word and each byte n-gram is hashed to a vector; a text is the mean of its
vectors; a softmax layer gives class probabilities.  Vectors and layer are learned by
stochastic gradient descent in numpy on all labelled rows: each slice of them teaches
a model of its own, and the models' log odds are averaged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from .shared import table
from .text import LOWER, SPACE, U, buffer, mix, slices, words

#: Labelled rows, and bytes of their texts, that a model learns from, about; what is more goes to further models.
ROWS, VOLUME = 6_000, 1 << 25
#: A class that is rarer than one row in so many is told to several models.
RARE = 7
#: Rows that a model's log odds are cut into.
CHUNKS = 16
NGRAMS = (1, 3, 5)
#: Word pairs are told apart only as repeated or not.
AGAIN, NEXT = U(101), U(102)


def features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of every word and every byte n-gram within a text, and the first of each text (n + 1)."""
    _, _, first, hashes = words(LOWER[raw], offsets, ~SPACE)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(hashes)]] = False
    pair = np.where(again, AGAIN, NEXT)  # the pair of a word and the one before: the same or another
    parts = [((hashes >> U(64 - bits)).astype(np.int32), first), ((mix(pair) >> U(64 - bits)).astype(np.int32), first)]
    at = np.arange(len(raw))
    code = np.zeros(len(raw), U)
    wide = np.concatenate([raw, np.zeros(max(NGRAMS), np.uint8)]).astype(U)
    for k in range(max(NGRAMS)):
        code |= wide[k : k + len(raw)] << U(8 * k)
        if k + 1 in NGRAMS:
            left = np.repeat(offsets[1:], np.diff(offsets)) - at
            ok = left > k
            own = ((code[ok] + U(k << 56)) * U(0x9E3779B97F4A7C15)) >> U(64 - bits)
            counts = np.maximum(np.diff(offsets) - k, 0)
            parts.append((own.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])))
    sizes = sum(np.diff(f) for _, f in parts)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(begin[-1]), np.int32)
    used = begin[:-1].copy()
    for values, f in parts:
        out[np.repeat(used - f[:-1], np.diff(f)) + np.arange(len(values))] = values
        used += np.diff(f)
    return out, begin


class Model:
    """Learned parts: vectors of buckets, softmax weights, and per bucket what scoring needs."""

    def __init__(self, bits: int, dim: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
        self.weights = np.zeros((dim, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, bags: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.4, seed: int = 0) -> Model:
        """Plain SGD, one text a step: a bag holds a text's features and their shares.  Classes weigh alike whatever their share."""
        rng = np.random.default_rng(seed)
        share = np.bincount(labels, minlength=2) / max(1, len(labels))
        weigh = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)
        steps, done = epochs * len(bags), 0
        for _ in range(epochs):
            for i in rng.permutation(len(bags)):
                u, c = bags[i]
                c = c[:, None]
                lr = np.float32(rate * (1 - done / steps))
                done += 1
                rows = self.vectors[u]
                mean = (rows * c).sum(0)
                z = mean @ self.weights + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                p *= min(4.0, weigh[labels[i]])
                back = self.weights @ p
                self.weights -= lr * np.outer(mean, p)
                self.bias -= lr * p
                # the mean divides gradients by the number of features: frequent ones move most
                self.vectors[u] = rows - lr * len(u) ** 0.5 * c * back
        return self

    def logits(self) -> tuple[np.ndarray, float]:
        """How much each bucket moves the log odds of class 1, and their constant."""
        w = self.weights[:, 1] - self.weights[:, 0]
        return self.vectors @ w, float(self.bias[1] - self.bias[0])


def _folded(ids: np.ndarray, counts: np.ndarray, bits: int) -> tuple[bytes, bytes, list[int]]:
    """Ascending ids by their lowest 16 bits, counts in as few bytes as the largest needs, and how many ids each higher part has."""
    narrow = np.min_scalar_type(int(counts.max(initial=0)))
    return ids.astype(np.uint16).tobytes(), counts.astype(narrow).tobytes(), np.bincount(ids >> 16, minlength=1 << max(0, bits - 16)).tolist()


def _unfolded(low: memoryview, counts: memoryview, parts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, shares) of a folded text with ``total`` features."""
    ids = np.frombuffer(low, np.uint16).astype(np.int32) + (np.repeat(np.arange(len(parts), dtype=np.int32), parts) << 16)
    c = np.frombuffer(counts, f"u{len(counts) // len(ids)}" if len(ids) else np.uint8)
    return ids, (c / max(1, total)).astype(np.float32)


class _Folded:
    """Bags of texts, unfolded one at a time: a task that learns holds some three bytes for each feature."""

    def __init__(self) -> None:
        self.rows: list[tuple[bytes, bytes, list[int], int]] = []
        self.labels: list[int] = []

    def add(self, texts: pa.Array, labels: pa.Array, bits: int) -> None:
        every, first = features(*buffer(texts), bits)
        for a, b, label in zip(first[:-1].tolist(), first[1:].tolist(), labels.to_pylist()):
            u, c = np.unique(every[a:b], return_counts=True)
            self.rows.append((*_folded(u, c, bits), b - a))
            self.labels.append(label)

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        low, counts, parts, total = self.rows[i]
        return _unfolded(memoryview(low), memoryview(counts), np.array(parts, np.int32), total)


def _taught(texts: DataFrame, bits: int, dim: int) -> DataFrame:
    """(slice, chunk, weights, constant, n): the log odds that each slice of (slice, key, label, text) teaches, in chunks."""

    def learn(own: int, bags: _Folded) -> pa.RecordBatch:
        weights, constant = Model(bits, dim).fit(bags, np.array(bags.labels)).logits()
        parts = [w.astype(np.float32).tobytes() for w in np.array_split(weights, CHUNKS)]
        columns = [pa.array([own] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary()), pa.array([constant] * CHUNKS), pa.array([len(bags)] * CHUNKS, pa.int64())]
        return pa.record_batch(columns, names=["slice", "chunk", "weights", "constant", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bags = None, _Folded()
        for batch in slices(batches, limit=1 << 18):
            ids = batch.column("slice").to_numpy()
            cuts = (np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if a == b:
                    continue
                if own is not None and own != ids[a]:
                    yield learn(own, bags)
                    bags = _Folded()
                own = int(ids[a])
                bags.add(batch.column("text").slice(a, b - a), batch.column("label").slice(a, b - a), bits)
        if own is not None:
            yield learn(own, bags)

    return texts.mapInArrow(run, "slice int, chunk int, weights binary, constant double, n bigint")


def _averaged(taught: DataFrame) -> DataFrame:
    """(chunk, weights, constant): means over the slices, by their rows, added up in the slices' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for chunk, weights, constant, n in zip(*(batch.column(c) for c in ("chunk", "weights", "constant", "n"))):
                own, n = sums.setdefault(chunk.as_py(), [0.0, 0.0, 0]), n.as_py()
                own[0] = own[0] + n * np.frombuffer(weights.as_buffer(), np.float32).astype(np.float64)
                own[1] += n * constant.as_py()
                own[2] += n
        for chunk, (weights, constant, n) in sums.items():
            yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([(weights / n).astype(np.float32).tobytes()], pa.binary()), pa.array([constant / n])], names=["chunk", "weights", "constant"])

    return taught.repartition(CHUNKS, "chunk").sortWithinPartitions("chunk", "slice").mapInArrow(run, "chunk int, weights binary, constant double")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", bits: int = 18, dim: int = 8, rows: int = ROWS) -> tuple[np.ndarray, float, int]:
    """Learn from all labelled rows, with all features of their texts.

    Rows are dealt to slices of about ``rows`` by a hash of their key, fewer where texts
    are long; every slice teaches a model in a task of its own, and the log odds are the
    models' mean.  A rare class's rows go to as many slices as each needs to know it.
    Keys are chosen first, so that no text but theirs is dealt.  Rows with a null text,
    label or key teach nothing; of rows that repeat a key one teaches, and of a key
    with two labels neither.  Without any row, every score is one half; with one class
    only, that class is favoured.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).where("key is not null and label in (0, 1)")
    known = known.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").drop("high")
    every = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null")
    there = every.groupBy("key").agg(F.max(F.octet_length("text")).alias("size"))
    chosen = table(known.join(there, "key"), "labelled")
    classes = chosen.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    n = sum(c.n for c in classes)
    if not n:
        return np.zeros(1 << bits, np.float32), 0.0, 0
    parts = max(-(-n // rows), -(-sum(c["size"] for c in classes) // VOLUME))
    copies = F.lit(1)
    for c in classes:
        copies = F.when(F.col("label") == c.label, min(parts, math.ceil(n / (RARE * c.n)))).otherwise(copies)
    texts = every.join(chosen.select("key", "label"), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    at = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(11)), F.lit(parts))
    dealt = texts.withColumn("slice", F.explode(F.transform(F.sequence(F.lit(0), copies - 1), lambda k: F.pmod(at + k, F.lit(parts)).cast("int"))))
    dealt = dealt.repartitionById(parts, F.col("slice")).sortWithinPartitions("slice", F.col("key").cast("string"), "key")
    # tasks learn, so that no feature reaches the driver
    learned = _averaged(_taught(dealt.select("slice", "label", "text"), bits, dim)).collect()
    learned.sort(key=lambda r: r.chunk)
    return np.concatenate([np.frombuffer(r.weights, np.float32) for r in learned]), learned[0].constant, n


def score(docs: DataFrame, learned: tuple[np.ndarray, float, int], text: str = "text", to: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``to``, in place of one of that name: the probability of class 1.

    Null and empty texts get the constant's; repeated rows are each scored.
    """
    weights, constant, _ = learned
    bits = len(weights).bit_length() - 1
    shipped = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop(to)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in slices(batches, text, 1 << 19):
            raw, offsets = buffer(batch.column(text))
            ids, first = features(raw, offsets, bits)
            sums = np.concatenate([[0], np.cumsum(table[ids], dtype=np.float64)])
            odds = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1) + constant
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(1 / (1 + np.exp(-np.clip(odds, -60, 60))))], names=[*names, to])

    schema = StructType([*docs.schema.fields]).add(to, DoubleType())
    return docs.mapInArrow(run, schema)
