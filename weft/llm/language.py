"""Which languages a text mixes, and in what proportions.

Byte n-gram counts of labelled texts give each language's model.  A text is a bag
of words, each drawn from one language; expectation-maximisation finds the mixture.
Languages leave the set, the weakest first (one by one, or half of them while there are
many), and the set stays whose likelihood, penalised for its number of languages, is best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .text import LOWER, SPACE, U, buffer, slices, spans

#: Most distinct texts of each language that a fit reads, chosen by hash.
ROWS = 3_000
#: N-grams fall into 2 ** BITS buckets, or fewer where there are so many languages that the table would have over CELLS numbers.
BITS, CELLS, NGRAM = 17, 1 << 25, 4
#: Beyond so many languages left, half of them leave at a time.
MANY = 8


def grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each word with a space on both sides, and the first of each word (n + 1)."""
    sizes = ends - starts
    counts = sizes + 1  # one ends at each byte and one at the closing space
    begin = np.concatenate([[0], np.cumsum(counts)])
    word = np.repeat(np.arange(len(starts)), counts)
    place = np.arange(int(begin[-1])) - begin[word]  # of the n-gram's last byte
    at = starts[word] + place
    wide = np.concatenate([raw, np.full(1, 32, np.uint8)])
    code = np.zeros(len(at), U)
    for k in range(NGRAM):
        own = at - k
        byte = np.where((place - k >= 0) & (own < ends[word]), wide[np.maximum(own, 0)], 32)
        code |= byte.astype(U) << U(8 * k)
    return ((code * U(0x9E3779B97F4A7C15)) >> U(64 - bits)).astype(np.int64), begin


def _clean(raw: np.ndarray) -> np.ndarray:
    """Lower-cased bytes, all ASCII but letters made spaces."""
    low = LOWER[raw]
    letter = (low >= 0x61) & (low <= 0x7A) | (low >= 0x80)
    return np.where(letter, low, 32).astype(np.uint8)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bucket in each).  Rows with a null text or language teach nothing.

    Every language that occurs is learned, from at most ``rows`` of its distinct texts,
    the same at every size of input; n-grams are counted where the texts are, and the
    driver gets counts only.
    """
    known = docs.where(f"`{text}` is not null and `{lang}` is not null").select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).withColumn("hash", F.xxhash64("text"))
    per = known.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    names = sorted(r.lang for r in per.select("lang").collect())
    if not names:
        return [], np.zeros((1 << BITS, 0), np.float32)
    bits = min(BITS, (CELLS // len(names)).bit_length() - 1)
    # about a fifth more than enough by hash, then the first ones; copies share a hash, so one of them teaches.  ``per`` has one row
    # for each language, as many as the driver holds as well
    chosen = known.join(F.broadcast(per), "lang").where(F.pmod("hash", F.lit(1 << 30)) < F.least(F.lit(1.0), 1.2 * rows / F.col("n")) * (1 << 30)).dropDuplicates(["lang", "hash"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash"))
    chosen = chosen.withColumn("at", first).where(F.col("at") <= rows).select("text", "lang")
    number = {n: k for k, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), 1 << bits), np.int64)
        seen = False
        for batch in slices(batches, "text", 1 << 20):
            raw, offsets = buffer(batch.column("text"))
            clean = _clean(raw)
            starts, ends, first = spans(clean, offsets, ~SPACE)
            if not len(starts):
                continue
            seen = True
            ids, begin = grams(clean, starts, ends, bits)
            of = np.array([number[x] for x in batch.column("lang").to_pylist()])
            row = np.repeat(np.repeat(of, np.diff(first)), np.diff(begin))
            sums += np.bincount(row * (1 << bits) + ids, minlength=sums.size).reshape(sums.shape)
        if seen:
            for k in range(len(names)):
                some = np.flatnonzero(sums[k])
                yield pa.record_batch([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(sums[k][some])], names=["k", "g", "n"])

    counted = chosen.mapInArrow(count, "k int, g int, n bigint").groupBy("k", "g").agg(F.sum("n").alias("n"))
    sums = np.zeros((1 << bits, len(names)), np.float32)
    for r in counted.toLocalIterator():
        sums[r.g, r.k] = r.n
    total = sums.sum(0, dtype=np.float64)
    # a bucket unseen in a language keeps a share of its probability in all of them
    every = (sums.sum(1, dtype=np.float64) + 0.5) / (total.sum() + 0.5 * len(sums))
    for k in range(len(names)):
        sums[:, k] = np.log((sums[:, k] + 2000 * every) / (total[k] + 2000))
    return names, sums


def _mixture(odds: np.ndarray, owner: np.ndarray, texts: int, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all texts at once.  odds: exp of each word's log likelihood less its best; returns shares and log likelihood."""
    share = allowed / allowed.sum(1, keepdims=True)
    edge = np.searchsorted(owner, np.arange(texts))
    full = np.bincount(owner, minlength=texts) > 0
    total = np.ones(len(owner))
    for k in range(rounds + 1):
        mass = odds * share[owner]
        total = mass.sum(1) + 1e-300
        if k == rounds:
            break
        mass /= total[:, None]
        sums = np.zeros_like(share)
        sums[full] = np.add.reduceat(mass, edge[full], axis=0)
        sums *= allowed
        share = np.where(full[:, None], sums / np.maximum(sums.sum(1, keepdims=True), 1e-300), share)
    likelihood = np.zeros(texts)
    likelihood[full] = np.add.reduceat(np.log(total), edge[full])
    return share, likelihood


def infer(odds: np.ndarray, owner: np.ndarray, texts: int, penalty: float = 3.0, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the chosen languages of each text, and how many were chosen."""
    languages = odds.shape[1]
    allowed = np.ones((texts, languages))
    count = np.bincount(owner, minlength=texts)
    price = penalty * np.log(np.maximum(count, 2))
    share, likelihood = _mixture(odds, owner, texts, allowed, rounds)
    best, best_value, best_size = share, likelihood - languages * price, np.full(texts, languages)
    while (size := int(allowed[0].sum()) if texts else 0) > 1:
        gone = size // 2 if size > MANY else 1
        rest = np.where(allowed > 0, share, np.inf)[:, ::-1]
        weakest = languages - 1 - np.argsort(rest, axis=1, kind="stable")[:, :gone]  # of equals the last name leaves
        allowed = allowed.copy()
        np.put_along_axis(allowed, weakest, 0, 1)
        size -= gone
        share, likelihood = _mixture(odds, owner, texts, allowed, rounds)
        value = likelihood - size * price
        better = value >= best_value
        best = np.where(better[:, None], share, best)
        best_size = np.where(better, size, best_size)
        best_value = np.where(better, value, best_value)
    return best, best_size


def languages(docs: DataFrame, learned: tuple[list[str], np.ndarray], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, shares) of each row.

    lang_pred is the language of the largest share and score that share; shares maps
    the chosen languages to proportions.  A text that is null or has no letter is
    ``und`` with score 0, and so is every text where nothing was learned; ties go to
    the name that sorts first.
    """
    names, table = learned
    bits, limit = len(table).bit_length() - 1, max(1 << 14, (1 << 22) // max(4, len(names)))  # a slice's words times languages
    shipped = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shipped.value
        for batch in slices(batches, "text", limit):
            raw, offsets = buffer(batch.column("text"))
            clean = _clean(raw)
            starts, ends, first = spans(clean, offsets, ~SPACE)
            n = batch.num_rows
            pred, score, shares = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
            if names and n:
                if len(starts):
                    ids, begin = grams(clean, starts, ends, bits)
                    logp = np.add.reduceat(logs[ids], begin[:-1], axis=0)
                    odds = np.exp(np.maximum(logp - logp.max(1, keepdims=True), -40)).astype(np.float64)
                else:
                    odds = np.ones((0, len(names)))
                owner = np.repeat(np.arange(n), np.diff(first))
                share, _ = infer(odds, owner, n)
                top = share.argmax(1)
                for i in np.flatnonzero(batch.column("letter").to_numpy(zero_copy_only=False)).tolist():
                    pred[i], score[i] = names[top[i]], min(1.0, float(share[i, top[i]]))
                    shares[i] = [(names[k], float(share[i, k])) for k in np.flatnonzero(share[i] > 1e-6)]
            yield pa.record_batch([batch.column("key"), pa.array(pred), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=["key", "lang_pred", "score", "shares"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double, shares map<string,double>").withColumnRenamed("key", key)
