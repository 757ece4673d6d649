"""Tokens of the sections of whole documents.

A document is encoded once.  The character span of each token is joined with the
spans of the document's sections, an interval join on two sorted lists, and a token
that crosses a boundary goes to one section by a stated rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import SPACE, buffer, slices, spans

RULES = ("first", "last", "largest")


@lru_cache(maxsize=2)
def load(path: str, pattern: str):
    """A byte-level encoding of a file of ranks, and the bytes of each token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, number in ranks.items():
        sizes[number] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def paragraphs(text: bytes) -> np.ndarray:
    """(start, end) bytes of the lines that are not blank, white space at their ends left out."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros((0, 2), np.int64)
    lines, ends, _ = spans(raw, np.array([0, len(raw)]), ~np.isin(np.arange(256), [10, 13]))
    first, last, _ = spans(raw, np.array([0, len(raw)]), ~SPACE)
    a, b = np.searchsorted(first, lines), np.searchsorted(last, ends, "right")
    some = a < b
    return np.stack([first[a[some]], last[b[some] - 1]], axis=1)


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "first") -> np.ndarray:
    """Section of each token, -1 for none.  Sections are sorted and do not overlap.

    Tokens and sections are both sorted, so the sections that a token meets are a
    range, found by two binary searches.  Of these, ``first`` takes the one where
    the token's earliest covered character lies, ``last`` the latest, and ``largest``
    the one with most of its characters (the earlier one of equals).
    """
    if not len(sections):
        return np.full(len(starts), -1)
    low = np.searchsorted(sections[:, 1], starts, "right")
    high = np.searchsorted(sections[:, 0], ends, "left")
    meets = (low < high) & (ends > starts)
    out = np.where(meets, low if rule == "first" else high - 1, -1)
    if rule == "largest":
        for i in np.flatnonzero(meets & (high - low > 1)).tolist():
            own = sections[low[i] : high[i]]
            out[i] = low[i] + int((np.minimum(own[:, 1], ends[i]) - np.maximum(own[:, 0], starts[i])).argmax())
        out = np.where(meets & (high - low == 1), low, out)
    return out


def token_counts(docs: DataFrame, ranks: str, pattern: str, rule: str = "first", text: str = "text", key: str = "doc_id", sections: str | None = None) -> DataFrame:
    """(key, n_tokens, n_outside, sections) of each row.

    sections lists (section, start, end, n_tokens): characters of the whole text and
    the tokens that ``rule`` gives the section.  Without a column ``sections`` of
    sorted, disjoint array<struct<start:bigint,end:bigint>> (in characters) the
    sections are the lines that aren't blank.  n_outside counts the tokens that meet
    no section.  A null or empty text has no token and no section; repeated rows are
    each counted; null sections are no sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *([F.col(sections).alias("own")] if sections else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = load(ranks, pattern)
        for batch in slices(batches):
            raw, offsets = buffer(batch.column("text"))
            inner = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters before each byte
            given = batch.column("own").to_pylist() if sections else None
            totals, outside, listed = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                a, b = int(offsets[i]), int(offsets[i + 1])
                ids = np.array(encoding.encode_ordinary(t or ""), np.int64)
                ends = np.cumsum(sizes[ids])
                char = inner[a : b + 1] - inner[a]
                first = ends - sizes[ids]
                # a token that ends or begins within a character touches that character
                stop = char[ends]
                start = np.where((raw[np.minimum(a + first, max(0, len(raw) - 1))] & 0xC0) == 0x80, char[first] - 1, char[first]) if len(ids) else first
                if given is None:
                    parts = char[paragraphs(raw[a:b].tobytes())]
                else:
                    parts = np.array([(s["start"], s["end"]) for s in given[i] or []], np.int64).reshape(-1, 2)
                own = attribute(start, stop, parts, rule)
                counts = np.bincount(own[own >= 0], minlength=len(parts))
                totals.append(len(ids))
                outside.append(int((own < 0).sum()))
                listed.append([{"section": k, "start": int(s), "end": int(e), "n_tokens": int(n)} for k, ((s, e), n) in enumerate(zip(parts.tolist(), counts.tolist()))])
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("section", "start", "end", "n_tokens")]))
            yield pa.record_batch([batch.column("key"), pa.array(totals, pa.int64()), pa.array(outside, pa.int64()), pa.array(listed, kind)], names=["key", "n_tokens", "n_outside", "sections"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint, n_outside bigint, sections array<struct<section:bigint,start:bigint,end:bigint,n_tokens:bigint>>").withColumnRenamed("key", key)
