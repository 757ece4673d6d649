"""Token ids of a word-level BPE file of the ``tokenizers`` library, a batch at a time.

The file's normaliser and splitter leave words that are encoded independently of
each other, so each distinct word is encoded once and kept in a bounded table.  Within a batch, hashes propose which words
are equal and their characters decide.  A word's own encoding comes from ``tiktoken`` with the same merges; a text that holds
a special token's string goes to ``tokenizers`` as it is.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import regex

from .text import numbered, span_hashes

#: The only way to split words that is known here (fixed value).
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words kept between batches.
KEEP = 200_000
#: Stands for the end of a word; no UTF-8 text holds this byte.
END = b"\xff"


class WordPieces:
    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in _printable().items()}
        suffix = spec["model"]["end_of_word_suffix"]
        ranks = {}
        special = {t["content"] for t in spec["added_tokens"]}
        for piece, number in spec["model"]["vocab"].items():
            if piece not in special:
                ended = piece.endswith(suffix)
                ranks[bytes(byte_of[c] for c in (piece[: -len(suffix)] if ended else piece)) + END * ended] = number
        ranks[END] = 1 << 30  # never left alone: a word's last byte takes it first
        self.fast = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != SPLITTER:
            raise ValueError(f"{path} splits words in another way")
        self.special = regex.compile("|".join(map(regex.escape, sorted(special))), regex.IGNORECASE)
        self.kept: dict[str, int] = {}
        self._clear()

    @cached_property
    def slow(self):
        """The library's own tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _clear(self) -> None:
        self.kept.clear()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.begin: list[int] = []
        self.size: list[int] = []

    def _learn(self, word: str) -> int:
        ids = self.fast.encode_single_piece(word.encode() + END)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin.append(self.used)
        self.size.append(len(ids))
        self.used += len(ids)
        self.kept[word] = len(self.begin) - 1
        return len(self.begin) - 1

    def _cut(self, text: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words of lower-cased texts that stand one after the other, an example of each distinct word, and each word's number."""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[chars]
        inner = offsets[(offsets > 0) & (offsets < len(chars))]
        begin = kind != SPACE
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        begin[inner] = kind[inner] != SPACE
        end = kind != SPACE
        end[:-1] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        end[inner - 1] = kind[inner - 1] != SPACE
        quote = np.flatnonzero((chars == ord("'")) & begin)
        if len(quote):
            stop = offsets[np.searchsorted(offsets, quote, "right")]
            far = np.concatenate([chars, np.zeros(2, np.uint32)])
            one = np.where(quote + 1 < stop, far[quote + 1], 0)
            two = np.where(quote + 2 < stop, far[quote + 2], 0)
            length = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
            for pair in ("re", "ve", "ll"):
                length[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
            quote, length, stop = quote[length > 0], length[length > 0], stop[length > 0]
            end[quote] = begin[quote + 1] = False
            end[quote + length] = True
            rest = quote + length + 1
            begin[rest[(rest < stop) & (kind[np.minimum(rest, len(kind) - 1)] == LETTER)]] = True
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        raw = chars.view(np.uint8)
        return starts, ends, *numbered(raw, 4 * starts, 4 * ends, span_hashes(raw, 4 * starts, 4 * ends))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.kept) > KEEP:
            self._clear()
        slow = {i: np.array(self.slow.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if self.special.search(t)}
        plain = ["" if i in slow else t.lower() if t.isascii() else unicodedata.normalize("NFC", t).replace("\u03a3", "\u03c3").lower() for i, t in enumerate(texts)]
        whole = "".join(plain)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in plain])]).astype(np.int64)
        if not whole:
            return [slow.get(i, np.zeros(0, np.uint32)) for i in range(len(texts))]
        starts, ends, first, which = self._cut(whole, offsets)
        kept, learn = self.kept, self._learn
        distinct = np.array([n if (n := kept.get(w := whole[a:b])) is not None else learn(w) for a, b in zip(starts[first].tolist(), ends[first].tolist())], np.int64)
        numbers = distinct[which]
        size, begin = np.array(self.size, np.int64), np.array(self.begin, np.int64)
        counts = size[numbers]
        reach = np.concatenate([[0], np.cumsum(counts)])
        flat = self.flat[np.repeat(begin[numbers] - reach[:-1], counts) + np.arange(reach[-1])]
        cuts = reach[np.searchsorted(starts, offsets)].tolist()
        return [slow[i] if i in slow else flat[a:b] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


#: Kinds of characters: what the splitter drops, joins, takes singly, joins.
SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    every = "".join(map(chr, range(0xD800))) + "?" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


def _printable() -> dict[int, str]:
    """The usual printable stand-in of each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load(path: str) -> WordPieces:
    return WordPieces(path)
