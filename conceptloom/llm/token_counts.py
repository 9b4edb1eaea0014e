"""Exact token counts of a byte-pair vocabulary with word ends, by rank-synchronous merging of ragged numpy arrays.

Pre-tokens lie one after another in one array. Each round looks up every adjacent pair's rank, takes each sequence's
lowest one and merges all its places at once, from the left; sequences without a known pair leave. What is left over of a
sequence are its tokens. A later merge never outranks the one that made its parts (checked on loading), so all places of
the lowest pair go before anything they make.

Defined results: a null text is empty and has no tokens; special strings in a text are one token each, as the library's
default has it; code points that Python and the library class differently are taken as the library does; repeated rows count alike; texts of any length are counted whole; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from conceptloom.llm.common import map_texts, tune
from conceptloom.llm.unicode_ranges import NO_LETTERS, NO_MARKS, SMALL

VOCABULARY = "word_bpe_49k.json"
#: Pre-tokens whose counts a Python worker remembers; beyond it starts anew.
REMEMBERED = 300_000


_UNMARKED = frozenset(map(chr, NO_MARKS))
#: Stands for a character that is neither letter nor number nor white space.
_NEITHER = dict.fromkeys(NO_LETTERS, "\ue000")


def _class(points: frozenset[int]) -> str:
    starts, ends = (sorted(c for c in points if c + by not in points) for by in (-1, 1))
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]"


_ODD = NO_LETTERS | NO_MARKS | SMALL.keys()
#: The second one is slower, and most texts have nothing from the first odd character on.
HIGH, ODD, MARKS = re.compile(f"[{chr(min(_ODD))}-\U0010ffff]"), re.compile(_class(_ODD)), re.compile(f"({_class(NO_MARKS)})")


class WordEndCounter:
    """Counts tokens as the tokenizer file ``path`` gives them, without added special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = spec["normalizer"]["normalizers"]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if [p["type"] for p in parts] != ["NFC", "Replace", "Lowercase"] or (parts[1]["pattern"], parts[1]["content"]) != ({"Regex": r"\s+"}, " ") or [p["type"] for p in splits] != ["Split", "ByteLevel"] or not splits[0]["invert"]:
            raise ValueError(f"{path} has another form of normalizer or pre-tokenizer")
        self.pieces = regex.compile(splits[0]["pattern"]["Regex"])
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials)))
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        left, right = (np.array([vocab[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        born = np.full(max(vocab.values()) + 1, -1, dtype=np.int64)
        born[made] = np.arange(len(made))
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError(f"{path} has merges before those that make their parts")
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys, self.made = keys[self.order], made
        self.known: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], len(self.made))

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each non-empty byte string."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.final[data[ends]]
        counts = np.ones(len(words), dtype=np.int64)
        seq = np.repeat(np.arange(len(words)), sizes)
        while len(symbols):
            joined = seq[1:] == seq[:-1]
            rank = np.full(len(symbols), len(self.made), dtype=np.int64)
            rank[:-1][joined] = self._ranks(symbols[:-1][joined], symbols[1:][joined])
            first = np.flatnonzero(np.append(True, ~joined))
            least = np.minimum.reduceat(rank, first)
            going = least < len(self.made)
            sizes = np.diff(np.append(first, len(symbols)))
            counts[seq[first[~going]]] = sizes[~going]
            at = np.flatnonzero((rank == np.repeat(least, sizes)) & np.repeat(going, sizes))
            if len(at):  # of touching places, as in a run of one symbol, every second one from the left
                start = np.append(True, at[1:] != at[:-1] + 1)
                run = np.flatnonzero(start)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
                symbols[at] = self.made[rank[at]]
            stay = np.repeat(going, sizes)
            stay[at + 1] = False
            symbols, seq = symbols[stay], seq[stay]
        return counts

    def split(self, text: str) -> tuple[list[str], int]:
        """The text's pre-tokens, and how many special tokens it has."""
        parts = self.special.split(text) if any(s in text for s in self.specials) else [text]
        out: list[str] = []
        for part in parts:
            if part.isascii():
                out += self.pieces.findall(part.lower())
            elif HIGH.search(part) and ODD.search(part):
                out += self._split_odd(part)
            else:
                out += self.pieces.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out, len(parts) - 1

    def _split_odd(self, text: str) -> list[str]:
        """The pre-tokens of a text with characters of which the library's Unicode says something else than Python's."""
        text = "".join(x if x in _UNMARKED else unicodedata.normalize("NFC", x) for x in MARKS.split(text))
        text = "".join(chr(SMALL[ord(c)]) if ord(c) in SMALL else "σ" if c == "Σ" else c.lower() for c in text)
        plain = text.translate(_NEITHER)  # one character for one
        return [text[m.start() : m.end()] for m in self.pieces.finditer(plain)]

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*[p for p, _ in split]).difference(self.known))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.known.update(zip(part, self.merge([w.encode() for w in part]).tolist(), strict=True))
        known = self.known.__getitem__
        return [sum(map(known, pieces)) + n for pieces, n in split]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where visible in Latin-1, else 256 and up."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=2)
def counter(path: str) -> WordEndCounter:
    return WordEndCounter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for every text; one narrow pass. ``path`` must exist on every executor."""
    tune(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        tokens = np.array(counter(path).count(texts), dtype=np.int64)
        return {"n_bytes": pa.array([len(t.encode()) for t in texts], type=pa.int64()), "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)}

    return map_texts(docs.select("doc_id", "text"), fn, "n_bytes long, n_tokens long, over_limit boolean")
