"""Byte-level BPE: encoding by a lazily determinised transducer, and streaming decoding.

A pre-token that is a token of its own is emitted as such. For any other, the transducer reads bytes. The tokens of every
prefix form a tree: a prefix's last token is the one token ending there that may follow the last token of the prefix
before it, where "may follow" means that encoding the two together gives the two. A state holds the live prefixes, those
from whose end a longer token may still start, with their last tokens; a transition gives the last token of the prefix
it completes. Where the live prefixes' tokens come together all earlier tokens are final and are emitted, so the lookahead
is bounded by the longest token. States and transitions are made when they are first needed; those of the first bytes of a
pre-token are kept in a bounded table.

Defined results: a null text is empty and has no tokens; every byte of the rank file's alphabet must be a token; rows are
encoded one by one, so repeated rows encode alike; an empty table gives an empty table. Decoding reads ids in any
portions; text comes out at the end of whole characters, and malformed bytes stay as they are in the byte output.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from conceptloom.llm.common import map_texts, tune

RANKS = "byte_bpe_multi_50k.tiktoken"
#: States, pair checks and pre-tokens that a Python worker remembers; beyond that a table starts anew.
STATES, PAIRS, PIECES = 200_000, 300_000, 150_000
#: Bytes of a pre-token whose transitions are kept; further on few come again, and making them costs less than keeping them.
KEPT = 12
#: Bytes of a pre-token after which settled tokens are given out.
LOOKAHEAD = 256

#: Of each live prefix the place in the trie of tokens that the bytes since its end lead to, and its last token, as one number.
State = tuple[int, ...]
#: Bits of a token, and the value that stands for no token.
TOKEN_BITS = 24
NONE = (1 << TOKEN_BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Bytes in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        # the trie of all tokens: by place and byte the next place; of each place its depth, its token (NONE: none) and whether it goes on
        self.trie: dict[int, int] = {}
        self.depth, self.ends_as, self.goes_on = [0], [NONE], [True]
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                self.goes_on[at] = True
                key = at << 8 | byte
                at = self.trie.get(key, -1)
                if at < 0:
                    at = self.trie[key] = len(self.depth)
                    self.depth.append(self.depth[key >> 8] + 1)
                    self.ends_as.append(NONE)
                    self.goes_on.append(False)
            self.ends_as[at] = rank
        self.spines: dict[tuple[int, int], list[tuple[bytes, float]]] = {}
        self.follows: dict[int, bool] = {}
        self.nodes: list[dict] = []
        self._reset()

    def _reset(self) -> None:
        for node in self.nodes:  # they point at one another
            node.clear()
        self.ids: dict[State, dict] = {}
        self.nodes = []  # of each state by byte the next state's node and the token; under -1 the state
        self.start = self._state((NONE,))

    def _state(self, key: State) -> dict:
        node = self.ids.get(key)
        if node is None:
            node = self.ids[key] = {-1: key}
            self.nodes.append(node)
        return node

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The merge rule itself, down to ``stop`` parts; used once for each token."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > stop:
            best, at = min(((r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None), default=(None, 0))
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at the token's right (1) or left (0) edge while it is being merged, outermost first, each with the
        rank of the merge that takes it; empty if merging the token's bytes gives something else."""
        key = (token, side)
        if key not in self.spines:
            out: list[tuple[bytes, float]] = []
            data, taken = self.tokens[token], float("inf")
            while True:
                parts = self.merged(data, 2)
                if len(data) > 1 and (len(parts) != 2 or self.ranks.get(data) is None):
                    out = []
                    break
                out.append((data, taken))
                if len(data) == 1:
                    break
                taken, data = self.ranks[data], parts[-side]
            self.spines[key] = out
        return self.spines[key]

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether merging the bytes of both gives both: no pair across their border has its turn while its two sides stand."""
        key = before << TOKEN_BITS | token
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) >= PAIRS:
                self.follows.clear()
            known = self.follows[key] = bool(self._spine(token, 0)) if before == NONE else self._stand(self._spine(before, 1), self._spine(token, 0))
        return known

    def _stand(self, left: list[tuple[bytes, float]], right: list[tuple[bytes, float]]) -> bool:
        if not left or not right:
            return False
        rank = self.ranks.get
        for a, a_taken in left:
            for b, b_taken in right:
                merge = rank(a + b)
                # of equal ranks the one further left goes first
                if merge is not None and merge < a_taken and merge <= b_taken:
                    return False
        return True

    def _make(self, node: dict, byte: int) -> tuple[dict, int]:
        """The transition of a state with ``byte``, kept: the next state and the last token of the prefix that it completes."""
        live, last = self._run(node[-1], bytes((byte,)), [])
        move = node[byte] = (self._state(tuple(live)), last[0])
        return move

    def _run(self, live: Iterable[int], data: bytes, last: list[int]) -> tuple[list[int], list[int]]:
        """The live prefixes after ``data``; each byte's prefix's last token is put to ``last``."""
        trie, ends_as, goes_on, follows = self.trie, self.ends_as, self.goes_on, self.follows
        for byte in data:
            here, open_ = NONE, []
            for x in live:
                at = trie.get(x >> TOKEN_BITS << 8 | byte)
                if at is None:
                    continue
                token = ends_as[at]
                if token != NONE and here == NONE:
                    may = follows.get((x & NONE) << TOKEN_BITS | token)
                    if may or may is None and self._may_follow(x & NONE, token):
                        here = token
                if goes_on[at]:
                    open_.append(at << TOKEN_BITS | x & NONE)
            if here == NONE:
                raise ValueError(f"no token ends with byte {byte}")
            open_.append(here)
            last.append(here)
            live = open_
        return live, last

    def encode(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        if data in self.ranks:
            return [self.ranks[data]]
        if len(self.nodes) > STATES:
            self._reset()
        out: list[int] = []
        node, last = self.start, []  # the last token of every prefix behind what is out already
        for byte in data[:KEPT]:
            node, token = node.get(byte) or self._make(node, byte)
            last.append(token)
        live = node[-1]
        for at in range(KEPT, len(data), LOOKAHEAD):
            live, last = self._run(live, data[at : at + LOOKAHEAD], last)
            if at + LOOKAHEAD < len(data):
                cut = self._final(live, last)
                out += self._back(last, cut)
                del last[:cut]
        return out + self._back(last, len(last))

    def _final(self, live: Iterable[int], last: list[int]) -> int:
        """How many bytes are settled: where the live prefixes' tokens come together, all before is final."""
        places = {len(last) - self.depth[x >> TOKEN_BITS] for x in live}
        while len(places) > 1:
            top = max(places)
            places.remove(top)
            places.add(top - self.size[last[top - 1]])
        return places.pop()

    def _back(self, last: list[int], at: int) -> list[int]:
        """The tokens of the prefix that ends at ``at``, read off backwards."""
        out, size = [], self.size
        while at > 0:
            token = last[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out


#: In texts of these characters alone ``\\w``, ``\\d`` and ``\\s`` say the same as letter, number and white space, and the standard
#: library's quicker matcher splits them like PATTERN.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ɏ]*")
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Known(dict):
    """Packed ids of pre-tokens. When it is full what it holds becomes old, and what is not asked for again goes."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__()
        self.machine, self.old = machine, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.old = dict(self)
            self.clear()
        packed = self.old.get(piece)
        if packed is None:
            packed = array("I", self.machine.encode(piece.encode()))
            if sys.byteorder == "big":
                packed.byteswap()
            packed = packed.tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class Encoder:
    """Encodes texts: each match of ``pattern`` for itself, remembered as packed ids."""

    def __init__(self, path: str, pattern: str) -> None:
        self.transducer = Transducer(read_ranks(path))
        self.any_split = regex.compile(pattern).findall
        self.plain_split = PLAIN_SPLIT.findall if pattern == public_tokenizers.PATTERN else self.any_split
        self.bytes_of = self.transducer.tokens
        self.known = Known(self.transducer)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of ``text``."""
        return self.plain_split(text) if PLAIN.fullmatch(text) else self.any_split(text)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()


#: The lead bytes of longer characters with their length and the range of the byte after; later bytes are 80 to BF.
LEADS = ((0xC2, 0xDF, 2, 0x80, 0xBF), (0xE0, 0xE0, 3, 0xA0, 0xBF), (0xE1, 0xEC, 3, 0x80, 0xBF), (0xED, 0xED, 3, 0x80, 0x9F), (0xEE, 0xEF, 3, 0x80, 0xBF), (0xF0, 0xF0, 4, 0x90, 0xBF), (0xF1, 0xF3, 4, 0x80, 0xBF), (0xF4, 0xF4, 4, 0x80, 0x8F))


class Utf8Machine:
    """The states of UTF-8: between characters (0), or so many bytes due, the first of them in a certain range."""

    def __init__(self) -> None:
        self.states: list[tuple[int, int, int]] = [(0, 0, 0), (1, 0x80, 0xBF), (2, 0x80, 0xBF)]
        self.lead: dict[int, int] = {}
        for low, high, size, first, last in LEADS:
            key = (size - 1, first, last)
            if key not in self.states:
                self.states.append(key)
            for b in range(low, high + 1):
                self.lead[b] = self.states.index(key)

    def next(self, state: int, byte: int) -> int | None:
        """The state after ``byte``; None where it may not come."""
        due, low, high = self.states[state]
        if due == 0:
            return 0 if byte < 0x80 else self.lead.get(byte)
        if not low <= byte <= high:
            return None
        return due - 1 if due > 1 else 0


_MACHINE = Utf8Machine()


class StreamDecoder:
    """Token ids in portions to bytes that end with whole characters; what is unfinished waits for the next portion."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.bytes_of = tokens.__getitem__
        self.waiting = b""

    def feed(self, ids: Iterable[int]) -> bytes:
        data = self.waiting + b"".join(map(self.bytes_of, ids))
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            lead = data[cut - back]
            if lead >= 0xC0:  # the last character begins here: run the machine over its bytes
                state: int | None = 0
                for b in data[cut - back :]:
                    state = None if state is None else _MACHINE.next(state, b)
                if state:
                    cut -= back
                break
            if lead < 0x80:
                break
        self.waiting = data[cut:]
        return data[:cut]

    def end(self) -> bytes:
        rest, self.waiting = self.waiting, b""
        return rest


def decode_stream(portions: Iterable[Iterable[int]], tokens: dict[int, bytes]) -> Iterator[str]:
    """Text as it becomes complete; malformed bytes become replacement characters."""
    decoder = StreamDecoder(tokens)
    for ids in portions:
        if data := decoder.feed(ids):
            yield data.decode("utf-8", "replace")
    if data := decoder.end():
        yield data.decode("utf-8", "replace")


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the collector of cycles, which would go through the growing tables again and again and find none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (or ``doc_id``) with ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit) of every text."""
    tune(docs.sparkSession)
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        with _uncollected():
            packed = [encoder(path, pattern).packed(t or "") for t in batch.column("text").to_pylist()]
        return {"n_tokens": pa.array([len(p) // 4 for p in packed], type=pa.int64()), "ids": pa.array(packed, type=pa.binary())}

    columns = columns or ["doc_id"]
    return map_texts(docs.select(*dict.fromkeys([*columns, "text"])), fn, "n_tokens long, ids binary", columns)


def encode_and_verify(docs: DataFrame, path: str | None = None, pattern: str | None = None, columns: list[str] | None = None, portion: int = 4096) -> DataFrame:
    """Encode every text, then decode its ids as a stream: ``n_tokens``, ``ids`` (packed), ``ids_sha256``, ``decoded_sha256`` beside ``columns`` (or ``doc_id``)."""
    tune(docs.sparkSession)
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        coder = encoder(path, pattern)
        ids, ids_sha, text_sha = [], [], []
        for text in batch.column("text").to_pylist():
            with _uncollected():
                packed = coder.packed(text or "")
            ids.append(packed)
            ids_sha.append(hashlib.sha256(packed).hexdigest())
            decoder, digest = StreamDecoder(coder.bytes_of), hashlib.sha256()
            for at in range(0, len(packed), 4 * portion):
                digest.update(decoder.feed(np.frombuffer(packed[at : at + 4 * portion], dtype="<u4").tolist()))
            digest.update(decoder.end())
            text_sha.append(digest.hexdigest())
        return {"n_tokens": pa.array([len(p) // 4 for p in ids], type=pa.int64()), "ids": pa.array(ids, type=pa.binary()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)}

    columns = columns or ["doc_id"]
    return map_texts(docs.select(*dict.fromkeys([*columns, "text"])), fn, "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string", columns)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """:func:`encode_and_verify` without the ids."""
    return encode_and_verify(docs, **options).drop("ids")
