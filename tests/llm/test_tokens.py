import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from conceptloom.llm import byte_bpe, token_counts


@pytest.fixture(scope="module")
def encoding():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed):
    r = random.Random(seed)
    parts = ["a", "e", "th", " ", "é", "über", "The", "'s", "'Re", "\n", "\t\t ", "1", "234", "!!", "漢", "字", "\U0001f600", "ß", "ing", "aaaa", "ñ", "Σ", "<|endoftext|>", "İ", "\x1c", "́", "²", "_"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["".join(chr(r.randint(97, 122)) for _ in range(r.randint(0, 3000))) for _ in range(n // 5)]


def test_encoder_equals_the_library(encoding, odd_texts):
    coder = byte_bpe.Encoder(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    for text in random_texts(600, 1) + [t or "" for t in odd_texts]:
        assert coder.ids(text) == encoding.encode_ordinary(text)
        assert coder.any_split(text) == coder.split(text)


def test_encoder_with_tiny_tables(encoding, monkeypatch):
    for name in ("STATES", "PAIRS", "PIECES"):
        monkeypatch.setattr(byte_bpe, name, 20)
    monkeypatch.setattr(byte_bpe, "LOOKAHEAD", 8)
    coder = byte_bpe.Encoder(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    for text in random_texts(150, 2):
        assert coder.ids(text) == encoding.encode_ordinary(text)


def test_stream_decoding_in_any_portions(encoding):
    tokens = {v: k for k, v in byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS)).items()}
    for text in random_texts(60, 3):
        ids = encoding.encode_ordinary(text)
        for size in (1, 2, 7, 1000):
            parts = list(byte_bpe.decode_stream([ids[i : i + size] for i in range(0, len(ids), size)], tokens))
            assert "".join(parts) == text and "�" not in "".join(parts)
    broken = [next(i for i, b in tokens.items() if b == bytes([x])) for x in (0xE6, 0x41, 0xFF, 0xC3)]
    decoder = byte_bpe.StreamDecoder(tokens)
    assert b"".join([*(decoder.feed([i]) for i in broken), decoder.end()]) == b"\xe6A\xff\xc3"


def test_round_trip_query(docs, odd_texts, encoding):
    for r in byte_bpe.round_trip(docs(odd_texts)).collect():
        text = odd_texts[r["doc_id"]] or ""
        ids = encoding.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe.round_trip(docs([])).count() == 0


def test_every_code_point_splits_as_in_the_library():
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library, own = Tokenizer.from_file(path), token_counts.WordEndCounter(path)
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE0200)]]  # nothing is assigned elsewhere
    split = lambda t: [x for x, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(t))]
    letters = token_counts.byte_letters()
    for at in range(0, len(points), 60):
        for text in ("".join(f"a{c}b 1{c}1 " for c in points[at : at + 60]), " ".join(f"e{c}\u0323\u0301" for c in points[at : at + 60])):
            assert ["".join(letters[b] for b in p.encode()) for p in own.split(text)[0]] == split(text)
    r = random.Random(12)
    odd = [chr(c) for c in sorted(token_counts.NO_LETTERS | token_counts.NO_MARKS | token_counts.SMALL.keys())]
    texts = ["".join(r.choice(["a", "É", " ", "1", "\u0323", "\u0301", "Σ", "\U00011935", *r.sample(odd, 3)]) for _ in range(30)) for _ in range(2000)]
    assert own.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(docs, odd_texts):
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library = Tokenizer.from_file(path)
    texts = random_texts(600, 4) + [t or "" for t in odd_texts]
    assert token_counts.WordEndCounter(path).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    found = {r["doc_id"]: tuple(r)[1:] for r in token_counts.token_counts(docs(odd_texts)).collect()}
    for i, t in enumerate(odd_texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert found[i] == (len((t or "").encode()), n, n > 2048)
    assert token_counts.token_counts(docs([])).count() == 0
