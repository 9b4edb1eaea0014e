import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from conceptloom.llm import anchors, components, repetition, simhash, substrings, suffixes


def brute_repeats(words):
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            out[i] = max(out[i], n)
    return out


def test_longest_repeats_and_rules():
    r = random.Random(1)
    for _ in range(120):
        texts = [b" ".join(r.choice([b"a", b"b", b"c\nc"]) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 4))]
        got = repetition.measure(texts, 4)
        for i, text in enumerate(texts):
            longest = brute_repeats(text.split())
            assert got["longest_repeat"][i] == max(longest, default=0)
            for column, least in (("covered_words", 4), ("n_repeat_words", 3)):
                assert got[column][i] == len({p + k for p, n in enumerate(longest) if n >= least for k in range(n)})
            lines = [x for x in text.split(b"\n") if x.split()]
            assert got["n_dup_lines"][i] == len(lines) - len(set(lines))


def test_rules_on_odd_texts(docs, odd_texts):
    out = {r["doc_id"]: r for r in repetition.repetition_rules(docs(odd_texts)).collect()}
    assert len(out) == len(odd_texts)
    for i, t in enumerate(odd_texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (out[i]["n_words"], out[i]["word_chars"], out[i]["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
    assert not out[7]["kept"] and out[8]["kept"] and not out[0]["kept"]
    kept = repetition.quality_filter(docs(odd_texts))
    assert kept.columns == docs([]).columns and sorted(r["doc_id"] for r in kept.collect()) == [8, 9]
    assert repetition.quality_filter(docs([])).count() == 0


def reference_fingerprint(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs, odd_texts):
    for r in simhash.fingerprints(docs(odd_texts)).collect():
        assert r["fp"] % (1 << 64) == reference_fingerprint(odd_texts[r["doc_id"]])


@pytest.mark.parametrize("radius", [1, 2])
def test_masks_cover_every_pair(radius):
    import itertools

    for bits in itertools.combinations(range(64), radius):
        assert any(not any(m >> b & 1 for b in bits) for m in simhash.masks(radius))


def brute_components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_links_are_complete_in_small_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 3)
    r = random.Random(5)
    fps = {0}
    while len(fps) < 300:
        base = r.choice(sorted(fps)) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randint(0, 3)):
            base ^= 1 << r.randrange(64)
        fps.add(base)
    fps = list(fps)
    rows = spark.createDataFrame([(i, [f - (1 << 64) if f >> 63 else f]) for i, f in enumerate(fps)], "rep long, fps array<long>")
    found = {x["node"]: x["component"] for x in components.components(simhash.links(rows)).collect()}
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = brute_components(edges, range(len(fps)))
    assert {i: found.get(i, i) for i in range(len(fps))} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    df = spark.createDataFrame(chain + [(None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.components(df.limit(0)).count() == 0


def test_groups_with_ties_nulls_and_repeated_rows(docs, odd_texts):
    out = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs(odd_texts + ["one two three four five"], [*range(len(odd_texts)), None])).collect()]
    assert dict(out)[5] == 4 and dict(out)[None] == 4 and dict(out)[1] == dict(out)[2] == 0 and len(out) == len(odd_texts) + 1
    assert simhash.near_duplicates(docs([])).count() == 0


def test_one_of_each_catches_near_copies_only(docs):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    base = [[r.choice(vocabulary) for _ in range(300)] for _ in range(30)]
    near = []
    for words in base[:15]:
        copy = list(words)
        copy[r.randrange(300)] = "changed"
        near.append(copy)
    half = [w[:150] + base[(i + 1) % 30][:150] for i, w in enumerate(base)]
    texts = [" ".join(w) for w in base + near + half] + [" ".join(base[0])]
    kept = {x["doc_id"] for x in simhash.one_of_each(docs(texts)).collect()}
    assert set(range(30)) <= kept and set(range(45, 75)) <= kept and 75 not in kept
    assert len(kept & set(range(30, 45))) <= 1
    assert simhash.one_of_each(docs([])).count() == 0


def block_edits(r, vocabulary, size):
    """A text and its copies with the tail replaced, words appended, the end cut off and single words changed."""
    base = [r.choice(vocabulary) for _ in range(size)]
    k = size // 11
    new = [r.choice(vocabulary) for _ in range(k + size // 8)]
    scattered = list(base)
    for i in range(size // 80):
        scattered[r.randrange(i * 80, i * 80 + 80)] = "changed"
    return [base, base[:-k] + new[:k], base + new[: size // 6], base[: -size // 6], scattered]


def test_similar_documents_are_exactly_those_of_the_similarity(docs):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    hot = [r.choice(vocabulary) for _ in range(60)]
    # each edit in a group of its own, so that no other edit can link it
    texts = [x for size in (60, 90, 200, 400) for k in (1, 2, 3, 4) for _ in range(8) for edits in [block_edits(r, vocabulary, size)] for x in (edits[0], edits[k])]
    texts += [hot + [r.choice(vocabulary) for _ in range(r.randint(0, 90))] for _ in range(40)]
    r.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(edges) > 100
    found = {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(docs([" ".join(t) for t in texts])).collect()}
    assert found == brute_components(edges, range(len(texts)))


def test_sketches_bound_what_texts_share():
    r = random.Random(13)
    for _ in range(400):
        pool = np.unique(np.array([r.getrandbits(64) for _ in range(r.randint(1, 400))], dtype=np.uint64))
        a, b = (pool[[r.random() < share for _ in pool]] for share in (r.random(), r.random()))
        both = len(np.intersect1d(a, b))
        assert both <= simhash.shared_at_most(simhash.sketch(a), simhash.sketch(b)) <= min(len(a), len(b))
    assert simhash.sketch(np.arange(2000, dtype=np.uint64)) == b"" and simhash.shared_at_most(b"", simhash.sketch(pool)) == float("inf")


def test_one_of_each_keeps_different_texts_of_one_id(docs):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    kept = simhash.one_of_each(docs([a, b, a, a, None], [1, 1, 1, 2, None])).collect()
    assert sorted((x["doc_id"] or 9, x["text"] or "") for x in kept) == [(1, a), (1, b), (9, "")]


def test_suffix_sorting():
    r = random.Random(3)
    for _ in range(300):
        data = bytes(r.choice([0, 97, 98, 255][: r.randint(1, 4)]) for _ in range(r.randint(0, 60)))
        words = suffixes.words_at(data, 100)
        order = suffixes.two_stage(data, words, 100).tolist()
        assert [data[i:] for i in order] == sorted(data[i:] for i in range(len(data)))
        common = suffixes.same_prefix(np.array(order, dtype=np.int64), words, 100) if data else []
        for k in range(1, len(order)):
            a, b = data[order[k - 1] :] + bytes(200), data[order[k] :] + bytes(200)
            assert common[k] == next((i for i in range(100) if a[i] != b[i]), 100)


def test_equal_windows_have_equal_anchors():
    r = random.Random(4)
    texts = [bytes(r.choice(b"abc") for _ in range(r.randint(0, 120))) for _ in range(60)]
    data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    h, lo, n, far = anchors.anchors(np.frombuffer(data, dtype=np.uint8), ends, 20, 6)
    seen = {}
    for a, at, many, o in zip(h.tolist(), lo.tolist(), n.tolist(), far.tolist(), strict=True):
        assert (np.frombuffer(data[at + o : at + o + 6], dtype=np.uint8).size, anchors.gram_hashes(np.frombuffer(data, dtype=np.uint8), 6)[at + o].item()) == (6, a)
        for s in range(at, at + many):
            assert seen.setdefault(data[s : s + 20], a) == a
    assert int(n.sum()) == sum(max(0, len(t) - 19) for t in texts)


def brute_removal(texts, width):
    seen, out = set(), []
    for t in texts:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        out.append((len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("pieces", [2, 2048])
def test_removal_equals_brute_force(docs, odd_texts, monkeypatch, pieces):
    monkeypatch.setattr(substrings, "PIECES", pieces)
    r = random.Random(6)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randint(90, 400))) for _ in range(6)]
    texts = list(odd_texts) + ["".join(r.choice(passages)[r.randint(0, 40) : r.randint(150, 400)] + "".join(r.choice("xyz ") for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 5))) for _ in range(40)]
    found = {x["doc_id"]: tuple(x)[1:] for x in substrings.digests(docs(texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute_removal(texts, 100)


def test_removal_with_null_and_repeated_ids(docs):
    a, b = "p" * 50 + "".join(chr(97 + i % 26) for i in range(200)), "q" * 60 + "".join(chr(97 + i % 26) for i in range(200))
    out = substrings.digests(docs([a, a, b, a, "é" * 120], [1, 1, 1, None, 2])).collect()
    # a and b are two documents of id 1, in the order of a hash; the copies of a agree
    first, *_ = [x for x in (brute_removal([a, b, "é" * 120, a], 100), brute_removal([b, a, "é" * 120, a], 100)) if {r["n_removed"] for r in out if r["doc_id"] == 1} == {x[0][1], x[1][1]}]
    assert sorted((r["doc_id"] or 9, *tuple(r)[1:]) for r in out if r["doc_id"] != 1) == [(2, *first[2]), (9, *first[3])]
    sole = [r for r in out if r["doc_id"] == 1 and r["n_bytes"] == len(a)]
    assert len(out) == 5 and len(sole) == 2 and sole[0] == sole[1]
    clear = substrings.digests(docs([a, a, a[:150] + b], [1, 1, 3])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in clear) == [(i, brute_removal([a, a[:150] + b], 100)[i == 3][1]) for i in (1, 1, 3)]
    cut = {r["doc_id"]: r["text"] for r in substrings.cut_repeats(docs([a, "x" + a, None, "é" * 120])).collect()}
    assert cut[1] == "x" and cut[2] is None and set(cut[3]) == {"é"}
    assert substrings.digests(docs([])).count() == 0


def test_frequent_shingles_are_counted_over_all_documents(spark):
    from conceptloom.llm import simhash

    words = lambda i: f"a{i} b{i} c{i} d{i} e{i}"
    texts = [words(0)] * 5 + [words(1)] * 4 + [words(2)] * 4 + [words(3)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    of = lambda i: int(simhash.shingles(simhash.hashed_words(words(i).encode()))[0])
    seen = lambda most: dict(zip(*[x.tolist() for x in simhash._frequent(docs, 5, most)], strict=True))
    assert seen(9) == {of(0): 5, of(1): 4, of(2): 4} and seen(2) == {of(0): 5} and seen(0) == {}
    assert not hasattr(simhash, "FREQUENT_DOCS")
