"""SimHash fingerprints and their near-duplicate groups by covering locality-sensitive hashing.

Covering hashing for radius r: bit i gets a non-zero vector m(i) of r + 1 bits, and for each of the 2^(r+1) - 1 non-zero
vectors v a table keeps the bits with odd <m(i), v>. Any r differing bits leave some v orthogonal to all their vectors,
so two fingerprints within the radius agree on all bits that this table keeps: no pair can be missed.

A bucket's fingerprints are linked without listing pairs: two fingerprints are within two bits exactly if some value
lies within one bit of both, so each sends itself and its one-bit neighbours among the bucket's free bits, and equal
values are grouped to their smallest member. Work stays linear in a bucket's size, whatever that is.

Fingerprints of two bits' radius are close to exact copies only. ``similar_documents`` links all texts whose distinct
five-word shingles have a Jaccard similarity of 0.8: of n shingles in a common order, rare ones first, each text keeps
the first n - ceil(0.8 n) + 1, and two similar texts share one of these. Fingerprints over the distinct words and one
comparison with a shingle's first text join most copies; the rest are compared pair by pair. A sketch of each text's
shingles bounds how many a pair can share, and what that leaves is decided by the exact similarity. Many texts that share
rare shingles without being similar are a quadratic number of pairs.

Defined results: a null text and a text without words have fingerprint zero and link like any other; repeated rows link
at distance zero; rows whose id is null get a fingerprint, the smallest id reachable, and start no group; an empty table
gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from conceptloom.llm.common import discard, map_texts, text_bytes, tune, written
from conceptloom.llm.components import components

RADIUS, SHINGLE = 2, 3
#: Rows of a bucket whose pairs are compared one by one.
SMALL = 8


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The tables' masks; with m(i) running through the non-zero vectors, each keeps about 2^r of 2^(r+1) - 1 bits."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE, digest=xxhash.xxh64_digest) -> int:
    """Unsigned 64-bit SimHash over the text's word shingles, repeats included."""
    words = text.lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashed = digest(joined, 42)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
        hashed = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    n = len(hashed) // 8
    table = np.frombuffer(hashed, dtype=np.uint8).reshape(n, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(table[at : at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long); one narrow pass."""
    tune(docs.sparkSession)

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"fp": pa.array(np.array([fingerprint(t, shingle) for t in text_bytes(batch)], dtype=np.uint64).view(np.int64))}

    return map_texts(docs.select("doc_id", "text"), fn, "fp long")


def links(groups: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (``a``, ``b``) between the ``rep`` of rows with ``fps``, an array of fingerprints each compared with the others' at
    its place: they connect exactly what chains of pairs within ``radius`` (1 or 2) bits connect.

    Buckets of up to ``SMALL`` rows compare their pairs; larger ones link through one-bit neighbours, as said above.
    """
    if radius not in (1, 2):
        raise ValueError("the midpoint links are exact for a radius of 1 or 2")
    tables = [(v, _signed(m)) for v, m in enumerate(masks(radius))]
    kept = F.array(*[F.struct(F.lit(v).cast("short").alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in tables])
    each = groups.select("rep", F.posexplode("fps").alias("j", "fp")).select("rep", F.col("j").cast("short").alias("j"), "fp")
    # rows with one fingerprint link to their smallest; it alone stands for them from here on
    nodes = written(each.groupBy("j", "fp").agg(F.min("rep").alias("b"), F.max("rep").alias("top")), "prints")
    equal = each.join(nodes.where("b < top").select("j", "fp", "b"), ["j", "fp"]).where("rep <> b").select(F.col("rep").alias("a"), "b")
    rows = nodes.select(F.col("b").alias("rep"), "j", "fp").select("rep", "j", "fp", F.inline(kept))
    shared = written(rows.groupBy("j", "v", "key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = written(rows.join(shared, ["j", "v", "key"]), "met")
    few = met.where(F.col("n") <= SMALL).groupBy("j", "v", "key").agg(F.array_sort(F.collect_list(F.struct("rep", "fp"))).alias("rows"))
    near = F.filter("rows", lambda x: (x["rep"] < F.col("one.rep")) & (F.bit_count(x["fp"].bitwiseXOR(F.col("one.fp"))) <= radius))
    pairs = few.select("rows", F.explode("rows").alias("one")).select(F.col("one.rep").alias("a"), F.explode(F.transform(near, lambda x: x["rep"])).alias("b"))
    # the bits that are free in any of a fingerprint's large buckets, so that its neighbours are made once and not per table
    free = F.element_at(F.array(*[F.lit(~m) for _, m in tables]), F.col("v") + 1)
    large = met.where(F.col("n") > SMALL).groupBy("j", "fp", "rep").agg(F.bit_or(free).alias("free"))
    bits = F.filter(F.array(*[F.lit(_signed(1 << i)) for i in range(64)]), lambda bit: bit.bitwiseAND(F.col("free")) != 0)
    middle = large.select("rep", "j", F.explode(F.concat(F.array("fp"), F.transform(bits, lambda bit: F.col("fp").bitwiseXOR(bit)))).alias("z"))
    least = middle.groupBy("j", "z").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b < top").select("j", "z", "b")
    least = written(least, "middles")
    stars = middle.join(least, ["j", "z"]).where("rep <> b").select(F.col("rep").alias("a"), "b")
    return equal.unionByName(pairs).unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id``: the smallest id among all documents reachable over fingerprints within ``radius``."""
    prints = written(fingerprints(docs, shingle), "prints")
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "groups")
    found = components(links(groups.where("rep IS NOT NULL").select("rep", F.array("fp").alias("fps")), radius))
    named = groups.join(found, groups["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


#: Fingerprints over words, words of a shingle, and the similarity (Jaccard, of distinct shingles).
SEEDS, WORDS, SIMILARITY = 4, 5, 0.8
#: How many of the most frequent shingles, counted over all documents, are put last.
FREQUENT = 500_000


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Other 64-bit hashes of the same things."""
    h = (h ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big") if len(h) else 0


def hashed_words(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    return np.array(list(map(xxhash.xxh3_64_intdigest, text.lower().split())), dtype=np.uint64)


def word_fingerprints(hashed: np.ndarray, seeds: int = SEEDS) -> list[int]:
    """``seeds`` fingerprints over the distinct words."""
    single = np.unique(hashed)
    return [_majority(_mixed(single, k)) for k in range(seeds)]


def shingles(hashed: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of the distinct shingles; a shorter text is one shingle."""
    if not len(hashed):
        return hashed
    size = min(words, len(hashed))
    out = np.full(len(hashed) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = _mixed(out, k) + hashed[k : k + len(out)]
    return np.unique(_mixed(out, words))


def _ratio(similarity: float) -> tuple[int, int]:
    return Fraction(similarity).limit_denominator(1000).as_integer_ratio()


def prefix(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles in an order that all texts share, so many that two texts of at least that similarity have one in
    common. The order is rare before ``frequent`` (sorted hashes, their counts), then by hash; any order would be as exact."""
    p, q = _ratio(similarity)
    size = len(found) - -(-p * len(found) // q) + 1 if len(found) else 0
    known, counts = frequent
    rank = np.zeros(len(found), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        rank = np.where(known[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))[:size]]


def sketch(found: np.ndarray) -> bytes:
    """How many of the shingles begin with each value of their first bits, about four of them a value, in one byte each; empty
    where a byte does not hold it."""
    bits = max(1, len(found) // 4).bit_length() - 1
    first = found >> np.uint64(64 - bits) if bits else np.zeros(len(found), dtype=np.uint64)
    counts = np.bincount(first.astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def shared_at_most(one: bytes, other: bytes) -> float:
    """An upper bound of the number of shingles that two sketches' texts share: what each value's smaller count allows."""
    if not one or not other:
        return float("inf")
    a, b = (np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in (one, other))
    size = min(len(a), len(b))
    return int(np.minimum(a.reshape(size, -1).sum(axis=1), b.reshape(size, -1).sum(axis=1)).sum())


def _frequent(docs: DataFrame, words: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts over all documents of the ``most`` frequent shingles, without those of the first count that does not fit."""
    fn = lambda batch: {"h": pa.array([shingles(hashed_words(t), words).view(np.int64) for t in text_bytes(batch)], type=pa.list_(pa.int64()))}
    counted = written(map_texts(docs.select("key", "text"), fn, "h array<long>", ["key"]).select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 2"), "counted")
    total, least = 0, None
    for n, size in sorted(map(tuple, counted.groupBy("n").count().collect()), reverse=True):
        total += size
        if total > most:
            break
        least = n
    top = counted.where(F.col("n") >= least if least is not None else F.lit(False)).toPandas()
    discard(counted)
    h, n = top["h"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64)
    by = np.argsort(h)
    return h[by], n[by]


def _ends(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the ``columns`` of both ends' rows in ``of`` (``rep``), as ``x_a`` and ``x_b``."""
    for end in ("a", "b"):
        pairs = pairs.join(of.select(F.col("rep").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return pairs


def _promising(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those ``pairs`` (``a``, ``b``) whose numbers of shingles and sketches leave the similarity possible."""
    p, q = _ratio(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, one, other = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b"))
            keep = [shared_at_most(x, y) * (p + q) >= p * (k + m) for k, m, x, y in zip(n_a, n_b, one, other, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    sized = _ends(pairs, nodes, ["n"]).where(q * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b"))
    return _ends(sized, nodes, ["sketch"]).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those ``pairs`` (``a``, ``b``: keys) whose distinct shingles are at least so similar, exactly."""
    p, q = _ratio(similarity)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    fn = lambda batch: {"set": pa.array([shingles(hashed_words(t), words).tobytes() for t in text_bytes(batch)], type=pa.binary())}
    sets = written(map_texts(docs.select("key", "text").join(wanted, "key", "left_semi"), fn, "set binary", ["key"]), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(z.as_py(), dtype=np.uint64) for z in (x, y))
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) * (p + q) >= p * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    out = written(_ends(pairs, sets.withColumnRenamed("key", "rep"), ["set"]).select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), "alike")
    discard(sets)
    return out


def _grouped(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """``key``, ``doc_id``, ``component_id`` and ``first``, the smallest id of the group and the key of its row, over ``docs`` with a
    lasting ``key`` of each row."""
    tune(docs.sparkSession)
    p, q = _ratio(similarity)
    frequent = _frequent(docs, words)

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        hashed = [hashed_words(t) for t in text_bytes(batch)]
        found = [shingles(h, words) for h in hashed]
        longs = lambda rows: pa.array([x.view(np.int64) for x in rows], type=pa.list_(pa.int64()))
        return {
            "n": pa.array([len(x) for x in found], type=pa.int32()), "kind": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], type=pa.binary()), "sketch": pa.array([sketch(x) for x in found], type=pa.binary()),
            "fps": longs(np.array(word_fingerprints(h), dtype=np.uint64) for h in hashed), "prefix": longs(prefix(x, frequent, similarity) for x in found),
        }

    prints = written(map_texts(docs.select("key", "doc_id", "text"), fn, "n int, kind binary, sketch binary, fps array<long>, prefix array<long>", ["key", "doc_id"]), "prints")
    groups = written(prints.where("doc_id IS NOT NULL").groupBy("kind").agg(F.min(F.struct("doc_id", "key")).alias("one")).select("kind", "one.doc_id", F.col("one.key").alias("rep")), "groups")
    nodes = written(groups.select(F.col("rep").alias("key")).join(prints.where("n > 0"), "key").select(F.col("key").alias("rep"), "n", "sketch", "fps", "prefix"), "nodes")
    named = written(prints.select("key", "doc_id", "kind"), "kinds")
    discard(prints)
    # one comparison of a shingle's texts with the first of them, and the SimHash candidates: linear, and enough within most groups
    rows = nodes.select("rep", "n", F.posexplode("prefix").alias("pos", "h"))
    shared = written(rows.groupBy("h").agg(F.min("rep").alias("least"), F.max("rep").alias("top")).where("least < top").select("h", "least"), "shared")
    met = written(rows.join(shared, "h"), "met")
    stars = met.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    near = links(nodes.select("rep", "fps")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    candidates = written(stars.unionByName(near).distinct(), "candidates")
    edges = _alike(written(_promising(candidates, nodes, similarity), "promising"), docs, words, similarity)
    # what is not in one group yet is compared in full: two texts that are alike enough meet in their prefixes
    joined = components(edges).select(F.col("node").alias("rep"), "component")
    left = written(met.join(joined, "rep", "left").select("h", "rep", "n", "pos", F.coalesce("component", "rep").alias("c")), "left")
    open_ = written(left.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("h"), "open")
    left = left.join(open_, "h", "left_semi")
    one, other = (left.select("h", *[F.col(x).alias(f"{x}{i}") for x in ("rep", "n", "pos", "c")]) for i in (1, 2))
    enough = (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) * (p + q) >= p * (F.col("n1") + F.col("n2"))) & (q * F.least("n1", "n2") >= p * F.greatest("n1", "n2"))
    rest = one.join(other, (one["h"] == other["h"]) & (F.col("rep1") > F.col("rep2")) & (F.col("c1") != F.col("c2")) & enough)
    rest = written(rest.select(F.col("rep1").alias("a"), F.col("rep2").alias("b")).distinct().join(candidates, ["a", "b"], "left_anti"), "rest")
    found = components(edges.unionByName(_alike(written(_promising(rest, nodes, similarity), "promising"), docs, words, similarity)))
    of = groups.join(found, groups["rep"] == found["node"], "left").select("kind", "doc_id", "rep", F.coalesce("component", "rep").alias("c"))
    least = written(of.groupBy("c").agg(F.min(F.struct("doc_id", "rep")).alias("one")).select("c", F.col("one.doc_id").alias("component_id"), F.col("one.rep").alias("first")), "least")
    of = written(of.join(least, "c").select("kind", "component_id", "first"), "named")
    return named.join(of, "kind", "left").select("key", "doc_id", "component_id", "first")


def _with_key(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a lasting ``key`` of each row: the id where it tells all rows apart."""
    n = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("ids"), F.count_distinct("doc_id").alias("distinct")).first()
    if n["rows"] == n["ids"] == n["distinct"] and isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")


def similar_documents(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``component_id``: the smallest id of the group that similar five-word shingles link. Texts without words form one group."""
    return _grouped(_with_key(docs.select("doc_id", "text"), "key"), words, similarity).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row, of the smallest id, of each group of similar documents; rows with a null id stay, and rows with equal
    ids count each for itself."""
    key = max(docs.columns, key=len) + "_key"
    rows = _with_key(docs, key)
    grouped = _grouped(rows.where("doc_id IS NOT NULL").select(F.col(key).alias("key"), "doc_id", "text"), words, similarity)
    kept = written(grouped.where("key = first").select(F.col("key").alias(key)), "kept")
    return rows.join(kept, key, "left_semi").select(docs.columns).unionByName(rows.where("doc_id IS NULL").select(docs.columns))
