"""SpotSigs fingerprints: chains of content words behind common-word anchors, compared by pruned Jaccard similarity.

At each common word (of English, French, German or Spanish) a signature is made of that word and the next ``CHAIN`` words
that are not common; a text's fingerprint is the set of its signatures. A text without a signature has one for all its
words, a text without words the empty set.

Sets are partitioned by length so that sets of classes further than one apart cannot reach the threshold, and within
reach a comparison ends as soon as the rest cannot lift it to what is asked for.

Defined results: a null text is empty; two empty sets are alike (1.0); equal texts have equal fingerprints, so repeated
rows agree; documents follow one another by id, null ids last, equal ids in the order of their texts' hashes; a lone row
is its own successor; an empty table gives an empty table; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptloom.llm.common import chunks, map_texts, tune, written

CHAIN, THRESHOLD = 2, 0.8
#: Documents of one range of ids, and ranges at most.
RANGE_ROWS, RANGES = 4096, 20_000
COMMON = frozenset(
    """the a an of and or to in is are was were be been by for with on at from as that this it its he she they we you i not but have has had
    le la les un une des du de et ou à en dans est sont par pour avec sur que qui ce cette il elle ils nous vous ne pas au aux
    der die das ein eine einer eines und oder zu in im ist sind war von für mit auf den dem des nicht als auch es er sie wir ihr
    el los las una unos y o que es son por para con su sus del al no se lo como más""".split()
)
_DROPPED = bytes(b for b in range(33, 127) if not chr(b).isalnum())


class _Hashes(dict):
    """Hash of each word, its lowest bit set for a common word; starts anew when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) & ~1 | (word.decode("utf-8", "replace") in COMMON)
        return h


_HASHES = _Hashes()


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """The text's signatures as sorted distinct 32-bit hashes."""
    words = text.lower().encode().translate(None, _DROPPED).split()
    if not words:
        return np.empty(0, dtype=np.uint32)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    common = (h & np.uint64(1)).astype(bool)
    spots, content = np.flatnonzero(common), np.flatnonzero(~common)
    after = np.searchsorted(content, spots)
    spots, after = spots[after + chain <= len(content)], after[after + chain <= len(content)]
    if not len(spots):
        return np.array([xxhash.xxh32_intdigest(b" ".join(words))], dtype=np.uint32)
    mixed = h[spots]
    for k in range(chain):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[content[after + k]]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def encode(signs: np.ndarray) -> str:
    """A fingerprint as text: its sorted hashes, little-endian, in base64."""
    return base64.b64encode(signs.astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def length_class(size: int, threshold: float = THRESHOLD) -> int:
    """Sets at least ``threshold`` alike are in one class or in neighbouring ones."""
    return 0 if size == 0 else 1 + int(math.log(size) / -math.log(threshold) + 1e-9)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted distinct arrays; 0.0 as soon as it is known to be under ``least``."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 1.0
    if len(a) < least * len(b):
        return 0.0
    both = done = 0
    step = len(a) if least <= 0 else 256
    while done < len(a):
        part = a[done : done + step]
        at = np.searchsorted(b, part)
        both += int((b[np.minimum(at, len(b) - 1)] == part).sum())
        done += len(part)
        best = both + len(a) - done
        if best < least * (len(a) + len(b) - best):
            return 0.0
    return both / (len(a) + len(b) - both)


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[float, bool]:
    """Jaccard similarity of two sets, and whether it reaches ``threshold``. Sets of classes further than one apart are not compared for
    that, the others by the pruned comparison; only for the value of what is told apart so, all is counted."""
    if abs(length_class(len(a), threshold) - length_class(len(b), threshold)) <= 1 and (found := jaccard(a, b, threshold)) >= threshold:
        return found, True
    return jaccard(a, b), False


def edited(text: str, following: str) -> str:
    """``text`` whose last quarter of code points gives way to the first as many of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _range_of(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    leads = F.array(*[F.lit(g[0]) for g in groups])
    sets = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    group = F.size(F.filter(leads, lambda x: x <= value))
    inside = F.size(F.filter(F.element_at(sets, F.greatest(group, F.lit(1))), lambda x: x <= value))
    return F.when(group == 0, 0).otherwise((group - 1) * step + inside)


def in_order(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id``, ``text`` in ranges of ids (``part``), each sorted in one task and followed by the first row of the next range
    (``own`` false; the first range follows the last). One shuffle of the texts; the driver sees one id per range."""
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    keyed = docs.select("doc_id", "text", place.alias("place"))
    n = docs.count()
    parts = max(1, min(RANGES, -(-n // rows)))
    bounds = sorted(set(keyed.select(F.col("place").cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 and n else []
    keyed = keyed.withColumn("part", _range_of(F.col("place").cast("double"), bounds).cast("int"))
    heads = sorted((r["part"], r["first"]) for r in keyed.groupBy("part").agg(F.min("place").alias("first")).collect())
    size = max((part for part, _ in heads), default=0) + 1
    firsts, befores = [None] * size, [None] * size
    for i, (part, first) in enumerate(heads):
        firsts[part], befores[part] = first, heads[i - 1][0]
    at = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("part") + 1)
    head = F.when(F.col("place") == at(firsts, "long"), F.struct(at(befores, "int").alias("part"), F.lit(False).alias("own")))
    copies = F.array_compact(F.array(F.struct("part", F.lit(True).alias("own")), head))
    dealt = keyed.withColumn("copy", F.explode(copies)).select("doc_id", "text", "place", "copy.part", "copy.own")
    return dealt.repartition("part").sortWithinPartitions("part", F.col("own").desc(), "place", F.xxhash64("text"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, how alike it is to that and to the next document's, whether that reaches
    the threshold, and the fingerprint's length class."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its successor: part, doc_id, text, signatures
        for batch in chunks(batches):
            out: list[tuple] = []
            for part, own, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("part", "own", "doc_id", "text")], strict=True):
                text = text or ""
                signs = signatures(text)
                if held is not None and held[0] == part:
                    _, before, old, old_signs = held
                    new = edited(old, text)
                    new_signs = signatures(new)
                    out.append((before, len(old), hashlib.sha256(new.encode()).hexdigest(), encode(old_signs), encode(new_signs), *likeness(old_signs, new_signs), *likeness(old_signs, signs), length_class(len(old_signs))))
                held = (part, doc_id, text, signs) if own else None
            if out:
                cols = list(zip(*out, strict=True))
                types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.float64(), pa.bool_(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "alike_edited", "near_next", "alike_next", "length_class"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_order(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, alike_edited boolean, near_next double, alike_next boolean, length_class int")


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Pairs (``a``, ``b``, ``likeness``) of different signature sets at least ``threshold`` alike, each named by its smallest id, and
    ``doc_id``, ``class_id`` for all documents.

    Sets are dealt by length class and by their rarest signatures, as many as any partner must share one of; the partners'
    sets meet in equi-joins whose hot keys adaptive execution splits, and the likeness is computed in the JVM.
    """
    tune(docs.sparkSession)

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"signs": pa.array([signatures(t or "").astype(np.int64) for t in batch.column("text").to_pylist()], type=pa.list_(pa.int64()))}

    known = written(map_texts(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), fn, "signs array<long>").withColumn("kind", F.sha2(F.array_join("signs", ","), 256)), "spots")
    sets = written(known.groupBy("kind").agg(F.min(F.struct("doc_id", "signs")).alias("one")).select("kind", F.col("one.doc_id").alias("id"), "one.signs"), "sets")
    spread = sets.select("id", F.size("signs").alias("n"), F.explode("signs").alias("sign"))
    rare = spread.join(written(spread.groupBy("sign").agg(F.count("*").alias("df")), "signs"), "sign")
    probe = rare.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sign"))).alias("s"))
    probe = probe.select("id", "n", F.explode(F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).alias("s")).select("id", "n", "s.sign", (F.floor(F.log("n") / F.lit(-math.log(threshold)) + 1e-9)).alias("class"))
    left = probe.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "sign", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    met = left.join(probe.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "sign", "class"), ["sign", "class"])
    met = met.where("a <> b AND (n_a < n_b OR n_a = n_b AND a < b)").where(F.col("n_a") >= F.col("n_b") * threshold).select("a", "b").distinct()
    full = met.join(sets.select(F.col("id").alias("a"), F.col("signs").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("signs").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    pairs = full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (both / (F.size("x") + F.size("y") - both)).alias("likeness")).where(F.col("likeness") >= threshold)
    return pairs, known.join(sets.select("kind", F.col("id").alias("class_id")), "kind").select("doc_id", "class_id")
