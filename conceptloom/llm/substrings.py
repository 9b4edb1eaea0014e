"""Removal of repeated byte strings: every byte under a string of ``width`` bytes that also starts earlier goes.

1. Each window of ``width`` bytes has a winnowed anchor (see ``anchors``); equal windows have equal anchors at the same
   place, so a window whose anchor's hash is alone in the corpus has no copy. One aggregation over hashes finds the others.
2. Where all pieces of text under a hash are the same string, the first document keeps it and the rest lose it.
3. Where they differ, a piece falls into the windows that hold the half of ``width`` before the anchor and those that hold
   the half behind it. Equal windows agree in that longer stretch too, so it takes the hash's place: common anchors in
   other surroundings part here, and again a string that is alone, or the same throughout, is done.
4. The different strings that are left go to the task of their stretch, which sorts their suffixes in two stages and takes
   runs of windows with a common prefix of ``width`` bytes; the first of a run stays. A stretch with many different strings
   is dealt to several tasks, and what each of them found to be first meets again in an aggregation over the windows.
5. Each document drops the union of its windows' spans.

Equal strings are told by 128-bit digests (XXH3) before the sort, which then sees each string once.

Documents are ordered by id. Defined results: a null text is empty; rows with a null id come last; different texts of
one id are documents of their own, in the order of a hash; rows equal in id and text get equal results and do not remove
each other; ids that are not integers count in their own order; texts under ``width`` bytes and an empty table stay as
they are; other columns are carried or left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptloom.llm import suffixes
from conceptloom.llm.anchors import anchors
from conceptloom.llm.common import chunks, discard, release, text_bytes, tune, written

WIDTH, GRAM = 100, 28
#: Different strings of one stretch that one task sorts together; more are dealt to more tasks.
PIECES = 1024
#: Bytes whose windows or suffixes are handled at once.
STEP = 400_000
#: Bytes of strings that are sorted at once, in whole groups of one stretch; the sort holds many arrays of as many numbers.
SORTED = 200_000


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``uid``, a long that orders documents: the id itself, or the rank of (id, text) where ids are null, repeat or are
    no integers; and ``uid``, ``text`` of each different document."""
    n = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("ids"), F.count_distinct("doc_id").alias("distinct")).first()
    if n["rows"] == n["ids"] == n["distinct"] and isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        docs = docs.withColumn("uid", F.col("doc_id").cast("long"))
        return docs, docs.select("uid", "text")
    known = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    pairs = known.select("doc_id", "_hash").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "_hash")
    ranks = written(pairs.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), F.monotonically_increasing_id().alias("uid")), "ranks")
    docs = written(known.join(ranks, known["doc_id"].eqNullSafe(ranks["_id"]) & (known["_hash"] == ranks["_h"])).drop("_hash", "_id", "_h"), "ranked")
    return docs, docs.groupBy("uid").agg(F.min("text").alias("text"))


def _digests(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests in two halves."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), dtype="<i8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def _again(doc: np.ndarray, g1: np.ndarray, g2: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Marks strings that stand earlier in the same document."""
    by = np.lexsort((lo, g2, g1, doc))
    out = np.zeros(len(doc), dtype=bool)
    out[by[1:]] = (g1[by[1:]] == g1[by[:-1]]) & (g2[by[1:]] == g2[by[:-1]]) & (doc[by[1:]] == doc[by[:-1]])
    return out


def _anchor_rows(texts: DataFrame, width: int) -> DataFrame:
    """``h`` (anchor hash), ``g1``, ``g2`` (digest of the piece of text under its windows), ``uid``, ``lo``, ``n``, ``o`` (bytes from ``lo`` to
    the anchor), ``again`` (the same piece stands earlier in the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=STEP):
            found = text_bytes(batch)
            data = b"".join(found)
            ends = np.cumsum([len(t) for t in found])
            h, lo, n, o = anchors(np.frombuffer(data, dtype=np.uint8), ends, width, GRAM)
            if not len(h):
                continue
            g1, g2 = _digests([data[a : a + m] for a, m in zip(lo.tolist(), (n + width - 1).tolist(), strict=True)])
            doc = np.searchsorted(ends, lo, side="right")
            again = _again(doc, g1, g2, lo)
            uid = batch.column("uid").to_numpy(zero_copy_only=False)[doc]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), g1, g2, uid, (lo - np.append(0, ends[:-1])[doc]), n.astype(np.int32), o.astype(np.int16), again)], names=["h", "g1", "g2", "uid", "lo", "n", "o", "again"])

    return texts.mapInArrow(run, "h long, g1 long, g2 long, uid long, lo long, n int, o short, again boolean")


def _wanted(texts: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each text with the list of its ``rows``."""
    lists = rows.groupBy("uid").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    return texts.join(lists, "uid")


def _unpacked(batch: pa.RecordBatch) -> tuple[pa.StructArray, np.ndarray, list[bytes], np.ndarray]:
    """The wanted rows, each one's text by number, the texts and each row's uid."""
    lists = batch.column("wanted")
    doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    return lists.flatten(), doc, text_bytes(batch), batch.column("uid").to_numpy(zero_copy_only=False)[doc]


def _stretches(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The ``wanted`` pieces (``uid``, ``lo``, ``n``, ``o``) cut in two: ``h`` is now the hash of the stretch that all windows of a part hold, the
    anchor with half of what a window has besides, before it or behind it."""
    half = (width - GRAM + 1) // 2
    behind = width - half + 1  # bytes from the anchor on in a window with less than ``half`` before it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=STEP):
            flat, doc, found, uids = _unpacked(batch)
            rows = [(d, uid, lo, min(n, o - half + 1), lo + o - half, lo + o + GRAM, 1) for d, uid, lo, n, o in zip(doc.tolist(), uids.tolist(), *[flat.field(c).to_pylist() for c in ("lo", "n", "o")], strict=True) if o >= half]
            rows += [(d, uid, lo + max(0, o - half + 1), n - max(0, o - half + 1), lo + o, lo + o + behind, 2) for d, uid, lo, n, o in zip(doc.tolist(), uids.tolist(), *[flat.field(c).to_pylist() for c in ("lo", "n", "o")], strict=True) if o - half + 1 < n]
            if not rows:
                continue
            h = np.array([xxhash.xxh3_64_intdigest(found[d][a:b], side) for d, _, _, _, a, b, side in rows], dtype=np.uint64).view(np.int64)
            g1, g2 = _digests([found[d][lo : lo + n + width - 1] for d, _, lo, n, *_ in rows])
            doc, uid, lo, n = (np.array(x, dtype=np.int64) for x in list(zip(*rows, strict=True))[:4])
            again = _again(doc, np.bitwise_xor(h, g1), g2, lo)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, g1, g2, uid, lo, n.astype(np.int32), again)], names=["h", "g1", "g2", "uid", "lo", "n", "again"])

    return _wanted(texts, wanted, ["lo", "n", "o"]).mapInArrow(run, "h long, g1 long, g2 long, uid long, lo long, n int, again boolean")


def _bodies(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The text under the ``wanted`` windows (``uid``, ``h``, ``salt``, ``lo``, ``n``) as ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=STEP):
            flat, doc, found, uids = _unpacked(batch)
            lo, n = flat.field("lo").to_numpy(), flat.field("n").to_numpy()
            bodies = [found[d][a : a + m] for d, a, m in zip(doc.tolist(), lo.tolist(), (n + width - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field("h"), flat.field("salt"), pa.array(uids), flat.field("lo"), flat.field("n"), pa.array(bodies, type=pa.binary())], names=["h", "salt", "uid", "lo", "n", "body"])

    return _wanted(texts, wanted, ["h", "salt", "lo", "n"]).mapInArrow(run, "h long, salt int, uid long, lo long, n int, body binary")


def _shared(found: DataFrame, name: str) -> DataFrame:
    """Of each ``h`` that several places have: whether all hold one string, and the first document."""
    seen = found.where("NOT again").groupBy("h").agg(F.count("*").alias("copies"), *[f(g).alias(f"{f.__name__}_{g}") for g in ("g1", "g2") for f in (F.min, F.max)], F.min("uid").alias("first")).where("copies > 1")
    return written(seen.select("h", "first", ((F.col("min_g1") == F.col("max_g1")) & (F.col("min_g2") == F.col("max_g2"))).alias("alike")), name)


def _repeats(rows: list[tuple], width: int) -> tuple[list, list]:
    """Of pieces (h, salt, uid, lo, n, body, shared), whole groups of one hash and salt: removed window runs (uid, lo, n),
    and of groups dealt to several tasks (shared) the windows that were first here, with their digests (g1, g2, uid, lo)."""
    rows.sort(key=lambda r: (r[2], r[3]))
    gone, kinds, order_of = [], {}, []
    for h, salt, uid, lo, n, body, shared in rows:
        if (h, body) in kinds:
            gone.append((uid, lo, n))
        else:
            kinds[h, body] = len(order_of)
            order_of.append((uid, lo, n, body, shared))
    data = b"".join(r[3] for r in order_of)
    words = suffixes.words_at(data, width)
    order = suffixes.two_stage(data, words, width)
    starts = np.cumsum([0] + [len(r[3]) for r in order_of])[:-1]
    n = np.array([r[2] for r in order_of])
    piece = np.repeat(np.arange(len(order_of)), [len(r[3]) for r in order_of])
    window = np.arange(len(data)) - starts[piece] < n[piece]
    order = order[window[order]]
    common = suffixes.same_prefix(order, words, width)
    run = np.flatnonzero(common < width)  # pieces are in the order of their documents, so the least position is first
    position = order
    if len(order_of) > 1:  # pieces of one document may overlap; order their windows by place in the document
        uids = np.array([r[0] for r in order_of])
        los = np.array([r[1] for r in order_of])
        rank = np.concatenate([[0], np.cumsum(uids[1:] != uids[:-1])])
        position = (rank[piece[order]] << 40) + los[piece[order]] + order - starts[piece[order]]
    first = np.repeat(np.minimum.reduceat(position, run), np.diff(np.append(run, len(order))))
    removed = np.zeros(len(data) + 1, dtype=bool)
    removed[order[position > first]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], removed])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        uid, lo, *_ = order_of[piece[a]]
        gone.append((uid, lo + a - int(starts[piece[a]]), b - a))
    met = []
    if any(r[4] for r in order_of):
        shared = np.array([r[4] for r in order_of])
        for at in order[(position == first) & shared[piece[order]]].tolist():
            uid, lo, *_ = order_of[piece[at]]
            digest = xxhash.xxh3_128_digest(data[at : at + width])
            met.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), uid, lo + at - int(starts[piece[at]])))
    return gone, met


def _sorted_bins(pieces: DataFrame, width: int) -> DataFrame:
    """``uid``, ``lo``, ``n`` of removed runs (``g1`` null), or of first windows of hashes dealt to several tasks with their digest."""
    schema = pa.schema([("uid", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("g1", pa.int64()), ("g2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            gone, met = _repeats(held, width)
            cols = [[r[0] for r in gone] + [r[2] for r in met], [r[1] for r in gone] + [r[3] for r in met], [r[2] for r in gone] + [1] * len(met), [None] * len(gone) + [r[0] for r in met], [None] * len(gone) + [r[1] for r in met]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("h", "salt", "uid", "lo", "n", "body", "shared")], strict=True):
                if size >= SORTED and row[:2] != held[-1][:2]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush()
        held.clear()
        release()

    dealt = pieces.withColumn("shared", F.col("salt") >= 0).repartition("h", "salt").sortWithinPartitions("h", "salt")
    return dealt.mapInArrow(run, "uid long, lo long, n int, g1 long, g2 long")


def repeated_windows(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """``uid``, ``lo``, ``n``: the windows from byte ``lo`` on that also start earlier, each once. ``texts`` has one row for each ``uid``."""
    cols = ["uid", "lo", "n"]
    repeated = F.col("again") | (F.col("alike") & (F.col("uid") != F.col("first")))
    # an anchor with other copies: done where all are one string
    found = _anchor_rows(texts, width)
    marked = found.drop("g1", "g2").join(_shared(found, "anchors").hint("shuffle_hash"), "h", "left").where("again OR (alike IS NOT NULL AND NOT (alike AND uid = first))")
    marked = written(marked.select(*cols, "o", F.coalesce(repeated, F.lit(True)).alias("gone")), "marked")
    # the same for the longer stretches of those that differ
    parts = written(_stretches(texts, marked.where("NOT gone"), width), "stretches")
    left = parts.join(_shared(parts, "stretch_hashes").hint("shuffle_hash"), "h", "left").where("again OR (alike IS NOT NULL AND NOT (alike AND uid = first))")
    left = written(left.select(*cols, "h", "g1", "g2", F.coalesce(repeated, F.lit(True)).alias("gone")), "left")
    discard(parts)
    # each of the different strings of a stretch once, where it is first
    kinds = written(left.where("NOT gone").groupBy("h", "g1", "g2").agg(F.min("uid").alias("first")), "kinds")
    sizes = written(kinds.groupBy("h").agg(F.ceil(F.count("*") / PIECES).cast("int").alias("tasks")), "sizes")
    placed = left.where("NOT gone").join(kinds, ["h", "g1", "g2"]).join(sizes, "h")
    placed = written(placed.select(*cols, "h", F.when(F.col("tasks") > 1, F.pmod("g1", "tasks").cast("int")).otherwise(-1).alias("salt"), (F.col("uid") != F.col("first")).alias("gone")), "placed")
    bins = written(_sorted_bins(_bodies(texts, placed.where("NOT gone"), width), width), "bins")
    met = bins.where("g1 IS NOT NULL")
    least = written(met.groupBy("g1", "g2").agg(F.min(F.struct("uid", "lo")).alias("least")), "least")
    late = met.join(least, ["g1", "g2"]).where(F.struct("uid", "lo") > F.col("least"))
    return marked.where("gone").select(cols).unionByName(left.where("gone").select(cols)).unionByName(placed.where("gone").select(cols)).unionByName(bins.where("g1 IS NULL").select(cols)).unionByName(late.select(cols))


def spans_of(lo: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes under the windows, as starts and ends."""
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], (lo + n + width - 1)[by]
    reach = np.maximum.accumulate(hi)
    new = np.append(True, lo[1:] > reach[:-1])
    return lo[new], reach[np.append(new[1:], True)]


def _with_spans(docs: DataFrame, columns: list[str], width: int, fn: Callable[[list[bytes], list[tuple[list[int], list[int]]]], list[pa.Array]], made: str) -> DataFrame:
    """``columns`` of ``docs`` and what ``fn`` makes (``made``) of a chunk's texts and of the starts and ends of their removed spans."""
    tune(docs.sparkSession)
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    rows, texts = keyed(docs.select(*own, "doc_id", "text"))
    windows = repeated_windows(texts, width).groupBy("uid").agg(F.collect_list(F.struct("lo", "n")).alias("windows"))
    joined = rows.join(windows, "uid", "left")
    names, fields = [f"c{i}" for i in range(len(columns))], T._parse_datatype_string(made).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found, spans, lists = text_bytes(batch), [], batch.column("windows")
            for i in range(len(found)):
                flat = lists[i].values if lists[i].is_valid else None
                spans.append(([], []) if flat is None else tuple(x.tolist() for x in spans_of(flat.field("lo").to_numpy(), flat.field("n").to_numpy(), width)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + fn(found, spans), names=[*names, *[f"m{i}" for i in range(len(fields))]])

    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, columns, strict=True)] + [T.StructField(f"m{i}", f.dataType) for i, f in enumerate(fields)])
    return joined.mapInArrow(run, schema).toDF(*columns, *[f.name for f in fields])


def _outside(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)) if starts else text


def remove_repeats(docs: DataFrame, width: int = WIDTH, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (or ``doc_id``), ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (array of start and end bytes) and ``kept`` (the bytes that stay)."""

    def fn(texts: list[bytes], spans: list[tuple[list[int], list[int]]]) -> list[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        listed = [[{"start": a, "end": b} for a, b in zip(*x, strict=True)] for x in spans]
        sizes = [[len(t) for t in texts], [sum(x[1]) - sum(x[0]) for x in spans], [len(x[0]) for x in spans]]
        return [*[pa.array(x, type=pa.int64()) for x in sizes], pa.array(listed, type=kind), pa.array([_outside(t, *x) for t, x in zip(texts, spans, strict=True)], type=pa.binary())]

    return _with_spans(docs, columns or ["doc_id"], width, fn, "n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document the sizes of what goes and the SHA-256 of what stays."""
    return remove_repeats(docs, width).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _whole(text: bytes, starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """The spans without characters that they hold only in part."""
    out: tuple[list[int], list[int]] = ([], [])
    for start, end in zip(starts, ends, strict=True):
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        out[0].append(start), out[1].append(end)
    return out


def cut_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` and ``n_chars`` (where there is one) counted anew. A character whose bytes a
    span holds only in part stays; a null text stays null."""

    def fn(texts: list[bytes], spans: list[tuple[list[int], list[int]]]) -> list[pa.Array]:
        return [pa.array([_outside(t, *_whole(t, *x)).decode() for t, x in zip(texts, spans, strict=True)], type=pa.string())]

    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    mark = max(docs.columns, key=len) + "_null"  # a name that is not taken
    cut = _with_spans(docs.withColumn(mark, F.col("text").isNull()), [*others, mark], width, fn, f"`{mark}_cut` string")
    text = F.when(~F.col(f"`{mark}`"), F.col(f"`{mark}_cut`"))
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
