"""Quality rules from repetition: a suffix array over each text's words, its longest-common-prefix intervals and the
union of the maximal repeated spans, next to the plain counts.

Defined results: a null text is the empty text (no words, rejected for its length); rows are judged one by one, so
repeated rows and equal ids get equal verdicts; repeats are followed up to one word more than the longest one allowed, which
``longest_repeat`` then says; an empty table gives an empty table; columns that share a name with a
result are replaced by it, others are kept by :func:`quality_filter`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.llm.common import map_texts, text_bytes, tune

SYMBOLS = b"#*$%&|<>"
#: A repeat counts from this many words; the share of words (percent) that such repeats may cover; the longest repeat allowed.
MIN_REPEAT, MAX_COVERED_PERCENT, MAX_REPEAT = 6, 30, 60
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"
_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def longest_repeats(symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each position of ``symbols`` the length, up to ``depth``, of the longest substring from there that also starts elsewhere.

    The suffix array is grown by doubling to that depth and only suffixes that are still tied are sorted again; neighbours'
    common prefixes come from the kept ranks, of which there are log2(depth), and a position's longest repeat is the larger
    one on its two sides. Spans of repeats longer than ``depth`` are covered by those of the positions that follow.
    """
    n = len(symbols)
    longest = np.zeros(n, dtype=np.int64)
    if n == 0:
        return longest
    order = np.argsort(symbols, kind="stable")
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(symbols[order[1:]], symbols[order[:-1]], out=new[1:])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = head
    levels, places, step = [rank], _tied(new), 1
    pairs = places[1:][~new[places[1:]]] if len(places) else places
    while len(places) and step < depth:
        suffixes = order[places]
        keys = levels[-1][suffixes] * (n + 1) + levels[-1][np.minimum(suffixes + step, n)] + 1
        by = np.argsort(keys, kind="stable")
        order[places] = suffixes[by]
        keys = keys[by]
        start = np.empty(len(places), dtype=bool)
        start[0] = True
        np.not_equal(keys[1:], keys[:-1], out=start[1:])
        rank = levels[-1].copy()
        rank[order[places]] = places[np.maximum.accumulate(np.where(start, np.arange(len(places)), 0))]
        levels.append(rank)
        places = places[_tied(start)]
        step *= 2
    if len(pairs):
        left, right = order[pairs - 1].copy(), order[pairs].copy()
        common = np.zeros(len(pairs), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][left] == levels[k][right]
            same &= (left < n) & (right < n)
            add = same * (1 << k)
            common += add
            left, right = np.minimum(left + add, n), np.minimum(right + add, n)
        common = np.minimum(common, depth)
        np.maximum.at(longest, order[pairs - 1], common)
        np.maximum.at(longest, order[pairs], common)
    return longest


def _tied(start: np.ndarray) -> np.ndarray:
    """Places of entries whose group, as marked by ``start``, has more than one entry."""
    alone = start & np.append(start[1:], True)
    return np.flatnonzero(~alone)


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Marks the positions inside a repeat of ``least`` symbols or more: the union of all such spans."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + longest[at], -1)
    return np.cumsum(change[:n]) > 0


def measure(texts: list[bytes], min_repeat: int = MIN_REPEAT, max_covered_percent: int = MAX_COVERED_PERCENT, max_repeat: int = MAX_REPEAT) -> dict[str, np.ndarray]:
    """The rule columns of each text, by one suffix array over all texts' words; no repeat crosses two texts."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for words in split for w in words), dtype=np.int64, count=int(counts.sum()))
    doc = np.repeat(np.arange(len(texts)), counts)
    # equal words of two texts are two symbols, and a symbol of its own ends each text
    ends = np.cumsum(counts + 1) - 1 if len(texts) else counts
    total = int(counts.sum()) + len(texts)
    symbols = np.empty(total, dtype=np.int64)
    inside = np.ones(total, dtype=bool)
    inside[ends] = False
    symbols[inside] = flat + doc * max(len(ids), 1)
    symbols[ends] = len(texts) * max(len(ids), 1) + np.arange(len(texts))
    longest = longest_repeats(symbols, max(3, min_repeat, max_repeat + 1))
    first = ends - counts

    def per_text(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks)])
        return (sums[ends] - sums[first]).astype(np.int64)

    tops = np.maximum.reduceat(longest, first) if len(texts) else counts
    repeat3, spans = per_text(covered(longest, 3)), per_text(covered(longest, min_repeat))
    failed = (counts < 50) | (100 * repeat3 > 50 * counts)
    dups, symbols_in, chars = [], [], []
    for text in texts:
        lines = [x for x in text.split(b"\n") if _WORD.search(x)]
        dups.append(len(lines) - len(set(lines)))
        symbols_in.append(len(text) - len(text.translate(None, SYMBOLS)))
        kept = text.translate(_LEADS, b" \t\n\r\x0b\f")
        chars.append(len(kept) - kept.count(b"\x80"))
    return {
        "n_words": counts, "word_chars": np.array(chars, dtype=np.int64), "n_symbols": np.array(symbols_in, dtype=np.int64), "n_dup_lines": np.array(dups, dtype=np.int64), "n_repeat_words": repeat3,
        "base_failed": failed, "kept": ~failed & (100 * spans <= max_covered_percent * counts) & (tops <= max_repeat), "covered_words": spans, "longest_repeat": tops.astype(np.int64),
    }


#: Maps every UTF-8 continuation byte to 0x80, so that counting that byte leaves the code points.
_LEADS = bytes(0x80 if 0x80 <= b < 0xC0 else b for b in range(256))


def repetition_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered_percent: int = MAX_COVERED_PERCENT, max_repeat: int = MAX_REPEAT, columns: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or ``columns``) with the counts and verdicts of every text; one narrow pass, no shuffle."""
    tune(docs.sparkSession)
    keep = columns or ["doc_id"]
    own = [f.split()[0] for f in COLUMNS.split(", ")]
    taken = [c for c in keep if c not in own]

    def fn(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return measure(text_bytes(batch), min_repeat, max_covered_percent, max_repeat)

    return map_texts(docs.select(*dict.fromkeys([*taken, "text"])), fn, COLUMNS, taken)


def quality_filter(docs: DataFrame, **limits: int) -> DataFrame:
    """``docs`` without the rows that the rules reject; all their columns stay."""
    tune(docs.sparkSession)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text"))
    kept = repetition_rules(marked, columns=["row", "text"], **limits).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
