"""Column functions over labels, codes and identifiers; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from conceptloom import model

_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local_name(iri: Column | str) -> Column:
    """What follows the last ``#``, else the last ``/``."""
    x = _col(iri)
    return F.when(F.contains(x, F.lit("#")), F.substring_index(x, "#", -1)).otherwise(F.substring_index(x, "/", -1))


def prefix_of(curie: Column | str) -> Column:
    return F.substring_index(_col(curie), ":", 1)


def is_code(x: Column | str, letter: str = "C") -> Column:
    """ASCII digits behind a letter; full-width digits do not count."""
    return _col(x).rlike(f"^{letter}[0-9]+$")


def stripped(x: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(_col(x), f"^{_SPACE}+", ""), f"{_SPACE}+$", "")


def normalized_label(x: Column | str) -> Column:
    return F.lower(stripped(x))


def folded(x: Column | str) -> Column:
    """Lower case with the sharp s spelled out and final sigma unified, for caseless comparison."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(x)), "ß", "ss"), "ς", "σ")


def mint_id(axis: Column | str, label: Column | str) -> Column:
    """Stable id of a proposed concept."""
    return F.concat(F.lit("MINT-"), F.substring(F.sha1(F.concat(_col(axis), F.lit("|"), normalized_label(label))), 1, 12))


def contains_any(x: Column | str, markers: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of the markers; null text: false."""
    low = F.lower(_col(x))
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    return F.coalesce(out, F.lit(False))


def has_many_aspects(label: Column | str) -> Column:
    """A label that names several things at once: a marker word or a parenthesis."""
    return F.coalesce(_col(label).rlike("[()]"), F.lit(False)) | contains_any(label, model.ASPECT_MARKERS)


def is_staging_label(label: Column | str) -> Column:
    return contains_any(label, model.STAGING_MARKERS)


def is_defining_role(role: Column | str, label: Column | str) -> Column:
    """Neither dropped nor an exclusion; a role without a label is kept."""
    excluded = F.coalesce(F.contains(_col(label), F.lit("Excludes")), F.lit(False))
    return ~excluded & ~_col(role).isin(*model.DROPPED_ROLES)


def label_aspects(label: Column | str) -> Column:
    """Array of (axis, surface, polarity) read off a label: side, findings with or without, staging system version.

    A finding takes a capitalised word and at most one more word."""
    x = F.coalesce(_col(label), F.lit(""))
    empty = F.array().cast("array<struct<axis:string,surface:string,polarity:string>>")

    def aspect(axis: str, surface: Column, polarity: Column | str) -> Column:
        return F.struct(F.lit(axis).alias("axis"), surface.alias("surface"), (F.lit(polarity) if isinstance(polarity, str) else polarity).alias("polarity"))

    side = F.regexp_extract(x, r"^(Left|Right|Bilateral|Unilateral)\b", 1)
    sides = F.when(side != "", F.array(aspect("laterality", side, "positive"))).otherwise(empty)
    found = F.regexp_extract_all(x, F.lit(r"((?:[Ww]ithout|[Ww]ith) [A-Z][A-Za-z-]*(?: [A-Za-z-]+)?)"), 1)
    findings = F.transform(found, lambda m: aspect("finding", F.regexp_replace(m, "^[Ww]ith(out)? ", ""), F.when(m.rlike("^[Ww]ithout"), "negative").otherwise("positive")))
    staging = F.transform(F.regexp_extract_all(x, F.lit(r"((?:AJCC|UICC) v[0-9]+)"), 1), lambda m: aspect("staging_system", m, "positive"))
    return F.concat(sides, findings, staging)


def version_number(x: Column | str) -> Column:
    """The leading decimal number of a version, else 0."""
    return F.coalesce(F.expr("try_cast(NULL AS double)"), F.when(F.regexp_extract(_col(x), r"^\s*([+-]?[0-9]+(?:\.[0-9]*)?)", 1) != "", F.regexp_extract(_col(x), r"^\s*([+-]?[0-9]+(?:\.[0-9]*)?)", 1).cast("double")), F.lit(0.0))


def prefix_terms(query: str) -> list[str]:
    """Lower-cased search terms of a query, its operator characters taken as blanks."""
    return query.translate(str.maketrans({c: " " for c in '"*():^-'})).lower().split()


def split_list(x: Column | str, separator: str) -> Column:
    """Trimmed non-empty parts."""
    return F.filter(F.transform(F.split(_col(x), separator), F.trim), lambda v: v != "")


def embedding_text(label: Column | str, definition: Column | str, synonyms: Column | str) -> Column:
    """The text that stands for a concept: label, up to five synonyms, definition up to 500 characters."""
    parts = F.concat(F.array(F.coalesce(_col(label), F.lit(""))), F.coalesce(F.slice(_col(synonyms), 1, 5), F.array().cast("array<string>")), F.array(F.coalesce(F.left(_col(definition), F.lit(500)), F.lit(""))))
    return F.array_join(F.filter(parts, lambda v: v != ""), " | ")
