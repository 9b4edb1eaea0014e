"""Full-text search on inverted lists: prefix search and weighted ranking, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The English stop words that carry no weight in ranked search.
STOP_WORDS = "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves"
WEIGHT_A, WEIGHT_B = 1.0, 0.4


def tokens(x: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+)"), 1)


def stem(x: Column) -> Column:
    """A light English stem: plural and common verb endings go, from words that stay at least three letters long."""
    x = F.when(x.rlike("^.{2,}ies$"), F.regexp_replace(x, "ies$", "y")).when(x.rlike("^.*(ss|us|is)$"), x).otherwise(F.regexp_replace(x, "^(.{3,})s$", "$1"))
    return F.regexp_replace(x, "^(.{3,}?)(ing|ed|ly)$", "$1")


def postings(docs: DataFrame, key: str, columns: dict[str, float]) -> DataFrame:
    """``key``, ``term``, ``tf``, ``weight``: one row per document, term and weight class of its columns."""
    parts = [docs.select(key, F.posexplode(tokens(c)).alias("pos", "term"), F.lit(w).alias("weight")) for c, w in columns.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key, "term", "weight").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def prefix_and(lists: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """``query_id``, ``key``: documents with a word for every term prefix of a query (``query_id``, ``terms``); a query without terms has none.

    Terms are matched by equality of all their prefixes of the queried lengths, so that the join is an equi-join."""
    return _with_all_prefixes(lists.select(key, "term"), key, queries)


def prefix_search(docs: DataFrame, key: str, columns: list[str], queries: DataFrame) -> DataFrame:
    """:func:`prefix_and` over documents without lists: words are looked up where they stand, and only those that a query asks for are shuffled."""
    words = F.array_distinct(F.flatten(F.array(*[F.coalesce(tokens(c), F.array().cast("array<string>")) for c in columns])))
    return _with_all_prefixes(docs.select(key, F.explode(words).alias("term")), key, queries)


def _with_all_prefixes(terms: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("prefix"), F.size(F.array_distinct("terms")).alias("n"))
    lengths = sorted(r[0] for r in wanted.select(F.length("prefix")).distinct().collect())  # no more than a query has letters
    if not lengths:
        return queries.select("query_id").join(terms.select(key), F.lit(False))
    cut = F.array_compact(F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in lengths]))
    hits = terms.select(key, F.explode(cut).alias("prefix")).join(wanted, "prefix").groupBy("query_id", key, "n").agg(F.count_distinct("prefix").alias("hits"))
    return hits.where("hits = n").select("query_id", key)


def ranked(lists: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """``query_id``, ``key``, ``rank``: documents with all stems of a query (``query_id``, ``terms``), ranked by the sum of weight * (1 + ln tf)."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS.split()])
    wanted = queries.select("query_id", F.explode(F.array_distinct(F.transform(F.filter("terms", lambda t: ~F.array_contains(stop, t)), stem))).alias("stem"))
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    own = lists.select(key, stem(F.col("term")).alias("stem"), "weight", "tf").groupBy(key, "stem", "weight").agg(F.sum("tf").alias("tf"))
    hits = own.join(wanted, "stem").groupBy("query_id", key).agg(F.count_distinct("stem").alias("hits"), F.sum(F.col("weight") * (1 + F.log("tf"))).alias("rank"))
    return hits.join(sizes, "query_id").where("hits = n").select("query_id", key, "rank")
