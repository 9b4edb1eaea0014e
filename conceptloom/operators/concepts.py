"""Reads over a terminology: details, labels, relations, lists, pages and substring search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptloom import model
from conceptloom.functions import text

LABEL, PREFERRED, DEFINITION, SEMTYPE, SYNONYM = "label", "P108", "P97", "P106", "P90"


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> DataFrame:
    """A triple pattern: the given positions are fixed."""
    for name, value in (("g", g), ("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name) == value)
    return triples


def ask(df: DataFrame) -> bool:
    return not df.isEmpty()


def named_targets(triples: DataFrame, namespace: str) -> DataFrame:
    """Triples whose object is an IRI of the namespace."""
    return triples.where((F.col("o_kind") == "iri") & F.startswith("o", F.lit(namespace)))


def one_value(df: DataFrame, column: str) -> str:
    """The only distinct non-null value; none or several raise."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(2).collect()]
    if len(values) != 1:
        raise ValueError(f"{column} has {'no value' if not values else 'more than one value'}")
    return values[0]


def joined_versions(headers: DataFrame) -> DataFrame:
    """One row ``version``: all distinct header values in order, joined by `` + ``."""
    return headers.select(F.explode(F.array("version_info", "version_iri")).alias("v")).where("v IS NOT NULL").agg(F.array_join(F.array_sort(F.collect_set("v")), " + ").alias("version"))


def _values(prop: str) -> Column:
    return F.array_sort(F.collect_set(F.when((F.col("prop") == prop) & (F.col("value") != ""), F.col("value"))))


def detail(props: DataFrame) -> DataFrame:
    """One row per ``code``: label, preferred name, definition, sorted semantic types and synonyms."""
    first = lambda p: F.min(F.when((F.col("prop") == p) & (F.col("value") != ""), F.col("value")))
    return props.groupBy("code").agg(first(LABEL).alias("label"), F.coalesce(first(PREFERRED), first(LABEL)).alias("preferred_name"), first(DEFINITION).alias("definition"), _values(SEMTYPE).alias("semantic_types"), _values(SYNONYM).alias("synonyms"))


def embedding_records(props: DataFrame, after: str | None = None, limit: int | None = None) -> DataFrame:
    """``code``, ``preferred_name``, ``semantic_type``, ``definition``, ``synonyms`` joined by `` | ``; optionally one page by key."""
    rows = detail(props).select("code", "preferred_name", F.array_min("semantic_types").alias("semantic_type"), "definition", F.array_join("synonyms", " | ").alias("synonyms"))
    rows = rows.where(F.col("code") > after) if after is not None else rows
    return rows.orderBy("code").limit(limit) if limit is not None else rows


def labels_for(labels: DataFrame, codes: DataFrame) -> DataFrame:
    """Labels of the requested codes; codes without one are left out."""
    return labels.join(codes.select("code").distinct(), "code", "left_semi").groupBy("code").agg(F.min("label").alias("label"))


def outgoing(restrictions: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("code").alias("filler"), F.col("label").alias("filler_label"))
    return restrictions.join(named, "filler", "left")


def incoming(restrictions: DataFrame, labels: DataFrame, fillers: DataFrame) -> DataFrame:
    """``filler``, ``role``, ``subject``, ``subject_label`` of the restrictions that point to ``fillers`` (``code``)."""
    found = restrictions.join(fillers.select(F.col("code").alias("filler")).distinct(), "filler", "left_semi")
    return found.join(labels.select(F.col("code").alias("subject"), F.col("label").alias("subject_label")), "subject", "left").select("filler", "role", "subject", "subject_label")


def related(restrictions: DataFrame, associations: DataFrame, labels: DataFrame, per_arm: int = 100) -> DataFrame:
    """``code``, ``arm``, ``rel``, ``target``, ``label``: roles and associations, each arm of a code up to ``per_arm`` rows by (rel, target)."""
    roles = restrictions.select(F.col("subject").alias("code"), F.lit("role").alias("arm"), F.col("role").alias("rel"), F.col("filler").alias("target"))
    links = associations.select(F.col("subject").alias("code"), F.lit("association").alias("arm"), "rel", "target")
    rows = roles.unionByName(links).distinct().withColumn("_n", F.row_number().over(Window.partitionBy("code", "arm").orderBy("rel", "target"))).where(F.col("_n") <= per_arm).drop("_n")
    return rows.join(labels.select(F.col("code").alias("target"), "label"), "target", "left").select("code", "arm", "rel", "target", "label")


def page(rows: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page with the number of all rows in ``total``; a page past the end has no row."""
    total = rows.agg(F.count("*").alias("total"))  # one row: joined, so that no window gathers the table in a task
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).orderBy(*order)


def contains_text(rows: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows one of whose columns holds ``term``, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))
    return rows.where(hit)


def exact_name_first(rows: DataFrame, query: str, limit: int, rank: Column | None = None) -> DataFrame:
    """Search hits in order: exact name, rank, shorter label, label, code."""
    wanted = query.strip(" \t\r\n\"'").lower()
    exact = (F.lower("label") == wanted).cast("int")
    by_rank = [rank.desc_nulls_last()] if rank is not None else []
    return rows.withColumn("exact", exact).orderBy(F.desc("exact"), *by_rank, F.length("label"), "label", "code").limit(limit)


def nulls_last(column: str, descending: bool = False) -> Column:
    """A sort order in which nulls come last in both directions."""
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()


def find_nodes(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """``term``, ``code``: for each term the first node (``code``, ``label``) whose code it is or whose label holds it, whatever the case; the least code
    counts as first, and a blank term finds none. Terms are few: each one is compared with every label."""
    asked = terms.select("term", F.lower(F.trim("term")).alias("_needle")).where("_needle <> ''").distinct()
    needles = asked.agg(F.collect_set(F.struct("term", "_needle")).alias("_asked"))
    hits = nodes.crossJoin(F.broadcast(needles)).select("code", F.explode(F.filter("_asked", lambda x: (F.lower("code") == x["_needle"]) | F.contains(F.lower(F.coalesce("label", F.lit(""))), x["_needle"]))).alias("_hit"))
    return hits.groupBy(F.col("_hit.term").alias("term")).agg(F.min("code").alias("code"))


def anchors_by_type(links: DataFrame) -> DataFrame:
    """``concept_type``, ``codes``: distinct codes by type, and over all types where the type is null."""
    return links.groupingSets([["concept_type"], []], "concept_type").agg(F.count_distinct("concept_code").alias("codes"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``both``, ``a_only``, ``b_only`` over the distinct codes of two tables."""
    left, right = a.select("code").distinct().withColumn("in_a", F.lit(True)), b.select("code").distinct().withColumn("in_b", F.lit(True))
    j = left.join(right, "code", "full")
    return j.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("both"), F.count_if(F.col("in_a") & F.col("in_b").isNull()).alias("a_only"), F.count_if(F.col("in_b") & F.col("in_a").isNull()).alias("b_only"))


def expandable(mappings: DataFrame) -> DataFrame:
    return mappings.where(text.prefix_of("object_id").isin(*model.EXPANDABLE_PREFIXES))


def graph_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("g").agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"))


def certify(counts: DataFrame, bounds: dict[str, tuple[int, int]]) -> None:
    """Raise unless each graph's number of triples lies within its bounds."""
    found = {r["g"]: r["triples"] for r in counts.where(F.col("g").isin(*bounds)).collect()}
    bad = [f"{g}: {found.get(g, 0)} not in {lo}..{hi}" for g, (lo, hi) in bounds.items() if not lo <= found.get(g, 0) <= hi]
    if bad:
        raise ValueError("; ".join(bad))
