"""Reading and writing RDF: N-Triples and N-Quads by Spark's text source, ontology headers from RDF/XML, Turtle output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.functions import text
from conceptloom.lineage import cut

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>)?\s*\.\s*(?:#.*)?$'
SUBCLASS, LABEL = "http://www.w3.org/2000/01/rdf-schema#subClassOf", "http://www.w3.org/2000/01/rdf-schema#label"
OWL = "http://www.w3.org/2002/07/owl#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, "^<|>$", "")


def read_ntriples(spark: SparkSession, path: str, graph: str = "default", strict: bool = True) -> DataFrame:
    """``g``, ``s``, ``p``, ``o``, ``o_kind`` (iri, bnode, literal), ``o_lang``, ``o_dtype``; a malformed line raises, or is left out if not ``strict``."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    ok = F.col("value").rlike(_LINE)
    if strict:
        lines = lines.withColumn("value", F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("malformed triple: "), F.left("value", F.lit(200))))))
    else:
        lines = lines.where(ok)
    part = lambda i: F.regexp_extract("value", _LINE, i)
    raw = lines.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), part(4).alias("g"))
    kind = F.when(F.startswith("o", F.lit("<")), "iri").when(F.startswith("o", F.lit("_:")), "bnode").otherwise("literal")
    body = F.regexp_replace(F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1), r'\\"', '"')
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\\n", "\n"), r"\\t", "\t"), r"\\\\", r"\\")
    none = lambda x: F.when(x != "", x)
    return raw.select(F.coalesce(none(_bare(F.col("g"))), F.lit(graph)).alias("g"), _bare(F.col("s")).alias("s"), "p", F.when(kind == "literal", body).otherwise(_bare(F.col("o"))).alias("o"), kind.alias("o_kind"), none(F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1)).alias("o_lang"), none(F.regexp_extract("o", r'"\^\^<([^>]*)>$', 1)).alias("o_dtype"))


def write_triples(triples: DataFrame, path: str, replace: bool = True) -> None:
    """Parquet by graph; ``replace`` swaps only the graphs that are written."""
    writer = triples.write.partitionBy("g").option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if replace else "append").parquet(path)


def isa(triples: DataFrame) -> DataFrame:
    """``child``, ``parent`` between named classes; blank nodes and owl:Thing are left out."""
    rows = triples.where((F.col("p") == SUBCLASS) & (F.col("o_kind") == "iri") & ~F.startswith("s", F.lit("_:")) & (F.col("o") != f"{OWL}Thing"))
    return rows.select(text.local_name("s").alias("child"), text.local_name("o").alias("parent")).distinct()


def restrictions(triples: DataFrame) -> DataFrame:
    """``subject``, ``role``, ``filler`` of existential restrictions, their blank nodes resolved once."""
    nodes = triples.where((F.col("p") == f"{OWL}onProperty")).select(F.col("s").alias("node"), text.local_name("o").alias("role"))
    some = triples.where(F.col("p") == f"{OWL}someValuesFrom").select(F.col("s").alias("node"), text.local_name("o").alias("filler"))
    held = triples.where((F.col("p") == SUBCLASS) & (F.col("o_kind") == "bnode")).select(text.local_name("s").alias("subject"), F.col("o").alias("node"))
    return held.join(nodes, "node").join(some, "node").select("subject", "role", "filler").distinct()


def list_members(triples: DataFrame, heads: DataFrame, max_hops: int = 15) -> DataFrame:
    """``list``, ``hop``, ``member``: the members of RDF lists that start at ``heads`` (``list``)."""
    rest = triples.where(F.col("p") == f"{RDF}rest").select(F.col("s").alias("at"), F.col("o").alias("next"))
    first = triples.where(F.col("p") == f"{RDF}first").select(F.col("s").alias("at"), F.col("o").alias("member"))
    cells = frontier = cut(heads.select("list", F.col("list").alias("at"), F.lit(0).alias("hop")))
    for hop in range(1, max_hops):
        frontier = cut(frontier.join(rest, "at").where(F.col("next") != f"{RDF}nil").select("list", F.col("next").alias("at"), F.lit(hop).alias("hop")))
        if frontier.isEmpty():
            break
        cells = cells.unionByName(frontier)
    return cells.join(first, "at").select("list", "hop", "member")


def ontology_headers(spark: SparkSession, path: str) -> DataFrame:
    """``iri``, ``version_info``, ``version_iri`` of the ontology elements of RDF/XML files."""
    schema = "`_rdf:about` string, `owl:versionInfo` string, `owl:versionIRI` struct<`_rdf:resource`: string>"
    rows = spark.read.format("xml").option("rowTag", "owl:Ontology").schema(schema).load(path)
    return rows.select(F.col("`_rdf:about`").alias("iri"), F.col("`owl:versionInfo`").alias("version_info"), F.col("`owl:versionIRI`.`_rdf:resource`").alias("version_iri"))


def _literal(x: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))


def mapping_lines(records: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``value``: one N-Triples line per mapping; a CURIE whose prefix is unknown raises."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])

    def iri(c: str) -> Column:
        base = F.element_at(table, text.prefix_of(c))
        return F.when(base.isNull(), F.raise_error(F.concat(F.lit("unknown prefix: "), F.col(c)))).otherwise(F.concat(F.lit("<"), base, F.substring_index(c, ":", -1), F.lit(">")))

    return records.select(F.concat(iri("subject_id"), F.lit(" "), iri("predicate_id"), F.lit(" "), iri("object_id"), F.lit(" .")).alias("value"))


def constituent_lines(constituents: DataFrame, base: str) -> DataFrame:
    """``value``: N-Triples lines of constituents (``concept``, ``axis``, ``filler``, ``needs_review``)."""
    node = F.concat(F.lit(f"<{base}"), F.col("concept"), F.lit("/"), F.col("axis"), F.lit("/"), F.col("filler"), F.lit(">"))
    lines = F.array(
        F.concat(F.lit(f"<{base}"), F.col("concept"), F.lit(f"> <{base}hasConstituent> "), node, F.lit(" .")),
        F.concat(node, F.lit(f" <{base}axis> "), _literal(F.col("axis")), F.lit(" .")),
        F.concat(node, F.lit(f" <{base}filler> <{base}"), F.col("filler"), F.lit("> .")),
        F.concat(node, F.lit(f" <{base}needsReview> "), _literal(F.col("needs_review").cast("string")), F.lit(" .")),
    )
    return constituents.select(F.explode(lines).alias("value"))
