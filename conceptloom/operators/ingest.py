"""From triples of two ontologies to stored mappings: candidates, the facts that judge them, and promotions with their run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom import model
from conceptloom.functions import text
from conceptloom.operators import concepts, mappings
from conceptloom.sources import rdf

XREF_PREDICATE = "http://www.geneontology.org/formats/oboInOwl#hasDbXref"
LABEL_PREDICATE = "http://www.w3.org/2000/01/rdf-schema#label"
DISJOINT_PREDICATE = "http://www.w3.org/2002/07/owl#disjointWith"
OBO = "http://purl.obolibrary.org/obo/"


def filler_codes(triples: DataFrame, roles: tuple[str, ...] = model.INGEST_ROLES) -> DataFrame:
    """``code``: the fillers of the roles that mappings are wanted for."""
    return rdf.restrictions(triples).where(F.col("role").isin(*roles)).select(F.col("filler").alias("code")).distinct()


def curie(iri: Column) -> Column:
    """``http://purl.obolibrary.org/obo/UBERON_0000955`` as ``UBERON:0000955``; null for any other form."""
    local = F.substring(iri, len(OBO) + 1, 1 << 20)
    return F.when(F.startswith(iri, F.lit(OBO)) & F.contains(local, F.lit("_")), F.concat(F.substring_index(local, "_", 1), F.lit(":"), F.regexp_replace(local, "^[^_]*_", "")))


def upstream_xrefs(triples: DataFrame, prefix: str = "NCIT:") -> DataFrame:
    """``code``, ``curie``: what upstream classes assert as their cross-references to codes with ``prefix``."""
    rows = triples.where((F.col("p") == XREF_PREDICATE) & F.startswith("o", F.lit(prefix)))
    return rows.select(F.substring("o", len(prefix) + 1, 1 << 20).alias("code"), curie(F.col("s")).alias("curie")).where("curie IS NOT NULL").distinct()


def labels(triples: DataFrame, upstream: bool) -> DataFrame:
    """``code``, ``label`` of named classes, upstream ones by CURIE."""
    name = curie(F.col("s")) if upstream else text.local_name("s")
    return triples.where((F.col("p") == LABEL_PREDICATE) & (F.col("o_kind") == "literal")).select(name.alias("code"), F.col("o").alias("label")).where("code IS NOT NULL").distinct()


def edges(triples: DataFrame, upstream: bool) -> DataFrame:
    """``child``, ``parent`` between named classes, upstream ones by CURIE."""
    if not upstream:
        return rdf.isa(triples)
    rows = triples.where((F.col("p") == rdf.SUBCLASS) & (F.col("o_kind") == "iri"))
    return rows.select(curie(F.col("s")).alias("child"), curie(F.col("o")).alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL").distinct()


def disjoint(triples: DataFrame, upstream: bool) -> DataFrame:
    """``a``, ``b`` of binary disjointness between named classes."""
    name = (lambda c: curie(F.col(c))) if upstream else text.local_name
    rows = triples.where((F.col("p") == DISJOINT_PREDICATE) & (F.col("o_kind") == "iri") & ~F.startswith("s", F.lit("_:")))
    return rows.select(name("s").alias("a"), name("o").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()


def generate(ncit: DataFrame, upstream: DataFrame, run_id: str, ncit_version: str, source_version: str) -> tuple[DataFrame, DataFrame]:
    """Proposed records of all candidates between the fillers of ``ncit`` and the classes of ``upstream`` (triples), and the report of how many
    fillers have one."""
    fillers = filler_codes(ncit)
    pairs = mappings.candidates(labels(ncit, False), labels(upstream, True), upstream_xrefs(upstream), fillers)
    rows = pairs.select(
        F.lit(run_id).alias("run_id"), "subject_id", F.lit(mappings.CLOSE).alias("predicate_id"), "object_id", "mapping_justification", "confidence",
        F.lit(ncit_version).alias("subject_source_version"), F.lit(source_version).alias("object_source_version"), F.lit("proposed").alias("lifecycle_state"), F.lit("unreviewed").alias("review_status"), F.lit("").alias("author"),
    )
    return rows, mappings.candidate_report(pairs, fillers)


def faults(records: DataFrame) -> DataFrame:
    """``records`` that break a rule of mapping records, with ``fault``, the first one broken: an empty field, an unknown predicate or state, a
    confidence outside 0 to 1."""
    needed = ("subject_id", "object_id", "mapping_justification", "subject_source_version", "object_source_version")
    fault = F.lit(None).cast("string")
    rules = [(F.coalesce(F.col(c) == "", F.lit(True)), f"{c} is empty") for c in needed]
    rules += [(~F.coalesce(F.col("predicate_id").isin(*model.PREDICATES), F.lit(False)), "predicate_id"), (~F.coalesce(F.col("lifecycle_state").isin(*model.LIFECYCLE), F.lit(False)), "lifecycle_state"), (~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence")]
    for broken, name in reversed(rules):
        fault = F.when(broken, name).otherwise(fault)
    return records.withColumn("fault", fault).where("fault IS NOT NULL")


def inadmissible(evidence: DataFrame) -> DataFrame:
    """Evidence (``kind``, ``source``, ``detail``) that must not count, with ``fault``: an unknown kind, no source, or a mapping predicate (short or as IRI) as
    source or detail, since a mapping does not justify itself."""
    local = [p.split(":")[1] for p in model.PREDICATES]
    mapping = lambda c: F.col(c).isin(*model.PREDICATES, *[mappings.SKOS[1] + x for x in local])
    fault = F.when(~F.coalesce(F.col("kind").isin(*model.EVIDENCE_KINDS), F.lit(False)), "kind").when(F.coalesce(F.col("source") == "", F.lit(True)), "source").when(F.coalesce(mapping("source"), F.lit(False)) | F.coalesce(mapping("detail"), F.lit(False)), "mapping as evidence")
    return evidence.withColumn("fault", fault).where("fault IS NOT NULL")


def context(records: DataFrame, runs: DataFrame, source: str, ncit: DataFrame, upstream: DataFrame) -> dict[str, DataFrame]:
    """What judging the proposed close matches needs: ``pairs`` that can be expressed, ``skipped`` ones, ``anchors`` in force, labels, edges and
    disjointness of both sides."""
    proposed = mappings.one_per_pair(records.where((F.col("lifecycle_state") == "proposed") & (F.col("predicate_id") == mappings.CLOSE)))
    pairs = concepts.expandable(proposed)
    known = mappings.candidates(labels(ncit, False), labels(upstream, True), upstream_xrefs(upstream), pairs.select(F.col("subject_id").alias("code"))).select("subject_id", "object_id", "via_xref", "via_label")
    seen = pairs.join(known, ["subject_id", "object_id"], "left").withColumn("via_xref", F.coalesce("via_xref", F.lit(False))).withColumn("via_label", F.coalesce("via_label", F.lit(False)))
    return {
        "pairs": seen, "skipped": proposed.join(pairs.select("subject_id", "object_id"), ["subject_id", "object_id"], "left_anti"), "anchors": mappings.anchors_in_force(records, runs, source),
        "ncit": edges(ncit, False), "upstream": edges(upstream, True), "disjoint": disjoint(ncit, False).unionByName(disjoint(upstream, True)),
    }


def judge(found: dict[str, DataFrame], curated: DataFrame) -> DataFrame:
    """The context's pairs with evidence, structural corroboration through other anchors, and the verdict of the consistency check: a pair is
    refuted where disjoint classes lie above its two ends, anchors in force taken as equivalences."""
    from conceptloom.operators import graph

    ends = found["pairs"].select(F.col("subject_id").alias("subject"), F.col("object_id").alias("object"))
    # a pair's own anchor must not support it
    told = graph.corroboration(ends, found["ncit"], found["upstream"], found["anchors"])
    corroborated = told.where("verdict = 'CORROBORATED'").select(F.col("subject").alias("subject_id"), F.col("object").alias("object_id"))
    pairs = mappings.evidence(found["pairs"], curated, corroborated)
    bridge = found["anchors"].select(F.col("code").alias("child"), F.col("curie").alias("parent"))
    both = found["ncit"].unionByName(found["upstream"]).unionByName(bridge).unionByName(bridge.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
    reach = graph.closure(both, sources=ends.select(F.explode(F.array("subject", "object")).alias("code")).distinct())
    above = reach.select("child", "parent").unionByName(ends.select(F.explode(F.array("subject", "object")).alias("child")).select("child", F.col("child").alias("parent"))).distinct()
    apart = found["disjoint"].unionByName(found["disjoint"].select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    left = ends.join(above.select(F.col("child").alias("subject"), F.col("parent").alias("a")), "subject").join(apart, "a").select("subject", "object", "b")
    refuted = left.join(above.select(F.col("child").alias("object"), F.col("parent").alias("b")), ["object", "b"], "left_semi").select(F.col("subject").alias("subject_id"), F.col("object").alias("object_id"), F.lit(True).alias("_bad")).distinct()
    return pairs.join(refuted, ["subject_id", "object_id"], "left").withColumn("el_valid", F.col("_bad").isNull()).drop("_bad")


def persisted(promoted: DataFrame, run_id: str, source: str, ncit_version: str, source_version: str) -> tuple[DataFrame, DataFrame]:
    """The run row and the records of a promotion, in its own run: the candidates stay as they are, and each promoted record says which versions it was
    judged against."""
    done = promoted.where("lifecycle_state = 'validated'")
    rows = done.withColumns({"run_id": F.lit(run_id), "subject_source_version": F.lit(ncit_version), "object_source_version": F.lit(source_version)})
    counts = promoted.agg(F.count("*").alias("candidates"), F.count_if(F.col("lifecycle_state") == "validated").alias("promoted"), F.count_if(F.col("outcome") == "reasoner_error").alias("errors"))
    state = F.when((F.col("candidates") > 0) & (F.col("errors") == F.col("candidates")), "failed").otherwise("completed")
    return counts.select(F.lit(run_id).alias("id"), F.lit(source).alias("source"), F.lit(ncit_version).alias("ncit_version"), F.lit(source_version).alias("source_version"), state.alias("status"), "candidates", "promoted", "errors"), rows


def save_baseline(report: DataFrame, path: str) -> None:
    """One coverage report as JSON, in place of the one before."""
    report.limit(1).coalesce(1).write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> dict[str, object]:
    """The report saved last; none raises."""
    row = spark.read.json(path).first()
    if row is None:
        raise ValueError(f"no baseline in {path}")
    return row.asDict()


def micro_average(counts: DataFrame) -> DataFrame:
    """One row ``precision``, ``recall``, ``f1`` over summed ``tp``, ``fp``, ``fn``; an empty side counts as 0."""
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    total = total.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return total.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
