"""The cross-ontology mapping pipeline: candidates, evidence, gate, contests, staleness, coverage, translation, scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptloom import model
from conceptloom.functions import text

EXACT, CLOSE = "skos:exactMatch", "skos:closeMatch"
LEXICAL, XREF, COMPOSITE, CURATION = "semapv:LexicalMatching", "semapv:DatabaseCrossReference", "semapv:CompositeMatching", "semapv:ManualMappingCuration"


@dataclass(frozen=True)
class Sides:
    """Candidate pairs before they are listed: ``subjects`` and ``objects`` have ``code``, ``names`` and ``keys`` (arrays, ``keys`` those of the
    cross-references); a pair has a common name or key. ``single``: no subject has more than one key.

    :meth:`rows` lists each pair once, where its first common name or else key meets, so that pairs are neither shuffled nor grouped."""

    subjects: DataFrame
    objects: DataFrame
    single: bool = False

    def rows(self, of_subjects: DataFrame | None = None, of_objects: DataFrame | None = None) -> DataFrame:
        """``subject_id``, ``object_id``, ``via_xref``, ``via_label``, ``mapping_justification``, ``confidence`` and the columns of ``of_subjects`` (``subject_id``)
        and ``of_objects`` (``object_id``), each of which has at most one row of an end."""
        ends, more = [], []
        for side, extra, end in ((self.subjects, of_subjects, "subject_id"), (self.objects, of_objects, "object_id")):
            df = side.select(F.col("code").alias(end), F.col("names").alias(f"names_{end}"), F.col("keys").alias(f"keys_{end}"))
            if extra is not None:
                more += [c for c in extra.columns if c != end]
                df = df.join(extra.withColumnRenamed(end, "_end"), F.col(end).eqNullSafe(F.col("_end")), "left").drop("_end")
            ends.append(df)
        overlap = lambda c: F.arrays_overlap(f"{c}_subject_id", f"{c}_object_id")
        one = lambda c: (F.size(f"{c}_subject_id") == 1) | (F.size(f"{c}_object_id") == 1)
        first = lambda c: F.when(one(c), True).otherwise(F.array_min(F.array_intersect(f"{c}_subject_id", f"{c}_object_id")) == F.col("at"))
        meet = lambda c, drop=(): ends[0].withColumn("at", F.explode("names_subject_id" if c == "names" else "keys_subject_id")).drop(*[f"{x}_subject_id" for x in drop]).join(ends[1].withColumn("at", F.explode(f"{c}_object_id")).drop(*[f"{x}_object_id" for x in drop]), "at")
        by_label = meet("names").where(first("names")).select("subject_id", "object_id", overlap("keys").alias("via_xref"), F.lit(True).alias("via_label"), *more)
        by_key = meet("keys", ("keys",)) if self.single else meet("keys").where(first("keys"))
        by_key = by_key.where(~overlap("names")).select("subject_id", "object_id", F.lit(True).alias("via_xref"), F.lit(False).alias("via_label"), *more)
        kind = F.when(F.col("via_xref") & F.col("via_label"), "composite").when(F.col("via_xref"), "xref").otherwise("lexical")
        pick = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind)
        found = by_label.unionByName(by_key)
        return found.select("subject_id", "object_id", "via_xref", "via_label", pick({"composite": COMPOSITE, "xref": XREF, "lexical": LEXICAL}).alias("mapping_justification"), pick(model.CONFIDENCE).alias("confidence"), *more)


def sides(subject_labels: DataFrame, object_labels: DataFrame, xrefs: DataFrame | tuple[DataFrame, DataFrame], fillers: DataFrame) -> Sides:
    """The two sides of the candidates for the wanted ``fillers`` (``code``). Labels (``code``, ``label``) match caselessly; ``xrefs`` (``code``, ``curie``) are
    asserted by the other side, or given by what both ends have in common: (``code``, ``key``) of the subjects and of the objects."""
    wanted = fillers.select("code").distinct()
    single = not isinstance(xrefs, tuple)
    if single:
        ours, theirs = xrefs.select("code", F.col("code").alias("key")), xrefs.select(F.col("curie").alias("code"), F.col("code").alias("key"))
    else:
        ours, theirs = xrefs

    def side(labels: DataFrame, keys: DataFrame) -> DataFrame:
        names = labels.select("code", text.folded("label").alias("name"), F.lit(None).cast(keys.schema["key"].dataType).alias("key"))
        rows = names.unionByName(keys.select("code", F.lit(None).cast("string").alias("name"), "key"))
        return rows.groupBy("code").agg(F.collect_set("name").alias("names"), F.collect_set("key").alias("keys"))

    return Sides(side(subject_labels.join(wanted, "code", "left_semi"), ours.join(wanted, "code", "left_semi")), side(object_labels, theirs), single)


def candidates(subject_labels: DataFrame, object_labels: DataFrame, xrefs: DataFrame | tuple[DataFrame, DataFrame], fillers: DataFrame) -> DataFrame:
    """``subject_id``, ``object_id``, ``via_xref``, ``via_label``, ``mapping_justification``, ``confidence`` of all pairs between :func:`sides`."""
    return sides(subject_labels, object_labels, xrefs, fillers).rows()


def candidate_report(pairs: DataFrame, fillers: DataFrame) -> DataFrame:
    """One row: fillers, those with a candidate by cross-reference (both kinds included) or by label only, and the recall."""
    per = pairs.groupBy("subject_id").agg(F.bool_or("via_xref").alias("x"))
    j = fillers.select(F.col("code").alias("subject_id")).distinct().join(per, "subject_id", "left")
    return j.agg(F.count("*").alias("fillers"), F.count_if("x").alias("via_xref"), F.count_if(~F.col("x")).alias("via_label_only")).withColumn("recall", F.coalesce(F.round(F.try_divide(F.col("via_xref") + F.col("via_label_only"), "fillers"), 4), F.lit(0.0)))


def evidence(pairs: DataFrame, curated: DataFrame | Column, corroborated: DataFrame | Column) -> DataFrame:
    """``pairs`` with ``evidence``, the kinds of evidence besides the signal that made the candidate, and ``independent``: curated, or two kinds.

    A composite candidate's own signals both stay. ``curated`` and ``corroborated`` have ``subject_id``, ``object_id``, or are
    conditions on ``pairs``."""
    marks = pairs
    for name, told in (("c", curated), ("s", corroborated)):
        marks = marks.withColumn(name, told) if isinstance(told, Column) else marks.join(told.select("subject_id", "object_id", F.lit(True).alias(name)).distinct(), ["subject_id", "object_id"], "left")
    why = F.col("mapping_justification")
    known = why.isin(LEXICAL, XREF, COMPOSITE, CURATION)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("via_label") & (why != LEXICAL), F.lit("label_agreement")),
            F.when(F.col("c"), F.lit("sme_curation")),
            F.when(F.col("s"), F.lit("structural_corroboration")),
            F.when(F.col("via_xref") & (why != XREF), F.lit("xref_assertion")),
        )
    )
    return marks.withColumn("evidence", F.when(known, kinds)).withColumn("independent", F.coalesce(F.array_contains("evidence", "sme_curation") | (F.size("evidence") >= 2), F.lit(False))).drop("c", "s")


def one_per_pair(records: DataFrame, order: tuple[str, ...] = (CURATION, COMPOSITE, XREF, LEXICAL)) -> DataFrame:
    """Of equal (subject, object) the record with the first justification in ``order``; unknown ones come last, then ``run_id``."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("mapping_justification"))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    first = Window.partitionBy("subject_id", "object_id").orderBy(rank, "run_id", F.desc("confidence"))
    return records.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def contested(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``contested``: the subject or the object also stands in another pair."""
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    return pairs.withColumn("contested", (n("subject_id") > 1) | (n("object_id") > 1))


def _marked(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``qualified`` and ``sme``, qualified by curation that is not stale."""
    rows = pairs.withColumn("qualified", F.coalesce(F.col("el_valid") & F.col("independent"), F.lit(False)))
    return rows.withColumn("sme", F.col("qualified") & ~F.col("stale") & F.array_contains("evidence", "sme_curation"))


def _decided(rows: DataFrame) -> DataFrame:
    """Marked rows with ``contest``, ``sole`` and ``lost``, with the outcome in place of these."""
    outcome = (
        F.when(F.col("evidence").isNull() | F.col("el_valid").isNull(), "reasoner_error")
        .when(~F.col("el_valid"), "refuted")
        .when(~F.col("independent"), "insufficient_evidence")
        .when(F.col("lost"), "endpoint_taken")
        .when(F.col("contest") & ~F.col("sole"), "contested")
        .when(F.array_contains("evidence", "structural_corroboration"), "promoted_with_structural_corroboration")
        .when(F.array_contains("evidence", "sme_curation") & (F.size("evidence") == 1), "promoted_on_curation_alone")
        .otherwise("promoted_on_source_agreement")
    )
    rows = rows.withColumn("outcome", outcome)
    done = F.startswith("outcome", F.lit("promoted"))
    return rows.withColumn("predicate_id", F.when(done, EXACT).otherwise(CLOSE)).withColumn("lifecycle_state", F.when(done, "validated").otherwise("proposed")).drop("qualified", "sme", "sole", "lost", "contest")


def promote(pairs: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``pairs`` (with ``evidence``, ``independent``, ``el_valid`` and ``stale``) with ``outcome`` and, if promoted, the exact predicate.

    An unknown reasoner verdict (null) is its own outcome. Among qualified pairs that share an end none wins, but one that
    alone among them is curated and not stale. ``taken`` (``subject_id``, ``object_id``) are pairs already in force: other pairs with one
    of their ends lose."""
    rows = _marked(pairs)
    n = lambda c: F.count_if("qualified").over(Window.partitionBy(c))
    rows = rows.withColumn("contest", (n("subject_id") > 1) | (n("object_id") > 1))
    m = lambda c: F.count_if("sme").over(Window.partitionBy(c))
    rows = rows.withColumn("sole", F.col("sme") & (m("subject_id") == 1) & (m("object_id") == 1))
    if taken is None:
        rows = rows.withColumn("lost", F.lit(False))
    else:
        ends = lambda c: taken.select(c, F.lit(True).alias(f"has_{c}")).distinct()
        same = taken.select("subject_id", "object_id", F.lit(True).alias("same")).distinct()
        rows = rows.join(ends("subject_id"), "subject_id", "left").join(ends("object_id"), "object_id", "left").join(same, ["subject_id", "object_id"], "left")
        rows = rows.withColumn("lost", F.coalesce(F.col("has_subject_id") | F.col("has_object_id"), F.col("has_subject_id"), F.col("has_object_id"), F.lit(False)) & F.col("same").isNull()).drop("has_subject_id", "has_object_id", "same")
    return _decided(rows)


def promote_all(found: Sides, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """:func:`promote` of all pairs between two sides. ``judge`` adds the columns that it needs, each row for itself.

    The pairs are listed anew for each count and for the outcome; only the counts of each end are shuffled, and meet the ends
    before they are paired."""
    marked = _marked(judge(found.rows()))
    n, m = {"subject_id": "n_s", "object_id": "n_o"}, {"subject_id": "m_s", "object_id": "m_o"}
    per = {c: marked.groupBy(c).agg(F.count_if("qualified").alias(n[c]), F.count_if("sme").alias(m[c])) for c in n}
    rows = _marked(judge(found.rows(per["subject_id"], per["object_id"])))
    rows = rows.withColumn("contest", (F.col("n_s") > 1) | (F.col("n_o") > 1)).withColumn("sole", F.col("sme") & (F.col("m_s") == 1) & (F.col("m_o") == 1))
    return _decided(rows.withColumn("lost", F.lit(False)).drop(*n.values(), *m.values()))


def promotion_report(promoted: DataFrame) -> DataFrame:
    return promoted.groupBy("outcome").agg(F.count("*").alias("candidates"))


def stale(records: DataFrame, runs: DataFrame, source: str, version: str) -> DataFrame:
    """Validated records of the source's runs made from another version."""
    mine = runs.where(F.col("source") == source).select(F.col("id").alias("run_id")).distinct()
    return records.join(mine, "run_id", "left_semi").where((F.col("lifecycle_state") == "validated") & (F.col("object_source_version") != version))


def quarantine(records: DataFrame, runs: DataFrame, source: str, version: str, reasoner_errors: int = 0) -> DataFrame:
    """All records, stale ones quarantined; a run with reasoner errors retires nothing."""
    if reasoner_errors:
        return records
    mine = runs.where(F.col("source") == source).select(F.col("id").alias("run_id"), F.lit(True).alias("_mine")).distinct()
    old = F.coalesce(F.col("_mine"), F.lit(False)) & (F.col("lifecycle_state") == "validated") & (F.col("object_source_version") != version)
    return records.join(mine, "run_id", "left").withColumn("lifecycle_state", F.when(old, "quarantined").otherwise(F.col("lifecycle_state"))).drop("_mine")


def is_identity(predicate: Column | str = "predicate_id", state: Column | str = "lifecycle_state") -> Column:
    predicate, state = (F.col(x) if isinstance(x, str) else x for x in (predicate, state))
    return (predicate == EXACT) & state.isin("validated", "active")


def strength(records: DataFrame) -> DataFrame:
    """``code``, ``identity``, ``close_only`` of every mapped subject; a mapping that is no identity counts as close."""
    per = records.groupBy(F.col("subject_id").alias("code")).agg(F.bool_or(is_identity()).alias("identity"))
    return per.withColumn("close_only", ~F.col("identity"))


def coverage_report(anchors: DataFrame, live: DataFrame, mapped: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """One row of counts over data elements (``public_id``, ``version``) and their anchor codes (``concept_code``, ``concept_type``).

    Covered: at least one code, and all codes are live with an identity mapping. Post-coordinated: several codes of one type.
    With ``scope`` (``code``) only elements all of whose codes lie in it count."""
    flag = lambda df, name: df.select(F.col("code").alias("concept_code")).distinct().withColumn(name, F.lit(True))
    rows = anchors.select("public_id", "version", "concept_code", "concept_type").distinct().join(flag(live, "live"), "concept_code", "left").join(flag(mapped.where("identity"), "identity"), "concept_code", "left").join(flag(mapped.where("close_only"), "close"), "concept_code", "left")
    rows = rows.join(flag(scope, "scoped"), "concept_code", "left") if scope is not None else rows.withColumn("scoped", F.lit(True))
    rows = rows.select("public_id", "version", "concept_code", "concept_type", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("live", "identity", "close", "scoped")])
    per_type = rows.groupBy("public_id", "version", "concept_type").agg(F.count_distinct("concept_code").alias("n"), F.bool_and(F.col("live") & F.col("identity")).alias("covered"), F.bool_and("scoped").alias("scoped"))
    per = per_type.groupBy("public_id", "version").agg(F.max("n").alias("n"), F.bool_and("covered").alias("covered"), F.bool_and("scoped").alias("scoped")).where("scoped")
    kept = rows.join(per.select("public_id", "version"), ["public_id", "version"], "left_semi").groupBy("concept_code").agg(F.bool_or("live").alias("live"), F.bool_or("identity").alias("identity"), F.bool_or("close").alias("close"))
    a = per.agg(F.count("*").alias("elements"), F.count_if("covered").alias("covered"), F.count_if(F.col("n") > 1).alias("post_coordinated"))
    b = kept.agg(F.count("*").alias("codes"), F.count_if("live").alias("live_codes"), F.count_if(F.col("identity")).alias("identity_codes"), F.count_if(F.col("close") & ~F.col("identity")).alias("close_only_codes"))
    return a.crossJoin(b).withColumn("coverage", F.coalesce(F.round(F.try_divide("covered", "elements"), 4), F.lit(0.0)))


def regressed(current: float, previous: float, tolerance: float = 0.01) -> bool:
    return current < previous - tolerance


def translate(codes: DataFrame, records: DataFrame, licensed: bool = False) -> DataFrame:
    """``code``, ``target``, ``equivalence``, ``confidence``: mappings in force in both directions, the code itself as unmatched where there is none.

    Of equal (target, predicate) the one with the code as subject counts; licensed vocabularies only on demand."""
    force = records.where(F.col("lifecycle_state").isin("validated", "active"))
    there = force.select(F.col("subject_id").alias("code"), F.col("object_id").alias("target"), "predicate_id", "confidence", F.lit(0).alias("way"))
    back = force.select(F.col("object_id").alias("code"), F.col("subject_id").alias("target"), "predicate_id", "confidence", F.lit(1).alias("way"))
    both = there.unionByName(back).join(codes.select("code").distinct(), "code", "left_semi")
    if not licensed:
        both = both.where(~text.prefix_of("target").isin(*model.LICENSED_PREFIXES))
    first = Window.partitionBy("code", "target", "predicate_id").orderBy("way", F.desc("confidence"))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in model.EQUIVALENCE.items() for x in kv]), F.col("predicate_id")), F.lit("unmatched"))
    hits = both.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("code", "target", kind.alias("equivalence"), "confidence")
    none = codes.select("code").distinct().join(hits, "code", "left_anti").select("code", F.col("code").alias("target"), F.lit("unmatched").alias("equivalence"), F.lit(0.0).alias("confidence"))
    return hits.unionByName(none)


def attach(fillers: DataFrame, records: DataFrame) -> DataFrame:
    """``fillers`` (``filler``) with ``upstream``, a sorted array of their mappings, empty where there are none."""
    nested = records.groupBy(F.col("subject_id").alias("filler")).agg(F.array_sort(F.collect_set(F.struct("object_id", "predicate_id", "lifecycle_state"))).alias("upstream"))
    return fillers.join(nested, "filler", "left").withColumn("upstream", F.coalesce("upstream", F.array().cast(nested.schema["upstream"].dataType)))


def score(golden: DataFrame, actual: DataFrame, predicate: str = EXACT) -> DataFrame:
    """One row of precision, recall and F1 over (subject, object) pairs of a predicate; empty sides count as 0."""
    pairs = lambda df, n: df.where(F.col("predicate_id") == predicate).select("subject_id", "object_id").distinct().withColumn(n, F.lit(True))
    c = pairs(golden, "g").join(pairs(actual, "a"), ["subject_id", "object_id"], "full").agg(F.count_if(F.col("g") & F.col("a")).alias("tp"), F.count_if(F.col("a") & F.col("g").isNull()).alias("fp"), F.count_if(F.col("g") & F.col("a").isNull()).alias("fn"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


SKOS = ("skos:", "http://www.w3.org/2004/02/skos/core#")


def bridge_axiom(axiom: Column) -> Column:
    """The axiom to put into a reasoner's input; a mapping predicate there raises, as it would prove itself."""
    hit = F.startswith(axiom, F.lit(SKOS[0])) | F.startswith(axiom, F.lit(SKOS[1]))
    return F.when(hit, F.raise_error(F.concat(F.lit("a mapping predicate is no axiom: "), axiom)).cast("string")).otherwise(axiom)


def validation_axioms(pairs: DataFrame, ncit: DataFrame, upstream: DataFrame, disjoint: DataFrame) -> DataFrame:
    """``subject_id``, ``object_id``, ``axioms``: sorted axioms that a reasoner needs to judge each pair as an equivalence: those over the pair's own
    ancestors on both sides, the disjointness between them, and the equivalence."""
    from conceptloom.operators import graph

    def side(edges: DataFrame, column: str) -> DataFrame:
        up = graph.closure(edges, sources=pairs.select(F.col(column).alias("code")))
        reach = up.unionByName(up.select("child", F.col("child").alias("parent"))).unionByName(edges.select("child", F.col("child").alias("parent"))).distinct()
        own = pairs.select("subject_id", "object_id", F.col(column).alias("child")).join(reach, "child").select("subject_id", "object_id", F.col("parent").alias("at"))
        return own

    def axioms(edges: DataFrame, column: str) -> DataFrame:
        return side(edges, column).join(edges, F.col("at") == F.col("child")).select("subject_id", "object_id", F.concat_ws(" ", F.col("child"), F.lit("subClassOf"), F.col("parent")).alias("axiom"))

    apart = side(upstream, "object_id").join(disjoint, F.col("at") == F.col("a")).select("subject_id", "object_id", F.concat_ws(" ", F.col("a"), F.lit("disjointWith"), F.col("b")).alias("axiom"))
    same = pairs.select("subject_id", "object_id", F.concat_ws(" ", F.col("subject_id"), bridge_axiom(F.lit("equivalentClass")), F.col("object_id")).alias("axiom"))
    rows = axioms(ncit, "subject_id").unionByName(axioms(upstream, "object_id")).unionByName(apart).unionByName(same)
    return rows.groupBy("subject_id", "object_id").agg(F.array_sort(F.collect_set("axiom")).alias("axioms"))


def refuse_degenerate(**inputs: DataFrame) -> None:
    """Raise where an input without which nothing can be judged is empty."""
    empty = [name for name, df in inputs.items() if df.isEmpty()]
    if empty:
        raise ValueError("no rows in " + ", ".join(sorted(empty)))


def anchors_in_force(records: DataFrame, runs: DataFrame, source: str) -> DataFrame:
    """``code``, ``curie`` of the source's validated identity mappings."""
    mine = runs.where(F.col("source") == source).select(F.col("id").alias("run_id")).distinct()
    return records.join(mine, "run_id", "left_semi").where(is_identity()).select(F.col("subject_id").alias("code"), F.col("object_id").alias("curie")).distinct()


def liveness(codes: DataFrame, classes: DataFrame) -> DataFrame:
    """``code``, ``live``: whether a class of that code exists."""
    return codes.select("code").distinct().join(classes.select("code", F.lit(True).alias("live")).distinct(), "code", "left").select("code", F.coalesce("live", F.lit(False)).alias("live"))
