"""More registered queries: registry upserts, runs and claims, the mapping pipeline from triples on, seeded graph walks, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptloom.operators import concepts, decomposition, elements, graph, ingest, mappings
from conceptloom.plans import claims, lifecycle
from conceptloom.plans.projection import World, code, with_
from conceptloom.plans.queries import query, values
from conceptloom.sources import rdf

# ---- decomposition and registry


@query(f"""{with_("roles")}, m AS (SELECT code, role FROM roles GROUP BY ALL HAVING count(DISTINCT filler) > 1) SELECT DISTINCT filler FROM roles JOIN m USING (code, role)""")
def comparison_fillers(w: World) -> DataFrame:
    return decomposition.comparison_fillers(w.roles.select(F.col("code").alias("concept"), F.col("role").alias("axis"), "filler"))


@query("""WITH r AS (SELECT 'O' || l_orderkey AS concept, CASE WHEN l_linenumber > 1 THEN l_linestatus END AS status, l_returnflag AS axis, 'P' || (l_partkey % 7) AS filler, l_linenumber % 2 = 1 AS ms, l_extendedprice AS ord FROM lineitem),
  h AS (SELECT concept, arg_min(status, ord) FILTER (WHERE status IS NOT NULL) AS status FROM r GROUP BY ALL) SELECT r.concept, h.status, axis, filler, arg_max(ms, ord) AS most_specific FROM r JOIN h USING (concept) GROUP BY ALL""")
def fold_stored_rows(w: World) -> DataFrame:
    n = F.col("l_linenumber")
    rows = w.table("lineitem").select(code("O", "l_orderkey").alias("concept"), F.when(n > 1, F.col("l_linestatus")).alias("status"), F.lit(None).cast("string").alias("date"), F.col("l_returnflag").alias("axis"), F.concat(F.lit("P"), (F.col("l_partkey") % 7).cast("string")).alias("filler"), F.when(n % 2 == 1, "true").otherwise("0").alias("most_specific"), F.col("l_extendedprice").alias("ord"))
    return decomposition.fold(rows).select("concept", "status", F.inline("constituents"))


@query("""SELECT l_partkey::VARCHAR AS public_id, l_suppkey::VARCHAR AS version, l_orderkey AS member_seq, l_linenumber AS pos, l_quantity AS payload FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1""")
def upsert_last_wins(w: World) -> DataFrame:
    rows = w.table("lineitem").select(F.col("l_partkey").cast("string").alias("public_id"), F.col("l_suppkey").cast("string").alias("version"), F.col("l_orderkey").alias("member_seq"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("payload"))
    return elements.upserted(rows)


@query("""WITH r AS (SELECT l_partkey::VARCHAR AS public_id, '1' AS version, 'S' || l_suppkey AS concept_code, CASE l_returnflag WHEN 'A' THEN 'property' WHEN 'R' THEN 'object_class' ELSE 'other' END AS concept_type, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY public_id, concept_code ORDER BY CASE concept_type WHEN 'object_class' THEN 1 WHEN 'property' THEN 2 ELSE 5 END, pos) = 1""")
def first_concepts(w: World) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = w.table("lineitem").select(F.col("l_partkey").cast("string").alias("public_id"), F.lit("1").alias("version"), code("S", "l_suppkey").alias("concept_code"), F.when(flag == "A", "property").when(flag == "R", "object_class").otherwise("other").alias("concept_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return elements.first_concepts(rows)


@query("""SELECT p_partkey::VARCHAR AS public_id, p_size::VARCHAR AS version, p_name AS long_name FROM part ORDER BY p_partkey LIMIT 40""")
def natural_order_page(w: World) -> DataFrame:
    return w.elements.orderBy(*elements.natural_order()).limit(40).select("public_id", "version", "long_name")


@query("""SELECT p_partkey::VARCHAR AS public_id FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an') OR contains(lower(p_type), 'an')""")
def like_search(w: World) -> DataFrame:
    return elements.like(w.elements, "aN").select("public_id")


@query("""WITH m AS (SELECT l_orderkey AS archive, l_linenumber AS seq, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM lineitem WHERE l_returnflag <> 'R') SELECT archive, seq FROM m WHERE before IS NOT NULL AND seq <> before + 1""")
def archive_gaps(w: World) -> DataFrame:
    return elements.contiguous(w.table("lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").alias("seq")))


@query("""WITH c AS (SELECT 'C' || c_custkey AS key, 'old' AS v FROM customer), n AS (SELECT 'C' || o_custkey AS key, 'new' || count(*) AS v FROM orders GROUP BY ALL UNION ALL SELECT 'X' || n_nationkey, 'new' FROM nation)
SELECT key, coalesce(n.v, c.v) AS v, 'merged' AS how FROM c FULL JOIN n USING (key) UNION ALL SELECT key, coalesce(c.v, n.v), 'inserted' FROM c FULL JOIN n USING (key)""")
def merge_and_insert(w: World) -> DataFrame:
    current = w.table("customer").select(code("C", "c_custkey").alias("key"), F.lit("old").alias("v"))
    new = w.table("orders").groupBy(code("C", "o_custkey").alias("key")).agg(F.concat(F.lit("new"), F.count("*").cast("string")).alias("v")).unionByName(w.table("nation").select(code("X", "n_nationkey").alias("key"), F.lit("new").alias("v")))
    return lifecycle.merged(current, new, ["key"]).withColumn("how", F.lit("merged")).unionByName(lifecycle.inserted(current, new, ["key"]).withColumn("how", F.lit("inserted")))


# ---- runs and claims

_ITEMS = """SELECT 'run' || (o_custkey % 4) AS run_id, 'O' || o_orderkey AS concept_code, o_orderkey AS ordinal, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'complete' END AS state, (o_orderkey % 3)::INT AS attempts, CASE WHEN o_orderkey % 4 = 1 THEN 'old' END AS claim_token FROM orders"""


def _items(w: World) -> tuple[DataFrame, DataFrame]:
    """Items of four runs in all states, and the runs: two running, one failed, one complete."""
    k = F.col("o_orderkey")
    state = F.element_at(F.array(*[F.lit(x) for x in ("pending", "running", "failed", "complete")]), (k % 4 + 1).cast("int"))
    items = w.table("orders").select(F.concat(F.lit("run"), (F.col("o_custkey") % 4).cast("string")).alias("run_id"), code("O", "o_orderkey").alias("concept_code"), k.alias("ordinal"), state.alias("state"), (k % 3).cast("int").alias("attempts"), F.when(k % 4 == 1, "old").alias("claim_token"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("constituents"))
    runs = w.spark.range(4).select(F.concat(F.lit("run"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") < 2, "running").when(F.col("id") == 2, "failed").otherwise("complete").alias("status"), F.lit("f").alias("fingerprint"))
    return items, runs


@query(f"""WITH i AS ({_ITEMS}), t AS (SELECT *, run_id IN ('run0', 'run1') AND state IN ('pending', 'failed') AND ordinal % 5 < 3 AS takes FROM i)
SELECT run_id, concept_code, CASE WHEN takes THEN 'running' ELSE state END AS state, attempts + takes::INT AS attempts, CASE WHEN takes THEN 'new' ELSE claim_token END AS claim_token FROM t""")
def claim_items(w: World) -> DataFrame:
    items, runs = _items(w)
    return claims.claim(items, runs, "new", items.where("ordinal % 5 < 3")).select("run_id", "concept_code", "state", "attempts", "claim_token")


@query(f"""WITH i AS ({_ITEMS}), n AS (SELECT 'O' || l_orderkey AS concept_code, count(*)::INT AS n FROM lineitem GROUP BY ALL) SELECT run_id, concept_code, CASE WHEN state = 'running' AND n % 2 = 0 THEN 'complete' ELSE state END AS state, CASE WHEN state = 'running' AND n % 2 = 0 THEN n END AS constituents,
  CASE WHEN state = 'running' AND n % 2 = 0 THEN NULL ELSE claim_token END AS claim_token FROM i LEFT JOIN n USING (concept_code)""")
def complete_items(w: World) -> DataFrame:
    items, _ = _items(w)
    found = w.table("lineitem").groupBy(code("O", "l_orderkey").alias("concept_code")).agg(F.count("*").cast("int").alias("constituents")).where("constituents % 2 = 0")
    results = claims.claimed(items, "old").select("run_id", "concept_code").join(found, "concept_code")
    return claims.complete(items, results, "old").select("run_id", "concept_code", "state", "constituents", "claim_token")


@query(f"""WITH i AS ({_ITEMS}) SELECT concept_code, CASE WHEN run_id = 'run2' AND state = 'running' THEN 'failed' ELSE state END AS state, CASE WHEN run_id = 'run2' AND state = 'running' THEN 'the worker before did not finish' END AS error, CASE run_id WHEN 'run3' THEN 'complete' ELSE 'running' END AS status FROM i""")
def resume_run(w: World) -> DataFrame:
    runs, items = claims.resume(*_items(w), "run2", "f")
    return claims.items_of_runs(items, runs).select("concept_code", "state", "error", "status")


@query(f"""WITH i AS ({_ITEMS}) SELECT concept_code FROM i WHERE run_id = 'run1' AND state <> 'complete'""")
def pending_items(w: World) -> DataFrame:
    return claims.pending(_items(w)[0], "run1")


@query(f"""WITH i AS ({_ITEMS}), d AS (SELECT 'O' || o_orderkey AS concept_code, o_orderkey % 6 = 3 OR o_orderkey % 10 = 7 AS drift FROM orders) SELECT run_id, concept_code, CASE WHEN state = 'complete' AND drift THEN 'pending' ELSE state END AS state FROM i JOIN d USING (concept_code)""")
def source_drift(w: World) -> DataFrame:
    items, _ = _items(w)
    k = F.col("o_orderkey")
    rows = w.table("orders").select(code("O", "o_orderkey").alias("concept_code"), F.sha2(F.concat("o_orderstatus", k.cast("string")), 256).alias("sha256"), k)
    now = rows.withColumn("sha256", F.when(k % 6 == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256"))).where(k % 10 != 7)
    return claims.drifted(items, rows.drop("o_orderkey"), now.drop("o_orderkey")).select("run_id", "concept_code", "state")


@query("""WITH i AS (SELECT 'run' || (o_custkey % 4) AS run_id, CASE WHEN o_custkey % 4 = 1 THEN 'complete' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'complete' END AS state, o_orderkey % 2 = 0 AS d, o_orderkey % 6 = 0 AS r, (o_orderkey % 5)::INT AS n FROM orders)
SELECT run_id, count(*) AS items, count(*) FILTER (WHERE state = 'complete') AS complete, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE d) AS decomposed, count(*) FILTER (WHERE r) AS residual, sum(n)::BIGINT AS constituents, count(*) FILTER (WHERE d)::DOUBLE / count(*) AS coverage, coalesce(count(*) FILTER (WHERE r)::DOUBLE / nullif(count(*) FILTER (WHERE d), 0), 0) AS residual_rate FROM i GROUP BY run_id""")
def run_outcomes(w: World) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(F.col("o_custkey") % 4 == 1, "complete").when(k % 7 == 0, "failed").otherwise("complete")
    return lifecycle.outcomes(w.table("orders").select(F.concat(F.lit("run"), (F.col("o_custkey") % 4).cast("string")).alias("run_id"), state.alias("state"), (k % 2 == 0).alias("is_decomposed"), (k % 6 == 0).alias("is_residual"), (k % 5).cast("int").alias("constituent_count")))


# ---- mappings

@query(f"""{with_("records")}, s AS (SELECT 'S' || s_suppkey AS filler FROM supplier WHERE s_suppkey % 5 > 0 UNION ALL SELECT 'Z1'), u AS (SELECT subject_id, array_to_string(list_transform(list_sort(list(DISTINCT {{'o': object_id, 'p': predicate_id, 's': lifecycle_state}})), lambda x: x.o || '|' || x.p || '|' || x.s), ';') AS upstream FROM records GROUP BY ALL)
SELECT filler, coalesce(upstream, '') AS upstream FROM s LEFT JOIN u ON filler = subject_id""")
def attach_upstream(w: World) -> DataFrame:
    fillers = w.table("supplier").where("s_suppkey % 5 > 0").select(code("S", "s_suppkey").alias("filler")).unionByName(values(w, "filler", ["Z1"]))
    return mappings.attach(fillers, w.records).select("filler", F.array_join(F.transform("upstream", lambda x: F.concat_ws("|", x["object_id"], x["predicate_id"], x["lifecycle_state"])), ";").alias("upstream"))


@query(f"""{with_("links")} SELECT DISTINCT concept_code AS code, concept_code IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0) AS live FROM links""")
def liveness(w: World) -> DataFrame:
    return mappings.liveness(w.links.select(F.col("concept_code").alias("code")), w.table("supplier").where("s_acctbal > 0").select(code("S", "s_suppkey").alias("code")))


@query(f"""{with_("records")}, r AS (SELECT DISTINCT subject_id, object_id, run_id FROM records WHERE predicate_id = 'skos:exactMatch'), g AS (SELECT DISTINCT subject_id, object_id FROM r WHERE run_id <> 'run0'), a AS (SELECT DISTINCT subject_id, object_id FROM r WHERE run_id <> 'run1'),
  c AS (SELECT count(*) FILTER (WHERE g.subject_id IS NOT NULL AND a.subject_id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.subject_id IS NULL) AS fp, count(*) FILTER (WHERE a.subject_id IS NULL) AS fn FROM g FULL JOIN a USING (subject_id, object_id)),
  q AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM c) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q""")
def score_mappings(w: World) -> DataFrame:
    return mappings.score(w.records.where("run_id <> 'run0'"), w.records.where("run_id <> 'run1'"))


@query(f"""{with_("records")} SELECT DISTINCT subject_id AS code, object_id AS curie FROM records WHERE run_id IN ('run0', 'run1') AND predicate_id = 'skos:exactMatch' AND lifecycle_state IN ('validated', 'active')""")
def anchors_in_force(w: World) -> DataFrame:
    return mappings.anchors_in_force(w.records, w.runs, "uberon")


@query(f"""{with_("records")} SELECT subject_id, object_id, predicate_id FROM records WHERE split_part(object_id, ':', 1) IN ('UBERON', 'CL')""")
def expandable_pairs(w: World) -> DataFrame:
    return concepts.expandable(w.records).select("subject_id", "object_id", "predicate_id")


@query("""SELECT 'S' || s_suppkey AS subject_id, CASE WHEN s_suppkey % 11 = 0 THEN 'object_id is empty' WHEN s_suppkey % 7 = 0 THEN 'predicate_id' WHEN s_suppkey % 5 = 0 THEN 'lifecycle_state' WHEN s_suppkey % 3 = 0 THEN 'confidence' END AS fault FROM supplier WHERE s_suppkey % 11 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 3 = 0""")
def record_faults(w: World) -> DataFrame:
    k = F.col("s_suppkey")
    rows = w.table("supplier").select(code("S", "s_suppkey").alias("subject_id"), F.when(k % 11 != 0, "UBERON:1").otherwise("").alias("object_id"), F.when(k % 7 == 0, "owl:sameAs").otherwise("skos:closeMatch").alias("predicate_id"), F.lit("semapv:LexicalMatching").alias("mapping_justification"), F.lit("1").alias("subject_source_version"), F.lit("2").alias("object_source_version"), F.when(k % 5 == 0, "done").otherwise("proposed").alias("lifecycle_state"), F.when(k % 3 == 0, 1.5).otherwise(0.5).alias("confidence"))
    return ingest.faults(rows).select("subject_id", "fault")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'kind' WHEN s_suppkey % 5 = 0 THEN 'source' ELSE 'mapping as evidence' END AS fault FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 3 = 0""")
def evidence_faults(w: World) -> DataFrame:
    k = F.col("s_suppkey")
    rows = w.table("supplier").select(k.alias("id"), F.when(k % 7 == 0, "hearsay").otherwise("sme_curation").alias("kind"), F.when(k % 5 != 0, "panel").alias("source"), F.when(k % 3 == 0, F.when(k % 2 == 0, "skos:exactMatch").otherwise("http://www.w3.org/2004/02/skos/core#closeMatch")).otherwise("note").alias("detail"))
    return ingest.inadmissible(rows).select("id", "fault")


_OBO = "http://purl.obolibrary.org/obo/UBERON_"


def _triples(w: World) -> tuple[DataFrame, DataFrame]:
    """Orders whose restrictions point to suppliers, and upstream classes for suppliers: some with the same label, some with a cross-reference, in a
    hierarchy of nations two of which are disjoint."""
    rdfs, owl, here = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://own#"

    def row(df: DataFrame, s: Column, p: str, o: Column, kind: str) -> DataFrame:
        return df.select(F.lit("g").alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))

    lines, supplier, nation = w.table("lineitem"), w.table("supplier"), w.table("nation")
    node = F.concat(F.lit("_:b"), F.col("l_orderkey").cast("string"), F.lit("x"), F.col("l_linenumber").cast("string"))
    own = lambda letter, c: F.concat(F.lit(here + letter), F.col(c).cast("string"))
    obo = lambda c, by: F.concat(F.lit(_OBO + by), F.col(c).cast("string"))
    ncit = row(lines, own("O", "l_orderkey"), rdf.SUBCLASS, node, "bnode").unionByName(row(lines, node, f"{owl}onProperty", F.concat(F.lit(here), F.when(F.col("l_linenumber") == 1, "R101").otherwise("R900")), "iri")).unionByName(row(lines, node, f"{owl}someValuesFrom", own("S", "l_suppkey"), "iri"))
    ncit = ncit.unionByName(row(supplier, own("S", "s_suppkey"), f"{rdfs}label", F.col("s_name"), "literal")).unionByName(row(supplier, own("S", "s_suppkey"), rdf.SUBCLASS, own("N", "s_nationkey"), "iri"))
    even, third = supplier.where("s_suppkey % 2 = 0"), supplier.where("s_suppkey % 3 = 0")
    upstream = row(even, obo("s_suppkey", "1"), f"{rdfs}label", F.upper("s_name"), "literal").unionByName(row(third, obo("s_suppkey", "1"), ingest.XREF_PREDICATE, F.concat(F.lit("NCIT:S"), F.col("s_suppkey").cast("string")), "literal")).unionByName(row(supplier, obo("s_suppkey", "1"), rdf.SUBCLASS, obo("s_nationkey", "2"), "iri"))
    return ncit, upstream.unionByName(row(nation.where("n_nationkey = 0"), F.lit(f"{_OBO}20"), ingest.DISJOINT_PREDICATE, F.lit(f"{_OBO}21"), "iri"))


_INGEST = """f AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_linenumber = 1), p AS (SELECT 'S' || k AS subject_id, 'UBERON:1' || k AS object_id, k % 3 = 0 AS x, k % 2 = 0 AS l, k FROM f WHERE k % 3 = 0 OR k % 2 = 0)"""


@query(f"""WITH {_INGEST} SELECT subject_id, object_id, CASE WHEN x AND l THEN 'semapv:CompositeMatching' WHEN x THEN 'semapv:DatabaseCrossReference' ELSE 'semapv:LexicalMatching' END AS mapping_justification, CASE WHEN x AND l THEN 0.95::DOUBLE WHEN x THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence, 'proposed' AS lifecycle_state FROM p""")
def mapping_ingest(w: World) -> DataFrame:
    rows, _ = ingest.generate(*_triples(w), "r1", "26.02d", "2024-01")
    return rows.select("subject_id", "object_id", "mapping_justification", "confidence", "lifecycle_state")


@query(f"""WITH {_INGEST}, j AS (SELECT *, k % 4 = 0 AS sme FROM p) SELECT subject_id, object_id, 'r2' AS run_id, '26.03d' AS subject_source_version, '2024-02' AS object_source_version, 'skos:exactMatch' AS predicate_id FROM j
  WHERE sme OR (x AND l)""")
def mapping_promotion(w: World) -> DataFrame:
    ncit, upstream = _triples(w)
    records, _ = ingest.generate(ncit, upstream, "r1", "26.02d", "2024-01")
    runs = values(w, "id", ["r1"]).withColumn("source", F.lit("uberon"))
    found = ingest.context(records, runs, "uberon", ncit, upstream)
    k = F.regexp_extract("subject_id", "[0-9]+", 0).cast("long")
    judged = ingest.judge(found, found["pairs"].where(k % 4 == 0)).withColumn("stale", F.lit(False))
    _, rows = ingest.persisted(mappings.promote(judged), "r2", "uberon", "26.03d", "2024-02")
    return rows.select("subject_id", "object_id", "run_id", "subject_source_version", "object_source_version", "predicate_id")


@query("""WITH c AS (SELECT p_type, count(*) FILTER (WHERE p_size <= 25 AND p_size >= 15) AS tp, count(*) FILTER (WHERE p_size > 25) AS fp, count(*) FILTER (WHERE p_size < 15) AS fn FROM part GROUP BY ALL), t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c),
  q AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM t) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q""")
def micro_average(w: World) -> DataFrame:
    size = F.col("p_size")
    return ingest.micro_average(w.table("part").groupBy("p_type").agg(F.count_if((size <= 25) & (size >= 15)).alias("tp"), F.count_if(size > 25).alias("fp"), F.count_if(size < 15).alias("fn")))


# ---- graph

@query(f"""{with_("isa")} SELECT left(child, 1) AS g, count(*) AS triples, count(DISTINCT child) AS subjects FROM isa GROUP BY ALL""")
def graph_triple_counts(w: World) -> DataFrame:
    return concepts.graph_counts(w.isa.select(F.left("child", F.lit(1)).alias("g"), F.col("child").alias("s")))


@query(f"""{with_("isa", recursive=True)}, n AS (SELECT 'S' || s_suppkey AS code FROM supplier UNION SELECT parent FROM n JOIN isa ON child = code) SELECT DISTINCT child, parent FROM isa WHERE child IN (SELECT code FROM n)""")
def induced_ancestors(w: World) -> DataFrame:
    return graph.induced(w.isa, w.table("supplier").select(code("S", "s_suppkey").alias("code")))


_PARTS = """rel AS (SELECT 'N' || n_nationkey AS subject, 'R' || n_regionkey AS filler FROM nation UNION ALL SELECT 'R' || r_regionkey, 'W' FROM region)"""


def _relations(w: World) -> DataFrame:
    return w.table("nation").select(code("N", "n_nationkey").alias("subject"), code("R", "n_regionkey").alias("filler")).unionByName(w.table("region").select(code("R", "r_regionkey").alias("subject"), F.lit("W").alias("filler")))


@query(f"""{with_("isa", recursive=True)}, {_PARTS}, n AS (SELECT 'C' || c_custkey AS code FROM customer WHERE c_acctbal > 0 UNION SELECT parent FROM n JOIN isa ON child = code) SELECT DISTINCT subject, filler FROM rel WHERE subject IN (SELECT code FROM n)""")
def ancestor_relations(w: World) -> DataFrame:
    return graph.ancestor_path_edges(w.isa, _relations(w), w.table("customer").where("c_acctbal > 0").select(code("C", "c_custkey").alias("code")))


@query("""SELECT 'S' || s_suppkey AS part, 'R' || n_regionkey AS whole FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'S' || s_suppkey, 'W' FROM supplier""")
def part_of_seeded(w: World) -> DataFrame:
    return graph.part_of_pairs(w.isa, _relations(w), parts=w.table("supplier").select(code("S", "s_suppkey").alias("code")))


_SITED = """s AS (SELECT DISTINCT 'O' || l_orderkey AS concept, 'S' || l_suppkey AS filler FROM lineitem UNION SELECT 'O' || o_orderkey, 'N' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT 'O' || o_orderkey, 'W' FROM orders UNION SELECT 'O' || o_orderkey, 'R' || (o_orderkey % 5) FROM orders)"""


@query(f"""WITH {_SITED}, above AS (SELECT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent FROM supplier UNION SELECT 'S' || s_suppkey, 'R' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'S' || s_suppkey, 'W' FROM supplier
  UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT 'N' || n_nationkey, 'W' FROM nation UNION SELECT 'R' || r_regionkey, 'W' FROM region), wide AS (SELECT DISTINCT concept, parent AS filler FROM s JOIN above ON filler = child)
SELECT concept, filler FROM s ANTI JOIN wide USING (concept, filler)""")
def anatomy_leaves(w: World) -> DataFrame:
    orders, lines = w.table("orders"), w.table("lineitem")
    bought = orders.join(w.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = code("O", "o_orderkey").alias("concept")
    sites = lines.select(code("O", "l_orderkey").alias("concept"), code("S", "l_suppkey").alias("filler")).unionByName(bought.select(o, code("N", "c_nationkey").alias("filler"))).unionByName(orders.select(o, F.lit("W").alias("filler"))).unionByName(orders.select(o, F.concat(F.lit("R"), (F.col("o_orderkey") % 5).cast("string")).alias("filler"))).distinct()
    return graph.site_leaves(sites, w.isa, _relations(w))


@query(f"""{with_("isa")}, a AS (SELECT child AS src, 'isa' AS rel, parent AS dst, 'one' AS label FROM isa WHERE child LIKE 'S%' OR child LIKE 'N%'), b AS (SELECT child AS src, 'isa' AS rel, parent AS dst, 'two' AS label FROM isa WHERE child LIKE 'N%' OR child LIKE 'C%') SELECT src, rel, dst, coalesce(b.label, a.label) AS label FROM a FULL JOIN b USING (src, rel, dst)""")
def expand_and_merge(w: World) -> DataFrame:
    part = lambda letters, label: w.isa.where(F.col("child").rlike(f"^[{letters}]")).select(F.col("child").alias("src"), F.lit("isa").alias("rel"), F.col("parent").alias("dst"), F.lit(label).alias("label"))
    return graph.merge_edges(part("SN", "one"), part("NC", "two"))


@query(f"""{with_("labels")}, t AS (SELECT * FROM (VALUES ('asia'), ('C7'), ('  SUPPLIER#00000001 '), (' '), ('zzz')) AS v(term)) SELECT term, min(code) AS code FROM t JOIN labels ON lower(code) = lower(trim(term)) OR contains(lower(label), lower(trim(term))) WHERE trim(term) <> '' GROUP BY term""")
def find_nodes(w: World) -> DataFrame:
    return concepts.find_nodes(w.labels, values(w, "term", ["asia", "C7", "  SUPPLIER#00000001 ", " ", "zzz"]))


@query(f"""{with_("roles")} SELECT code AS concept, role AS axis, array_to_string(list_sort(list(DISTINCT filler)), ',') AS fillers FROM roles GROUP BY ALL HAVING count(DISTINCT filler) > 1""")
def ambiguous_axes(w: World) -> DataFrame:
    return decomposition.ambiguous_axes(w.roles.select(F.col("code").alias("concept"), F.col("role").alias("axis"), "filler")).withColumn("fillers", F.array_join("fillers", ","))


@query("""SELECT s_suppkey, s_acctbal FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS s_acctbal FROM supplier) ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 9""")
def nulls_last_both_ways(w: World) -> DataFrame:
    rows = w.table("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")).alias("s_acctbal"))
    return rows.orderBy(concepts.nulls_last("s_acctbal", True), "s_suppkey").limit(9)


@query("""WITH n AS (SELECT 'R' || n_regionkey AS center, 'N' || n_nationkey AS code, n_nationkey % 3 AS t FROM nation UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey, 0 FROM region UNION ALL SELECT 'R0', 'Z', 2)
SELECT center, code, code <> 'R1' AND NOT (center = 'R1' AND code LIKE 'N%') AS dimmed FROM n WHERE center = code OR (t <> 0 AND code <> 'Z')""")
def visible_nodes(w: World) -> DataFrame:
    nation, region = w.table("nation"), w.table("region")
    kind = lambda c: F.concat(F.lit("t"), c.cast("string"))
    center = code("R", "n_regionkey").alias("center")
    nodes = nation.select(center, code("N", "n_nationkey").alias("code"), kind(F.col("n_nationkey") % 3).alias("semantic_type")).unionByName(region.select(code("R", "r_regionkey").alias("center"), code("R", "r_regionkey").alias("code"), F.lit("t0").alias("semantic_type"))).unionByName(w.spark.range(1).select(F.lit("R0").alias("center"), F.lit("Z").alias("code"), F.lit("t2").alias("semantic_type")))
    edges = nation.select(center, code("N", "n_nationkey").alias("src"), code("R", "n_regionkey").alias("dst"))
    return graph.visible(nodes, edges, values(w, "semantic_type", ["t0"]), True, "R1")[0].select("center", "code", "dimmed")


@query("""SELECT 'C' || c_custkey AS root, 'R88' AS role, c_mktsegment AS filler FROM customer UNION ALL SELECT 'C' || c_custkey, 'R101', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def spike_walk(w: World) -> DataFrame:
    customer, nation = w.table("customer"), w.table("nation")
    none = F.lit(None).cast("string")
    genus = lambda df, c, g: df.select(c.alias("concept"), g.alias("genus"), none.alias("role"), none.alias("role_label"), none.alias("filler"))
    role = lambda df, c, r, label, f: df.select(c.alias("concept"), none.alias("genus"), F.lit(r).alias("role"), F.lit(label).alias("role_label"), f.alias("filler"))
    c, n = code("C", "c_custkey"), code("N", "n_nationkey")
    members = genus(customer, c, code("N", "c_nationkey")).unionByName(genus(nation, n, code("R", "n_regionkey"))).unionByName(role(customer, c, "R88", "Has", F.col("c_mktsegment"))).unionByName(role(customer, c, "R9", "May_Have", F.col("c_name"))).unionByName(role(nation, n, "R101", "Has_Site", F.col("n_name")))
    return graph.spike_walk(members, customer.select(c.alias("code")))
