"""The registered queries of the terminology engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom import model
from conceptloom.functions import text
from conceptloom.operators import concepts, decomposition, elements, graph, mappings, search, similarity
from conceptloom.plans.projection import World, code, with_
from conceptloom.streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[World], DataFrame]], Callable[[World], DataFrame]]:
    """Register a query over a :class:`World` under its function's name."""

    def add(f: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(World(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(w: World, column: str, items: list[str]) -> DataFrame:
    return w.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in items])).alias(column))


# ---- flagship: decomposition of every order into constituents

_SITES = """,
  up AS (SELECT 'C' || c_custkey AS child, 'N' || c_nationkey AS parent FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier),
  site AS (SELECT DISTINCT 'O' || l_orderkey AS concept, 'R101' AS axis, 'S' || l_suppkey AS filler FROM lineitem UNION SELECT DISTINCT 'O' || o_orderkey, 'R101', 'N' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
  lin AS (SELECT DISTINCT 'O' || o_orderkey AS concept, 'lineage' AS axis, o_orderpriority AS filler FROM orders UNION SELECT DISTINCT 'O' || o_orderkey, 'lineage', o_orderstatus FROM orders),
  narrow AS (SELECT DISTINCT a.concept, a.filler FROM site a JOIN up ON a.filler = up.child JOIN site b ON b.concept = a.concept AND b.filler = up.parent),
  leaf AS (SELECT s.* FROM site s ANTI JOIN (SELECT DISTINCT x.concept, up.parent AS filler FROM site x JOIN up ON x.filler = up.child) b USING (concept, filler)),
  kept AS (SELECT *, count(*) OVER (PARTITION BY concept, axis) AS n FROM (SELECT * FROM leaf UNION ALL SELECT * FROM lin)),
  organ AS (SELECT 'O' || l_orderkey AS concept, 'S' || min(l_suppkey) AS organ FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey),
  k2 AS (SELECT kept.*, organ, axis = 'R101' AND n > 1 AND coalesce(max(CASE WHEN axis = 'R101' AND filler = organ THEN 1 ELSE 0 END) OVER (PARTITION BY kept.concept, axis), 0) = 1 AS known FROM kept LEFT JOIN organ ON kept.concept = organ.concept),
  k3 AS (SELECT k2.*, s_suppkey IS NOT NULL AS is_organ FROM k2 LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) o ON filler = 'S' || s_suppkey WHERE NOT known OR filler = organ),
  k4 AS (SELECT *, axis = 'R101' AND NOT known AND n > 1 AND count(*) FILTER (WHERE NOT is_organ) OVER (PARTITION BY concept, axis) > 0 AS split FROM k3),
  k5 AS (SELECT concept, CASE WHEN split AND NOT is_organ THEN 'region' ELSE axis END AS axis, filler, known FROM k4),
  k6 AS (SELECT *, CASE WHEN known THEN 1 ELSE count(*) OVER (PARTITION BY concept, axis) END AS n FROM k5)
"""


@query(f"""{with_("labels")}{_SITES}
SELECT concept, axis, filler, EXISTS (SELECT 1 FROM narrow WHERE narrow.concept = k6.concept AND narrow.filler = k6.filler) AS most_specific,
  n > 1 AND axis NOT IN ('lineage', 'region') AS needs_review, CASE WHEN n > 1 AND axis IN ('lineage', 'region') THEN axis || ':' || concept END AS grp FROM k6""")
def select_constituents(w: World) -> DataFrame:
    lines, orders = w.table("lineitem"), w.table("orders")
    joined = orders.join(w.table("customer"), orders["o_custkey"] == F.col("c_custkey"))
    row = lambda df, key, axis, filler: df.select(code("O", key).alias("concept"), F.lit(axis).alias("axis"), filler.alias("filler")).distinct()
    routed = row(lines, "l_orderkey", "R101", code("S", "l_suppkey")).unionByName(row(joined, "o_orderkey", "R101", code("N", "c_nationkey"))).unionByName(row(orders, "o_orderkey", "lineage", F.col("o_orderpriority"))).unionByName(row(orders, "o_orderkey", "lineage", F.col("o_orderstatus")))
    above = w.isa.where(F.col("child").rlike("^[CS][0-9]"))
    types = w.table("supplier").where("s_acctbal > 0").select(code("S", "s_suppkey").alias("code"), F.lit(model.ORGAN_TYPE).alias("semantic_type"))
    organs = lines.where("l_orderkey % 3 = 0").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s")).select(code("O", "l_orderkey").alias("concept"), code("S", "s").alias("organ"))
    return decomposition.select_constituents(routed, above, types, organs)


# ---- reads

@query(f"""{with_("links")} SELECT DISTINCT concept_code, public_id, version, long_name FROM links""")
def cdes_for_concept(w: World) -> DataFrame:
    return elements.for_concepts(w.elements, w.links)


@query(f"""{with_("links")} SELECT concept_code, public_id, version, long_name FROM (SELECT *, row_number() OVER (PARTITION BY concept_code ORDER BY long_name, public_id, version) AS n FROM (SELECT DISTINCT concept_code, public_id, version, long_name FROM links)) WHERE n <= 5""")
def first_cdes_for_concept(w: World) -> DataFrame:
    return elements.for_concepts(w.elements, w.links, limit=5)


@query("""SELECT 'P' || p_partkey AS code, p_name AS label, p_name AS preferred_name, NULL::VARCHAR AS definition, p_type AS semantic_types, CASE WHEN p_brand < p_type THEN p_brand || '||' || p_type ELSE p_type || '||' || p_brand END AS synonyms FROM part
  UNION ALL SELECT 'C' || c_custkey, c_name, c_name, NULL, c_mktsegment, '' FROM customer""")
def concept_detail(w: World) -> DataFrame:
    return concepts.detail(w.props).withColumn("semantic_types", F.array_join("semantic_types", "||")).withColumn("synonyms", F.array_join("synonyms", "||"))


@query("""SELECT 'P' || p_partkey AS code, p_name AS preferred_name, p_type AS semantic_type, NULL::VARCHAR AS definition, CASE WHEN p_brand < p_type THEN p_brand || ' | ' || p_type ELSE p_type || ' | ' || p_brand END AS synonyms FROM part
  UNION ALL SELECT 'C' || c_custkey, c_name, c_mktsegment, NULL, '' FROM customer""")
def embedding_records(w: World) -> DataFrame:
    return concepts.embedding_records(w.props)


@query(f"""{with_("labels", "isa")} SELECT code, label FROM labels WHERE code IN (SELECT child FROM isa)""")
def labels_for(w: World) -> DataFrame:
    return concepts.labels_for(w.labels, w.isa.select(F.col("child").alias("code")))


@query(f"""{with_("roles", "labels")} SELECT filler, role, r.code AS subject, label AS subject_label FROM roles r LEFT JOIN labels l ON r.code = l.code WHERE filler LIKE 'S%'""")
def incoming_roles(w: World) -> DataFrame:
    restrictions = w.roles.select(F.col("code").alias("subject"), "role", "filler")
    return concepts.incoming(restrictions, w.labels, w.table("supplier").select(code("S", "s_suppkey").alias("code")))


@query(f"""{with_("roles", "labels")}, arms AS (SELECT DISTINCT code, 'role' AS arm, role AS rel, filler AS target FROM roles UNION ALL SELECT 'O' || o_orderkey, 'association', 'A_STATUS', o_orderstatus FROM orders)
SELECT a.code, arm, rel, target, label FROM (SELECT *, row_number() OVER (PARTITION BY code, arm ORDER BY rel, target) AS n FROM arms) a LEFT JOIN labels l ON a.target = l.code WHERE n <= 3""")
def related_concepts_per_arm_limit(w: World) -> DataFrame:
    links = w.table("orders").select(code("O", "o_orderkey").alias("subject"), F.lit("A_STATUS").alias("rel"), F.col("o_orderstatus").alias("target"))
    return concepts.related(w.roles.select(F.col("code").alias("subject"), "role", "filler"), links, w.labels, 3)


@query(f"""{with_("labels")} SELECT code, label, (SELECT count(*) FROM labels) AS total FROM labels ORDER BY label, code LIMIT 50 OFFSET 100""")
def list_concepts_page(w: World) -> DataFrame:
    return concepts.page(w.labels, ["label", "code"], 50, 100)


@query(f"""{with_("labels")} SELECT code, label FROM labels WHERE contains(lower(label), 'an')""")
def substring_search(w: World) -> DataFrame:
    return concepts.contains_text(w.labels, ["label"], "AN")


@query(f"""{with_("labels")} SELECT code, label, (lower(label) = 'supplier#000000003')::INT AS exact FROM labels WHERE contains(lower(label), '3')
  ORDER BY (lower(label) = 'supplier#000000003')::INT DESC, length(label), label, code LIMIT 25""")
def exact_name_first_order(w: World) -> DataFrame:
    return concepts.exact_name_first(concepts.contains_text(w.labels, ["label"], "3"), ' "Supplier#000000003"\n', 25)


@query("""SELECT public_id, version, long_name FROM (SELECT p_size::VARCHAR AS public_id, p_partkey || '.' || p_size AS version, p_name AS long_name, row_number() OVER (PARTITION BY p_size ORDER BY (p_partkey || '.' || p_size)::DOUBLE DESC, p_partkey || '.' || p_size DESC) AS n FROM part) WHERE n = 1""")
def latest_version(w: World) -> DataFrame:
    rows = w.table("part").select(F.col("p_size").cast("string").alias("public_id"), F.concat_ws(".", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("version"), F.col("p_name").alias("long_name"))
    return elements.latest(rows)


@query("""WITH words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS term FROM documents), q AS (SELECT * FROM (VALUES (1, 'on'), (1, 'th'), (2, 'le'), (2, 'que'), (2, 'aux'), (3, 'licen'), (3, 'mit'), (4, 'zzzz')) AS v(query_id, prefix)),
  n AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id)
SELECT query_id, doc_id FROM (SELECT q.query_id, doc_id, count(DISTINCT prefix) AS hits FROM words JOIN q ON starts_with(term, prefix) GROUP BY ALL) JOIN n USING (query_id) WHERE hits = n""")
def prefix_and_search(w: World) -> DataFrame:
    rows = [(1, "on* th"), (2, 'le "que" aux'), (3, "licen mit"), (4, "zzzz"), (5, '"*"')]
    terms = [F.struct(F.lit(i).alias("query_id"), F.array(*[F.lit(t) for t in text.prefix_terms(q)]).cast("array<string>").alias("terms")) for i, q in rows]
    return search.prefix_search(w.table("documents"), "doc_id", ["text"], w.spark.range(1).select(F.inline(F.array(*terms))))


@query()
def ranked_search(w: World) -> DataFrame:
    lists = search.postings(w.table("pages"), "page_id", {"url": search.WEIGHT_A, "html": search.WEIGHT_B})
    one = F.struct(F.lit(1).alias("query_id"), F.array(F.lit("the"), F.lit("html")).alias("terms"))
    return search.ranked(lists, "page_id", w.spark.range(1).select(F.inline(F.array(one))))


# ---- graph

_CLOSURE = """, up AS (SELECT child, parent FROM isa UNION SELECT up.child, isa.parent FROM up JOIN isa ON up.parent = isa.child)"""


@query(f"""{with_("isa", recursive=True)}{_CLOSURE} SELECT child, parent FROM up WHERE child <> parent""")
def isa_closure(w: World) -> DataFrame:
    return graph.closure(w.isa)


@query(f"""{with_("isa", recursive=True)}, d AS (SELECT 'R1' AS code UNION SELECT child FROM isa JOIN d ON isa.parent = d.code) SELECT code FROM d""")
def scope_descendants(w: World) -> DataFrame:
    return graph.descendants(w.isa, values(w, "code", ["R1"]))


_PARTS = """'X1' AS subject, 'X2' AS filler UNION ALL SELECT 'X2', 'X1' UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation"""


@query(f"""{with_("isa", recursive=True)}{_CLOSURE}, rel AS (SELECT {_PARTS}), own AS (SELECT subject AS part, filler AS whole FROM rel UNION SELECT child, filler FROM up JOIN rel ON up.parent = rel.subject),
  all_ AS (SELECT part, whole FROM own UNION SELECT all_.part, own.whole FROM all_ JOIN own ON all_.whole = own.part) SELECT part, whole FROM all_ WHERE part <> whole""")
def part_of_closure_bounded(w: World) -> DataFrame:
    cycle = w.spark.range(1).select(F.inline(F.array(F.struct(F.lit("X1").alias("subject"), F.lit("X2").alias("filler")), F.struct(F.lit("X2").alias("subject"), F.lit("X1").alias("filler")))))
    relations = cycle.unionByName(w.table("orders").select(code("O", "o_orderkey").alias("subject"), code("C", "o_custkey").alias("filler"))).unionByName(w.table("nation").select(code("N", "n_nationkey").alias("subject"), code("R", "n_regionkey").alias("filler")))
    return graph.part_of_pairs(w.isa, relations)


@query("""SELECT DISTINCT 'C' || c_custkey AS subject, 'S' || s_suppkey AS object, CASE WHEN c_nationkey % 4 = 3 THEN 'NO_ANCHORED_ANCESTOR' WHEN c_nationkey = s_nationkey THEN 'CORROBORATED' ELSE 'NOT_ENTAILED' END AS verdict
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""")
def mixed_reachability(w: World) -> DataFrame:
    bought = w.table("lineitem").join(w.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = bought.select(code("C", "o_custkey").alias("subject"), code("S", "l_suppkey").alias("object")).distinct()
    anchors = w.table("nation").where("n_nationkey % 4 <> 3").select(code("N", "n_nationkey").alias("code"), code("N", "n_nationkey").alias("curie"))
    return graph.corroboration(pairs, w.isa, w.isa, anchors)


def _taxonomy(w: World) -> DataFrame:
    return w.isa.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit("isa").alias("rel"))


_AROUND = f"""{with_("isa", recursive=True)}, e AS (SELECT child AS src, parent AS dst FROM isa), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
  n AS (SELECT 'R' || r_regionkey AS center, 'R' || r_regionkey AS code, 0 AS hop FROM region UNION SELECT n.center, b.b, n.hop + 1 FROM n JOIN b ON n.code = b.a WHERE n.hop < 2),
  f AS (SELECT center, code, min(hop) AS hop FROM n GROUP BY ALL), k AS (SELECT center, code, hop, count(*) OVER (PARTITION BY center) >= 400 AS truncated FROM f QUALIFY row_number() OVER (PARTITION BY center ORDER BY hop, code) <= 400)"""


def _around(w: World) -> tuple[DataFrame, DataFrame]:
    return graph.neighborhood(_taxonomy(w), w.table("region").select(code("R", "r_regionkey").alias("code")), 2)


@query(f"""{_AROUND} SELECT center, code, hop, truncated FROM k""")
def neighborhood_depth2(w: World) -> DataFrame:
    return _around(w)[0]


@query(f"""{_AROUND} SELECT DISTINCT a.center, src, dst, 'isa' AS rel FROM e JOIN k a ON a.code = src JOIN k z ON z.code = dst AND z.center = a.center""")
def neighborhood_edges(w: World) -> DataFrame:
    return _around(w)[1]


@query(f"""{with_("isa")}, e AS (SELECT child AS src, parent AS dst FROM isa) SELECT code, count(*) AS degree FROM (SELECT src AS code FROM e UNION ALL SELECT dst FROM e) GROUP BY code ORDER BY degree DESC, code LIMIT 5""")
def degree_topn(w: World) -> DataFrame:
    return graph.degrees(_taxonomy(w)).orderBy(F.desc("degree"), "code").limit(5)


@query()
def betweenness(w: World) -> DataFrame:
    _, inside = graph.neighborhood(_taxonomy(w), w.table("region").select(code("R", "r_regionkey").alias("code")), 2)
    return graph.betweenness(inside)


@query()
def communities(w: World) -> DataFrame:
    return graph.communities(_taxonomy(w))


def _members(w: World) -> DataFrame:
    """``concept``, ``hop``, ``genus``, ``role``, ``filler``."""
    orders, lines, customer, nation = w.table("orders"), w.table("lineitem"), w.table("customer"), w.table("nation")
    none = F.lit(None).cast("string")
    genus = lambda df, c, g: df.select(c.alias("concept"), F.lit(0).alias("hop"), g.alias("genus"), none.alias("role"), none.alias("filler"))
    role = lambda df, c, r, f: df.select(c.alias("concept"), F.lit(1).alias("hop"), none.alias("genus"), F.lit(r).alias("role"), f.alias("filler")).distinct()
    return genus(orders, code("O", "o_orderkey"), code("C", "o_custkey")).unionByName(genus(customer, code("C", "c_custkey"), code("N", "c_nationkey"))).unionByName(genus(nation, code("N", "n_nationkey"), code("R", "n_regionkey"))).unionByName(role(lines, code("O", "l_orderkey"), "R103", code("P", "l_partkey"))).unionByName(role(customer, code("C", "c_custkey"), "R88", F.col("c_mktsegment"))).unionByName(role(customer, code("C", "c_custkey"), "R999", F.col("c_name"))).unionByName(role(nation, code("N", "n_nationkey"), "R101", F.col("n_name")))


@query("""SELECT DISTINCT 'O' || l_orderkey AS root, 'R103' AS role, 'P' || l_partkey AS filler, 0 AS depth, NULL::VARCHAR AS anchoring_genus FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'O' || o_orderkey, 'R88', c_mktsegment, 1, 'C' || c_custkey FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'O' || o_orderkey, 'R101', n_name, 2, 'N' || n_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def genus_walk_first_seen(w: World) -> DataFrame:
    return graph.genus_walk(_members(w), w.table("orders").select(code("O", "o_orderkey").alias("code")))


@query("""SELECT 'C' || c_custkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN 'R' || n_regionkey ELSE 'N' || n_nationkey END AS morphology FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'Y1', NULL UNION ALL SELECT 'Y2', NULL""")
def morphology_resolve(w: World) -> DataFrame:
    genera = w.isa.where(F.col("child").rlike("^[CN][0-9]")).select(F.col("child").alias("concept"), F.col("parent").alias("genus"))
    loop = w.spark.range(1).select(F.inline(F.array(F.struct(F.lit("Y1").alias("concept"), F.lit("Y2").alias("genus")), F.struct(F.lit("Y2").alias("concept"), F.lit("Y1").alias("genus")))))
    labels = w.table("nation").select(code("N", "n_nationkey").alias("code"), F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, " by origin").otherwise("")).alias("label")).unionByName(w.table("region").select(code("R", "r_regionkey").alias("code"), F.col("r_name").alias("label")))
    return graph.resolve_morphology(genera.unionByName(loop), labels)


@query(f"""{with_("isa", recursive=True)}, e AS (SELECT child, parent FROM isa UNION ALL SELECT 'N0', 'N1' UNION ALL SELECT 'N1', 'N0'), up AS (SELECT child, parent FROM e UNION SELECT up.child, e.parent FROM up JOIN e ON up.parent = e.child)
SELECT DISTINCT a.child AS code FROM up a JOIN up b USING (child) WHERE a.parent = 'R0' AND b.parent = 'R1'""")
def el_unsat(w: World) -> DataFrame:
    pair = lambda x, y: w.spark.range(1).select(F.lit(x).alias("a"), F.lit(y).alias("b"))
    return graph.unsatisfiable(w.isa, pair("N0", "N1"), pair("R0", "R1"))


# ---- decomposition

@query(f"""{with_("roles")}, n AS (SELECT code, count(DISTINCT role) AS n FROM roles WHERE NOT coalesce(contains(role_label, 'Excludes'), false) GROUP BY code)
SELECT 'O' || o_orderkey AS code, (n + (o_totalprice > 100000)::INT)::BIGINT AS axes, o_orderstatus IN ('F', 'O') AS in_scope, o_orderstatus AS semantic_type, o_orderstatus IN ('F', 'O') AND n + (o_totalprice > 100000)::INT >= 4 AS is_precoordinated FROM orders JOIN n ON code = 'O' || o_orderkey""")
def detect_precoordinated(w: World) -> DataFrame:
    rows = w.table("orders").select(code("O", "o_orderkey").alias("code"), F.array("o_orderstatus").alias("semantic_types"), F.col("o_orderpriority").alias("label"), (F.col("o_totalprice") > 100000).alias("has_morphology"))
    return decomposition.detect(rows, w.roles, ("F", "O"), 4)


@query(f"""{with_("roles")} SELECT DISTINCT code, filler, CASE WHEN role = 'R101' AND anchoring_genus IN ('N1', 'N2', 'N3') THEN 'lineage' WHEN role = 'R88' AND filler IN ('1-URGENT', '2-HIGH') THEN 'stage_system' ELSE role END AS axis FROM roles""")
def route_axis(w: World) -> DataFrame:
    return w.roles.select("code", "filler", decomposition.routed_axis(lineage=("N1", "N2", "N3"), stages=("1-URGENT", "2-HIGH")).alias("axis")).distinct()


@query("""WITH up AS (SELECT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent FROM supplier),
  site AS (SELECT DISTINCT 'O' || l_orderkey AS concept, 'R101' AS axis, 'S' || l_suppkey AS filler FROM lineitem UNION SELECT DISTINCT 'O' || o_orderkey, 'R101', 'N' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
  wide AS (SELECT DISTINCT concept, parent AS filler FROM site JOIN up ON filler = child) SELECT concept, axis, filler FROM site ANTI JOIN wide USING (concept, filler)""")
def most_specific_leaves(w: World) -> DataFrame:
    orders = w.table("orders").join(w.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    fillers = w.table("lineitem").select(code("O", "l_orderkey").alias("concept"), F.lit("R101").alias("axis"), code("S", "l_suppkey").alias("filler")).unionByName(orders.select(code("O", "o_orderkey").alias("concept"), F.lit("R101").alias("axis"), code("N", "c_nationkey").alias("filler"))).distinct()
    return graph.leaves(fillers, w.isa.where(F.col("child").rlike("^[CS][0-9]")), ["concept", "axis"])


_SAID = """SELECT 'C' || c_custkey AS code, c_custkey AS k, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS seg FROM customer"""


@query(f"""WITH s AS ({_SAID}), a AS (SELECT code, 'laterality' AS axis, 'Left' AS surface, 'positive' AS polarity FROM s WHERE k % 3 = 0
  UNION ALL SELECT code, 'finding', seg || CASE WHEN k % 5 = 0 THEN ' AJCC' ELSE '' END, CASE WHEN k % 2 = 0 THEN 'positive' ELSE 'negative' END FROM s UNION ALL SELECT code, 'staging_system', 'AJCC v8', 'positive' FROM s WHERE k % 5 = 0)
SELECT code, axis, surface, polarity, CASE WHEN polarity = 'positive' AND surface = 'Building' THEN 'K1' ELSE 'MINT-' || substr(sha1(axis || '|' || lower(trim(CASE WHEN polarity = 'negative' THEN 'Without ' || surface ELSE surface END))), 1, 12) END AS filler FROM a""")
def label_aspects(w: World) -> DataFrame:
    k = F.col("c_custkey")
    label = F.concat(F.when(k % 3 == 0, "Left ").otherwise(""), F.lit("Order"), F.when(k % 2 == 0, " with ").otherwise(" without "), F.initcap(F.lower("c_mktsegment")), F.when(k % 5 == 0, " AJCC v8").otherwise(""))
    known = w.spark.range(1).select(F.lit("K1").alias("code"), F.lit(" building ").alias("label"))
    return decomposition.label_constituents(w.table("customer").select(code("C", "c_custkey").alias("code"), label.alias("label")), known)


@query("""SELECT 'P' || p_partkey AS code, 'MINT-' || substr(sha1(p_type || '|' || lower(trim(p_name))), 1, 12) AS id FROM part""")
def mint_ids(w: World) -> DataFrame:
    return w.table("part").select(code("P", "p_partkey").alias("code"), text.mint_id("p_type", "p_name").alias("id"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS concept, l_partkey FROM lineitem), d AS (SELECT count(DISTINCT concept) AS decomposed FROM c), r AS (SELECT count(DISTINCT concept) AS residual FROM c JOIN part ON l_partkey = p_partkey WHERE p_size > 40)
SELECT decomposed, residual, residual::DOUBLE / decomposed AS rate FROM d, r""")
def residual_metric(w: World) -> DataFrame:
    rows = w.table("lineitem").select(code("O", "l_orderkey").alias("concept"), code("P", "l_partkey").alias("filler")).distinct()
    detected = w.table("part").select(code("P", "p_partkey").alias("code"), (F.col("p_size") > 40).alias("is_precoordinated"))
    return decomposition.residual(rows, detected)


@query("""WITH p AS (SELECT p_type AS axis, p_brand AS filler, bool_or(p_size <= 25) AS e, bool_or(p_size >= 15) AS a, bool_or(p_size = 20) AS r FROM part GROUP BY ALL),
  c AS (SELECT count(*) FILTER (WHERE NOT r AND e AND a) AS tp, count(*) FILTER (WHERE NOT r AND a AND NOT e) AS fp, count(*) FILTER (WHERE NOT r AND e AND NOT a) AS fn, count(*) FILTER (WHERE r) AS deferred FROM p),
  q AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 1.0::DOUBLE) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 1.0::DOUBLE) AS recall FROM c) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q""")
def score_prf(w: World) -> DataFrame:
    pairs = lambda cond: w.table("part").where(cond).select(F.col("p_type").alias("axis"), F.col("p_brand").alias("filler"))
    return decomposition.score(pairs("p_size <= 25"), pairs("p_size >= 15"), pairs("p_size = 20"))


# ---- registry and mappings

@query(f"""{with_("links")} SELECT concept_type, count(DISTINCT concept_code) AS codes FROM links GROUP BY GROUPING SETS ((concept_type), ())""")
def anchor_counts_by_type(w: World) -> DataFrame:
    return concepts.anchors_by_type(w.links)


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A') SELECT (SELECT count(*) FROM a WHERE l_partkey IN (FROM b)) AS "both", (SELECT count(*) FROM a WHERE l_partkey NOT IN (FROM b)) AS a_only, (SELECT count(*) FROM b WHERE l_partkey NOT IN (FROM a)) AS b_only""")
def overlap_counts(w: World) -> DataFrame:
    side = lambda f: w.table("lineitem").where(F.col("l_returnflag") == f).select(code("P", "l_partkey").alias("code"))
    return concepts.overlap(side("R"), side("A"))


@query(f"""{with_("named_pairs")} SELECT subject_id, object_id, via_xref, via_label, mapping_justification, confidence FROM named_pairs""")
def candidate_provenance(w: World) -> DataFrame:
    return w.pairs


@query(f"""{with_("pairs")}, f AS (SELECT 'P' || p_partkey AS code FROM part WHERE p_partkey % 2 = 1), p AS (SELECT subject_id, bool_or(via_xref) AS x FROM pairs GROUP BY ALL),
  c AS (SELECT count(*) AS fillers, count(*) FILTER (WHERE x) AS via_xref, count(*) FILTER (WHERE NOT x) AS via_label_only FROM f LEFT JOIN p ON code = subject_id) SELECT *, round((via_xref + via_label_only)::DOUBLE / fillers, 4) AS recall FROM c""")
def candidate_coverage(w: World) -> DataFrame:
    return mappings.candidate_report(w.pairs, w.table("part").where("p_partkey % 2 = 1").select(code("P", "p_partkey").alias("code")))


@query(f"""{with_("judged")} SELECT subject_id, object_id, array_to_string(evidence, ',') AS evidence, independent FROM judged""")
def evidence_kinds(w: World) -> DataFrame:
    return w.judged.select("subject_id", "object_id", F.array_join("evidence", ",").alias("evidence"), "independent")


@query(f"""{with_("records")} SELECT subject_id, object_id, predicate_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, object_id ORDER BY CASE predicate_id WHEN 'skos:exactMatch' THEN 1 WHEN 'skos:closeMatch' THEN 2 ELSE 3 END, run_id, confidence DESC) AS n
  FROM (SELECT subject_id, object_id, predicate_id, run_id, confidence FROM records UNION ALL SELECT subject_id, object_id, 'skos:closeMatch', 'run9', 0.1 FROM records)) WHERE n = 1""")
def one_per_pair(w: World) -> DataFrame:
    rows = w.records.select("subject_id", "object_id", F.col("predicate_id").alias("mapping_justification"), "run_id", "confidence")
    more = w.records.select("subject_id", "object_id", F.lit("skos:closeMatch").alias("mapping_justification"), F.lit("run9").alias("run_id"), F.lit(0.1).alias("confidence"))
    return mappings.one_per_pair(rows.unionByName(more), ("skos:exactMatch", "skos:closeMatch")).select("subject_id", "object_id", F.col("mapping_justification").alias("predicate_id"))


_OUTCOME = f"""{with_("judged")}, q AS (SELECT *, coalesce(el_valid AND independent, false) AS qualified FROM judged), s AS (SELECT *, qualified AND NOT stale AND list_contains(evidence, 'sme_curation') AS sme,
    count(*) FILTER (WHERE qualified) OVER (PARTITION BY subject_id) > 1 OR count(*) FILTER (WHERE qualified) OVER (PARTITION BY object_id) > 1 AS contest FROM q),
  t AS (SELECT *, sme AND count(*) FILTER (WHERE sme) OVER (PARTITION BY subject_id) = 1 AND count(*) FILTER (WHERE sme) OVER (PARTITION BY object_id) = 1 AS sole FROM s),
  o AS (SELECT subject_id, object_id, CASE WHEN el_valid IS NULL THEN 'reasoner_error' WHEN NOT el_valid THEN 'refuted' WHEN NOT independent THEN 'insufficient_evidence' WHEN contest AND NOT sole THEN 'contested'
    WHEN list_contains(evidence, 'structural_corroboration') THEN 'promoted_with_structural_corroboration' WHEN list_contains(evidence, 'sme_curation') AND len(evidence) = 1 THEN 'promoted_on_curation_alone' ELSE 'promoted_on_source_agreement' END AS outcome FROM t)"""


@query(f"""{_OUTCOME} SELECT subject_id, object_id, outcome, CASE WHEN starts_with(outcome, 'promoted') THEN 'skos:exactMatch' ELSE 'skos:closeMatch' END AS predicate_id FROM o""")
def promote_candidates(w: World) -> DataFrame:
    return mappings.promote_all(w.sides, w.judge).select("subject_id", "object_id", "outcome", "predicate_id")


@query(f"""{_OUTCOME} SELECT outcome, count(*) AS candidates FROM o GROUP BY outcome""")
def promotion_report(w: World) -> DataFrame:
    return mappings.promotion_report(mappings.promote_all(w.sides, w.judge))


@query(f"""{with_("named_pairs")} SELECT subject_id, object_id, count(*) OVER (PARTITION BY subject_id) > 1 OR count(*) OVER (PARTITION BY object_id) > 1 AS contested FROM named_pairs""")
def contests(w: World) -> DataFrame:
    return mappings.contested(w.pairs).select("subject_id", "object_id", "contested")


@query(f"""{with_("records")} SELECT run_id, subject_id, object_id, predicate_id FROM records WHERE run_id IN ('run0', 'run1') AND lifecycle_state = 'validated' AND object_source_version <> 'v1'""")
def stale_mappings(w: World) -> DataFrame:
    return mappings.stale(w.records, w.runs, "uberon", "v1").select("run_id", "subject_id", "object_id", "predicate_id")


@query(f"""{with_("records")} SELECT run_id, subject_id, object_id, CASE WHEN run_id IN ('run0', 'run1') AND lifecycle_state = 'validated' AND object_source_version <> 'v1' THEN 'quarantined' ELSE lifecycle_state END AS lifecycle_state FROM records""")
def quarantine_sweep(w: World) -> DataFrame:
    return mappings.quarantine(w.records, w.runs, "uberon", "v1").select("run_id", "subject_id", "object_id", "lifecycle_state")


@query(f"""{with_("links", "records")}, m AS (SELECT subject_id AS code, bool_or(predicate_id = 'skos:exactMatch' AND lifecycle_state IN ('validated', 'active')) AS identity FROM records GROUP BY ALL),
  r AS (SELECT DISTINCT public_id, version, concept_code, concept_type, s_acctbal > -500 AS live, coalesce(identity, false) AS identity, coalesce(NOT identity, false) AS close FROM links JOIN supplier ON concept_code = 'S' || s_suppkey LEFT JOIN m ON code = concept_code),
  t AS (SELECT public_id, version, concept_type, count(DISTINCT concept_code) AS n, bool_and(live AND identity) AS covered FROM r GROUP BY ALL), p AS (SELECT public_id, version, max(n) AS n, bool_and(covered) AS covered FROM t GROUP BY ALL),
  a AS (SELECT count(*) AS elements, count(*) FILTER (WHERE covered) AS covered, count(*) FILTER (WHERE n > 1) AS post_coordinated FROM p), c AS (SELECT concept_code, bool_or(live) AS live, bool_or(identity) AS identity, bool_or(close) AS close FROM r GROUP BY ALL),
  b AS (SELECT count(*) AS codes, count(*) FILTER (WHERE live) AS live_codes, count(*) FILTER (WHERE identity) AS identity_codes, count(*) FILTER (WHERE close AND NOT identity) AS close_only_codes FROM c)
SELECT *, round(covered::DOUBLE / elements, 4) AS coverage FROM a, b""")
def coverage_report(w: World) -> DataFrame:
    live = w.table("supplier").where("s_acctbal > -500").select(code("S", "s_suppkey").alias("code"))
    return mappings.coverage_report(w.links, live, mappings.strength(w.records))


@query(f"""{with_("records")}, f AS (SELECT * FROM records WHERE lifecycle_state IN ('validated', 'active')), c AS (SELECT 'S' || s_suppkey AS code FROM supplier UNION ALL SELECT 'UBERON:' || k FROM (SELECT unnest(range(60)) AS k)),
  b AS (SELECT subject_id AS code, object_id AS target, predicate_id, confidence, 0 AS way FROM f UNION ALL SELECT object_id, subject_id, predicate_id, confidence, 1 FROM f),
  h AS (SELECT b.code, target, CASE predicate_id WHEN 'skos:exactMatch' THEN 'equivalent' WHEN 'skos:closeMatch' THEN 'close' WHEN 'skos:broadMatch' THEN 'broad' ELSE 'unmatched' END AS equivalence, confidence FROM b SEMI JOIN c USING (code) WHERE split_part(target, ':', 1) NOT IN ('SNOMED', 'ICD-O-3')
    QUALIFY row_number() OVER (PARTITION BY b.code, target, predicate_id ORDER BY way, confidence DESC) = 1)
SELECT * FROM h UNION ALL SELECT code, code, 'unmatched', 0 FROM c WHERE code NOT IN (SELECT code FROM h)""")
def translate(w: World) -> DataFrame:
    wanted = w.table("supplier").select(code("S", "s_suppkey").alias("code")).unionByName(w.spark.range(60).select(code("UBERON:", "id").alias("code")))
    return mappings.translate(wanted, w.records)


@query("""WITH e AS (SELECT event_id, ts, props, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT 'invalid_json' AS kind, count(*) FILTER (WHERE NOT json_valid(props)) AS rows FROM e
  UNION ALL SELECT 'bad_id', 0 UNION ALL SELECT 'duplicate_key', 0 UNION ALL SELECT 'json_differs', count(*) FROM e WHERE event_id % 3 = 0 UNION ALL SELECT 'no_values_array', count(*) FROM e WHERE event_id % 5 = 0 UNION ALL SELECT 'orphan_link', (SELECT count(DISTINCT user_id) FROM events WHERE user_id NOT IN (SELECT event_id FROM events))""")
def json_validation(w: World) -> DataFrame:
    e = w.table("events")
    key = F.col("event_id").cast("string")
    document = F.concat(F.lit('{"public_id": "'), F.when(F.col("event_id") % 3 == 0, "?").otherwise(key), F.lit('", "version": "1", "props": '), "props", F.when(F.col("event_id") % 5 == 0, "").otherwise(', "permissible_values": []'), F.lit("}"))
    rows = e.select(key.alias("public_id"), F.lit("1").alias("version"), document.alias("cde_json"))
    return elements.problems(rows, e.select(F.col("user_id").cast("string").alias("public_id"), F.lit("1").alias("version")).distinct())


@query("""SELECT p_partkey::VARCHAR AS public_id, sha256('{"long_name":"' || p_name || '","public_id":"' || p_partkey || '","version":"' || p_size || '"}') AS sha256 FROM part""")
def doc_fingerprint_rows(w: World) -> DataFrame:
    return elements.fingerprint_rows(w.elements.select("public_id", "version", "long_name"), ["public_id"])


@query(f"""{with_("links")} SELECT src, 'cde-concept' AS rel, dst FROM (SELECT public_id || ':' || version AS src, concept_code AS dst, row_number() OVER (PARTITION BY public_id, version ORDER BY concept_code) AS n FROM (SELECT DISTINCT public_id, version, concept_code FROM links)) WHERE n <= 12""")
def cde_neighborhood_edges(w: World) -> DataFrame:
    return elements.neighborhood_edges(w.links.withColumn("is_primary", F.lit(1)), w.elements)


# ---- vectors, streams, extensions

@query("""SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, r.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) DESC, r.vec_id) AS n FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id) WHERE n <= 5""")
def cosine_topk(w: World) -> DataFrame:
    rows = w.table("embeddings")
    return similarity.top_k(similarity.valid(rows, "embedding", 64), rows.where("vec_id % 50 = 0"), 5).withColumn("score", F.round("score", 6))


_HITS = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  f AS (SELECT key, event_id, rn, us, us AS start, 1 AS hit FROM e WHERE rn = 1 UNION ALL SELECT e.key, e.event_id, e.rn, e.us, CASE WHEN e.us - f.start >= 86400000000 THEN e.us ELSE f.start END, CASE WHEN e.us - f.start >= 86400000000 THEN 1 ELSE f.hit + 1 END FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1)"""


@query(f"""{_HITS} SELECT key, event_id, hit::BIGINT AS hit, hit <= 3 AS allowed, CASE WHEN hit <= 3 THEN 0 ELSE greatest(1, floor(86400 - (us - start) / 1e6)::BIGINT) END::BIGINT AS retry_after FROM f""")
def rate_limit_first_hit_window(w: World) -> DataFrame:
    return limits.first_hit_windows(w.table("events"), 86400, 3)


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_window_counts(w: World) -> DataFrame:
    return limits.tumbling_counts(w.table("events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("""WITH m AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM m)
SELECT user_id, min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP AS last, count(*) AS events FROM s GROUP BY user_id, n""")
def session_windows(w: World) -> DataFrame:
    return limits.sessions(w.table("events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("last", F.col("last").cast("timestamp_ntz"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_anchor_types(w: World) -> DataFrame:
    return w.table("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("bigint").alias("quantity"))


from conceptloom.plans import state_queries  # noqa: E402, F401  registers more queries
