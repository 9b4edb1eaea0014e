from pathlib import Path

import pytest

from conceptloom.operators import graph
from conceptloom.plans.projection import World
from conceptloom.plans.queries import QUERIES


def edges(spark, pairs, a="child", b="parent"):
    return spark.createDataFrame(pairs, f"{a} string, {b} string")


def test_closure_with_cycle_diamond_and_duplicates(spark, rows):
    e = edges(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "b"), ("a", "d"), ("d", "c")])
    assert rows(graph.closure(e)) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("c", "b"), ("d", "b"), ("d", "c")]
    assert rows(graph.closure(edges(spark, []))) == []


def test_bounded_closure_raises_or_stops(spark, rows):
    e = edges(spark, [(str(i), str(i + 1)) for i in range(4)])
    with pytest.raises(graph.BoundExceeded):
        graph.closure(e, max_hops=3, strict=True)
    assert ("0", "4") not in rows(graph.closure(e, max_hops=3))
    assert ("0", "4") in rows(graph.closure(e, max_hops=4, strict=True))


def test_part_of_inherits_and_never_is_reflexive(spark, rows):
    isa = edges(spark, [("C32291", "C99100"), ("C99203", "C99204")])
    rel = edges(spark, [("C99100", "C12510"), ("C99204", "C99205"), ("C20003", "C99206"), ("C99206", "C99207"), ("C99210", "C99211"), ("C99211", "C99210"), ("C99103", "C99104"), ("C99103", "C99104")], "subject", "filler")
    found = rows(graph.part_of_pairs(isa, rel))
    assert found == sorted([("C32291", "C12510"), ("C99100", "C12510"), ("C99203", "C99205"), ("C99204", "C99205"), ("C20003", "C99206"), ("C20003", "C99207"), ("C99206", "C99207"), ("C99210", "C99211"), ("C99211", "C99210"), ("C99103", "C99104")])
    assert rows(graph.part_of_pairs(isa, rel.orderBy("filler", ascending=False))) == found


def test_leaves_keep_cycles_and_unrelated(spark, rows):
    fillers = spark.createDataFrame([("x", f) for f in ("a", "b", "c", "p", "q")], "concept string, filler string")
    anc = edges(spark, [("a", "b"), ("p", "q"), ("q", "p")])
    assert rows(graph.leaves(fillers, anc, ["concept"]), "filler") == [("a",), ("c",), ("p",), ("q",)]


def test_genus_walk_takes_core_roles_below_the_first_level(spark, rows):
    members = spark.createDataFrame(
        [("A", 0, "B", None, None), ("A", 1, None, "R1", "x"), ("B", 0, "C", None, None), ("B", 1, None, "R101", "y"), ("B", 2, None, "R1", "z"), ("C", 1, None, "R101", "y"), ("C", 2, None, "R88", "w"), ("C", 0, "A", None, None)],
        "concept string, hop int, genus string, role string, filler string",
    )
    roots = spark.createDataFrame([("A",)], "code string")
    assert rows(graph.genus_walk(members, roots)) == [("A", "R1", "x", 0, None), ("A", "R101", "y", 1, "B"), ("A", "R88", "w", 2, "C")]


def test_morphology_skips_stages_and_loops(spark, rows):
    genus = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("m", "n"), ("n", "o")], "concept string, genus string")
    labels = spark.createDataFrame([("b", "Carcinoma by AJCC v8 Stage"), ("c", "Carcinoma"), ("o", "Neoplasm")], "code string, label string")
    assert dict(rows(graph.resolve_morphology(genus, labels)))["a"] == "c"
    assert dict(rows(graph.resolve_morphology(genus, labels)))["x"] is None
    assert dict(rows(graph.resolve_morphology(genus, labels)))["m"] == "o"


def test_neighborhood_grows_with_depth_and_is_capped(spark, rows):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("d", "a", "r")], "src string, dst string, rel string")
    center = spark.createDataFrame([("a",)], "code string")
    near, _ = graph.neighborhood(e, center, 1)
    assert rows(near, "code") == [("a",), ("b",), ("d",)]
    far, inside = graph.neighborhood(e, center, 2)
    assert rows(far, "code") == [("a",), ("b",), ("c",), ("d",)] and inside.count() == 3
    some, inside = graph.neighborhood(e, center, 2, cap=2)
    assert rows(some, "code", "truncated") == [("a", True), ("b", True)] and rows(inside, "src", "dst") == [("a", "b")]


def test_merge_degree_betweenness_communities(spark, rows):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "c", "r")], "src string, dst string, rel string")
    assert rows(graph.degrees(e)) == [("a", 1), ("b", 2), ("c", 1)]
    merged = graph.merge_edges(e.selectExpr("*", "'old' AS label"), e.limit(1).selectExpr("*", "'new' AS label"))
    assert merged.count() == 3 and merged.where("label = 'new'").count() == 1
    from pyspark.sql import functions as F

    b = dict(rows(graph.betweenness(e.withColumn("center", F.lit("g"))), "code", "betweenness"))
    assert b == {"a": 0.0, "b": 0.5, "c": 0.0}
    assert {r[1] for r in rows(graph.communities(e))} <= {"a", "b", "c"}


def test_communities_of_star_tree_and_cliques(spark):
    def found(pairs):
        return {r["code"]: r["community"] for r in graph.communities(spark.createDataFrame(pairs, "src string, dst string")).collect()}

    assert set(found([(f"leaf{i}", "hub") for i in range(9)]).values()) == {"hub"}
    tree = found([(f"{h}{i}", h) for h in "xyz" for i in range(6)] + [(h, "root") for h in "xyz"])
    assert all(tree[f"{h}{i}"] == tree[h] for h in "xyz" for i in range(6)) and len({tree[h] for h in "xyz"}) == 3
    cliques = found([(f"{c}{i}", f"{c}{j}") for c in "pq" for i in range(5) for j in range(i)] + [("p0", "q0")])
    assert cliques == {f"{c}{i}": f"{c}0" for c in "pq" for i in range(5)}
    assert found([("a", "a")]) == {}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="the test tables are not here")
def test_registered_queries_take_the_whole_isa_table(spark):
    isa = {tuple(r) for r in World(spark, "/root/testdata/sf0.001").isa.select("child", "parent").collect()}
    found = {r["code"]: r["community"] for r in QUERIES["communities"](spark, "/root/testdata/sf0.001").collect()}
    assert set(found) == {x for e in isa for x in e} and sum(found[a] == found[b] for a, b in isa) > 0.8 * len(isa)
    near = {r: {r} for _, r in isa if r.startswith("R")}
    for codes in near.values():
        for _ in range(2):
            codes |= {a for a, b in isa if b in codes} | {b for a, b in isa if a in codes}
    between = QUERIES["betweenness"](spark, "/root/testdata/sf0.001").collect()
    assert max(map(len, near.values())) <= 400
    assert {(r["center"], r["code"]) for r in between} == {(c, x) for c, xs in near.items() for x in xs}


def test_unsatisfiable_and_corroboration(spark, rows):
    sub = edges(spark, [("x", "a"), ("x", "b2"), ("y", "a")])
    eq = spark.createDataFrame([("b", "b2")], "a string, b string")
    dis = spark.createDataFrame([("a", "b")], "a string, b string")
    assert rows(graph.unsatisfiable(sub, eq, dis)) == [("x",)]
    pairs = spark.createDataFrame([("s", "o1"), ("s", "o2"), ("t", "o1")], "subject string, object string")
    up = edges(spark, [("s", "p")])
    there = edges(spark, [("o1", "im")])
    anchors = spark.createDataFrame([("p", "im")], "code string, curie string")
    assert rows(graph.corroboration(pairs, up, there, anchors)) == [("s", "o1", "CORROBORATED"), ("s", "o2", "NOT_ENTAILED"), ("t", "o1", "NO_ANCHORED_ANCESTOR")]


def test_rounds_of_communities_carry_no_checkpoints(spark, monkeypatch):
    def refused(df):
        raise AssertionError("a checkpoint carries the constraints of all rounds before it")

    monkeypatch.setattr(graph, "cut", refused)
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "pq" for i in range(4) for j in range(i)] + [("p0", "q0")]
    found = {r["code"]: r["community"] for r in graph.communities(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert found == {f"{c}{i}": f"{c}0" for c in "pq" for i in range(4)}
