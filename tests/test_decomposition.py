from pyspark.sql import functions as F

from conceptloom import model
from conceptloom.functions import text
from conceptloom.operators import decomposition as D


def routed(spark, items):
    return spark.createDataFrame(items, "concept string, axis string, filler string")


def ancestors(spark, pairs=()):
    return spark.createDataFrame(list(pairs), "child string, parent string")


def test_detection_counts_roles_morphology_and_label(spark, rows):
    concepts = spark.createDataFrame(
        [("C1", ["Neoplastic Process"], "Carcinoma", False), ("C2", ["Gene"], "Tumor with Edema", True), ("C3", None, None, None), ("C4", ["Zeta", "Disease or Syndrome"], "Neoplasm (x)", False)],
        "code string, semantic_types array<string>, label string, has_morphology boolean",
    )
    roles = spark.createDataFrame([("C1", "R101", None), ("C1", "R105", "Disease_Has"), ("C1", "R142", "Disease_Excludes_Finding"), ("C1", "R114", "x"), ("C4", "R101", "a")], "code string, role string, role_label string")
    found = {r["code"]: r for r in D.detect(concepts, roles).collect()}
    assert (found["C1"]["axes"], found["C1"]["is_precoordinated"]) == (2, True)
    assert (found["C2"]["axes"], found["C2"]["is_precoordinated"]) == (2, False)
    assert (found["C3"]["axes"], found["C3"]["in_scope"], found["C3"]["semantic_type"]) == (0, False, None)
    assert (found["C4"]["semantic_type"], found["C4"]["is_precoordinated"]) == ("Disease or Syndrome", True)


def test_routing(spark, rows):
    r = spark.createDataFrame([("R101", "C1", "C3010"), ("R101", "C1", "C9"), ("R101", "C1", None), ("R88", "C90530", None), ("R88", "C27970", None)], "role string, filler string, anchoring_genus string")
    assert [x[0] for x in r.select(D.routed_axis()).collect()] == ["lineage", "R101", "R101", "stage_system", "R88"]


def test_selection_keeps_leaves_and_flags_ties(spark, rows):
    out = D.select_constituents(routed(spark, [("a", "R105", "x"), ("a", "R105", "y"), ("b", "R105", "x"), ("b", "R105", "top"), ("c", "lineage", "x"), ("c", "lineage", "top")]), ancestors(spark, [("x", "top")]))
    assert rows(out) == [("a", "R105", "x", False, True, None), ("a", "R105", "y", False, True, None), ("b", "R105", "x", True, False, None), ("c", "lineage", "top", False, False, "lineage:c"), ("c", "lineage", "x", True, False, "lineage:c")]


def test_sites_split_into_organs_and_regions(spark, rows):
    types = spark.createDataFrame([("lung", model.ORGAN_TYPE), ("liver", model.ORGAN_TYPE), ("chest", "Body Location")], "code string, semantic_type string")
    items = [("a", "R101", "lung"), ("a", "R101", "chest"), ("b", "R101", "lung"), ("b", "R101", "liver")]
    out = rows(D.select_constituents(routed(spark, items), ancestors(spark), types), "concept", "axis", "filler", "needs_review")
    assert out == [("a", "R101", "lung", False), ("a", "region", "chest", False), ("b", "R101", "liver", True), ("b", "R101", "lung", True)]
    organs = spark.createDataFrame([("a", "lung"), ("b", "heart")], "concept string, organ string")
    out = rows(D.select_constituents(routed(spark, items), ancestors(spark), types, organs), "concept", "axis", "filler", "needs_review")
    assert out == [("a", "R101", "lung", False), ("b", "R101", "liver", True), ("b", "R101", "lung", True)]


def test_label_aspects_and_minting(spark, rows):
    labels = spark.createDataFrame([("1", "Left Kidney Tumor with Edema"), ("2", "Tumor without Necrosis and more AJCC v8"), ("3", None), ("4", "Lymphoma")], "code string, label string")
    known = spark.createDataFrame([("K9", "edema"), ("K1", " Edema ")], "code string, label string")
    out = rows(D.label_constituents(labels, known), "code", "axis", "surface", "polarity")
    assert out == [("1", "finding", "Edema", "positive"), ("1", "laterality", "Left", "positive"), ("2", "finding", "Necrosis and", "negative"), ("2", "staging_system", "AJCC v8", "positive")]
    fill = {(r[0], r[1]): r[4] for r in D.label_constituents(labels, known).collect()}
    assert fill["1", "finding"] == "K1" and fill["2", "finding"].startswith("MINT-")
    import hashlib

    got = spark.range(1).select(text.mint_id(F.lit("R1"), F.lit("  Without X "))).first()[0]
    assert got == "MINT-" + hashlib.sha1(b"R1|without x").hexdigest()[:12]


def test_scores_and_residual(spark):
    pairs = lambda x: spark.createDataFrame(x, "axis string, filler string")
    s = D.score(pairs([("a", "1"), ("a", "2"), ("b", "3")]), pairs([("a", "1"), ("b", "3"), ("c", "4")]), pairs([("b", "3")])).first()
    assert (s["tp"], s["fp"], s["fn"], s["deferred"], s["precision"], s["recall"]) == (1, 1, 1, 1, 0.5, 0.5)
    s = D.score(pairs([]), pairs([]), pairs([])).first()
    assert (s["precision"], s["recall"], s["f1"]) == (1.0, 1.0, 1.0)
    c = spark.createDataFrame([("a", "x"), ("b", "MINT-1")], "concept string, filler string")
    d = spark.createDataFrame([("x", True), ("MINT-1", True)], "code string, is_precoordinated boolean")
    assert tuple(D.residual(c, d).first()) == (2, 1, 0.5)
    assert tuple(D.residual(c.limit(0), d).first()) == (0, 0, 0.0)


def test_fold_takes_first_status_and_last_constituent(spark):
    r = spark.createDataFrame([("a", None, None, "x", "1", "true", 1), ("a", "done", "2024", "x", "1", "0", 2), ("a", "late", None, None, None, None, 3)], "concept string, status string, date string, axis string, filler string, most_specific string, ord int")
    out = D.fold(r).first()
    assert (out["status"], out["date"]) == ("done", "2024") and [tuple(c) for c in out["constituents"]] == [("x", "1", False)]


def test_text_helpers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(text.local_name(F.lit("http://x/a#b"))) == "b" and get(text.local_name(F.lit("http://x/a"))) == "a"
    assert not get(text.is_code(F.lit("C１２"))) and get(text.is_code(F.lit("C12")))
    assert get(text.version_number(F.lit("1.2abc"))) == 1.2 and get(text.version_number(F.lit("x"))) == 0.0
    assert text.prefix_terms('a* "b:c" ^-') == ["a", "b", "c"]
    assert get(text.embedding_text(F.lit("L"), F.lit("d" * 600), F.array(*[F.lit(str(i)) for i in range(9)]))) == "L | 0 | 1 | 2 | 3 | 4 | " + "d" * 500
    assert get(text.folded(F.lit("Straße"))) == get(text.folded(F.lit("STRASSE")))
