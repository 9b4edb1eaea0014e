from conceptloom.operators import concepts, elements, mappings as M


def pairs(spark, items):
    return spark.createDataFrame(items, "subject_id string, object_id string, via_xref boolean, via_label boolean, mapping_justification string")


def test_candidates_and_report(spark, rows):
    a = spark.createDataFrame([("C1", "Lung"), ("C2", "Straße"), ("C3", "x"), ("C9", "lung")], "code string, label string")
    b = spark.createDataFrame([("U:1", "LUNG"), ("U:2", "STRASSE")], "code string, label string")
    x = spark.createDataFrame([("C1", "U:1"), ("C3", "U:7")], "code string, curie string")
    f = spark.createDataFrame([("C1",), ("C2",), ("C3",), ("C4",)], "code string")
    out = M.candidates(a, b, x, f)
    assert rows(out, "subject_id", "object_id", "confidence") == [("C1", "U:1", 0.95), ("C2", "U:2", 0.5), ("C3", "U:7", 0.9)]
    assert tuple(M.candidate_report(out, f).first()) == (4, 2, 1, 0.75)


def test_evidence_and_promotion(spark, rows):
    p = pairs(spark, [("a", "1", True, True, M.COMPOSITE), ("b", "2", False, True, M.LEXICAL), ("c", "3", True, False, M.XREF), ("d", "4", True, False, "unknown"), ("e", "5", False, True, M.LEXICAL), ("e", "6", True, True, M.COMPOSITE), ("f", "7", True, True, M.COMPOSITE), ("g", "7", True, True, M.COMPOSITE)])
    key = lambda x: spark.createDataFrame(x, "subject_id string, object_id string")
    e = M.evidence(p, key([("b", "2"), ("e", "5")]), key([("a", "1")]))
    found = {(r["subject_id"], r["object_id"]): r for r in e.collect()}
    assert found["a", "1"]["evidence"] == ["label_agreement", "structural_corroboration", "xref_assertion"]
    assert found["b", "2"]["independent"] and not found["c", "3"]["independent"] and found["d", "4"]["evidence"] is None
    judged = e.selectExpr("*", "CASE WHEN subject_id = 'zz' THEN NULL ELSE true END AS el_valid", "false AS stale")
    out = dict(((r["subject_id"], r["object_id"]), r["outcome"]) for r in M.promote(judged).collect())
    assert out["a", "1"] == "promoted_with_structural_corroboration" and out["b", "2"] == "promoted_on_curation_alone"
    assert out["c", "3"] == "insufficient_evidence" and out["d", "4"] == "reasoner_error"
    assert out["e", "5"] == "promoted_on_curation_alone" and out["e", "6"] == "contested"
    assert out["f", "7"] == out["g", "7"] == "contested"
    refuted = e.selectExpr("*", "CAST(NULL AS boolean) AS el_valid", "false AS stale")
    assert {r["outcome"] for r in M.promote(refuted).collect()} == {"reasoner_error"}
    taken = M.promote(judged, key([("a", "9"), ("b", "2")]))
    out = dict(((r["subject_id"], r["object_id"]), r["outcome"]) for r in taken.collect())
    assert out["a", "1"] == "endpoint_taken" and out["b", "2"] == "promoted_on_curation_alone"


def test_coverage_translation_and_scores(spark, rows):
    anchors = spark.createDataFrame([("1", "1", "a", "oc"), ("1", "1", "b", "oc"), ("2", "1", "a", "oc"), ("3", "1", "z", "p")], "public_id string, version string, concept_code string, concept_type string")
    live = spark.createDataFrame([("a",), ("b",)], "code string")
    rec = spark.createDataFrame([("a", "U:1", M.EXACT, "validated", 0.9), ("a", "U:1", M.EXACT, "quarantined", 0.9), ("b", "U:2", M.CLOSE, "proposed", 0.5), ("c", "SNOMED:1", M.EXACT, "active", 1.0)], "subject_id string, object_id string, predicate_id string, lifecycle_state string, confidence double")
    r = M.coverage_report(anchors, live, M.strength(rec)).first()
    assert (r["elements"], r["covered"], r["post_coordinated"], r["identity_codes"], r["close_only_codes"], r["coverage"]) == (3, 1, 1, 1, 1, 0.3333)
    r = M.coverage_report(anchors, live, M.strength(rec), spark.createDataFrame([("a",)], "code string")).first()
    assert (r["elements"], r["covered"]) == (1, 1)
    assert M.regressed(0.5, 0.52) and not M.regressed(0.5, 0.505)
    codes = spark.createDataFrame([("a",), ("U:1",), ("c",), ("q",)], "code string")
    assert rows(M.translate(codes, rec)) == [("U:1", "a", "equivalent", 0.9), ("a", "U:1", "equivalent", 0.9), ("c", "c", "unmatched", 0.0), ("q", "q", "unmatched", 0.0)]
    assert ("c", "SNOMED:1", "equivalent", 1.0) in rows(M.translate(codes, rec, licensed=True))
    s = M.score(rec, rec.limit(0)).first()
    assert (s["precision"], s["recall"], s["f1"]) == (0.0, 0.0, 0.0)


def test_registry(spark, rows):
    e = spark.createDataFrame([("100", "2.0", "n", "d", "s"), ("100", "10.0", "n10", "d", "s"), ("99", "1.5b", "É", "x_y", "s")], "public_id string, version string, long_name string, definition string, short_name string")
    assert rows(elements.latest(e), "public_id", "version") == [("100", "10.0"), ("99", "1.5b")]
    assert [r[0] for r in e.orderBy(*elements.natural_order()).collect()] == ["99", "100", "100"]
    assert elements.like(e, "é").count() == 0 and elements.like(e, "N1").count() == 1
    links = spark.createDataFrame([("C1", "100", "2.0"), ("C1", "100", "2.0"), ("C1", "7", "1")], "concept_code string, public_id string, version string")
    assert rows(elements.for_concepts(e, links)) == [("C1", "100", "2.0", "n")]
    bad = e.selectExpr("public_id", "version", """CASE WHEN public_id = '99' THEN '{' ELSE concat('{"public_id":"', public_id, '","version":"', version, '","permissible_values":[]}') END AS cde_json""")
    found = dict(rows(elements.problems(bad, links.drop("concept_code"))))
    assert (found["invalid_json"], found["orphan_link"], found["duplicate_key"], found["bad_id"]) == (1, 1, 0, 0)
    one, two = elements.fingerprint(e, ["public_id"]).first(), elements.fingerprint(e.orderBy("version"), ["public_id"]).first()
    assert one == two and one["rows"] == 3
    members = spark.createDataFrame([("z", 1), ("z", 2), ("z", 4)], "archive string, seq int")
    assert rows(elements.contiguous(members), "seq") == [(4,)]


def test_reads(spark, rows):
    props = spark.createDataFrame([("a", "label", "L"), ("a", "P90", "s2"), ("a", "P90", "s1"), ("a", "P90", "s1"), ("a", "P90", ""), ("b", "P108", "B")], "code string, prop string, value string")
    assert rows(concepts.embedding_records(props)) == [("a", "L", None, None, "s1 | s2"), ("b", "B", None, None, "")]
    assert rows(concepts.embedding_records(props, after="a", limit=5), "code") == [("b",)]
    page = concepts.page(props, ["code", "prop", "value"], 2, 1)
    assert page.count() == 2 and page.first()["total"] == 6 and concepts.page(props, ["code"], 2, 99).count() == 0
    heads = spark.createDataFrame([("26.02d", "http://v"), ("26.02d", None)], "version_info string, version_iri string")
    assert concepts.joined_versions(heads).first()[0] == "26.02d + http://v"
    assert concepts.one_value(heads, "version_info") == "26.02d"


def test_pairs_with_several_common_names_and_keys_come_once(spark, rows):
    a = spark.createDataFrame([("C1", "Lung"), ("C1", "pulmo"), ("C1", "LUNG"), ("C2", "pulmo"), ("C3", None), ("C4", "z")], "code string, label string")
    b = spark.createDataFrame([("U:1", "lung"), ("U:1", "Pulmo"), ("U:2", "pulmo"), ("U:3", None)], "code string, label string")
    ours = spark.createDataFrame([("C1", "k"), ("C1", "l"), ("C4", "k"), ("C4", "l"), ("C3", None)], "code string, key string")
    theirs = spark.createDataFrame([("U:1", "k"), ("U:1", "l"), ("U:3", "l"), ("U:3", None)], "code string, key string")
    f = spark.createDataFrame([("C1",), ("C2",), ("C3",), ("C4",)], "code string")
    out = M.candidates(a, b, (ours, theirs), f)
    expected = [("C1", "U:1", True, True), ("C1", "U:2", False, True), ("C1", "U:3", True, False), ("C2", "U:1", False, True), ("C2", "U:2", False, True), ("C4", "U:1", True, False), ("C4", "U:3", True, False)]
    assert rows(out, "subject_id", "object_id", "via_xref", "via_label") == expected
    listed = spark.createDataFrame([("C1", "U:1"), ("C1", "U:1"), ("C1", "U:3"), ("C4", "U:1"), ("C4", "U:3"), ("C9", "U:1")], "code string, curie string")
    assert rows(M.candidates(a, b, listed, f), "subject_id", "object_id", "via_xref", "via_label") == expected


def _judged_parts(spark, tmp_path, queries):
    """The shuffled rows of a query over parts of which 2 x 300 share a name, brand, size and type, and its result."""
    from pyspark.sql import functions as F

    import __spark_entry__ as entry

    spark.range(600).select(F.col("id").alias("p_partkey"), F.lit("ring").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan that runs is the one that is asked for its counts
    try:
        df = entry.queries()[queries](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan()
        n = df._jdf.queryExecution().executedPlan().execute().count()
        shuffled, todo = 0, [plan]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if "Exchange" in node.nodeName() and "Reused" not in node.nodeName() and node.metrics().contains("shuffleRecordsWritten"):
                shuffled += node.metrics().apply("shuffleRecordsWritten").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return n, shuffled


def test_promotion_shuffles_ends_and_not_pairs(spark, tmp_path):
    n, shuffled = _judged_parts(spark, tmp_path, "promote_candidates")
    assert n == 300 * 300 and shuffled < 300 * 300 / 5


def test_report_shuffles_ends_and_not_pairs(spark, tmp_path):
    n, shuffled = _judged_parts(spark, tmp_path, "promotion_report")
    assert 0 < n < 9 and shuffled < 300 * 300 / 5
