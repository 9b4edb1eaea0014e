import io
import zipfile

import pytest
from pyspark.sql import functions as F

from conceptloom.operators import graph, ingest, mappings
from conceptloom.sources import archives

OWN, OBO, RDFS, OWL = "http://own#", "http://purl.obolibrary.org/obo/", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"


def triples(spark, rows):
    return spark.createDataFrame([("g", *r) for r in rows], "g string, s string, p string, o string, o_kind string")


def planes(spark):
    ncit = [(f"{OWN}C1", f"{RDFS}subClassOf", "_:a", "bnode"), ("_:a", f"{OWL}onProperty", f"{OWN}R101", "iri"), ("_:a", f"{OWL}someValuesFrom", f"{OWN}C12", "iri")]
    ncit += [(f"{OWN}C1", f"{RDFS}subClassOf", "_:b", "bnode"), ("_:b", f"{OWL}onProperty", f"{OWN}R900", "iri"), ("_:b", f"{OWL}someValuesFrom", f"{OWN}C13", "iri")]
    ncit += [(f"{OWN}C12", f"{RDFS}label", "Liver", "literal"), (f"{OWN}C12", f"{RDFS}subClassOf", f"{OWN}C20", "iri"), (f"{OWN}C20", f"{OWL}disjointWith", f"{OWN}C30", "iri"), (f"{OWN}C20", f"{OWL}disjointWith", "_:z", "bnode")]
    upstream = [(f"{OBO}UBERON_7", f"{RDFS}label", "liver", "literal"), (f"{OBO}UBERON_7", ingest.XREF_PREDICATE, "NCIT:C12", "literal"), (f"{OBO}UBERON_8", ingest.XREF_PREDICATE, "NCI:C12", "literal"), (f"{OBO}UBERON_7", f"{RDFS}subClassOf", f"{OBO}UBERON_1", "iri"), ("http://else#X", f"{RDFS}label", "liver", "literal")]
    return triples(spark, ncit), triples(spark, upstream)


def test_candidates_from_triples(spark, rows):
    ncit, upstream = planes(spark)
    records, report = ingest.generate(ncit, upstream, "r", "1", "2")
    assert rows(records, "subject_id", "object_id", "mapping_justification", "predicate_id", "lifecycle_state") == [("C12", "UBERON:7", mappings.COMPOSITE, mappings.CLOSE, "proposed")]
    assert report.first()["fillers"] == 1
    assert rows(ingest.disjoint(ncit, False)) == [("C20", "C30")]
    empty = triples(spark, [])
    assert ingest.generate(empty, empty, "r", "1", "2")[0].count() == 0


def test_promotion_end_to_end_and_refutation_through_anchors(spark, rows):
    ncit, upstream = planes(spark)
    records, _ = ingest.generate(ncit, upstream, "r", "1", "2")
    runs = spark.createDataFrame([("r", "uberon"), ("r0", "uberon")], "id string, source string")
    none = spark.createDataFrame([], "subject_id string, object_id string")
    judged = ingest.judge(ingest.context(records, runs, "uberon", ncit, upstream), none).withColumn("stale", F.lit(False))
    run, done = ingest.persisted(mappings.promote(judged), "r9", "uberon", "3", "4")
    assert rows(done, "run_id", "subject_source_version", "object_source_version", "predicate_id", "lifecycle_state") == [("r9", "3", "4", mappings.EXACT, "validated")]
    assert rows(run, "status", "candidates", "promoted", "errors") == [("completed", 1, 1, 0)]
    # UBERON:1 is held to be C30, which C12's parent excludes
    anchor = spark.createDataFrame([("r0", "C30", mappings.EXACT, "UBERON:1", "semapv:LexicalMatching", 1.0, "1", "2", "validated", "", "")], records.schema)
    judged = ingest.judge(ingest.context(records.unionByName(anchor), runs, "uberon", ncit, upstream), none).withColumn("stale", F.lit(False))
    assert rows(mappings.promote(judged), "outcome") == [("refuted",)]


def test_faults_of_records_and_evidence(spark, rows):
    good = ("C1", "UBERON:1", "skos:closeMatch", "semapv:LexicalMatching", 0.5, "1", "2", "proposed")
    names = "subject_id string, object_id string, predicate_id string, mapping_justification string, confidence double, subject_source_version string, object_source_version string, lifecycle_state string"
    bad = [("", *good[1:]), (good[0], None, *good[2:]), (*good[:2], "owl:sameAs", *good[3:]), (*good[:4], 1.2, *good[5:]), (*good[:4], None, *good[5:]), (*good[:7], "done")]
    found = ingest.faults(spark.createDataFrame([good, *bad], names))
    assert sorted(r["fault"] for r in found.collect()) == ["confidence", "confidence", "lifecycle_state", "object_id is empty", "predicate_id", "subject_id is empty"]
    evidence = spark.createDataFrame([("sme_curation", "panel", ""), ("hearsay", "x", ""), ("xref_assertion", "", ""), ("xref_assertion", "skos:exactMatch", ""), ("xref_assertion", "x", "http://www.w3.org/2004/02/skos/core#broadMatch"), ("xref_assertion", "x", "skos:prefLabel")], "kind string, source string, detail string")
    assert sorted(r["fault"] for r in ingest.inadmissible(evidence).collect()) == ["kind", "mapping as evidence", "mapping as evidence", "source"]


def test_baseline_is_replaced(spark, tmp_path):
    report = lambda x: spark.range(1).select(F.lit(x).alias("coverage"), F.lit(3).alias("elements"))
    for x in (0.5, 0.25):
        ingest.save_baseline(report(x), f"{tmp_path}/b")
    assert ingest.load_baseline(spark, f"{tmp_path}/b") == {"coverage": 0.25, "elements": 3}
    assert mappings.regressed(0.2, 0.25) and not mappings.regressed(0.24, 0.25)


def test_seeded_walks(spark, rows):
    isa = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("c", "d")], "child string, parent string")
    seeds = spark.createDataFrame([("b",), ("x",)], "code string")
    assert rows(graph.closure(isa, sources=seeds)) == [("b", "c"), ("b", "d"), ("x", "y")]
    assert rows(graph.induced(isa, seeds.where("code = 'b'"))) == [("b", "c"), ("c", "d")]
    rel = spark.createDataFrame([("c", "W"), ("W", "V"), ("q", "Z")], "subject string, filler string")
    assert rows(graph.part_of_pairs(isa, rel, parts=spark.createDataFrame([("a",)], "code string"))) == [("a", "V"), ("a", "W")]
    assert rows(graph.ancestor_path_edges(isa, rel, seeds)) == [("c", "W")]
    sites = spark.createDataFrame([("k", "a"), ("k", "W"), ("k", "q"), ("j", "W")], "concept string, filler string")
    assert rows(graph.site_leaves(sites, isa, rel)) == [("j", "W"), ("k", "a"), ("k", "q")]
    # a long chain that no seed needs does not raise
    chain = isa.unionByName(spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], isa.schema))
    assert rows(graph.part_of_pairs(chain, rel.where("subject = 'c'"), 4)) == [("a", "W"), ("b", "W"), ("c", "W")]


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text, mode in members:
            info = zipfile.ZipInfo(name)
            info.external_attr = mode << 16
            z.writestr(info, text)
    return out.getvalue()


def test_the_one_member_of_an_archive(spark, tmp_path):
    (tmp_path / "ok.zip").write_bytes(packed([("T.owl", "a\r\nb\n" * 3000, 0o100644), ("note.txt", "x", 0o100644)]))
    found = archives.member_lines(spark, f"{tmp_path}/ok.zip", "T.owl")
    assert found.count() == 6000 and found.where("line_no = 5999").first()["value"] == "b"
    for members in ([("T.owl", "a", 0o120777)], [("U.owl", "a", 0o100644)], [("T.owl", "a", 0o100644), ("V.OWL", "a", 0o100644)], []):
        with zipfile.ZipFile(io.BytesIO(packed(members))) as z, pytest.raises(archives.ArchiveFault):
            archives.only_member(z, "T.owl")
    with zipfile.ZipFile(io.BytesIO(packed([("../T.owl", "a", 0o100644)]))) as z, pytest.raises(archives.ArchiveFault):
        archives.only_member(z, "../T.owl")
