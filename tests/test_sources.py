import json
import zipfile

import pytest

from conceptloom.sources import documents, rdf, registry, remote

NT = """# comment
<http://x#C1> <http://www.w3.org/2000/01/rdf-schema#label> "Lung \\"left\\""@en .
<http://x#C1> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://x#C2> .
<http://x#C1> <http://www.w3.org/2000/01/rdf-schema#subClassOf> _:b1 .
_:b1 <http://www.w3.org/2002/07/owl#onProperty> <http://x#R101> .
_:b1 <http://www.w3.org/2002/07/owl#someValuesFrom> <http://x#C3> .
<http://x#C2> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://www.w3.org/2002/07/owl#Thing> .
<http://x#C2> <http://x#n> "5"^^<http://www.w3.org/2001/XMLSchema#int> <http://g> .
"""


def test_triples(spark, rows, tmp_path):
    (tmp_path / "a.nt").write_text(NT)
    t = rdf.read_ntriples(spark, str(tmp_path / "a.nt"))
    assert t.count() == 7
    assert rows(t.where("o_kind = 'literal'"), "g", "o", "o_lang", "o_dtype") == [("default", 'Lung "left"', "en", None), ("http://g", "5", None, "http://www.w3.org/2001/XMLSchema#int")]
    assert rows(rdf.isa(t)) == [("C1", "C2")]
    assert rows(rdf.restrictions(t)) == [("C1", "R101", "C3")]
    rdf.write_triples(t, str(tmp_path / "out"))
    rdf.write_triples(t.where("g = 'http://g'"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    (tmp_path / "b.nt").write_text("<a> b .\n")
    assert rdf.read_ntriples(spark, str(tmp_path / "b.nt"), strict=False).count() == 0
    with pytest.raises(Exception, match="malformed triple"):
        rdf.read_ntriples(spark, str(tmp_path / "b.nt")).collect()


def test_lists_headers_and_lines(spark, rows, tmp_path):
    r = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    t = spark.createDataFrame([("l1", f"{r}first", "a"), ("l1", f"{r}rest", "l2"), ("l2", f"{r}first", "b"), ("l2", f"{r}rest", f"{r}nil")], "s string, p string, o string")
    assert rows(rdf.list_members(t, spark.createDataFrame([("l1",)], "list string"))) == [("l1", 0, "a"), ("l1", 1, "b")]
    (tmp_path / "o.xml").write_text('<rdf:RDF xmlns:rdf="r" xmlns:owl="o"><owl:Ontology rdf:about="http://o"><owl:versionInfo>26.02d</owl:versionInfo></owl:Ontology></rdf:RDF>')
    assert rows(rdf.ontology_headers(spark, str(tmp_path / "o.xml"))) == [("http://o", "26.02d", None)]
    m = spark.createDataFrame([("N:C1", "skos:exactMatch", "U:1")], "subject_id string, predicate_id string, object_id string")
    assert rows(rdf.mapping_lines(m, {"N": "http://n#", "U": "http://u/", "skos": "http://s#"})) == [("<http://n#C1> <http://s#exactMatch> <http://u/1> .",)]
    with pytest.raises(Exception, match="unknown prefix"):
        rdf.mapping_lines(m, {"N": "http://n#"}).collect()


XML = """<DataElementsList><DataElement num="1"><PUBLICID>100</PUBLICID><VERSION>2.0</VERSION><PREFERREDNAME>NEO</PREFERREDNAME><LONGNAME>Neoplasm</LONGNAME><PREFERREDDEFINITION>d</PREFERREDDEFINITION><CONTEXTNAME>c</CONTEXTNAME>
<DATAELEMENTCONCEPT><LongName>dec</LongName><ObjectClass><ConceptDetails><ConceptDetails_ITEM><PREFERRED_NAME>C3262</PREFERRED_NAME><LONG_NAME>Neoplasm</LONG_NAME><PRIMARY_FLAG_IND>Yes</PRIMARY_FLAG_IND></ConceptDetails_ITEM></ConceptDetails></ObjectClass>
<Property><ConceptDetails><ConceptDetails_ITEM><PREFERRED_NAME>C3262</PREFERRED_NAME><LONG_NAME>again</LONG_NAME><PRIMARY_FLAG_IND>No</PRIMARY_FLAG_IND></ConceptDetails_ITEM></ConceptDetails></Property></DATAELEMENTCONCEPT>
<VALUEDOMAIN><LongName>vd</LongName><Datatype>CHARACTER</Datatype><PermissibleValues><PermissibleValues_ITEM><VALIDVALUE>Yes</VALIDVALUE><VALUEMEANING>Affirmative</VALUEMEANING><MEANINGCONCEPTS>C49488::Y, C2916</MEANINGCONCEPTS></PermissibleValues_ITEM></PermissibleValues></VALUEDOMAIN></DataElement></DataElementsList>"""


def test_registry_xml_and_archive(spark, rows, tmp_path):
    (tmp_path / "e.xml").write_text(XML)
    raw = registry.read_elements(spark, str(tmp_path / "e.xml"))
    assert rows(registry.links(raw), "concept_code", "concept_type", "is_primary") == [("C2916", "permissible_value", 0), ("C3262", "object_class", 1), ("C49488", "permissible_value", 0)]
    e = registry.elements_of(raw).first()
    assert (e["public_id"], e["version"], e["datatype"]) == ("100", "2.0", "CHARACTER") and "Neoplasm" in e["search_text"]
    assert json.loads(e["cde_json"])["permissible_values"] == [{"value": "Yes", "meaning": "Affirmative", "meaning_code": "C49488"}]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("CDE_20260101120000_1.xml", XML)
    assert rows(registry.archive_members(spark, str(tmp_path / "a.zip")), "seq", "name") == [(1, "CDE_20260101120000_1.xml")]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.xml", "x")
    with pytest.raises(Exception, match="unexpected member"):
        registry.archive_members(spark, str(tmp_path / "b.zip")).collect()


def test_documents(spark, rows, tmp_path):
    study = {"protocolSection": {"identificationModule": {"nctId": "NCT01234567", "briefTitle": "T"}, "designModule": {"phases": ["PHASE1", "PHASE2"], "enrollmentInfo": {"count": 7}}, "conditionsModule": None, "sponsorCollaboratorsModule": {"leadSponsor": {"name": "L"}, "collaborators": [{"name": "K"}]}, "referencesModule": {"references": [{"pmid": "1"}, {"citation": "c"}]}}}
    t = documents.trials(spark.createDataFrame([(json.dumps(study),), ("{}",)], "json string")).collect()
    assert (t[0]["nct_id"], t[0]["phase"], t[0]["enrollment"], t[0]["conditions"], t[0]["sponsors"], len(t[0]["references"])) == ("NCT01234567", "PHASE1/PHASE2", 7, [], ["L", "K"], 1)
    assert t[1]["nct_id"] is None and t[1]["locations"] == []
    xml = "<PubmedArticle><MedlineCitation><PMID>9</PMID><Article><ArticleTitle>A <i>b</i> c</ArticleTitle><AuthorList><Author><LastName>Z</LastName></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList></Article><MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN='N'>H</DescriptorName><QualifierName MajorTopicYN='Y'>q</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>"
    a = documents.articles(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (a["pmid"], a["title"], a["authors"], a["major_mesh"], a["abstract"]) == ("9", "A b c", ["Z"], ["H"], None)
    summary = json.dumps({"result": {"uids": ["2", "1"], "1": {"uid": "1", "title": "one", "articleids": [{"idtype": "doi", "value": "10.1/x"}]}, "2": {"uid": "2", "title": "two", "articleids": []}}})
    assert rows(documents.article_summaries(spark.createDataFrame([(summary,)], "json string")), "pos", "pmid", "title", "doi") == [(0, "2", "two", None), (1, "1", "one", "10.1/x")]
    links = json.dumps({"linksets": [{"ids": ["1"], "linksetdbs": [{"linkname": "pubmed_pubmed", "links": ["1", "5", "6"]}]}]})
    assert rows(documents.linked_articles(spark.createDataFrame([(links,)], "json string"), limit=1), "pmid", "linked") == [("1", "5")]
    (tmp_path / "m.json").write_text(json.dumps({"_meta": {"status": "seed"}, "mappings": [{"subject_id": "a", "predicate_id": "skos:exactMatch", "object_id": "b"}]}))
    assert documents.mappings(spark, str(tmp_path / "m.json")).count() == 1
    with pytest.raises(Exception, match="not signed"):
        documents.mappings(spark, str(tmp_path / "m.json"), signed=True).collect()
    hits = spark.createDataFrame([("q", 0), ("q", 1), ("q", 2), ("q", 3)], "query string, position int")
    assert rows(documents.position_relevance(hits, "query", "position"), "relevance") == [(0.25,), (0.5,), (0.75,), (1.0,)]


def test_remote_helpers(tmp_path):
    assert remote.delays(4, 1, 2, 3) == [1, 2, 3]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "ok"

    assert remote.retried(flaky, sleep=lambda s: None) == "ok"
    waits = []
    t = remote.Throttle(1.0, now=lambda: 0.0, sleep=waits.append)
    for _ in range(3):
        t.wait()
    assert waits == [1.0, 2.0]
    target = tmp_path / "f.bin"
    assert remote.cached(lambda tag: (b"x", "t1"), target).read_bytes() == b"x"
    assert remote.cached(lambda tag: (None, tag), target).read_bytes() == b"x"
