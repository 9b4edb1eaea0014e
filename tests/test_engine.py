import datetime as dt

import pytest

from conceptloom import api
from conceptloom.operators import search, similarity
from conceptloom.plans import lifecycle
from conceptloom.streaming import limits


def events(spark, items):
    base = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(i, base + dt.timedelta(seconds=s), u, "click", 1.0) for i, (u, s) in enumerate(items)], "event_id long, ts timestamp, user_id long, event_type string, value double")


HITS = [(1, 0), (1, 30), (1, 59), (1, 61), (2, 5), (1, 62), (1, 500)]


def test_first_hit_windows(spark, rows):
    out = rows(limits.first_hit_windows(events(spark, HITS), 60, 2), "event_id", "hit", "allowed", "retry_after")
    assert out == [(0, 1, True, 0), (1, 2, True, 0), (2, 3, False, 1), (3, 1, True, 0), (4, 1, True, 0), (5, 2, True, 0), (6, 1, True, 0)]
    assert all(r[3] for r in rows(limits.first_hit_windows(events(spark, HITS), 60, 0)))


def test_first_hit_stream(spark, rows, tmp_path):
    frame = events(spark, HITS)
    for part in ("event_id < 3", "event_id >= 3"):
        frame.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = limits.first_hit_stream(stream, 60, 2).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = rows(spark.table("hits"), "event_id", "allowed")
    assert len(got) == len(HITS)


def test_windows_and_sessions(spark, rows):
    e = events(spark, HITS)
    assert rows(limits.sessions(e, "1 minute"), "user_id", "events") == [(1, 1), (1, 5), (2, 1)]
    assert sum(r[0] for r in rows(limits.tumbling_counts(e, "1 minute"), "events")) == 7
    m = spark.createDataFrame([("u", "v1"), ("u", "v2"), ("x", "v1")], "source string, object_source_version string")
    r = spark.createDataFrame([("u", "v2")], "source string, version string")
    assert rows(limits.stale_on_release(m, r), "source", "object_source_version", "is_stale") == [("u", "v1", True), ("u", "v2", False), ("x", "v1", False)]


def test_search(spark, rows):
    d = spark.createDataFrame([(1, "Lung cancer", "tumor"), (2, "Cancer of the lungs", "cancers cancer cancer"), (3, "Liver", "lung")], "id int, label string, synonyms string")
    lists = search.postings(d, "id", {"label": search.WEIGHT_A, "synonyms": search.WEIGHT_B})
    q = spark.createDataFrame([(1, ["canc", "lu"]), (2, ["zz"]), (3, [])], "query_id int, terms array<string>")
    assert rows(search.prefix_and(lists, "id", q)) == [(1, 1), (1, 2)]
    ranked = search.ranked(lists, "id", spark.createDataFrame([(1, ["the", "lung", "cancers"])], "query_id int, terms array<string>")).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == [1, 2]


def test_similarity_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 2)
    v = spark.createDataFrame([(i, [float(i % 3 == k) + 0.01 * i * k for k in range(3)]) for i in range(9)], "vec_id long, embedding array<float>")
    import numpy as np

    m = {r[0]: np.array(r[1], dtype=float) for r in v.collect()}
    out = similarity.top_k(v, v.where("vec_id < 5"), 3).collect()
    for q in range(5):
        want = sorted(((-float(m[q] @ m[j] / np.linalg.norm(m[q]) / np.linalg.norm(m[j])), j) for j in m if j != q))[:3]
        got = sorted((-r["score"], r["vec_id"]) for r in out if r["query_id"] == q)
        assert [j for _, j in got] == [j for _, j in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want])
    bad = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [1.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    assert rows(similarity.valid(bad, "embedding", 2), "vec_id") == [(4,)]


def test_lifecycle(spark, rows, tmp_path):
    assert lifecycle.advance("running", "complete") == "complete"
    with pytest.raises(lifecycle.IllegalTransition):
        lifecycle.advance("complete", "running")
    codes = spark.createDataFrame([("b",), ("a",), ("a",)], "code string")
    assert [r["concept_code"] for r in lifecycle.worklist(codes, "r").orderBy("ordinal").collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="repeats"):
        lifecycle.worklist(codes, "r", strict=True)
    a = spark.createDataFrame([("1", "x")], "id string, v string")
    b = spark.createDataFrame([("1", "y"), ("2", "z")], "id string, v string")
    assert rows(lifecycle.merged(a, b, ["id"])) == [("1", "y"), ("2", "z")] and rows(lifecycle.inserted(a, b, ["id"])) == [("1", "x"), ("2", "z")]
    docs = spark.createDataFrame([("1", "x"), ("2", "y")], "doc_id string, v string")
    path = str(tmp_path / "pub")
    lifecycle.publish(docs.limit(1), path)
    lifecycle.publish(docs, path, expected=2, required=docs)
    assert lifecycle.active(spark, path).count() == 2
    with pytest.raises(ValueError, match="missing"):
        lifecycle.publish(docs.limit(1), path, required=docs)
    assert lifecycle.active(spark, path).count() == 2
    items = spark.createDataFrame([("r", "complete", True, False, 2), ("r", "failed", None, None, None)], "run_id string, state string, is_decomposed boolean, is_residual boolean, constituent_count int")
    assert tuple(lifecycle.outcomes(items).first()) == ("r", 2, 1, 1, 1, 0, 2, 0.5, 0.0)


def test_api(spark, rows):
    t = lambda data, schema: spark.createDataFrame(data, schema)
    engine = api.Engine(
        {
            "props": t([("C1", "label", "Lung"), ("C1", "P90", "pulmo"), ("C2", "label", "Lung cancer")], "code string, prop string, value string"),
            "labels": t([("C1", "Lung"), ("C2", "Lung cancer")], "code string, label string"),
            "isa": t([("C2", "C1")], "child string, parent string"),
            "restrictions": t([("C2", "R101", "C1")], "subject string, role string, filler string"),
            "associations": t([], "subject string, rel string, target string"),
            "elements": t([("100", "1.0", "LNG", "Lung name", "def")], "public_id string, version string, short_name string, long_name string, definition string"),
            "links": t([("C1", "100", "1.0", 1)], "concept_code string, public_id string, version string, is_primary int"),
            "records": t([("C1", "skos:exactMatch", "U:1", "validated", 0.9)], "subject_id string, predicate_id string, object_id string, lifecycle_state string, confidence double"),
            "constituents": t([("C2", "R101", "C1")], "concept string, axis string, filler string"),
            "concept_vectors": t([("C1", [1.0, 0.0]), ("C2", [1.0, 1.0])], "doc_id string, embedding array<float>"),
        }
    )
    assert [r["code"] for r in engine.search_concepts("lung").collect()] == ["C1", "C2"]
    assert engine.list_concepts(1, 1).first()["code"] == "C2" and engine.concept_detail("C1").first()["synonyms"] == ["pulmo"]
    assert engine.related_concepts("C2").count() == 1 and engine.neighborhood("C1", 1)[0].count() == 2
    assert engine.similar_concepts("C1", 1).first()["doc_id"] == "C2"
    with pytest.raises(api.Unavailable):
        engine.similar_concepts("C9")
    with pytest.raises(api.Unavailable):
        engine.minted()
    assert engine.concept_mappings("U:1").count() == 1 and engine.translate(["C1"]).first()["target"] == "U:1"
    assert len(engine.concept_decomposition("C2").first()["upstream"]) == 1
    assert engine.search_elements("lun na").count() == 1 and engine.search_elements('"*"').count() == 0
    assert engine.element("100").count() == 1 and engine.list_elements().first()["total"] == 1
    assert engine.elements_for_concept("C1").count() == 1 and engine.element_neighborhood("100", "1.0").count() == 2
    out = api.embed(engine.table("labels"), "code", "label", lambda x: [[float(len(s)), 1.0] for s in x], 2)
    assert out.count() == 2
