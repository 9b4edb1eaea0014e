import pytest
from pyspark.sql import functions as F

from conceptloom.plans import claims


def items_and_runs(spark):
    work = spark.createDataFrame([("r1", f"C{i}", i) for i in range(4)] + [("r2", "C9", 0)], "run_id string, concept_code string, ordinal long")
    return claims.new_items(work), spark.createDataFrame([("r1", "running", "a"), ("r2", "complete", "a")], "id string, status string, fingerprint string")


def states(items):
    return {(r["run_id"], r["concept_code"]): (r["state"], r["attempts"], r["claim_token"]) for r in items.collect()}


def test_a_claim_takes_open_items_of_running_runs_once(spark):
    items, runs = items_and_runs(spark)
    first = claims.claim(items, runs, "t1", items.where("concept_code IN ('C0', 'C1', 'C9')"))
    assert states(first) == {("r1", "C0"): ("running", 1, "t1"), ("r1", "C1"): ("running", 1, "t1"), ("r1", "C2"): ("pending", 0, None), ("r1", "C3"): ("pending", 0, None), ("r2", "C9"): ("pending", 0, None)}
    second = claims.claim(first, runs, "t2", items)
    assert {k for k, v in states(second).items() if v[2] == "t2"} == {("r1", "C2"), ("r1", "C3")}
    done = claims.complete(second, claims.claimed(second, "t1").select("run_id", "concept_code", F.lit(3).alias("constituents")), "t1")
    assert states(done)["r1", "C0"] == ("complete", 1, None)
    with pytest.raises(claims.ClaimLost):
        claims.complete(done, claims.claimed(second, "t1").select("run_id", "concept_code", F.lit(3).alias("constituents")), "t1")
    with pytest.raises(claims.ClaimLost):
        claims.fail(second, claims.claimed(second, "t2").withColumn("error", F.lit("x")), "t1")
    failed = claims.fail(done, claims.claimed(done, "t2").withColumn("error", F.lit("x")), "t2")
    assert states(failed)["r1", "C3"][0] == "failed" and [r["concept_code"] for r in claims.pending(failed, "r1").collect()] == ["C2", "C3"]
    assert {r["id"]: r["status"] for r in claims.finish(failed, runs).collect()} == {"r1": "failed", "r2": "complete"}


def test_a_run_resumes_with_its_own_identity_only(spark):
    items, runs = items_and_runs(spark)
    held = claims.claim(items, runs, "t1", items.where("concept_code = 'C0'"))
    again, after = claims.resume(held, runs, "r1", "a")
    assert states(after)["r1", "C0"] == ("failed", 1, None) and {r["id"]: r["status"] for r in again.collect()}["r1"] == "running"
    with pytest.raises(claims.IdentityMismatch):
        claims.resume(held, runs, "r1", "b")
    for missing in ("r2", "r7"):
        with pytest.raises(ValueError, match="run r"):
            claims.resume(held, runs, missing, "a")


def test_changed_sources_reopen_complete_items_and_rows_are_replaced(spark):
    items, _ = items_and_runs(spark)
    done = items.withColumn("state", F.lit("complete"))
    rows = lambda pairs: spark.createDataFrame(pairs, "concept_code string, sha256 string")
    after = claims.drifted(done, rows([("C0", "x"), ("C1", "y"), ("C2", "z")]), rows([("C0", "x"), ("C1", "other")]))
    assert {k[1] for k, v in states(after).items() if v[0] == "pending"} == {"C1", "C2"}
    stored = spark.createDataFrame([("r1", "C0", "a"), ("r1", "C0", "b"), ("r1", "C1", "c")], "run_id string, concept_code string, axis string")
    new = spark.createDataFrame([("r1", "C0", "z")], stored.schema)
    assert sorted(tuple(r) for r in claims.replaced_constituents(stored, new).collect()) == [("r1", "C0", "z"), ("r1", "C1", "c")]
