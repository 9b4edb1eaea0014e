"""Claims on work items: a token fences each batch of claims, so that only who holds a claim can end it.

Tables are values here: every function returns the whole new table of items, which the caller publishes; the state it read
is the state it replaces. Items: ``run_id``, ``concept_code``, ``ordinal``, ``state``, ``attempts``, ``claim_token``, ``error``, ``constituents``; runs: ``id``,
``status``, ``fingerprint``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class ClaimLost(ValueError):
    """An item is not held under the given token."""


class IdentityMismatch(ValueError):
    """A run may only go on with the sources and settings that it began with."""


def new_items(worklist: DataFrame) -> DataFrame:
    """Items of a work list (``run_id``, ``concept_code``, ``ordinal``), all pending."""
    return worklist.select("run_id", "concept_code", "ordinal", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("claim_token"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("constituents"))


def claim(items: DataFrame, runs: DataFrame, token: str, codes: DataFrame) -> DataFrame:
    """``items`` after a claim on those of ``codes`` (``run_id``, ``concept_code``): pending and failed ones of a running run become running under
    ``token`` and count an attempt; others stay as they are."""
    live = runs.where("status = 'running'").select(F.col("id").alias("run_id"), F.lit(True).alias("_live")).distinct()
    asked = codes.select("run_id", "concept_code", F.lit(True).alias("_asked")).distinct()
    rows = items.join(live, "run_id", "left").join(asked, ["run_id", "concept_code"], "left")
    takes = F.coalesce(F.col("_live") & F.col("_asked") & F.col("state").isin("pending", "failed"), F.lit(False))
    return _changed(rows, items, takes, state=F.lit("running"), attempts=F.col("attempts") + 1, claim_token=F.lit(token), error=F.lit(None).cast("string"))


def claimed(items: DataFrame, token: str) -> DataFrame:
    """The items that ``token`` holds."""
    return items.where((F.col("state") == "running") & (F.col("claim_token") == token))


def _changed(rows: DataFrame, items: DataFrame, which, **values) -> DataFrame:
    return rows.select(*[F.when(which, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in items.columns])


def _owned(items: DataFrame, codes: DataFrame, token: str) -> None:
    lost = codes.select("run_id", "concept_code").distinct().join(claimed(items, token), ["run_id", "concept_code"], "left_anti")
    if not lost.isEmpty():
        raise ClaimLost(f"claims are not held under {token}")


def complete(items: DataFrame, results: DataFrame, token: str) -> DataFrame:
    """``items`` with those of ``results`` (``run_id``, ``concept_code``, ``constituents``: their number) complete; one that the token does not hold raises."""
    _owned(items, results, token)
    done = results.groupBy("run_id", "concept_code").agg(F.max("constituents").alias("_n"), F.lit(True).alias("_done"))
    rows = items.join(done, ["run_id", "concept_code"], "left")
    return _changed(rows, items, F.coalesce("_done", F.lit(False)), state=F.lit("complete"), claim_token=F.lit(None).cast("string"), constituents=F.col("_n"))


def fail(items: DataFrame, errors: DataFrame, token: str) -> DataFrame:
    """``items`` with those of ``errors`` (``run_id``, ``concept_code``, ``error``) failed; one that the token does not hold raises."""
    _owned(items, errors, token)
    bad = errors.groupBy("run_id", "concept_code").agg(F.min("error").alias("_error"), F.lit(True).alias("_bad"))
    rows = items.join(bad, ["run_id", "concept_code"], "left")
    return _changed(rows, items, F.coalesce("_bad", F.lit(False)), state=F.lit("failed"), claim_token=F.lit(None).cast("string"), error=F.col("_error"))


def resume(items: DataFrame, runs: DataFrame, run_id: str, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """``runs`` and ``items`` with a running or failed run reopened: claims that nobody ended count as failed. Another ``fingerprint`` (of sources and
    settings), a missing or a complete run raise."""
    row = runs.where(F.col("id") == run_id).first()
    if row is None or row["status"] not in ("running", "failed"):
        raise ValueError(f"run {run_id} is {'not there' if row is None else row['status']}")
    if row["fingerprint"] != fingerprint:
        raise IdentityMismatch(f"run {run_id} began with other sources or settings")
    mine = F.col("id") == run_id
    stuck = (F.col("run_id") == run_id) & (F.col("state") == "running")
    return runs.withColumn("status", F.when(mine, "running").otherwise(F.col("status"))), _changed(items, items, stuck, state=F.lit("failed"), claim_token=F.lit(None).cast("string"), error=F.lit("the worker before did not finish"))


def pending(items: DataFrame, run_id: str) -> DataFrame:
    """``concept_code`` of what is not complete, in the order of the work list."""
    return items.where((F.col("run_id") == run_id) & (F.col("state") != "complete")).orderBy("ordinal").select("concept_code")


def items_of_runs(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Items with their run's ``status``; items of a run that is not there are left out."""
    return items.join(runs.select(F.col("id").alias("run_id"), "status"), "run_id")


def finish(items: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` whose running ones are complete if all their items are, and failed if any item is; a run with open items stays."""
    per = items.groupBy(F.col("run_id").alias("id")).agg(F.bool_and(F.col("state") == "complete").alias("_all"), F.bool_or(F.col("state").isin("pending", "running")).alias("_open"))
    rows = runs.join(per, "id", "left")
    end = F.when(F.col("_all"), "complete").when(~F.col("_open"), "failed").otherwise(F.col("status"))
    return rows.select(*[F.when(F.col("status") == "running", F.coalesce(end, F.col("status"))).otherwise(F.col("status")).alias(c) if c == "status" else F.col(c) for c in runs.columns])


def replaced_constituents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` constituents with all rows of each (``run_id``, ``concept_code``) of ``new`` replaced by the new ones."""
    return stored.join(new.select("run_id", "concept_code").distinct(), ["run_id", "concept_code"], "left_anti").unionByName(new)


def drifted(items: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Complete items whose source rows (``concept_code``, ``sha256``) changed or went: their results are void and they are pending again."""
    last = lambda df, c: df.groupBy("concept_code").agg(F.max("sha256").alias(c))
    rows = items.join(last(before, "_then"), "concept_code", "left").join(last(now, "_now"), "concept_code", "left")
    void = (F.col("state") == "complete") & ~F.col("_then").eqNullSafe(F.col("_now"))
    return _changed(rows, items, void, state=F.lit("pending"), constituents=F.lit(None).cast("int"))


def last_attempts(items: DataFrame) -> DataFrame:
    """The item of each concept in the run with the greatest id."""
    w = Window.partitionBy("concept_code").orderBy(F.desc("run_id"))
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
