"""Runs, work lists and publication: tables whose states change by whole writes, and what may change into what."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_STATES = {"running": ("complete", "failed"), "failed": ("running",), "complete": ()}
ITEM_STATES = {"pending": ("running",), "failed": ("running",), "running": ("complete", "failed"), "complete": ()}


class IllegalTransition(ValueError):
    """A state that may not follow the one before."""


def advance(state: str, to: str, states: dict[str, tuple[str, ...]] = RUN_STATES) -> str:
    if to not in states[state]:
        raise IllegalTransition(f"{state} -> {to}")
    return to


def identity(columns: list[str]) -> Column:
    """Digest of canonical JSON over the sorted columns."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def worklist(codes: DataFrame, run_id: str, strict: bool = False) -> DataFrame:
    """``run_id``, ``concept_code``, ``ordinal``, ``state``, ``attempts`` for the sorted codes; with ``strict`` a repeated code raises.

    Ordinals are range-wise: a range's rank times 2^33 plus the place in it, increasing with the code."""
    if strict and not codes.groupBy("code").count().where("count > 1").isEmpty():
        raise ValueError("the work list repeats a concept")
    return codes.select("code").distinct().orderBy("code").select(F.lit(run_id).alias("run_id"), F.col("code").alias("concept_code"), F.monotonically_increasing_id().alias("ordinal"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"))


def merged(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` take the place of rows with their key."""
    return current.join(new, key, "left_anti").unionByName(new)


def inserted(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert or ignore: only rows with a new key are added, one per key, so that decisions already made stay."""
    once = new.dropDuplicates(key)
    return current.unionByName(once.join(current, key, "left_anti"))


def outcomes(items: DataFrame) -> DataFrame:
    """Per run: items by state and the shares decomposed and residual (0 where there are none)."""
    rows = items.groupBy("run_id").agg(F.count("*").alias("items"), F.count_if(F.col("state") == "complete").alias("complete"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if("is_decomposed").alias("decomposed"), F.count_if("is_residual").alias("residual"), F.coalesce(F.sum("constituent_count"), F.lit(0)).alias("constituents"))
    return rows.withColumn("coverage", F.coalesce(F.try_divide("decomposed", "items"), F.lit(0.0))).withColumn("residual_rate", F.coalesce(F.try_divide("residual", "decomposed"), F.lit(0.0)))


def publish(df: DataFrame, path: str, expected: int | None = None, required: DataFrame | None = None, key: str = "doc_id") -> str:
    """Stage ``df`` under ``path``, check it, then write the manifest row that makes it the active build; returns the build's id.

    Readers of :func:`active` see the old build until the manifest is there. A failed check leaves no manifest."""
    spark, build = df.sparkSession, uuid.uuid4().hex
    target = f"{path}/builds/{build}"
    df.write.parquet(target)
    rows = spark.read.parquet(target)
    n = rows.count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} rows, not {expected}")
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats")
    if required is not None and not required.select(key).join(rows, key, "left_anti").isEmpty():
        raise ValueError("required rows are missing")
    one = spark.range(1).select(F.lit(build).alias("build_id"), F.lit(n).cast("long").alias("rows"), F.current_timestamp().alias("completed_at"))
    one.write.mode("append").parquet(f"{path}/manifest")
    return build


def active(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the build published last."""
    last = spark.read.parquet(f"{path}/manifest").agg(F.max_by("build_id", F.struct("completed_at", "build_id"))).first()[0]
    return spark.read.parquet(f"{path}/builds/{last}")


def releases(rows: DataFrame) -> DataFrame:
    """The last version of each ``source`` by ``finished_at``."""
    w = Window.partitionBy("source").orderBy(F.desc("finished_at"), F.desc("id"))
    return rows.where("status = 'complete'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
