"""Mixing sources to target token budgets, with DataFrame operations only.

Sources get weights 5, 2, 1, 5, ... in code-point order (null last) and share ``share`` times all tokens by weight; a
source stops at ``cap`` times its own size and the excess is shared again by weight until none is above: filling up to a
common level, whose value follows from running sums over the sources in order of capacity per weight.

Each document has a hash-random key (MD5 of seed and id). Within a source the keys are cut into about sqrt(rows) equal
ranges; a range is sorted in one task, and running sums of the ranges' totals are added, so that no task holds a source.
Whole passes over the source come first; the last pass ends exactly at the budget, inside a document if need be.

Defined results: a null text has size 0 and takes 0; rows equal in source and id follow one another in the order of their
texts' hashes; null ids hash as an empty string; a source without words has target 0; an empty table gives an empty
table; other columns are left alone, and clashing names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptloom.llm.common import word_count, written

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source``, ``source_size``, ``target`` (double) from one row per source (``source``, ``source_size``)."""
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_room = Window.partitionBy(F.lit(0)).orderBy((F.col("room") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("room", (F.col("source_size") * cap).cast("double")).withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    level = (F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("open", F.when(F.col("level") * F.col("weight") < F.col("room"), F.col("level")))
    return ranked.withColumn("open", F.max("open").over(everything)).select("source", "source_size", F.when(F.col("open").isNull(), F.col("room")).otherwise(F.least("room", F.col("open") * F.col("weight"))).alias("target"))


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def take(docs: DataFrame, seed: str = "mix-", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, row: str = "doc_id") -> DataFrame:
    """``row`` (``doc_id``, or a column that tells rows apart), ``source``, ``size``, ``source_size``, ``target`` and ``taken``: the tokens that the
    mix takes of each document, repeats counted."""
    rows = docs.select("doc_id", F.col(row).alias("row"), "source", word_count("text").alias("size"), _key(seed).alias("key"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"))
    rows = written(rows, "sizes")
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    stats = stats.withColumn("ranges", F.ceil(F.sqrt("rows")).cast("long"))
    plan = written(targets(stats.select("source", "source_size"), weights, share, cap).join(stats.select(F.col("source").alias("_source"), "ranges"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "targets")
    plan = plan.withColumnRenamed("source", "_source")
    unit = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    ranged = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).drop("_source").withColumn("range", F.floor(unit * F.col("ranges")))
    totals = ranged.groupBy("source", "range").agg(F.sum("size").alias("total"))
    totals = totals.select(F.col("source").alias("_source"), F.col("range").alias("_range"), F.coalesce(F.sum("total").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("run", F.coalesce(F.sum("size").over(within), F.lit(0)))
    summed = summed.join(totals, summed["source"].eqNullSafe(totals["_source"]) & (summed["range"] == totals["_range"]))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - passes * F.col("source_size")).cast("long") - F.col("base") - F.col("run")
    return summed.select(F.col("row").alias(row), "source", "size", "source_size", "target", (passes * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` once for every whole or begun pass over it, with its columns as they were."""
    columns, row = docs.columns, "doc_id"
    n = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if n["rows"] != n["ids"]:  # ids are missing or repeat: each row gets a lasting number
        row = max(columns, key=len) + "_row"
        docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    times = F.ceil(F.col("taken") / F.when(F.col("size") > 0, F.col("size"))).cast("int")
    times = take(docs, row=row, **options).select(F.col(row).alias("_row"), times.alias("_times")).where("_times > 0")
    repeated = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col(row).alias("_row")).join(times, "_row")
    return repeated.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")


def oracle(seed: str = "mix-") -> str:
    """The same rows as DuckDB SQL."""
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(concat('{seed}', doc_id)) AS key FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
  w AS (SELECT *, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS room, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
  l AS (SELECT *, (budget - coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
  t AS (SELECT source, source_size, CASE WHEN highest IS NULL THEN room ELSE least(room, highest * weight) END AS target FROM (SELECT *, max(CASE WHEN level * weight < room THEN level END) OVER () AS highest FROM l)),
  r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS passes,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (passes * size + least(greatest(round(target - passes * source_size)::BIGINT - run, 0), size))::BIGINT AS taken FROM r"""
