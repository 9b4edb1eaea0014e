"""The registry of data elements: joins with concepts, lists, versions, search text, validation and neighborhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptloom.functions import text

KEY = ["public_id", "version"]


def for_concepts(elements: DataFrame, links: DataFrame, concepts: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``concept_code``, ``public_id``, ``version``, ``long_name``: the elements that use each concept, optionally the first ``limit`` by name."""
    if concepts is not None:
        links = links.join(concepts.select(F.col("code").alias("concept_code")).distinct(), "concept_code", "left_semi")
    found = links.select("concept_code", *KEY).distinct().join(elements.select(*KEY, "long_name"), KEY).distinct()
    if limit is not None:
        order = Window.partitionBy("concept_code").orderBy("long_name", *KEY)
        found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    return found.select("concept_code", *KEY, "long_name")


def latest(elements: DataFrame) -> DataFrame:
    """The row of each ``public_id`` with the largest version number; of equal ones the larger version text."""
    order = Window.partitionBy("public_id").orderBy(text.version_number("version").desc(), F.col("version").desc())
    return elements.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def natural_order() -> list[Column]:
    return [F.expr("try_cast(public_id AS bigint)").asc_nulls_first(), F.col("version").asc()]


def like(elements: DataFrame, query: str, columns: tuple[str, ...] = ("short_name", "long_name", "definition")) -> DataFrame:
    """Substring search, caseless for ASCII letters only."""
    fold = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(fold(c), fold(F.lit(query))), F.lit(False))
    return elements.where(hit)


def first_concepts(links: DataFrame, sources: tuple[str, ...] = ("object_class", "property", "representation", "permissible_value")) -> DataFrame:
    """Of a concept's several places in an element the first, by kind and position."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("concept_type"))
    order = Window.partitionBy(*KEY, "concept_code").orderBy(F.when(rank == 0, len(sources) + 1).otherwise(rank), "pos")
    return links.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upserted(rows: DataFrame) -> DataFrame:
    """Of rows with one key the last, by archive member and position."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("member_seq"), F.desc("pos"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def search_text(names: Column, values: Column, concepts: Column, value_cap: int = 10, concept_cap: int = 20) -> Column:
    """Names, permissible values and concept names, the latter two capped, joined by `` | ``."""
    parts = F.concat(names, F.slice(values, 1, value_cap), F.slice(concepts, 1, concept_cap))
    return F.array_join(F.filter(parts, lambda v: v.isNotNull() & (v != "")), " | ")


def problems(elements: DataFrame, links: DataFrame) -> DataFrame:
    """``kind``, ``rows`` of everything a publishable registry must not have (0 rows: none of that kind)."""
    doc = F.from_json("cde_json", "public_id string, version string, permissible_values array<struct<value:string,meaning:string,meaning_code:string>>")
    checks = {
        "invalid_json": doc.isNull() | F.expr("try_parse_json(cde_json) IS NULL"),
        "json_differs": ~doc["public_id"].eqNullSafe(F.col("public_id")) | ~doc["version"].eqNullSafe(F.col("version")),
        "no_values_array": doc["permissible_values"].isNull(),
        "bad_id": F.coalesce(F.col("public_id").rlike(r"[^A-Za-z0-9:_.\-]") | (F.col("public_id") == ""), F.lit(True)),
    }
    counts = elements.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("rows")) for k in checks])))
    twice = elements.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").agg(F.lit("duplicate_key").alias("kind"), F.count("*").alias("rows"))
    orphans = links.join(elements, KEY, "left_anti").agg(F.lit("orphan_link").alias("kind"), F.count("*").alias("rows"))
    return rows.unionByName(twice).unionByName(orphans)


def fingerprint_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and ``sha256`` of each row as JSON with sorted field names."""
    names = sorted(rows.columns)
    return rows.select(*key, F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias("sha256"))


def fingerprint(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row ``rows``, ``sha256`` over all rows' fingerprints, the same in any order: they are combined per leading six, then three hex
    digits, in order within each, so that no string holds more than a 16-millionth of the digests or 4096 parts."""
    out = fingerprint_rows(rows, key).select("sha256", F.lit(1).cast("long").alias("n"), F.col("sha256").alias("lead"))
    for digits in (6, 3, 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lead", "sha256"))), lambda x: x["sha256"]), "")
        by = [F.substring("lead", 1, digits).alias("lead")] if digits else []
        out = out.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(joined, 256).alias("sha256"))
    return out.select(F.col("n").alias("rows"), "sha256")


def neighborhood_edges(links: DataFrame, elements: DataFrame, cap: int = 12) -> DataFrame:
    """``src`` (element), ``rel``, ``dst`` (concept): up to ``cap`` concepts of each element, primary ones first."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("is_primary"), "concept_code")
    rows = links.join(elements.select(*KEY), KEY, "left_semi").select(*KEY, "concept_code", "is_primary").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap)
    return rows.select(F.concat_ws(":", *KEY).alias("src"), F.lit("cde-concept").alias("rel"), F.col("concept_code").alias("dst"))


def contiguous(members: DataFrame) -> DataFrame:
    """Archive members whose sequence number repeats or does not follow the one before (``seq``)."""
    return members.withColumn("_before", F.lag("seq").over(Window.partitionBy("archive").orderBy("seq"))).where("_before IS NOT NULL AND seq <> _before + 1").drop("_before")
