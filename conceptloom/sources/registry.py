"""Reading data elements from XML, and archives of them, into the registry's tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.functions import text
from conceptloom.operators import elements

_CONCEPTS = "struct<ConceptDetails: struct<ConceptDetails_ITEM: array<struct<PREFERRED_NAME: string, LONG_NAME: string, PRIMARY_FLAG_IND: string>>>>"
SCHEMA = (
    "PUBLICID string, VERSION string, PREFERREDNAME string, LONGNAME string, PREFERREDDEFINITION string, CONTEXTNAME string, WORKFLOWSTATUS string, REGISTRATIONSTATUS string, "
    f"DATAELEMENTCONCEPT struct<LongName: string, PreferredDefinition: string, ObjectClass: {_CONCEPTS}, Property: {_CONCEPTS}>, "
    f"VALUEDOMAIN struct<LongName: string, PreferredDefinition: string, Datatype: string, ValueDomainType: string, Representation: {_CONCEPTS}, "
    "PermissibleValues: struct<PermissibleValues_ITEM: array<struct<VALIDVALUE: string, VALUEMEANING: string, MEANINGCONCEPTS: string, MEANINGCONCEPTDISPLAYORDER: string>>>>"
)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """The raw nested rows, every leaf a string; nothing is inferred."""
    return spark.read.format("xml").option("rowTag", "DataElement").schema(SCHEMA).load(path)


def _array(x: Column, kind: str) -> Column:
    return F.coalesce(x, F.array().cast(kind))


def links(raw: DataFrame) -> DataFrame:
    """``public_id``, ``version``, ``concept_code``, ``concept_name``, ``concept_type``, ``is_primary``, ``pos``; a concept counts once per element, at its first place."""
    kinds = {"object_class": "DATAELEMENTCONCEPT.ObjectClass", "property": "DATAELEMENTCONCEPT.Property", "representation": "VALUEDOMAIN.Representation"}
    parts = []
    for name, path in kinds.items():
        item = raw.select(F.col("PUBLICID").alias("public_id"), F.col("VERSION").alias("version"), F.posexplode(f"{path}.ConceptDetails.ConceptDetails_ITEM").alias("pos", "c"))
        parts.append(item.select("public_id", "version", F.trim("c.PREFERRED_NAME").alias("concept_code"), F.col("c.LONG_NAME").alias("concept_name"), F.lit(name).alias("concept_type"), (F.col("c.PRIMARY_FLAG_IND") == "Yes").cast("int").alias("is_primary"), "pos"))
    values = raw.select(F.col("PUBLICID").alias("public_id"), F.col("VERSION").alias("version"), F.posexplode("VALUEDOMAIN.PermissibleValues.PermissibleValues_ITEM").alias("at", "v"))
    codes = values.select("public_id", "version", "at", F.col("v.VALUEMEANING").alias("concept_name"), F.posexplode(text.split_list("v.MEANINGCONCEPTS", ",")).alias("k", "code"))
    parts.append(codes.select("public_id", "version", F.trim(F.substring_index("code", "::", 1)).alias("concept_code"), "concept_name", F.lit("permissible_value").alias("concept_type"), F.lit(0).alias("is_primary"), (F.col("at") * 1000 + F.col("k")).alias("pos")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return elements.first_concepts(out.where("concept_code IS NOT NULL AND concept_code <> ''"))


def elements_of(raw: DataFrame) -> DataFrame:
    """The registry's rows with search text and JSON document."""
    values = F.transform(_array(F.col("VALUEDOMAIN.PermissibleValues.PermissibleValues_ITEM"), "array<struct<VALIDVALUE:string,VALUEMEANING:string,MEANINGCONCEPTS:string,MEANINGCONCEPTDISPLAYORDER:string>>"), lambda v: F.struct(v["VALIDVALUE"].alias("value"), v["VALUEMEANING"].alias("meaning"), F.trim(F.substring_index(F.element_at(F.split(F.coalesce(v["MEANINGCONCEPTS"], F.lit("")), ","), 1), "::", 1)).alias("meaning_code")))
    rows = raw.select(F.col("PUBLICID").alias("public_id"), F.col("VERSION").alias("version"), F.col("PREFERREDNAME").alias("short_name"), F.col("LONGNAME").alias("long_name"), F.col("PREFERREDDEFINITION").alias("definition"), F.col("CONTEXTNAME").alias("context"), F.col("WORKFLOWSTATUS").alias("workflow_status"), F.col("REGISTRATIONSTATUS").alias("registration_status"), F.col("VALUEDOMAIN.Datatype").alias("datatype"), F.col("VALUEDOMAIN.ValueDomainType").alias("value_domain_type"), values.alias("permissible_values"), F.array("DATAELEMENTCONCEPT.LongName", "DATAELEMENTCONCEPT.PreferredDefinition", "VALUEDOMAIN.LongName", "VALUEDOMAIN.PreferredDefinition").alias("names"))
    names = links(raw).groupBy("public_id", "version").agg(F.transform(F.array_sort(F.collect_list(F.struct("concept_type", "pos", "concept_name"))), lambda x: x["concept_name"]).alias("concepts"))
    rows = rows.join(names, ["public_id", "version"], "left")
    search = elements.search_text(F.concat(F.array("short_name", "long_name", "definition"), F.col("names")), F.transform("permissible_values", lambda v: v["value"]), F.coalesce("concepts", F.array().cast("array<string>")))
    document = F.to_json(F.struct("public_id", "version", "short_name", "long_name", "definition", "context", "workflow_status", "registration_status", "datatype", "value_domain_type", "permissible_values"))
    return rows.withColumn("search_text", search).withColumn("cde_json", document).drop("names", "concepts", "permissible_values")


_MEMBER = re.compile(r"^[A-Za-z0-9_.-]+_(\d{14})_(\d+)\.xml$")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """``archive``, ``name``, ``seq``, ``stamp``, ``content`` of the XML members of zip files; a member with a path, a link or another name raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        found = _MEMBER.match(info.filename)
                        if not found or info.external_attr >> 28 == 0xA:
                            raise ValueError(f"unexpected member {info.filename!r} in {where}")
                        yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([info.filename]), pa.array([int(found[2])], type=pa.int64()), pa.array([found[1]]), pa.array([z.read(info)], type=pa.binary())], names=["archive", "name", "seq", "stamp", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(run, "archive string, name string, seq long, stamp string, content binary")
    return rows.withColumn("stamp", F.to_timestamp("stamp", "yyyyMMddHHmmss"))
