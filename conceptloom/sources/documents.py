"""Parsing of remote documents that are given as text: trial records in JSON, articles in XML and JSON, mapping files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRIAL = (
    "protocolSection struct<identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string>, statusModule: struct<overallStatus: string, startDateStruct: struct<date: string>, completionDateStruct: struct<date: string>>, "
    "descriptionModule: struct<briefSummary: string>, designModule: struct<studyType: string, phases: array<string>, enrollmentInfo: struct<count: int>>, conditionsModule: struct<conditions: array<string>>, "
    "armsInterventionsModule: struct<interventions: array<struct<type: string, name: string, description: string>>>, outcomesModule: struct<primaryOutcomes: array<struct<measure: string, timeFrame: string>>, secondaryOutcomes: array<struct<measure: string, timeFrame: string>>>, "
    "eligibilityModule: struct<eligibilityCriteria: string, sex: string, minimumAge: string, maximumAge: string>, sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string>, collaborators: array<struct<name: string>>>, "
    "contactsLocationsModule: struct<locations: array<struct<facility: string, city: string, country: string>>>, referencesModule: struct<references: array<struct<pmid: string, citation: string>>>>"
)


def _list(x: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(x, F.array().cast(kind))


def trials(rows: DataFrame, column: str = "json") -> DataFrame:
    """One row per trial record; missing or null sections give nulls and empty arrays. The references need a citation."""
    p = F.from_json(column, TRIAL)["protocolSection"]
    names = lambda x: F.transform(x, lambda v: v["name"])
    arms = _list(p["armsInterventionsModule"]["interventions"], "array<struct<type:string,name:string,description:string>>")
    lead = F.filter(F.array(p["sponsorCollaboratorsModule"]["leadSponsor"]["name"]), lambda x: x.isNotNull())
    others = names(_list(p["sponsorCollaboratorsModule"]["collaborators"], "array<struct<name:string>>"))
    outcome = "array<struct<measure:string,timeFrame:string>>"
    return rows.select(
        p["identificationModule"]["nctId"].alias("nct_id"), F.coalesce(p["identificationModule"]["briefTitle"], p["identificationModule"]["officialTitle"]).alias("title"), p["statusModule"]["overallStatus"].alias("status"),
        F.array_join(_list(p["designModule"]["phases"]), "/").alias("phase"), p["designModule"]["enrollmentInfo"]["count"].alias("enrollment"), _list(p["conditionsModule"]["conditions"]).alias("conditions"),
        F.filter(names(arms), lambda x: x.isNotNull()).alias("interventions"), _list(p["outcomesModule"]["primaryOutcomes"], outcome).alias("primary_outcomes"), _list(p["outcomesModule"]["secondaryOutcomes"], outcome).alias("secondary_outcomes"),
        F.concat(lead, others).alias("sponsors"), _list(p["contactsLocationsModule"]["locations"], "array<struct<facility:string,city:string,country:string>>").alias("locations"),
        F.filter(_list(p["referencesModule"]["references"], "array<struct<pmid:string,citation:string>>"), lambda r: r["citation"].isNotNull()).alias("references"),
    )


def is_trial_id(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).rlike("^NCT[0-9]{8}$")


def position_relevance(rows: DataFrame, query: str, position: str) -> DataFrame:
    """``relevance`` of a result list: 1 at its head, falling evenly to 1/n."""
    w = Window.partitionBy(query)
    return rows.withColumn("relevance", F.round(1 - (F.row_number().over(w.orderBy(position)) - 1) / F.count("*").over(w), 4))


def articles(rows: DataFrame, column: str = "xml") -> DataFrame:
    """One row per article in XML: id, title and abstract with the text of inner tags, labelled sections, authors, journal, headings, keywords."""
    x = lambda path: F.xpath_string(column, F.lit(path))
    all_ = lambda path: F.xpath(column, F.lit(path + "/text()"))
    root = "//PubmedArticle/MedlineCitation"
    none = lambda c: F.when(c != "", c)
    return rows.select(none(x(f"{root}/PMID")).alias("pmid"), none(x(f"{root}/Article/ArticleTitle")).alias("title"), none(x(f"{root}/Article/Abstract")).alias("abstract"), none(x(f"{root}/Article/Journal/Title")).alias("journal"), none(x(f"{root}/Article/Journal/JournalIssue/PubDate/Year")).alias("year"), all_(f"{root}/Article/AuthorList/Author[LastName or ForeName]/LastName").alias("authors"), all_(f"{root}/MeshHeadingList/MeshHeading/DescriptorName").alias("mesh"), all_(f"{root}/MeshHeadingList/MeshHeading[DescriptorName/@MajorTopicYN='Y' or QualifierName/@MajorTopicYN='Y']/DescriptorName").alias("major_mesh"), all_(f"{root}/KeywordList/Keyword").alias("keywords"), none(x("//PubmedArticle/PubmedData/ArticleIdList/ArticleId[@IdType='doi']")).alias("doi"))


def article_summaries(rows: DataFrame, column: str = "json") -> DataFrame:
    """``pmid``, ``title``, ``journal``, ``pub_date``, ``doi`` from summary JSON (``result`` by id, in the order of ``uids``)."""
    doc = "struct<uid:string,title:string,fulljournalname:string,pubdate:string,articleids:array<struct<idtype:string,value:string>>>"
    ids = F.from_json(F.get_json_object(column, "$.result.uids"), "array<string>")
    table = F.from_json(F.get_json_object(column, "$.result"), "map<string,string>")
    one = rows.select(table.alias("t"), F.posexplode(ids).alias("pos", "pmid")).select("pos", "pmid", F.from_json(F.element_at("t", F.col("pmid")), doc).alias("d"))
    return one.where("d IS NOT NULL").select("pos", "pmid", "d.title", F.col("d.fulljournalname").alias("journal"), F.col("d.pubdate").alias("pub_date"), F.get(F.filter("d.articleids", lambda a: a["idtype"] == "doi"), 0)["value"].alias("doi"))


def linked_articles(rows: DataFrame, column: str = "json", link: str = "pubmed_pubmed", limit: int | None = None) -> DataFrame:
    """``pmid``, ``linked``: the ids of a link set, the article itself left out."""
    sets = F.from_json(F.get_json_object(column, "$.linksets"), "array<struct<ids:array<string>,linksetdbs:array<struct<linkname:string,links:array<string>>>>>")
    flat = rows.select(F.explode(sets).alias("s")).select(F.get("s.ids", 0).alias("pmid"), F.explode("s.linksetdbs").alias("db")).where(F.col("db.linkname") == link)
    found = flat.select("pmid", F.posexplode("db.links").alias("pos", "linked")).where("linked <> pmid")
    if limit is not None:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("pmid").orderBy("pos"))).where(F.col("_n") <= limit).drop("_n")
    return found


def mappings(spark: SparkSession, path: str, signed: bool = False) -> DataFrame:
    """``subject_id``, ``predicate_id``, ``object_id``, ``note`` of a mapping file; ``signed`` refuses files whose status is not signed off."""
    rows = spark.read.schema("_meta struct<status: string>, mappings array<struct<subject_id: string, predicate_id: string, object_id: string, note: string>>").json(path, multiLine=True)
    if signed:
        rows = rows.withColumn("mappings", F.when(F.col("_meta.status") == "sme-signed", F.col("mappings")).otherwise(F.raise_error(F.lit("the mapping file is not signed off"))))
    return rows.select(F.inline("mappings"))
