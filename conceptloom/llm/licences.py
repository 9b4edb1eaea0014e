"""Licence scans: a trained paragraph classifier over sparse word n-grams, with DataFrame and SQL functions only.

Training rows are the notices and paragraphs of ``licence_texts`` and, as class ``unknown``, sentences with licence words
that grant nothing and the paragraphs of a bounded sample of the corpus (but for those that hold most words of a licence
text). Features are the hashed one- to three-word grams of the trained texts. Spark's multinomial logistic regression (L1)
is fitted; its non-zero weights, bounded by the texts, are what the scan joins with. Every paragraph of the corpus is
scored; one without a weighted gram has the intercepts' score. A temperature fitted on held-out texts and paragraphs
calibrates the probabilities, and under ``LEAST`` the class is unknown. A prediction is confirmed if the paragraph holds
enough of the words of one of the family's texts.

Paragraphs are lines; a line that ends inside a sentence and goes on with a small letter or a bracket is joined with the
next one. Defined results: a null or empty text has no paragraph and no licence; rows equal in id are reported together;
ties go to the family first in order; a paragraph with two families is given to the likelier; an empty table gives an
empty table; other columns are left alone.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm import licence_texts
from conceptloom.llm.common import written

#: Documents whose paragraphs train the class ``unknown``; probability and share of a text's words for a confirmed licence.
SAMPLE_DOCS, LEAST, COVER = 400, 0.6, 0.75
#: What a licence text counts for in the fit; paragraphs of the corpus count for 1.
TEXT_WEIGHT = 25.0
UNKNOWN = "unknown"
FAMILIES = sorted({*licence_texts.TEXTS, *licence_texts.NAMES, UNKNOWN})
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)


def paragraphs(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with ``paragraph_no`` (from 0) and ``paragraph`` of each that has a character."""
    joined = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?<=[\p{L}\p{N},;/\"-]) *\r?\n(?=[a-z(])", " ")
    found = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.posexplode(F.split(joined, "\n")).alias("paragraph_no", "paragraph"))
    return found.where("trim(paragraph) <> ''")


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and inner dots or hyphens; one spelling of license."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "licence", "license"), F.lit(r"([\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*)"), 1)


def grams(w: str) -> Column:
    """Hashes of the distinct one- to three-word grams of the column ``w``; what runs over the end is a shorter gram again."""
    w = F.col(w)
    return F.array_distinct(F.flatten(F.transform(w, lambda x, i: F.array(F.xxhash64(x), F.xxhash64(x, F.get(w, i + 1)), F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))))


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of the driver, as one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _cover(w: str, family: str | None = None) -> Column:
    """The largest share of a text's words that the column ``w`` holds, of the texts of the column ``family`` or of all."""
    of: dict[str, list[Column]] = {}
    for name, text in licence_texts.templates():
        of.setdefault(name, []).append(F.array_distinct(words(F.lit(text))))
    share = lambda t: F.size(F.array_intersect(t, F.col(w))) / F.size(t)
    best = {name: F.array_max(F.transform(F.array(*sets), share)) for name, sets in of.items()}
    if family is None:
        return F.greatest(*best.values())
    out = F.lit(0.0)
    for name, value in best.items():
        out = F.when(F.col(family) == name, value).otherwise(out)
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, list[float], float]:
    """Weights (``gram``, ``w``: one for each of ``FAMILIES``), the intercepts and the temperature. The sample is of the ``sample_docs``
    documents with the smallest hashes of their ids: a bound on labelled rows, not on what is scanned."""
    spark = docs.sparkSession
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    # four times as many as wanted pass the filter, so that what is sorted does not grow with the corpus
    share = min(1.0, 4 * sample_docs / max(1, docs.count()))
    sample = docs.select("doc_id", "text").where(draw < int(share * (1 << 32))).orderBy(draw, "doc_id").limit(sample_docs)
    plain = paragraphs(sample).select(F.lit(UNKNOWN).alias("family"), F.col("paragraph").alias("text"), (F.pmod(F.xxhash64("paragraph"), F.lit(5)) == 0).alias("held"))
    plain = plain.withColumn("words", words(F.col("text"))).where(_cover("words") < COVER)
    known = [{"family": f, "text": t, "held": h} for f, t, h in [*licence_texts.paragraphs(), *[(UNKNOWN, t, i % 5 == 4) for i, t in enumerate(licence_texts.OTHER) for _ in range(3)]]]
    rows = _table(spark, known, "family string, text string, held boolean").withColumn("words", words(F.col("text"))).unionByName(plain).withColumn("licence", F.col("family") != UNKNOWN)
    label = F.array_position(F.array(*[F.lit(k) for k in FAMILIES]), F.col("family")).cast("double") - 1
    rows = written(rows.select(F.transform(grams("words"), lambda x: x.cast("string")).alias("grams"), label.alias("label"), "held", F.col("licence"), F.when(F.col("licence"), TEXT_WEIGHT).otherwise(1.0).alias("weight")), "licence_rows")
    vocabulary = sorted(r["g"] for r in rows.where("licence AND NOT held").select(F.explode("grams").alias("g")).distinct().collect())  # of the texts above only
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    seen = model.transform(rows).coalesce(4)
    fitted = LogisticRegression(maxIter=60, regParam=0.0003, elasticNetParam=0.3, family="multinomial", standardization=False, weightCol="weight").fit(seen.where("NOT held"))
    table, intercepts = fitted.coefficientMatrix.toArray(), [float(x) for x in fitted.interceptVector.toArray()]
    raw, top = F.col("raw"), F.array_max("raw")
    held = fitted.transform(seen.where("held")).select("label", vector_to_array("rawPrediction").alias("raw"))
    loss = lambda t: F.sum(F.log(F.aggregate(raw, F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))) - (F.get(raw, F.col("label").cast("int")) - top) / t)
    losses = held.agg(*[loss(t) for t in TEMPERATURES]).first()
    temperature = min(zip(losses, TEMPERATURES, strict=True))[1] if losses[0] is not None else 1.0
    weights = [{"gram": int(g), "w": [round(float(x), 6) for x in table[:, j]]} for j, g in enumerate(vocabulary) if abs(table[:, j]).max() > 1e-6]
    return written(_table(spark, weights, "gram bigint, w array<double>"), "weights"), intercepts, temperature


def scan(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``paragraph_no``, ``paragraph``, ``family``, ``probability`` (of the likeliest class), ``licence`` (probability of any licence), ``cover``,
    ``confirmed`` of every paragraph that more likely than not is of a licence."""
    weights, intercepts, temperature = train(docs, **options)
    # one narrow pass scores all paragraphs; the weights are bounded by the licence texts
    lines = paragraphs(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))).withColumn("words", words(F.col("paragraph")))
    each = lines.select("row", "doc_id", "paragraph_no", F.xxhash64("paragraph").alias("hash"), F.explode(grams("words")).alias("gram"))
    scored = each.join(F.broadcast(weights), "gram").groupBy("row", "doc_id", "paragraph_no", "hash").agg(*[F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(len(FAMILIES))])
    raw = F.array(*[(F.col(f"s{i}") + b) / temperature for i, b in enumerate(intercepts)])
    scored = scored.select("row", "doc_id", "paragraph_no", "hash", raw.alias("raw")).withColumn("best", F.array_max("raw"))
    odds = F.aggregate("raw", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("best")))
    none = F.exp(F.get("raw", F.lit(FAMILIES.index(UNKNOWN))) - F.col("best"))
    likely = F.element_at(F.array(*[F.lit(k) for k in FAMILIES]), F.array_position("raw", F.col("best")).cast("int"))
    scored = scored.select("row", "doc_id", "paragraph_no", "hash", likely.alias("family"), (1.0 / odds).alias("probability"), (1.0 - none / odds).alias("licence"))
    scored = written(scored.where("licence > 0.5").withColumn("family", F.when(F.col("probability") >= LEAST, F.col("family")).otherwise(F.lit(UNKNOWN))), "licences")
    # the texts of these few again, equal ones once
    hashes = written(scored.select("hash").distinct(), "hashes")
    texts = paragraphs(docs.select("text")).select(F.xxhash64("paragraph").alias("hash"), "paragraph").join(hashes, "hash", "left_semi")
    found = scored.join(written(texts.groupBy("hash").agg(F.min("paragraph").alias("paragraph")), "paragraphs"), "hash").withColumn("words", words(F.col("paragraph")))
    found = found.withColumn("cover", F.round(_cover("words", "family"), 6))
    return found.select("row", "doc_id", "paragraph_no", "paragraph", "family", F.round("probability", 4).alias("probability"), F.round("licence", 4).alias("licence"), "cover", ((F.col("family") != UNKNOWN) & (F.col("cover") >= COVER)).alias("confirmed"))


def document_licences(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``families`` (sorted, distinct, confirmed, joined by commas), ``n_confirmed``, ``n_unknown`` (paragraphs of
    a licence that is none of the families for sure, or that no text of its family confirms)."""
    found = scan(docs, **options).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"), F.count_if("confirmed").alias("n_confirmed"), F.count_if(~F.col("confirmed")).alias("n_unknown"))
    found = written(found.withColumnRenamed("doc_id", "_id"), "found")
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))
