"""The engine's typed entry points over a catalog of tables; every answer is a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.functions import text
from conceptloom.operators import concepts, elements, graph, mappings, search, similarity


class Unavailable(LookupError):
    """A corpus or a vector that an answer needs is not there; this is not an empty answer."""


@dataclass
class Engine:
    """``tables`` maps names to DataFrames: props, labels, isa, restrictions, associations, elements, links, records, constituents, runs, items, minted, concept_vectors, element_vectors."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise Unavailable(name)
        return self.tables[name]

    def _codes(self, codes: list[str]) -> DataFrame:
        any_table = next(iter(self.tables.values()))
        return any_table.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in codes])).alias("code"))

    # concepts
    def search_concepts(self, query: str, limit: int = 20) -> DataFrame:
        """Concepts all of whose query stems occur in label or synonyms: exact name, rank, length, label, code."""
        rows = concepts.detail(self.table("props")).select("code", F.coalesce("label", "preferred_name").alias("label"), F.array_join("synonyms", " ").alias("synonyms"))
        lists = search.postings(rows, "code", {"label": search.WEIGHT_A, "synonyms": search.WEIGHT_B})
        one = rows.sparkSession.range(1).select(F.lit(1).alias("query_id"), F.array(*[F.lit(t) for t in text.prefix_terms(query)]).cast("array<string>").alias("terms"))
        return concepts.exact_name_first(rows.join(search.ranked(lists, "code", one), "code"), query, limit, F.col("rank"))

    def list_concepts(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return concepts.page(self.table("labels"), ["label", "code"], limit, offset)

    def concept_detail(self, code: str) -> DataFrame:
        return concepts.detail(self.table("props").where(F.col("code") == code))

    def related_concepts(self, code: str, per_arm: int = 100) -> DataFrame:
        mine = F.col("subject") == code
        return concepts.related(self.table("restrictions").where(mine), self.table("associations").where(mine), self.table("labels"), per_arm)

    def neighborhood(self, code: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        if not 1 <= depth <= 3:
            raise ValueError("depth is 1 to 3")
        isa = self.table("isa").select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit("isa").alias("rel"))
        roles = self.table("restrictions").select(F.col("subject").alias("src"), F.col("filler").alias("dst"), F.col("role").alias("rel"))
        return graph.neighborhood(isa.unionByName(roles), self._codes([code]), depth)

    def similar_concepts(self, code: str, k: int = 10) -> DataFrame:
        return self._similar("concept_vectors", code, k).join(self.table("labels").select(F.col("code").alias("doc_id"), "label"), "doc_id", "left")

    def _similar(self, corpus: str, key: str, k: int) -> DataFrame:
        rows = self.table(corpus)
        source = rows.where(F.col("doc_id") == key)
        if source.isEmpty():
            raise Unavailable(f"{corpus}: no vector for {key}")
        return similarity.top_k(rows, source, k, "doc_id")

    def concept_mappings(self, code: str) -> DataFrame:
        """All mappings with the code at either end, whatever their state."""
        r = self.table("records")
        return r.where((F.col("subject_id") == code) | (F.col("object_id") == code))

    def concept_decomposition(self, code: str) -> DataFrame:
        rows = self.table("constituents").where(F.col("concept") == code)
        return mappings.attach(rows, self.table("records")).join(self.table("labels").select(F.col("code").alias("filler"), "label"), "filler", "left")

    def translate(self, codes: list[str], licensed: bool = False) -> DataFrame:
        return mappings.translate(self._codes(codes), self.table("records"), licensed)

    # data elements
    def search_elements(self, query: str, limit: int = 20) -> DataFrame:
        """Elements with a word for every query term's prefix."""
        rows = self.table("elements")
        terms = text.prefix_terms(query)
        keyed = rows.withColumn("_key", F.concat_ws(":", "public_id", "version"))
        lists = search.postings(keyed, "_key", {c: 1.0 for c in ("short_name", "long_name", "definition", "search_text") if c in rows.columns})
        one = rows.sparkSession.range(1).select(F.lit(1).alias("query_id"), F.array(*[F.lit(t) for t in terms]).cast("array<string>").alias("terms"))
        return keyed.join(search.prefix_and(lists, "_key", one), "_key", "left_semi").drop("_key").orderBy("long_name", "public_id", "version").limit(limit)

    def list_elements(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return concepts.page(self.table("elements"), elements.natural_order(), limit, offset)

    def element(self, public_id: str, version: str | None = None) -> DataFrame:
        rows = self.table("elements").where(F.col("public_id") == public_id)
        return rows.where(F.col("version") == version) if version is not None else elements.latest(rows)

    def similar_elements(self, doc_id: str, k: int = 10) -> DataFrame:
        """Nearest elements by vector; a neighbor without a registry row raises when read."""
        known = self.table("elements").select(F.concat_ws(":", "public_id", "version").alias("doc_id"), "long_name")
        found = self._similar("element_vectors", doc_id, k).join(known, "doc_id", "left")
        return found.withColumn("long_name", F.coalesce("long_name", F.raise_error(F.concat(F.lit("no registry row for "), F.col("doc_id"))).cast("string")))

    def elements_for_concept(self, code: str, limit: int = 50) -> DataFrame:
        return elements.for_concepts(self.table("elements"), self.table("links"), self._codes([code]), limit)

    def element_neighborhood(self, public_id: str, version: str, depth: int = 1) -> DataFrame:
        """Edges from the element to its concepts and around them."""
        mine = (F.col("public_id") == public_id) & (F.col("version") == version)
        own = elements.neighborhood_edges(self.table("links").where(mine), self.table("elements").where(mine))
        isa = self.table("isa").select(F.col("child").alias("src"), F.lit("isa").alias("rel"), F.col("parent").alias("dst"))
        _, around = graph.neighborhood(isa, own.select(F.col("dst").alias("code")), depth)
        return graph.merge_edges(own, around.select("src", "rel", "dst").distinct())

    # runs
    def runs(self) -> DataFrame:
        return self.table("runs").orderBy(F.desc("started_at"), "id")

    def run(self, run_id: str) -> DataFrame:
        return self.table("runs").where(F.col("id") == run_id)

    def minted(self, run_id: str | None = None, status: str | None = None) -> DataFrame:
        rows = self.table("minted")
        rows = rows.where(F.col("run_id") == run_id) if run_id else rows
        return rows.where(F.col("status") == status) if status else rows


def embed(rows: DataFrame, key: str, column: str, encode: Callable[[list[str]], list[list[float]]], size: int) -> DataFrame:
    """``doc_id``, ``embedding``: ``encode`` over batches of texts; a vector of another length, a non-finite or a zero one raises."""
    import math

    import pandas as pd

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            vectors = encode(pdf[column].fillna("").tolist())
            for name, v in zip(pdf[key], vectors, strict=True):
                if len(v) != size or not all(map(math.isfinite, v)) or not any(v):
                    raise ValueError(f"bad vector for {name}")
            yield pd.DataFrame({"doc_id": pd.Series([str(x) for x in pdf[key]], dtype=object), "embedding": [list(map(float, v)) for v in vectors]})

    return rows.select(key, column).mapInPandas(run, "doc_id string, embedding array<float>")
