"""Detection and decomposition of concepts that fuse several meanings into (axis, filler) constituents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptloom import model
from conceptloom.functions import text
from conceptloom.lineage import cut


def detect(concepts: DataFrame, roles: DataFrame, scope: tuple[str, ...] = model.IN_SCOPE_TYPES, min_axes: int = 2) -> DataFrame:
    """``code``, ``axes``, ``in_scope``, ``semantic_type``, ``is_precoordinated``.

    ``concepts``: ``code``, ``semantic_types``, ``label``, ``has_morphology``; ``roles``: ``code``, ``role``, ``role_label``. Axes are the distinct
    defining roles, a parent morphology and a label of many aspects, one each."""
    defining = roles.where(text.is_defining_role("role", "role_label")).groupBy("code").agg(F.count_distinct("role").alias("n_roles"))
    wanted = F.array(*[F.lit(s) for s in scope])
    inside = F.coalesce(F.arrays_overlap("semantic_types", wanted), F.lit(False))
    rows = concepts.join(defining, "code", "left").withColumn("axes", (F.coalesce("n_roles", F.lit(0)) + F.coalesce("has_morphology", F.lit(False)).cast("int") + text.has_many_aspects("label").cast("int")).cast("long"))
    kind = F.coalesce(F.array_min(F.filter("semantic_types", lambda t: t.isin(*scope))), F.array_min("semantic_types"))
    return rows.select("code", "axes", inside.alias("in_scope"), kind.alias("semantic_type"), (inside & (F.col("axes") >= min_axes)).alias("is_precoordinated"))


def routed_axis(role: Column | str = "role", filler: Column | str = "filler", genus: Column | str = "anchoring_genus", lineage: tuple[str, ...] = model.LINEAGE_GENERA, stages: tuple[str, ...] = model.STAGE_SYSTEMS) -> Column:
    """The axis of a restriction: sites under a generic lineage genus and stage systems have their own."""
    role, filler, genus = (F.col(x) if isinstance(x, str) else x for x in (role, filler, genus))
    return F.when((role == "R101") & F.coalesce(genus.isin(*lineage), F.lit(False)), "lineage").when((role == "R88") & filler.isin(*stages), "stage_system").otherwise(role)


def select_constituents(routed: DataFrame, ancestors: DataFrame, types: DataFrame | None = None, organs: DataFrame | None = None, organ_type: str = model.ORGAN_TYPE, site: str = "R101") -> DataFrame:
    """``concept``, ``axis``, ``filler``, ``most_specific``, ``needs_review``, ``grp`` (group name or null).

    ``routed``: distinct ``concept``, ``axis``, ``filler``; ``ancestors``: ``child``, ``parent``; ``types``: ``code``, ``semantic_type`` of fillers; ``organs``:
    ``concept``, ``organ`` known from its morphology. Each axis keeps its most specific fillers, the lineage axis all. A known
    organ among several sites stands alone; else sites that are no organs make an axis of their own, ``region``."""
    routed = cut(routed.select("concept", "axis", "filler").distinct())
    strict = ancestors.join(ancestors.select(F.col("child").alias("parent"), F.col("parent").alias("child")), ["child", "parent"], "left_anti")
    above = cut(routed.join(strict.select(F.col("child").alias("filler"), "parent"), "filler"))
    wider = above.where("axis <> 'lineage'").select("concept", "axis", F.col("parent").alias("filler")).distinct()
    kept = routed.join(wider, ["concept", "axis", "filler"], "left_anti")
    per_axis = Window.partitionBy("concept", "axis")
    kept = kept.withColumn("n", F.count("*").over(per_axis))
    if organs is not None:
        kept = kept.join(organs.select("concept", "organ"), "concept", "left")
        known = F.max(F.when((F.col("axis") == site) & (F.col("filler") == F.col("organ")), 1).otherwise(0)).over(per_axis)
        kept = kept.withColumn("known", (known == 1) & (F.col("n") > 1) & (F.col("axis") == site)).where(~F.col("known") | (F.col("filler") == F.col("organ"))).drop("organ")
    else:
        kept = kept.withColumn("known", F.lit(False))
    if types is not None:
        is_organ = types.where(F.col("semantic_type") == organ_type).select(F.col("code").alias("filler"), F.lit(True).alias("is_organ")).distinct()
        kept = kept.join(is_organ, "filler", "left").withColumn("is_organ", F.coalesce("is_organ", F.lit(False)))
    else:
        kept = kept.withColumn("is_organ", F.lit(True))
    regions = F.count_if(~F.col("is_organ")).over(per_axis)
    split = (F.col("axis") == site) & ~F.col("known") & (F.col("n") > 1) & (regions > 0)
    kept = kept.withColumn("axis", F.when(split & ~F.col("is_organ"), "region").otherwise(F.col("axis")))
    kept = kept.withColumn("n", F.when(F.col("known"), 1).otherwise(F.count("*").over(per_axis)))
    narrower = above.join(routed.select("concept", F.col("filler").alias("parent")).distinct(), ["concept", "parent"], "left_semi").select("concept", "filler", F.lit(True).alias("narrow")).distinct()
    grouped = F.col("axis").isin("lineage", "region") & (F.col("n") > 1)
    return kept.join(narrower, ["concept", "filler"], "left").select("concept", "axis", "filler", F.coalesce("narrow", F.lit(False)).alias("most_specific"), ((F.col("n") > 1) & ~grouped).alias("needs_review"), F.when(grouped, F.concat(F.col("axis"), F.lit(":"), F.col("concept"))).alias("grp"))


def comparison_fillers(routed: DataFrame) -> DataFrame:
    """``filler`` of every axis but lineage that has several: the ones whose order matters."""
    many = routed.where("axis <> 'lineage'").groupBy("concept", "axis").agg(F.count_distinct("filler").alias("n")).where("n > 1")
    return routed.join(many, ["concept", "axis"], "left_semi").select("filler").distinct()


def ambiguous_axes(routed: DataFrame) -> DataFrame:
    """``concept``, ``axis``, ``fillers`` (sorted): axes of a concept with more than one filler, which a person has to look at."""
    return routed.groupBy("concept", "axis").agg(F.array_sort(F.collect_set("filler")).alias("fillers")).where(F.size("fillers") > 1)


def label_constituents(labels: DataFrame, known: DataFrame) -> DataFrame:
    """``code``, ``axis``, ``surface``, ``polarity``, ``filler``: aspects of labels, resolved by exact label or minted; negative ones are always minted."""
    aspects = labels.select("code", F.explode(text.label_aspects("label")).alias("a")).select("code", "a.*")
    names = known.groupBy(text.normalized_label("label").alias("name")).agg(F.min("code").alias("found"))
    joined = aspects.withColumn("name", text.normalized_label("surface")).join(names, "name", "left")
    said = F.when(F.col("polarity") == "negative", F.concat(F.lit("Without "), F.col("surface"))).otherwise(F.col("surface"))
    filler = F.when((F.col("polarity") == "positive") & F.col("found").isNotNull(), F.col("found")).otherwise(text.mint_id(F.col("axis"), said))
    return joined.select("code", "axis", "surface", "polarity", filler.alias("filler"))


def residual(constituents: DataFrame, detected: DataFrame) -> DataFrame:
    """One row ``decomposed``, ``residual``, ``rate``: concepts one of whose fillers, minted ones aside, is itself precoordinated."""
    still = constituents.where(~F.startswith("filler", F.lit("MINT-"))).join(detected.where("is_precoordinated").select(F.col("code").alias("filler")), "filler", "left_semi")
    n = constituents.agg(F.count_distinct("concept").alias("decomposed"))
    r = still.agg(F.count_distinct("concept").alias("residual"))
    return n.crossJoin(r).select("decomposed", "residual", F.coalesce(F.try_divide("residual", "decomposed"), F.lit(0.0)).alias("rate"))


def score(expected: DataFrame, actual: DataFrame, review: DataFrame) -> DataFrame:
    """One row of precision, recall, F1 over (``axis``, ``filler``) pairs; pairs under ``review`` count on neither side but in ``deferred``; nothing
    expected or found counts as 1."""
    e, a = expected.select("axis", "filler").distinct().withColumn("e", F.lit(True)), actual.select("axis", "filler").distinct().withColumn("a", F.lit(True))
    flagged = review.select("axis", "filler").distinct().withColumn("r", F.lit(True))
    j = e.join(a, ["axis", "filler"], "full").join(flagged, ["axis", "filler"], "left")
    live = F.col("r").isNull()
    counts = j.agg(F.count_if(live & F.col("e") & F.col("a")).alias("tp"), F.count_if(live & F.col("a") & F.col("e").isNull()).alias("fp"), F.count_if(live & F.col("e") & F.col("a").isNull()).alias("fn"), F.count_if(~live).alias("deferred"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(1.0))
    both = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def fold(rows: DataFrame) -> DataFrame:
    """Stored rows (``concept``, ``status``, ``date``, ``axis``, ``filler``, ``most_specific`` text, ``ord``) to one row per concept: first status and date, of equal
    (axis, filler) the last, in order."""
    last = rows.where("axis IS NOT NULL AND filler IS NOT NULL").groupBy("concept", "axis", "filler").agg(F.max_by(F.col("most_specific").isin("true", "1"), "ord").alias("most_specific"))
    nested = last.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("axis", "filler", "most_specific"))).alias("constituents"))
    head = rows.groupBy("concept").agg(F.min_by("status", F.when(F.col("status").isNotNull(), F.col("ord"))).alias("status"), F.min_by("date", F.when(F.col("date").isNotNull(), F.col("ord"))).alias("date"))
    return head.join(nested, "concept", "left")
