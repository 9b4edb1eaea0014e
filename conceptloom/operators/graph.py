"""Graph operators over edge tables: closures, walks, neighborhoods, centrality, and consistency of an EL fragment.

Loops run over whole frontiers at once: each round is one equi-join, one distinct and one anti-join, cut into a
checkpoint, so the number of jobs grows with the graph's depth and not with its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptloom import model
from conceptloom.functions import text
from conceptloom.lineage import cut, forget, kept, merge_union


class BoundExceeded(ValueError):
    """A bounded closure would have to go on."""


def closure(edges: DataFrame, source: str = "child", target: str = "parent", max_hops: int | None = None, strict: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """All pairs (``source``, ``target``) joined by one or more edges, without a node's pair with itself, even on cycles.

    ``sources`` (``code``) are where walks begin, every node if left out. ``max_hops`` ends a walk after as many edges; with ``strict``
    a walk that could go on raises. Each round writes its own new pairs only; what has been seen is the union of the rounds."""
    step = kept(edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).distinct())
    first = step.select(F.col("_from").alias(source), F.col("_to").alias(target))
    if sources is not None:
        first = kept(first.join(sources.select(F.col("code").alias(source)).distinct(), source, "left_semi"))
    seen, frontier, hops = [first], first, 1
    while True:
        new = frontier.join(step, frontier[target] == step["_from"]).select(source, F.col("_to").alias(target)).distinct().join(merge_union(*seen), [source, target], "left_anti")
        if max_hops is not None and hops >= max_hops:
            if strict and not new.where(F.col(source) != F.col(target)).isEmpty():
                raise BoundExceeded(f"more than {max_hops} hops")
            break
        frontier = kept(new)
        if frontier.isEmpty():
            forget(frontier)
            break
        seen.append(frontier)
        hops += 1
    return merge_union(*seen).where(F.col(source) != F.col(target))


def descendants(isa: DataFrame, roots: DataFrame) -> DataFrame:
    """``code`` of the roots (column ``code``) and of everything below them."""
    found = frontier = cut(roots.select("code").distinct())
    while True:
        frontier = cut(isa.join(frontier, isa["parent"] == frontier["code"], "left_semi").select(F.col("child").alias("code")).distinct().join(found, "code", "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut(found.unionByName(frontier))


def inherited(isa_closure: DataFrame, relations: DataFrame) -> DataFrame:
    """``part``, ``whole``: relations (``subject``, ``filler``) of a node or of anything above it."""
    own = relations.select(F.col("subject").alias("part"), F.col("filler").alias("whole"))
    above = isa_closure.join(relations, isa_closure["parent"] == relations["subject"]).select(F.col("child").alias("part"), F.col("filler").alias("whole"))
    return own.unionByName(above).distinct()


def part_of_pairs(isa: DataFrame, relations: DataFrame, max_hops: int = 8, parts: DataFrame | None = None) -> DataFrame:
    """Transitive part-of pairs over inherited relations, never reflexive, of all parts or of ``parts`` (``code``); raises where a walk that
    these need goes beyond ``max_hops`` in either direction. Only classes below a relation's subject inherit one, so the walk over
    classes starts there and goes down."""
    down = closure(isa, "parent", "child", max_hops, strict=True, sources=relations.select(F.col("subject").alias("code")))
    return closure(inherited(down, relations), "part", "whole", max_hops, strict=True, sources=parts)


def induced(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """The is-a edges (``child``, ``parent``) on the way up from ``codes`` (``code``): both ends are one of these or above one."""
    up = closure(edges, sources=codes)
    nodes = codes.select("code").unionByName(up.select(F.col("parent").alias("code"))).distinct()
    return edges.select("child", "parent").distinct().join(nodes.select(F.col("code").alias("child")), "child", "left_semi").select("child", "parent")


def ancestor_path_edges(isa: DataFrame, relations: DataFrame, codes: DataFrame) -> DataFrame:
    """``subject``, ``filler``: the relations of ``codes`` and of everything above them."""
    up = closure(isa, sources=codes)
    nodes = codes.select("code").unionByName(up.select(F.col("parent").alias("code"))).distinct()
    return relations.select("subject", "filler").distinct().join(nodes.select(F.col("code").alias("subject")), "subject", "left_semi")


def site_leaves(sites: DataFrame, isa: DataFrame, relations: DataFrame, max_hops: int = 8) -> DataFrame:
    """Of each concept's sites (``concept``, ``filler``) those that no other site of the concept lies under, by class or as a part."""
    fillers = sites.select(F.col("filler").alias("code")).distinct()
    by_class = closure(isa, sources=fillers)
    by_part = part_of_pairs(isa, relations, max_hops, fillers).select(F.col("part").alias("child"), F.col("whole").alias("parent"))
    return leaves(sites, kept(by_class.unionByName(by_part).distinct()), ["concept"])


def leaves(fillers: DataFrame, ancestors: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group (``keys``) the fillers without a strictly narrower one; on cycles all members stay.

    ``fillers`` has ``keys`` and ``filler``; ``ancestors`` has ``child`` and ``parent``."""
    strict = ancestors.join(ancestors.select(F.col("child").alias("parent"), F.col("parent").alias("child")), ["child", "parent"], "left_anti")
    narrower = fillers.select(*keys, F.col("filler").alias("child")).join(strict, "child").select(*keys, F.col("parent").alias("filler")).distinct()
    return fillers.join(narrower, [*keys, "filler"], "left_anti")


def genus_walk(members: DataFrame, roots: DataFrame, max_depth: int = 5, core_roles: tuple[str, ...] = model.CORE_ROLES) -> DataFrame:
    """Roles collected along the genera of defined concepts, all roots at once.

    ``members`` has ``concept``, ``hop`` and either ``genus`` or ``role`` and ``filler``. Depth 0 gives every role, deeper levels
    core roles only; of a root's equal (role, filler) the first seen counts, by depth, then genus, then hop. Result: ``root``,
    ``role``, ``filler``, ``depth``, ``anchoring_genus`` (null at depth 0)."""
    genera = members.where("genus IS NOT NULL").select("concept", "genus").distinct()
    frontier = cut(roots.select(F.col("code").alias("root"), F.col("code").alias("at"), F.lit(0).alias("depth")).distinct())
    seen = frontier
    for depth in range(1, max_depth):
        nxt = frontier.join(genera, frontier["at"] == genera["concept"]).select("root", F.col("genus").alias("at"), F.lit(depth).alias("depth")).distinct().join(seen.select("root", "at"), ["root", "at"], "left_anti")
        frontier = cut(nxt)
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    roles = seen.join(members.where("role IS NOT NULL"), seen["at"] == members["concept"]).where((F.col("depth") == 0) | F.col("role").isin(*core_roles))
    first = Window.partitionBy("root", "role", "filler").orderBy("depth", "at", "hop")
    return roles.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("root", "role", "filler", "depth", F.when(F.col("depth") > 0, F.col("at")).alias("anchoring_genus"))


def resolve_morphology(first_genus: DataFrame, labels: DataFrame, max_steps: int = 5) -> DataFrame:
    """``code``, ``morphology``: the first genus up the chain (``concept``, ``genus``) whose label names no stage; a genus without a label
    goes on, and a chain that returns to a node it has passed ends without a result."""
    named = first_genus.join(labels.select(F.col("code").alias("genus"), "label"), "genus", "left")
    found = first_genus.select(F.col("concept").alias("code"), F.col("concept").alias("at"), F.lit(None).cast("string").alias("morphology"), F.array("concept").alias("path")).distinct()
    for _ in range(max_steps):
        step = found.join(named, (found["at"] == named["concept"]) & found["morphology"].isNull(), "left")
        back = F.array_contains("path", F.coalesce("genus", F.lit("")))
        stop = F.col("genus").isNotNull() & ~back & F.col("label").isNotNull() & ~text.is_staging_label("label")
        found = step.select("code", F.when(F.col("genus").isNotNull() & ~back, F.col("genus")).alias("at"), F.coalesce("morphology", F.when(stop, F.col("genus"))).alias("morphology"), F.when(F.col("genus").isNotNull(), F.array_append("path", F.col("genus"))).otherwise(F.col("path")).alias("path"))
    return found.select("code", "morphology")


def neighborhood(edges: DataFrame, centers: DataFrame, depth: int = 2, cap: int = model.NODE_CAP) -> tuple[DataFrame, DataFrame]:
    """Nodes (``center``, ``code``, ``hop``, ``truncated``) and edges (``center``, ``src``, ``dst``, ``rel``) within ``depth`` hops of each center.

    Edges are followed both ways. At most ``cap`` nodes of a center stay, nearest first and then by code; only edges between
    nodes that stay are given."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    nodes = frontier = cut(centers.select(F.col("code").alias("center"), "code", F.lit(0).alias("hop")).distinct())
    for hop in range(1, depth + 1):
        new = frontier.join(both, frontier["code"] == both["a"]).select("center", F.col("b").alias("code"), F.lit(hop).alias("hop")).distinct()
        frontier = cut(new.join(nodes.select("center", "code"), ["center", "code"], "left_anti"))
        nodes = nodes.unionByName(frontier)
    ranked = nodes.withColumn("_n", F.row_number().over(Window.partitionBy("center").orderBy("hop", "code"))).withColumn("truncated", F.count("*").over(Window.partitionBy("center")) >= cap)
    stay = cut(ranked.where(F.col("_n") <= cap).drop("_n"))
    inside = edges.distinct().join(stay.select("center", F.col("code").alias("src")), "src").join(stay.select("center", F.col("code").alias("dst")), ["center", "dst"], "left_semi")
    return stay, inside.select("center", "src", "dst", "rel").distinct()


def merge_edges(*parts: DataFrame) -> DataFrame:
    """Edges of several neighborhoods by (src, rel, dst); a later part's other columns win."""
    numbered = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    last = Window.partitionBy("src", "rel", "dst").orderBy(F.col("_part").desc())
    return out.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_part")


def degrees(edges: DataFrame) -> DataFrame:
    """``code``, ``degree`` of a directed multigraph without self-loops; both ends count."""
    ends = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("code"))
    return ends.groupBy("code").agg(F.count("*").alias("degree"))


def visible(nodes: DataFrame, edges: DataFrame, hidden_types: DataFrame, hide_isolated: bool = False, hovered: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes (``center``, ``code``, ``semantic_type``) and edges (``center``, ``src``, ``dst``) that a view shows.

    Nodes of a hidden type (``semantic_type``) and, on demand, those without an edge go, but a center stays. With a ``hovered`` code,
    ``dimmed`` marks the nodes that are neither it nor next to it, and only its own edges stay."""
    ends = edges.where("src <> dst").select("center", F.explode(F.array("src", "dst")).alias("code")).distinct()
    off = hidden_types.select("semantic_type", F.lit(True).alias("_off")).distinct()
    rows = nodes.join(off, "semantic_type", "left").join(ends.withColumn("_linked", F.lit(True)), ["center", "code"], "left")
    hides = F.coalesce("_off", F.lit(False)) | (F.lit(hide_isolated) & F.col("_linked").isNull())
    shown = rows.where((F.col("center") == F.col("code")) | ~hides).select(*nodes.columns)
    if hovered is None:
        return shown.withColumn("dimmed", F.lit(False)), edges
    own = edges.where((F.col("src") == hovered) | (F.col("dst") == hovered))
    near = own.select("center", F.explode(F.array("src", "dst")).alias("code")).distinct().withColumn("_near", F.lit(True))
    return shown.join(near, ["center", "code"], "left").withColumn("dimmed", F.col("_near").isNull() & (F.col("code") != hovered)).drop("_near"), own


def spike_walk(members: DataFrame, roots: DataFrame, max_nodes: int = 80, max_depth: int = 80, dropped: tuple[str, ...] = ("Excludes", "May_", "Mapped_")) -> DataFrame:
    """The exploratory walk: ``root``, ``role``, ``filler`` of every genus reached, whatever the depth, up to ``max_nodes`` genera of a root, nearest
    first and then by code; roles whose ``role_label`` holds one of ``dropped`` do not count. ``members`` as for :func:`genus_walk`."""
    genera = kept(members.where("genus IS NOT NULL").select("concept", "genus").distinct())
    frontier = kept(roots.select(F.col("code").alias("root"), F.col("code").alias("at"), F.lit(0).alias("depth")).distinct())
    seen = [frontier]
    for depth in range(1, max_depth):
        frontier = kept(frontier.join(genera, frontier["at"] == genera["concept"]).select("root", F.col("genus").alias("at"), F.lit(depth).alias("depth")).distinct().join(merge_union(*seen).select("root", "at"), ["root", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        seen.append(frontier)
    first = Window.partitionBy("root").orderBy("depth", "at")
    near = merge_union(*seen).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_nodes)
    counts = F.lit(True)
    for word in dropped:
        counts = counts & ~F.coalesce(F.contains("role_label", F.lit(word)), F.lit(False))
    roles = members.where("role IS NOT NULL").where(counts).select("concept", "role", "filler")
    return near.join(roles, near["at"] == roles["concept"]).select("root", "role", "filler").distinct()


def communities(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``code``, ``community`` (its smallest code) by Louvain: nodes move to the neighbours' community of the largest gain in modularity
    until none gains, then communities become nodes, until none moves.

    Edges count without direction, repeated ones each. A round moves a share of the nodes, drawn by hash and smaller with
    every few rounds, so that neighbours rarely change places; ties and draws are fixed, so reruns agree. A level that has not settled
    after ``rounds`` is contracted as it is. What a round leaves is written and read again: a checkpoint would carry the constraints of
    all rounds before it, which the driver holds and which grow with each."""
    merge = lambda df: df.hint("merge")  # noqa: E731  (dozens of rounds: a table that each of them broadcast would stay with the driver)
    ends = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    links = kept(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").cast("double").alias("w")))
    of = kept(links.select(F.col("a").alias("code")).distinct().withColumn("community", F.col("code")))
    whole = links.agg(F.sum("w")).first()[0]
    while whole:
        step = kept(links.groupBy("a").agg(F.sum("w").alias("k")).select("a", F.col("a").alias("c"), "k"))
        now, near_links = step, links.where("a <> b")
        for i in range(rounds):
            total = now.groupBy("c").agg(F.sum("k").alias("total"))
            near = near_links.join(merge(now.select(F.col("a").alias("b"), "c")), "b").select("a", "c", "w").unionByName(now.select("a", "c", F.lit(0.0).alias("w"))).groupBy("a", "c").agg(F.sum("w").alias("w"))
            options = near.join(merge(total), "c").join(merge(now.select("a", F.col("c").alias("own"), "k")), "a")
            gain = F.round(F.col("w") - F.col("k") * (F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / whole, 9)
            best = options.withColumn("gain", gain).groupBy("a", "own", "k").agg(F.min(F.struct((-F.col("gain")).alias("loss"), (F.col("c") != F.col("own")).alias("other"), "c")).alias("best"))
            drawn = F.pmod(F.xxhash64("a", F.lit(i)), F.lit(2 + i // 6)) == 0
            before, step = step, kept(best.select("a", F.col("best.c").alias("wish"), "own", "k", drawn.alias("drawn")))
            forget(before)
            now = step.select("a", F.when(F.col("drawn"), F.col("wish")).otherwise(F.col("own")).alias("c"), "k")
            if step.where("wish <> own").isEmpty():
                break
        if now.where("a <> c").isEmpty():
            break
        old = of, links, step
        of = kept(of.join(merge(now.select(F.col("a").alias("community"), "c")), "community").select("code", F.col("c").alias("community")))
        links = kept(links.join(merge(now.select("a", "c")), "a").join(merge(now.select(F.col("a").alias("b"), F.col("c").alias("d"))), "b").groupBy(F.col("c").alias("a"), F.col("d").alias("b")).agg(F.sum("w").alias("w")))
        forget(*old)
    least = of.groupBy("community").agg(F.min("code").alias("least"))
    return of.join(least, "community").select("code", F.col("least").alias("community"))


def betweenness(edges: DataFrame, key: str = "center") -> DataFrame:
    """``key``, ``code``, ``betweenness`` (normalized, directed, by shortest paths) within each group, such as a neighborhood of capped size."""
    import pandas as pd

    def brandes(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["src"]) | set(pdf["dst"]))
        out: dict[str, set[str]] = {n: set() for n in nodes}
        for s, d in zip(pdf["src"], pdf["dst"], strict=True):
            if s != d:
                out[s].add(d)
        score = dict.fromkeys(nodes, 0.0)
        for s in nodes:
            reached, before, paths, dist = [], {n: [] for n in nodes}, dict.fromkeys(nodes, 0.0), {s: 0}
            paths[s] = 1.0
            queue = [s]
            for v in queue:
                reached.append(v)
                for w in sorted(out[v]):
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        queue.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += paths[v]
                        before[w].append(v)
            share = dict.fromkeys(nodes, 0.0)
            for w in reversed(reached):
                for v in before[w]:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
                if w != s:
                    score[w] += share[w]
        n = len(nodes)
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        return pd.DataFrame({key: [pdf[key].iloc[0]] * n, "code": nodes, "betweenness": [score[x] * scale for x in nodes]})

    return edges.select(key, "src", "dst").groupBy(key).applyInPandas(brandes, f"{key} string, code string, betweenness double")


def unsatisfiable(subclass: DataFrame, equivalent: DataFrame, disjoint: DataFrame) -> DataFrame:
    """``code`` of classes that lie, by subclass edges (``child``, ``parent``) and equivalences (``a``, ``b``), under both sides of a
    disjoint pair (``a``, ``b``)."""
    edges = subclass.select("child", "parent").unionByName(equivalent.select(F.col("a").alias("child"), F.col("b").alias("parent"))).unionByName(equivalent.select(F.col("b").alias("child"), F.col("a").alias("parent"))).where("child <> parent")
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("child")).unionByName(disjoint.select(F.explode(F.array("a", "b")).alias("child"))).distinct()
    reach = cut(closure(edges).unionByName(nodes.select("child", F.col("child").alias("parent"))))
    left = reach.join(disjoint, reach["parent"] == disjoint["a"]).select("child", "b")
    return left.join(reach.select("child", F.col("parent").alias("b")), ["child", "b"], "left_semi").select(F.col("child").alias("code")).distinct()


def corroboration(pairs: DataFrame, ncit: DataFrame, upstream: DataFrame, anchors: DataFrame) -> DataFrame:
    """``subject``, ``object``, ``verdict``: whether ancestors of the subject that are anchored upstream are reached from the object.

    ``ncit`` and ``upstream`` are edges (``child``, ``parent``), the latter of any kind; ``anchors`` has ``code``, ``curie``."""
    up = closure(ncit, sources=pairs.select(F.col("subject").alias("code")))
    images = pairs.join(up, pairs["subject"] == up["child"]).join(anchors, F.col("parent") == anchors["code"]).select("subject", "object", F.col("curie").alias("image")).distinct()
    there = closure(upstream, sources=pairs.select(F.col("object").alias("code"))).select(F.col("child").alias("object"), F.col("parent").alias("image"), F.lit(True).alias("hit"))
    told = images.join(there, ["object", "image"], "left").groupBy("subject", "object").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"))
    return pairs.join(told, ["subject", "object"], "left").select("subject", "object", F.when(F.col("hit").isNull(), "NO_ANCHORED_ANCESTOR").when(F.col("hit"), "CORROBORATED").otherwise("NOT_ENTAILED").alias("verdict"))


def defined_walk(members: DataFrame, roots: DataFrame, max_depth: int = 10, max_hops: int = 15) -> DataFrame:
    """The research variant of :func:`genus_walk`: it goes on into genera only that are defined themselves (have members), reads the first row
    of each hop only, and keeps every role. Result: ``root``, ``role``, ``filler``, ``depth``."""
    first = Window.partitionBy("concept", "hop").orderBy(F.col("genus").asc_nulls_last(), "role", "filler")
    rows = cut(members.where(F.col("hop") < max_hops).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))
    genera = rows.where("genus IS NOT NULL").join(rows.select(F.col("concept").alias("genus")).distinct(), "genus", "left_semi").select("concept", "genus")
    frontier = seen = cut(roots.select(F.col("code").alias("root"), F.col("code").alias("at"), F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_depth):
        frontier = cut(frontier.join(genera, frontier["at"] == genera["concept"]).select("root", F.col("genus").alias("at"), F.lit(depth).alias("depth")).distinct().join(seen.select("root", "at"), ["root", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen.join(rows.where("role IS NOT NULL"), F.col("at") == F.col("concept")).groupBy("root", "role", "filler").agg(F.min("depth").alias("depth"))
