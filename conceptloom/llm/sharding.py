"""Sharding by balanced label propagation, with DataFrame operations only.

Documents start at random shards. In each round about half of the linked documents, chosen by a hash, ask for the shard
where most of their neighbours are; a shard takes as many as its quota of rows leaves room for, those that leave it in
the same round counted, chosen by a hash too, so that no task has to rank them. What is left is settled exactly: within each shard linked documents come first, a shard
keeps its target number of rows, and the rest, as a rule unlinked, fill the shards with room. Ranks come from counts of
hash ranges and from row numbers within a range; only the shards' eight counts reach the driver.

The law kept is ``rows``: the shards' counts are at most one apart.

Defined results: a null text counts as empty (and links to other empty ones); repeated rows link; a null id is hashed like
any other value and starts no link of its own; an empty table gives an empty table; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptloom.llm.common import written

SHARDS, ROUNDS, SLACK = 8, 8, 0.02
#: Rows of one range of the final ranking.
RANGE_ROWS = 4096


def _draw(node: Column | str, salt: int) -> Column:
    """A number from 0 up to 1 by hash."""
    return F.pmod(F.xxhash64(node, F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def equal_text_links(nodes: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) from each node to the smallest one with the same ``digest``: as many as there are copies."""
    hubs = nodes.groupBy("digest").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("digest", "b")
    hubs = written(hubs, "hubs")  # so that the join may split a digest's rows
    return nodes.join(hubs, "digest").where("node <> b").select(F.col("node").alias("a"), "b")


def _sums(moves: list[tuple[int, int, float]], by: int) -> dict[int, float]:
    """Moved rows by the shard that is left (0) or entered (1)."""
    out: dict[int, float] = {}
    for move in moves:
        out[move[by]] = out.get(move[by], 0) + move[2]
    return out


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """``node``, ``shard`` after the rounds, for the linked nodes only. ``nodes`` has ``node``; shards hold at most (1 + slack) times their share."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    start = F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(shards)).cast("int")
    total = [0] * shards
    for r in nodes.groupBy(start.alias("shard")).count().collect():
        total[r["shard"]] = r["count"]
    room_for = (1 + slack) * sum(total) / shards + 1
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("shard", start), "labels")
    for k in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("b"), "shard"), "b").groupBy("a", "shard").count()
        # of equally common shards the own one, else one by hash
        seen = votes.select(F.col("a").alias("node"), F.col("shard").alias("to"), "count").join(labels, "node")
        best = seen.groupBy("node").agg(F.max(F.struct("count", (F.col("to") == F.col("shard")).alias("own"), F.xxhash64("node", "to").alias("draw"), "to")).alias("best")).select("node", F.col("best.to").alias("to"))
        asked = written(labels.join(best, "node").withColumn("asks", (F.col("to") != F.col("shard")) & (_draw("node", 2 * k) < 0.5)), "asked")
        moves = [(r["shard"], r["to"], r["count"]) for r in asked.where("asks").groupBy("shard", "to").count().collect()]
        wanted = _sums(moves, 1)
        if not wanted:
            if k and not asked.where("to <> shard").limit(1).count():
                break
            continue
        taken = dict.fromkeys(wanted, 1.0)  # the share of its requests that a shard takes: its room and what leaves it
        for _ in range(50):
            leaves = _sums([(s, t, n * taken[t]) for s, t, n in moves], 0)
            taken = {t: min(1.0, max(0.0, room_for - total[t] + leaves.get(t, 0.0)) / n) for t, n in wanted.items()}
        chance = F.create_map(*[x for t, share in taken.items() for x in (F.lit(t), F.lit(share))])
        goes = F.col("asks") & (_draw("node", 2 * k + 1) < F.element_at(chance, F.col("to")))
        labels = written(asked.select("node", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"), F.when(goes, F.col("shard")).alias("left")), "labels")
        for r in labels.where("left IS NOT NULL").groupBy("left", "shard").count().collect():
            total[r["left"]] -= r["count"]
            total[r["shard"]] += r["count"]
        labels = labels.drop("left")
    return labels


def settle(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``placed`` (``node``, ``shard``, ``linked``, any other columns) with the final ``shard`` and its gapless ``slot``; counts at most one apart."""
    ranges = max(1, -(-placed.count() // (RANGE_ROWS * shards)))
    placed = placed.withColumn("_range", F.pmod(F.xxhash64("node", "tie"), F.lit(ranges)) + F.when(F.col("linked"), 0).otherwise(ranges))
    counts = written(placed.groupBy("shard", "_range").count(), "counts")
    has = [0] * shards
    for r in counts.groupBy("shard").agg(F.sum("count").alias("n")).collect():
        has[r["shard"]] = r["n"]
    target = [sum(has) // shards + (s < sum(has) % shards) for s in range(shards)]
    base = counts.select(F.col("shard").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ranked = placed.withColumn("_row", F.row_number().over(Window.partitionBy("shard", "_range").orderBy("node", "tie")) - 1)
    ranked = ranked.join(base, (ranked["shard"] == base["_s"]) & (ranked["_range"] == base["_r"])).withColumn("_rank", F.col("_row") + F.col("_base"))
    table = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard") + 1)
    over, room = [max(0, h - t) for h, t in zip(has, target, strict=True)], [max(0, t - h) for h, t in zip(has, target, strict=True)]
    excess = F.col("_rank") - table(target) + table([sum(over[:s]) for s in range(shards)])
    shard, slot = F.col("shard"), F.col("_rank")
    for s in range(shards):
        first = sum(room[:s])
        moves = (F.col("_rank") >= table(target)) & (excess >= first) & (excess < first + room[s])
        shard, slot = F.when(moves, F.lit(s)).otherwise(shard), F.when(moves, excess - first + has[s]).otherwise(slot)
    return ranked.withColumn("_shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop("shard", "_s", "_r", "_base", "_row", "_rank", "_range").withColumnRenamed("_shard", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``; equal texts are drawn to one shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("tie")), "rows")
    rows = rows.withColumn("node", F.coalesce(F.col("doc_id").cast("long"), -1 - F.col("tie")))
    labels = propagate(rows, equal_text_links(rows), shards, rounds)
    start = F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(shards)).cast("int")
    placed = rows.join(labels, "node", "left").withColumn("linked", F.col("shard").isNotNull()).withColumn("shard", F.coalesce("shard", start))
    return settle(placed, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
