"""Exact nearest neighbors by cosine similarity for a bounded set of query vectors, in blocks: each block of ``BLOCK`` queries is one
pass over all rows, so that this is for few queries (``MOST`` at most; more raise)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptloom.functions import vectors

#: Queries of one block; a block's vectors go to every task.
BLOCK = 2000
#: Queries of one call.
MOST = 200_000


def valid(rows: DataFrame, column: str, size: int) -> DataFrame:
    return rows.where(vectors.is_valid(F.col(column), size))


def top_k(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id``, ``key``, ``score``: for each query (``key``, ``column``) the ``k`` most similar other rows, ties by id.

    Queries are taken in blocks of ``BLOCK``; each task keeps its own ``k`` best of a block before anything is shuffled."""
    kind = rows.schema[key].dataType.simpleString()
    if (n := queries.count()) > MOST:
        raise ValueError(f"{n} queries; {MOST} at most in one call")
    ids = queries.select(key, column).orderBy(key)
    found, after = None, None
    while True:
        block = (ids if after is None else ids.where(F.col(key) > after)).limit(BLOCK).collect()
        if not block:
            break
        after = block[-1][0]
        names = [r[0] for r in block]
        matrix = np.array([r[1] for r in block], dtype=np.float64)
        norms = np.linalg.norm(matrix, axis=1)

        def best(batches, names=names, matrix=matrix, norms=norms):  # noqa: ANN001, ANN202
            for pdf in batches:
                own = np.array(pdf[column].tolist(), dtype=np.float64)
                if not len(own):
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = (matrix @ own.T) / np.outer(norms, np.linalg.norm(own, axis=1))
                keys = pdf[key].to_numpy(dtype=object)
                found: list[tuple] = []
                for q, row in zip(names, scores, strict=True):
                    ok = np.flatnonzero((keys != q) & np.isfinite(row))
                    top = ok[np.lexsort((keys[ok], -row[ok]))[:k]]
                    found += zip([q] * len(top), keys[top], row[top].tolist(), strict=True)
                yield pd.DataFrame({name: pd.Series([r[i] for r in found], dtype=object) for i, name in enumerate(("query_id", key, "score"))})

        part = rows.select(key, column).mapInPandas(best, f"query_id {kind}, {key} {kind}, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
        part = part.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
        found = part if found is None else found.unionByName(part)
        if len(block) < BLOCK:
            break
    if found is None:
        return rows.where(F.lit(False)).select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("score"))
    return found
