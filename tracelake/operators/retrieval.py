"""Top-k retrieval by cosine over an array column: a stated query set against all rows, in blocks of vectors.

Both sides are packed into blocks by hash; every pair of blocks is one matrix product, of which only the k best rows per
query are kept before the final cut. Nothing is broadcast; memory is bounded by the two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def _packed(vectors: DataFrame, key: str, vector: str, tag: str, block: int) -> DataFrame:
    n = max(1, -(-vectors.count() // block))
    b = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias("b"))
    return b.groupBy("b").agg(F.collect_list("id").alias(f"{tag}_ids"), F.collect_list("v").alias(f"{tag}_vs")).drop("b")  # at most about BLOCK rows


def top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, exclude_self: bool = True, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, row_id, score): the k nearest rows of every query; ties go to the lesser id.

    Vectors of no length have similarity 0; NULL vectors are left out.
    """

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                q, x = np.stack(r.q_vs).astype(np.float64), np.stack(r.x_vs).astype(np.float64)
                for m in (q, x):
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    np.divide(m, norm, out=m, where=norm > 0)
                qi, xi = np.asarray(r.q_ids), np.asarray(r.x_ids)
                order = np.argsort(xi, kind="stable")
                xi, score = xi[order], q @ x[order].T
                if exclude_self:
                    score[qi[:, None] == xi[None, :]] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                out = pd.DataFrame({"query_id": np.repeat(qi, top.shape[1]), "row_id": xi[top].ravel(), "score": np.take_along_axis(score, top, axis=1).ravel()})
                yield out[np.isfinite(out["score"])]

    pairs = _packed(queries, key, vector, "q", block).crossJoin(_packed(rows, key, vector, "x", block))
    near = pairs.mapInPandas(best, "query_id bigint, row_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
