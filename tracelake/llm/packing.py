"""Filling fixed-capacity containers with items (cost-balanced packing).

Method. An item of n tokens costs n + n^2 / ``attention`` (linear work plus attention). Items in descending order go to the
lowest-cost container that still has room for them; where none has, a new one is opened. It starts with as many
containers as the tokens fill. An item over the capacity is cut into full containers and a rest, no other item is cut.

Scale. Items, counted after cutting, are spread by hash over shards of about ``SHARD``, each packed by one task with a vector of
containers; a shard leaves at most a few containers unfilled, so the loss falls with the shard size and the work is linear in the
number of shards. Only (id, size) is shuffled, once, into as many partitions as there are shards (adaptive execution may not
merge them). The hash is of the row's number as well as its key, so repeated keys and hot sources are spread alike.

Defined results. Items of no tokens (NULL and empty texts) are put nowhere. Repeated rows are items of their own. Ties in size go by key,
ties in cost to the earlier container. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 20_000
ATTENTION = 4096.0
PACKED = "key bigint, part int, n_tokens bigint, token_start bigint, shard int, container int, n_in bigint"


def assign(sizes: np.ndarray, capacity: int, attention: float = ATTENTION) -> np.ndarray:
    """Container of every item; the sizes must be in descending order and none over the capacity."""
    count = max(1, -(-int(sizes.sum()) // capacity))
    room = np.full(max(16, 2 * count), capacity, dtype=np.int64)
    cost = np.full(len(room), np.inf)
    cost[:count] = 0.0
    out = np.empty(len(sizes), dtype=np.int64)
    for i, n in enumerate(sizes.tolist()):
        ways = np.where(room[:count] >= n, cost[:count], np.inf)
        k = int(ways.argmin())
        if not np.isfinite(ways[k]):
            k, count = count, count + 1
            if count > len(room):
                room = np.concatenate([room, np.full(len(room), capacity, dtype=np.int64)])
                cost = np.concatenate([cost, np.full(len(cost), np.inf)])
            cost[k] = 0.0
        out[i] = k
        room[k] -= n
        cost[k] += n + n * n / attention
    return out


def items(sizes: DataFrame, capacity: int) -> DataFrame:
    """(key, n_tokens) -> items that fit, with the number of their row: whole ones, and the parts of those over the capacity."""
    parts = F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))
    cut = sizes.where("n_tokens > 0").select("key", F.col("n_tokens").alias("whole"), F.monotonically_increasing_id().alias("row"), F.explode(parts).alias("part"))
    start = F.col("part").cast("bigint") * capacity
    return cut.select("key", "row", "part", F.least(F.lit(capacity), F.col("whole") - start).cast("bigint").alias("n_tokens"), start.alias("token_start"))


def pack(sizes: DataFrame, capacity: int, attention: float = ATTENTION, shard: int = SHARD) -> DataFrame:
    """One row per item: its shard and container, and the number of items in that container.

    ``sizes`` is read twice (to count the items and to pack them), so give a table, not a long computation.
    """
    n_items = sizes.where("n_tokens > 0").agg(F.sum(F.ceil(F.col("n_tokens") / capacity))).first()[0] or 0
    shards = max(1, int(n_items) // shard)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "key", "row", "part"], ascending=[False, True, True, True], kind="stable")
        pdf["container"] = assign(pdf["n_tokens"].to_numpy(), capacity, attention)
        pdf["n_in"] = pdf.groupby("container")["key"].transform("size")
        return pdf[["key", "part", "n_tokens", "token_start", "shard", "container", "n_in"]]

    placed = items(sizes, capacity).withColumn("shard", F.pmod(F.xxhash64("key", "row", "part"), F.lit(shards)).cast("int"))
    return placed.repartition(shards, "shard").groupBy("shard").applyInPandas(run, PACKED)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens and unused space of every shard and of all (shard NULL), beside the fewest containers that could do."""
    bins = packed.groupBy("shard", "container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_items"), F.sum(F.col("n_tokens") + F.col("n_tokens") * F.col("n_tokens") / ATTENTION).alias("cost"))
    grouped = bins.rollup("shard").agg(F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("max_tokens"), F.max("cost").alias("max_cost"), F.avg("cost").alias("mean_cost"))
    return grouped.withColumn("least_containers", F.ceil(F.col("n_tokens") / capacity)).withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * capacity))
