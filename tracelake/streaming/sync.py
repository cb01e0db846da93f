"""Incremental synchronisation of a trace store, and event-time windows over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, path_exists


def sync(source: DataFrame, folder: str, key: str, kind: str, root_kind: str, order: str) -> None:
    """New rows of a stream into two stores (roots and the rest), each id once, whenever it comes.

    What is known is the store itself: an epoch keeps of every new id the root row, else the row least by ``order``, and leaves
    out ids that are stored already, by an anti-join on the ids alone. No state grows beside the store and no row is too late. An
    epoch writes to folders of its own name, overwritten if it is replayed, so files and checkpoint agree after any failure. Rows
    without an id always go through.
    """

    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        rank = F.struct((~F.col(kind).eqNullSafe(root_kind)).alias("r"), F.col(order).alias("o"))
        cols = df.columns
        first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), rank).alias("row")).select("row.*")
        for store in ("roots", "rest"):
            if path_exists(spark, f"{folder}/{store}"):
                known = spark.read.option("basePath", f"{folder}/{store}").parquet(f"{folder}/{store}").where(F.col("sync_epoch") < epoch).select(key)
                first = first.join(known, key, "left_anti")
        new = materialise(first.unionByName(df.where(F.col(key).isNull())), "epoch")
        new.where(F.col(kind) == root_kind).write.mode("overwrite").parquet(f"{folder}/roots/sync_epoch={epoch}")
        new.where(F.coalesce(F.col(kind) != root_kind, F.lit(True))).write.mode("overwrite").parquet(f"{folder}/rest/sync_epoch={epoch}")

    q = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def synced(spark: SparkSession, folder: str, store: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/{store}").parquet(f"{folder}/{store}")


def windowed(source: DataFrame, folder: str, event_time: str, window, by: list[str], aggs: list, delay: str = "1 day", sessions: bool = False) -> DataFrame:
    """An event-time aggregate of everything the stream has now, closed windows and open ones.

    Each epoch writes the windows it changed, and the latest state of a window is the result; windows behind the watermark leave
    the state. Session windows may merge, which Spark can't report as changes, so with ``sessions`` the whole result is written
    each epoch and the state keeps all sessions.
    """
    spark = source.sparkSession
    grouped = source.withWatermark(event_time, delay).groupBy(window.alias("w"), *by).agg(*aggs)

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/state/sync_epoch={0 if sessions else epoch}")

    q = grouped.writeStream.foreachBatch(write).outputMode("complete" if sessions else "update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.option("basePath", f"{folder}/state").parquet(f"{folder}/state")
    values = [c for c in out.columns if c not in ("w", "sync_epoch", *by)]
    last = out.groupBy("w", *by).agg(F.max_by(F.struct(*values), F.col("sync_epoch")).alias("v")).select("w", *by, "v.*")
    return last.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *by, *values)
