"""Exactly one copy of messages that were delivered at least once.

Method. A Structured Streaming query keeps the first delivery seen so far of every identifier in a keyed state store
(RocksDB, so that the state may outgrow memory). Whichever of the stored and the arriving delivery is later is emitted
as dropped, so the result doesn't depend on the order in which files arrive. An identifier expires once the event-time
watermark has passed its last delivery by ``keep_ms``; the store's checkpoint and the output are committed by the same
epoch, hence neither is ever ahead of the other. Beside the dropped deliveries the stream emits the ones it keeps and the
identifiers that expire: this log is the archive.

Late-arrival lookup: only deliveries the state could not judge are looked up in the archive. These are rows without an event time, rows
behind the watermark (the query's progress tells whether there were any; a note of each run keeps it across restarts, and a
run that didn't end counts as having had some), and deliveries kept under an identifier after it had expired. They are compared with what was kept under their own identifiers, nothing else.

Scale. The stream shuffles narrow columns once. Copies are folded before the shuffle (per Arrow batch), so a hot
identifier reaches its state once per batch and the copies that fell away are spread evenly. Identifiers are stored in
hash buckets, each one state entry that is merged in vectors. A bucket holds the identifiers of the time until expiry, not of all
time; the number of buckets is fixed when a checkpoint is begun, from the size of the files there are then or as given.

Defined results. Identifiers are equal without blanks and hyphens and ignoring case. NULL or blank identifiers
(also those of hyphens only) are never duplicates. The first delivery is the least (event time, delivery id); a NULL
event time comes after all others. Repeated delivery ids are told apart by nothing: give unique ones. An empty source
gives no rows.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import new_path, path_exists, path_size

NEVER = (1 << 63) - 1
#: State on disk beside memory, and the progress of all epochs of a run.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.numRecentProgressUpdates": "1000000",
}
LOG = "verdict string, key string, at bigint, delivery_id bigint, mark bigint"
BUCKET_BYTES = 1 << 19
_starting = threading.Lock()


def delivery_key(c: Column | str) -> Column:
    """The identifier without blanks and hyphens in lower case; NULL if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.lower(c), r"(?U)[\s\-]+", ""), F.lit(""))


def micros(c: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone is."""
    t = f"cast({c} as timestamp_ntz)"
    return F.expr(f"unix_date(cast({t} as date)) * 86400000000L + (hour({t}) * 3600L + minute({t}) * 60L) * 1000000L + cast(extract(SECOND FROM {t}) * 1000000 as bigint)")


def _narrow(df: DataFrame, id_col: str, time_col: str, delivery_col: str) -> DataFrame:
    return df.select(delivery_key(id_col).alias("key"), F.coalesce(micros(time_col), F.lit(NEVER)).alias("at"), F.col(delivery_col).cast("bigint").alias("delivery_id")).where("key is not null")


def _prefold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mark the copies that lose within one Arrow batch already."""
    for part in parts:
        part = part.sort_values(["key", "at", "delivery_id"], kind="stable")
        yield part.assign(lost=part["key"].duplicated())


def _log(rows: pd.DataFrame, verdict: str, mark: int) -> pd.DataFrame:
    """Rows of the archive; only kept and expired ones need their identifier later."""
    out = rows[["key", "at", "delivery_id"]].assign(verdict=verdict, mark=mark)
    return out.assign(key=None)[LOG_COLUMNS] if verdict == "dropped" else out[LOG_COLUMNS]


LOG_COLUMNS = [c.split(" ")[0] for c in LOG.split(", ")]


def _fold(keep_ms: int):
    """The state's step for one bucket of identifiers: merge the arriving copies, emit the verdicts, let expire."""
    cols = ["key", "at", "delivery_id", "last"]

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(cols, state.get)) if state.exists else {"key": pd.Series(dtype=str), "at": pd.Series(dtype="int64"), "delivery_id": pd.Series(dtype="int64"), "last": pd.Series(dtype="int64")})
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            before = held["delivery_id"].to_numpy()
            for part in parts:
                lost = part["lost"].to_numpy(dtype=bool)
                if lost.any():
                    yield _log(part.loc[lost], "dropped", mark)
                came = part.loc[~lost, ["key", "at", "delivery_id"]]
                if len(came):
                    both = pd.concat([held, came.assign(last=came["at"])], ignore_index=True).sort_values(["key", "at", "delivery_id"], kind="stable")
                    again = both["key"].duplicated().to_numpy()
                    if again.any():
                        yield _log(both.loc[again], "dropped", mark)
                        both["last"] = both.groupby("key", sort=False)["last"].transform("max")
                    held = both[~again]
            new = held[~held["delivery_id"].isin(before)]
            if len(new):
                yield _log(new, "kept", mark)
        alive = (held["last"] // 1000 + keep_ms > mark).to_numpy()
        if not alive.all():
            yield _log(held[~alive], "expired", mark)
        held = held[alive]
        if held.empty:
            if state.exists:
                state.remove()
            return
        state.update(tuple(held[c].tolist() for c in cols))
        state.setTimeoutTimestamp(max(int(held["last"].min()) // 1000 + keep_ms, mark + 1))

    return step


def stream_verdicts(source: DataFrame, id_col: str, time_col: str, delivery_col: str, delay: str, keep_ms: int, buckets: int, out: str, checkpoint: str) -> int:
    """Run the stream over what ``source`` has now (``availableNow``); restart with the same folders to go on.

    Returns the number of rows that came behind the watermark.
    """
    spark = source.sparkSession
    rows = _narrow(source, id_col, time_col, delivery_col).where(F.col("at") < NEVER).mapInPandas(_prefold, "key string, at bigint, delivery_id bigint, lost boolean")
    rows = rows.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", delay)
    bucket = F.pmod(F.when(F.col("lost"), F.xxhash64("delivery_id")).otherwise(F.xxhash64("key")), F.lit(buckets))
    judged = rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(_fold(keep_ms), LOG, "key array<string>, at array<bigint>, delivery_id array<bigint>, last array<bigint>", "append", "EventTimeTimeout")
    writer = judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    with _starting:  # a query copies the session's settings when it starts; until then no other stream may start
        before = {k: spark.conf.get(k, None) for k in SETTINGS}
        try:
            for k, v in SETTINGS.items():
                spark.conf.set(k, v)
            query = writer.start()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def _archive(spark: SparkSession, out: str) -> DataFrame:
    """What the stream has committed so far; nothing if no epoch wrote a file."""
    return spark.read.schema(LOG).parquet(out) if path_exists(spark, out) else spark.createDataFrame([], LOG)


def duplicate_deliveries(source: DataFrame, batch: DataFrame, id_col: str, time_col: str, delivery_col: str, delay: str = "7 days", keep_ms: int = 30 * 86_400_000, folder: str | None = None, buckets: int | None = None) -> DataFrame:
    """delivery_id of every delivery but the first of its identifier.

    ``source`` is the stream, ``batch`` the same table as it stands, in which the rows are found that the state could not
    judge. ``folder`` holds the checkpoint, the archive and the markers; give it again to go on with new files.
    """
    spark = batch.sparkSession
    folder = folder or new_path(spark, "dedup")
    note = lambda n: spark.createDataFrame([(n,)], "behind bigint").coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    size = _buckets(batch, f"{folder}/buckets", buckets)
    note(None)
    note(stream_verdicts(source, id_col, time_col, delivery_col, delay, keep_ms, size, f"{folder}/log", f"{folder}/checkpoint"))
    runs = spark.read.schema("behind bigint").parquet(f"{folder}/runs").agg(F.sum("behind").alias("behind"), F.count("*").alias("n"), F.count("behind").alias("ended")).first()
    log = _archive(spark, f"{folder}/log")
    dropped = log.where("verdict = 'dropped'").select("delivery_id")
    kept = log.where("verdict = 'kept'").join(dropped, "delivery_id", "left_anti").select("key", "at", "delivery_id", "mark")
    open_rows = _narrow(batch, id_col, time_col, delivery_col)
    late = open_rows.where(F.col("at") == NEVER)
    if runs.behind or runs.n > 2 * runs.ended:
        seen = log.where("verdict in ('kept', 'dropped')").select("delivery_id")
        late = late.unionByName(open_rows.where(F.col("at") < NEVER).join(seen, "delivery_id", "left_anti"))
    expired = log.where("verdict = 'expired'")
    since = expired.agg(F.min("mark")).first()[0]
    gone = expired.select("key", F.col("mark").alias("gone"), F.col("delivery_id").alias("old"))
    returned = kept.where(F.lit(False) if since is None else F.col("mark") >= since).join(gone, "key").where("mark >= gone and delivery_id != old").select("key", "at", "delivery_id").distinct()
    asked = late.unionByName(returned)
    if asked.isEmpty():
        return dropped
    beside = kept.select("key", "at", "delivery_id").join(asked.select("key").distinct(), "key", "left_semi")
    involved = late.unionByName(beside)
    first = involved.groupBy("key").agg(F.min(F.struct("at", "delivery_id")).alias("first"))
    return dropped.unionByName(involved.join(first, "key").where(F.struct("at", "delivery_id") > F.col("first")).select("delivery_id"))


def _buckets(batch: DataFrame, place: str, given: int | None) -> int:
    """The number of buckets this checkpoint was begun with; a new one gets it from the size of the files there are."""
    spark = batch.sparkSession
    if path_exists(spark, place):
        return spark.read.schema("n int").parquet(place).first()[0]
    n = given or max(64, sum(path_size(spark, f) for f in batch.inputFiles()) // BUCKET_BYTES)
    spark.createDataFrame([(n,)], "n int").coalesce(1).write.parquet(place)
    return n


def batch_duplicates(rows: DataFrame, id_col: str, time_col: str, delivery_col: str) -> DataFrame:
    """The same rows by one window; the plain reference for tests and for backfills of a bounded period."""
    order = Window.partitionBy("key").orderBy("at", "delivery_id")
    return _narrow(rows, id_col, time_col, delivery_col).withColumn("rn", F.row_number().over(order)).where("rn > 1").select("delivery_id")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream over the files of one table."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # a stream wants a folder
        return reader.option("pathGlobFilter", place.getName()).parquet(path.rpartition("/")[0])
    return reader.parquet(path)
