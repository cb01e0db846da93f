"""Rebuilding conversations from message rows.

Method. Rows are an event log. The rows of one id are versions of one event (a row pulled again, an edit, a deletion); the
one with the greatest record key is final, and a final version marked as deleted removes the event. Per trace the events
fold into one turn: the user message of its TRACE row and the reply of its GENERATION rows, where a retry that says
something replaces attempts that failed or said nothing. Turns are ordered by the instant at which the trace began, as problem 4 reads it.
A conversation is all traces of one session and one user; one broken trace (no user message, or no reply beyond
white space) breaks it, and broken conversations are dropped.

Session and user stand in their column, else in the row's metadata, else (user) in its input, else in another row of
the trace.

Scale. JSON is parsed in the JVM, outputs only where they can hold a reply, inputs beside the TRACE row's only where they name a user. Everything is a grouped aggregate with partial aggregation, so a user who holds
a tenth or a third of all rows is folded on the map side first. Turn numbers don't sort a whole conversation in one
task: turns are numbered within (conversation, day) and shifted by the counts of the days before.

Defined results. Traces without a session or user in any row belong to no conversation. NULL or blank trace ids are left
out. A missing TRACE row is a missing user message. Turns without an instant come first; ties go by trace id. Repeated
rows are versions of one event. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled
from ..operators.instants import normalise
from ..runtime import materialise

# Where identities and messages stand, in order of precedence.
SESSION_KEYS = ["conversation_id", "session_id", "sessionId"]
USER_KEYS = ["user_id", "userId"]
INPUT_USER_KEY, INPUT_MESSAGE_KEYS, REPLY_KEYS = "sys.user_id", ["sys.query", "query"], ["text", "answer"]


def _object(c: str) -> Column:
    """The JSON object of a text as a map of texts; NULL if it isn't one."""
    return F.when(F.ltrim(F.col(c)).startswith("{"), F.from_json(F.col(c), "map<string,string>"))


def _says(c: Column) -> Column:
    return c.rlike(r"(?U)\S")


def _message(map_col: str, raw: str, keys: list[str]) -> Column:
    """The value under the first key that is there, or the plain text where the column isn't an object."""
    return F.when(F.col(map_col).isNull(), F.col(raw)).otherwise(F.coalesce(*[F.try_element_at(F.col(map_col), F.lit(k)) for k in keys]))


def _reply(map_col: str, raw: str) -> Column:
    """The value under the first reply key that says something, or the plain text where the column isn't an object."""
    values = [F.try_element_at(F.col(map_col), F.lit(k)) for k in REPLY_KEYS]
    return F.when(F.col(map_col).isNull(), F.col(raw)).otherwise(F.coalesce(*[F.when(_says(v), v) for v in values]))


def events(rows: DataFrame) -> DataFrame:
    """Row-local: (trace, event_id, version, type, session, user, message, reply, removed, started, collector)."""
    typed = rows.where(_says(F.col("traceid"))).select("traceid", "id", "obs_key", "type", "sessionid", "userid", "collector_id", F.coalesce("trace_timestamp", "start_time").alias("started"), F.when((F.col("type") == "TRACE") | F.contains("input", F.lit(INPUT_USER_KEY)), F.col("input")).alias("input"), F.when(F.col("type") == "GENERATION", F.col("output")).alias("output"), "metadata")
    parsed = typed.withColumns({"i": _object("input"), "o": _object("output"), "m": _object("metadata")})
    at = lambda col, key: F.try_element_at(F.col(col), F.lit(key))
    return parsed.select(
        F.col("traceid").alias("trace"),
        F.coalesce("id", F.concat(F.lit("row-"), F.col("obs_key").cast("string"))).alias("event_id"),
        F.col("obs_key").alias("version"),
        "type",
        first_filled("sessionid", *[at("m", k) for k in SESSION_KEYS]).alias("session"),
        first_filled("userid", *[at("m", k) for k in USER_KEYS], at("i", INPUT_USER_KEY)).alias("user"),
        F.when(F.col("type") == "TRACE", _message("i", "input", INPUT_MESSAGE_KEYS)).alias("message"),
        F.when(F.col("type") == "GENERATION", _reply("o", "output")).alias("reply"),
        F.coalesce(F.lower(at("m", "status")) == "deleted", F.lit(False)).alias("removed"),
        "started",
        "collector_id",
    )


def final_events(log: DataFrame) -> DataFrame:
    """The last version of every event, without removed ones."""
    payload = F.struct("type", "session", "user", "message", "reply", "removed", "started", "collector_id")
    last = log.groupBy("trace", "event_id").agg(F.max_by(payload, F.col("version")).alias("e"), F.max("version").alias("version"))
    return last.select("trace", "event_id", "version", "e.*").where("not removed")


def turns(log: DataFrame) -> DataFrame:
    """One row per trace: session, user, the message and reply that say something, and the start as it is written."""
    final = final_events(log)
    says = lambda c: F.when(_says(F.col(c)), F.col(c))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("version", c)))[c]
    marked = final.withColumns({"message": says("message"), "reply": says("reply"), "root": F.when(F.col("type") == "TRACE", F.col("started"))})
    return marked.groupBy("trace").agg(
        first("session").alias("session"),
        first("user").alias("user"),
        F.max(F.when(F.col("message").isNotNull(), F.struct("version", "message")))["message"].alias("message"),
        F.max(F.when(F.col("reply").isNotNull(), F.struct("version", "reply")))["reply"].alias("reply"),
        F.min(F.struct(F.col("root").isNull().alias("later"), "version", F.coalesce("root", "started").alias("started"), "collector_id")).alias("begin"),
    )


def conversations(turned: DataFrame) -> DataFrame:
    """(session, user, n_turns, broken): every conversation and whether one of its traces is broken."""
    broken = F.col("message").isNull() | F.col("reply").isNull()
    return turned.where("session is not null and user is not null").groupBy("session", "user").agg(F.count("*").alias("n_turns"), F.bool_or(broken).alias("broken"))


def broken_conversations(rows: DataFrame) -> DataFrame:
    """(sessionid, userid) of the conversations that are dropped. Texts are reduced to whether they say anything first."""
    log = events(rows)
    mark = lambda c: F.when(F.col(c).isNull(), F.lit(None)).when(_says(F.col(c)), F.lit("x")).otherwise("")
    narrow = log.withColumns({"message": mark("message"), "reply": mark("reply"), "started": F.lit(None).cast("string"), "collector_id": F.lit(None).cast("string")})
    return conversations(turns(narrow)).where("broken").select(F.col("session").alias("sessionid"), F.col("user").alias("userid"))


def rebuilt_conversations(rows: DataFrame, collectors: DataFrame) -> DataFrame:
    """(sessionid, userid, turn_no, traceid, at_us, role, content): the surviving conversations in order, two rows per turn.

    The turns are folded once and written. Their starts are read as all timestamps are (``operators.instants``), with the
    search over each collector's records.
    """
    key = ["session", "user"]
    turned = turns(events(rows)).where("session is not null and user is not null")
    turned = materialise(turned.select(*key, "trace", "message", "reply", F.col("begin.version").alias("version"), F.col("begin.started").alias("started"), F.col("begin.collector_id").alias("collector_id")), "turns")
    kept = conversations(turned).where("not broken").select(*key)
    times = normalise(turned.select("version", "started", "collector_id"), ["started"], "version", "collector_id", collectors, "zone_name")
    flat = turned.join(kept, key, "left_semi").join(times.select(F.col("record_key").alias("version"), F.col("epoch_us").alias("at_us")), "version", "left")
    timed = flat.withColumn("day", F.coalesce(F.floor(F.col("at_us") / 86_400_000_000), F.lit(-1)))
    days = timed.groupBy(*key, "day").agg(F.count("*").alias("n"))
    days = days.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*key, "day").orderBy(F.col("at_us").asc_nulls_first(), "trace"))
    numbered = timed.withColumn("within", within).join(days.drop("n"), [*key, "day"]).withColumn("turn_no", F.col("before") + F.col("within"))
    sides = F.array(F.struct(F.lit("user").alias("role"), F.col("message").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")))
    return numbered.select(F.col("session").alias("sessionid"), F.col("user").alias("userid"), F.col("turn_no").cast("bigint").alias("turn_no"), F.col("trace").alias("traceid"), "at_us", F.explode(sides).alias("s")).select("sessionid", "userid", "turn_no", "traceid", "at_us", "s.role", "s.content")
