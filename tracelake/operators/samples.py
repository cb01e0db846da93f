"""Traces to samples: normalised observations, retrieval calls, and one assembled sample per trace.

Assembly is one grouped aggregate: "first" and "last" in the visiting order of a trace are minima and maxima by an
order key, so no trace is ever collected into a list and partial aggregation works before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import get, get_filled, json_object
from ..functions.text import first_filled, non_empty
from ..functions.times import iso_text

HITS = "array<struct<title: string, content: string, metadata: struct<position: int, score: double, document_name: string, segment_id: string, chunk_id: string, node_type: string>>>"


def normalised_observations(rows: DataFrame) -> DataFrame:
    """Parsed payloads, ISO timestamps, TRACE rows as root spans, and identities filled from metadata and input."""
    parsed = rows.withColumns({"input_obj": json_object("input"), "output_obj": json_object("output"), "meta_obj": json_object("metadata")})
    return parsed.select(
        "obs_key",
        "id",
        F.col("traceid").alias("trace_id"),
        F.when(F.col("type") == "TRACE", "SPAN").otherwise(F.col("type")).alias("type"),
        F.col("type").alias("raw_type"),
        (F.col("type") == "TRACE").alias("is_trace_root"),
        "name",
        iso_text("start_time").alias("start_time"),
        iso_text("end_time").alias("end_time"),
        first_filled("sessionid").alias("own_session"),
        first_filled("sessionid", get("meta_obj", "conversation_id"), get("meta_obj", "session_id"), get("meta_obj", "sessionId")).alias("session_id"),
        first_filled("userid", get("meta_obj", "user_id"), get("meta_obj", "userId"), get("input_obj", "sys.user_id")).alias("user_id"),
        first_filled("tracename", "name").alias("trace_name"),
        non_empty("providedmodelname").alias("model"),
        "input",
        "output",
        "input_obj",
        "output_obj",
        "meta_obj",
    )


def visiting_order() -> Column:
    """Start time (as text, nothing first), root before others, name, id; the record key breaks what is left."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.struct(blank("start_time").alias("t"), F.when(F.col("is_trace_root"), 0).otherwise(1).alias("r"), blank("name").alias("n"), blank("id").alias("i"), F.col("obs_key").alias("k"))


def _first(value: Column, order: str = "ord") -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


def _last(value: Column, order: str = "ord") -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def is_retrieval() -> Column:
    return get("meta_obj", "node_type").eqNullSafe("knowledge-retrieval")


def is_llm() -> Column:
    return (F.col("raw_type") == "GENERATION") | get("meta_obj", "node_type").eqNullSafe("llm") | F.col("name").eqNullSafe("LLM")


def _visits(normalised: DataFrame) -> DataFrame:
    """Per row only what assembly can use: parsed values instead of payloads, which stay with the rows that need them."""
    strong = F.col("is_trace_root") | F.col("name").eqNullSafe("message")
    answers = F.coalesce(F.map_contains_key("output_obj", "answer"), F.lit(False))
    weak = ~strong & (F.col("type") == "SPAN") & answers
    root = strong | weak
    retrieval, llm = is_retrieval(), is_llm()
    result = get("output_obj", "result")
    return normalised.select(
        "trace_id",
        visiting_order().alias("ord"),
        strong.alias("strong"),
        weak.alias("weak"),
        retrieval.alias("retrieval"),
        llm.alias("llm"),
        "is_trace_root",
        non_empty("start_time").alias("start_time"),
        non_empty("trace_name").alias("trace_name"),
        "session_id",
        "user_id",
        F.coalesce(get_filled("meta_obj", "workflow_run_id"), get_filled("input_obj", "sys.workflow_run_id")).alias("workflow_run_id"),
        get_filled("input_obj", "sys.query", "query").alias("question"),
        F.when(retrieval, get_filled("input_obj", "query", "sys.query")).alias("retrieval_query"),
        F.when(retrieval & (F.coalesce(F.length(result), F.lit(0)) > 2), result).alias("retrieval_json"),
        F.when(llm, F.coalesce("model", get_filled("meta_obj", "model"))).alias("llm_model"),
        F.when(root, F.col("input")).alias("root_input"),
        F.when(root | llm, F.col("output")).alias("said"),
        F.when(root, get_filled("output_obj", "answer")).alias("answer"),
        F.when(llm, get_filled("output_obj", "text")).alias("llm_text"),
    )


def assemble_samples(normalised: DataFrame) -> DataFrame:
    """One sample per trace id."""
    o = _visits(normalised)
    given = lambda cond, v: F.when(F.col(cond), v)
    at = lambda cond, v: _first(F.when(F.col(cond) & F.col(v).isNotNull(), F.struct("ord", F.col(v).alias("v"))))
    agg = o.groupBy("trace_id").agg(
        *[_first(F.col(c)).alias(c) for c in ("trace_name", "session_id", "user_id", "workflow_run_id", "question")],
        *[_last(F.col(c)).alias(c) for c in ("retrieval_query", "retrieval_json", "llm_model")],
        F.count_if("retrieval").cast("int").alias("retrieval_call_count"),
        F.max_by(given("llm", F.col("said")), given("llm", F.col("ord"))).alias("llm_output"),
        at("strong", "root_input").alias("strong_in"),
        at("weak", "root_input").alias("weak_in"),
        at("strong", "said").alias("strong_out"),
        at("weak", "said").alias("weak_out"),
        at("strong", "answer").alias("strong_answer"),
        at("weak", "answer").alias("weak_answer"),
        at("llm", "llm_text").alias("llm_text"),
        _last(given("is_trace_root", F.col("start_time"))).alias("trace_timestamp"),
        F.min("start_time").alias("earliest_obs_time"),
        F.count("*").cast("int").alias("n_observations"),
    )
    # a span with an answer only counts as root while no root input has been seen before it
    seen = F.least(F.col("strong_in.ord"), F.col("weak_in.ord"))
    weak_ok = lambda c: F.when(F.col(c).isNotNull() & (seen.isNull() | (F.col(f"{c}.ord") <= seen)), F.col(c))
    answer = F.least(F.col("strong_answer"), weak_ok("weak_answer"), F.col("llm_text"))
    return agg.select(
        "trace_id", "trace_name", "session_id", "user_id", "workflow_run_id", "question", "retrieval_query", "retrieval_call_count", "retrieval_json",
        F.least(F.col("strong_in"), F.col("weak_in"))["v"].alias("root_input"),
        F.least(F.col("strong_out"), weak_ok("weak_out"))["v"].alias("root_output"),
        "llm_output", "llm_model", answer["v"].alias("final_answer"), "trace_timestamp", "earliest_obs_time", "n_observations",
    )


def retrieval_calls(normalised: DataFrame) -> DataFrame:
    """One row per hit of every retrieval call, calls numbered in visiting order within their trace."""
    from pyspark.sql import Window

    calls = normalised.where(is_retrieval()).withColumn("ord", visiting_order())
    order = F.row_number().over(Window.partitionBy("trace_id").orderBy("ord"))
    numbered = calls.select("trace_id", F.col("id").alias("observation_id"), order.alias("call_order"), get_filled("input_obj", "query", "sys.query").alias("query"), F.from_json(get("output_obj", "result"), HITS).alias("hits"))
    return numbered.select("trace_id", "observation_id", "call_order", "query", F.posexplode_outer("hits").alias("pos", "hit"))


def simplified_hits(calls: DataFrame) -> DataFrame:
    """Hits flattened: metadata beside title and content."""
    m = "hit.metadata"
    return calls.where("hit is not null").select("trace_id", "call_order", (F.col("pos") + 1).alias("rank"), F.col(f"{m}.position").alias("hit_position"), F.col(f"{m}.score").alias("score"), F.col(f"{m}.document_name").alias("document_name"), F.col(f"{m}.segment_id").alias("segment_id"), F.col("hit.title").alias("title"))


def run_of_user(user: Column) -> tuple[Column, Column]:
    """(run, question) of a user field ``rag_eval:<run>:<question>``; the question may hold further colons."""
    parts = F.split(user, ":", 3)
    fits = user.startswith("rag_eval:") & (F.size(parts) == 3)
    return F.when(fits, parts[1]), F.when(fits, parts[2])
