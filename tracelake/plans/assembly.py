"""Trace scan, normalisation and sample assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsons import first_array, first_object, get, get_filled, is_json, json_object, json_or_text
from ..functions.text import content_hash, non_blank, short_md5, squeeze, strip
from ..functions.times import iso_instant, iso_text, latency_ms
from ..operators import items as I
from ..operators import samples as S
from ..operators.judge import clean_content, gold_evidence, match_form
from ..operators.ranking import numbered
from ..runtime import new_path, table
from ..sources.jsonl import read_jsonl, write_jsonl
from . import sqltext as q
from .define import Registry

R = Registry()
query = R.query


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return S.normalised_observations(table(spark, d, "observations"))


@query("AGG-01", f"""with {q.OBS},
a as (select *, {q.filled(q.get('i', 'sys.query'), q.get('i', 'query'))} as q1, {q.filled(q.get('i', 'query'), q.get('i', 'sys.query'))} as q2, {q.get('o', 'result')} as res,
    not strong and type = 'SPAN' and coalesce(json_exists(o, '$.answer'), false) as weak, nullif({q.get('o', 'answer')}, '') as ans, nullif({q.get('o', 'text')}, '') as txt from ordered),
g as (select trace_id, arg_min(nullif(trace_name, ''), ord) filter (nullif(trace_name, '') is not null) as trace_name, arg_min(session_id, ord) filter (session_id is not null) as session_id, arg_min(user_id, ord) filter (user_id is not null) as user_id,
    arg_min(coalesce(nullif({q.get('m', 'workflow_run_id')}, ''), nullif({q.get('i', 'sys.workflow_run_id')}, '')), ord) filter (coalesce(nullif({q.get('m', 'workflow_run_id')}, ''), nullif({q.get('i', 'sys.workflow_run_id')}, '')) is not null) as workflow_run_id,
    arg_min(q1, ord) filter (q1 is not null) as question, arg_max(q2, ord) filter (is_retrieval and q2 is not null) as retrieval_query, cast(count(*) filter (is_retrieval) as integer) as retrieval_call_count,
    min(ord) filter ((strong or weak) and input is not null) as seen,
    arg_max(coalesce(model, nullif({q.get('m', 'model')}, '')), ord) filter (is_llm and coalesce(model, nullif({q.get('m', 'model')}, '')) is not null) as llm_model,
    arg_max(nullif(start_time, ''), ord) filter (is_trace_root and nullif(start_time, '') is not null) as trace_timestamp, min(nullif(start_time, '')) as earliest_obs_time, cast(count(*) as integer) as n_observations from a group by trace_id),
f as (select trace_id, arg_min(case when (strong or (weak and (seen is null or ord <= seen))) and ans is not null then ans else txt end, ord) filter (((strong or (weak and (seen is null or ord <= seen))) and ans is not null) or (is_llm and txt is not null)) as final_answer from a join g using (trace_id) group by 1)
select g.* exclude (seen), final_answer from g join f using (trace_id)""")
def agg_01(spark, d):
    """One sample per trace."""
    return S.assemble_samples(_obs(spark, d)).drop("retrieval_json", "root_input", "root_output", "llm_output")


@query("AGG-01_payloads", f"""with {q.OBS},
a as (select *, not strong and type = 'SPAN' and coalesce(json_exists(o, '$.answer'), false) as weak from ordered),
x as (select trace_id, least(min(ord) filter (strong and input is not null), min(ord) filter (weak and input is not null)) as ri, min(ord) filter (strong and output is not null) as so, min(ord) filter (weak and output is not null) as wo, max(ord) filter (is_llm) as lo, cast(count(*) filter (is_retrieval and json_array_length({q.obj('output')}, '$.result') > 0) as integer) as n_filled from a group by 1),
y as (select *, least(so, case when ri is null or wo <= ri then wo end) as ro from x)
select y.trace_id, md5(i.input) as root_input, md5(u.output) as root_output, md5(l.output) as llm_output, n_filled from y left join a i on i.trace_id = y.trace_id and i.ord = ri left join a u on u.trace_id = y.trace_id and u.ord = ro left join a l on l.trace_id = y.trace_id and l.ord = lo""")
def agg_01_payloads(spark, d):
    """The payloads of the assembled samples as digests, and the retrieval calls of each trace that returned something."""
    s = S.assemble_samples(_obs(spark, d)).select("trace_id", *[F.md5(c).alias(c) for c in ("root_input", "root_output", "llm_output")])
    calls = S.retrieval_calls(_obs(spark, d)).where("hit is not null").groupBy("trace_id").agg(F.countDistinct("call_order").cast("int").alias("n_filled"))
    return s.join(calls, "trace_id", "left").withColumn("n_filled", F.coalesce("n_filled", F.lit(0)))


_INSTANT = f"try_cast(case when regexp_matches({q.non_blank('trace_timestamp')}, '{q.ISO}') then case when regexp_matches({q.iso('trace_timestamp')}, '(Z|[+-]\\d\\d:\\d\\d)$') then {q.iso('trace_timestamp')} else {q.iso('trace_timestamp')} || 'Z' end end as timestamptz)"


@query("SRT-01", f"select trace_id, row_number() over (order by ts desc nulls last, trace_id) as place from (select trace_id, max({_INSTANT}) as ts from traces where trace_id is not null group by 1)")
def srt_01(spark, d):
    """Traces newest first, those without a readable time last; ties by id. The rank comes from a range-partitioned sort."""
    t = table(spark, d, "traces").where("trace_id is not null").groupBy("trace_id").agg(F.max(iso_instant("trace_timestamp")).alias("ts"))
    return numbered(t, [], [F.col("ts").desc_nulls_last(), F.col("trace_id")], "place").select("trace_id", "place")


@query("SRT-02", "select sample_id, row_number() over (order by coalesce(question, ''), trace_id, sample_id) as place from samples")
def srt_02(spark, d):
    t = table(spark, d, "samples").select("sample_id", "trace_id", F.coalesce("question", F.lit("")).alias("question"))
    return numbered(t, [], [F.col("question"), F.col("trace_id"), F.col("sample_id")], "place").select("sample_id", "place")


@query("WIN-01", f"with {q.OBS} select obs_key, trace_id, cast(ord as integer) as ord from ordered")
def win_01(spark, d):
    """The visiting order of observations within their trace."""
    w = Window.partitionBy("trace_id").orderBy(S.visiting_order())
    return _obs(spark, d).select("obs_key", "trace_id", F.row_number().over(w).alias("ord"))


@query("PRJ-01", f"select obs_key, case when output in ('', 'null') then null else {q.non_blank('output')} end as output_text, coalesce(json_valid({q.non_blank('output')}), false) as output_is_json from observations")
def prj_01(spark, d):
    t = json_or_text("output")
    return table(spark, d, "observations").select("obs_key", t.alias("output_text"), F.coalesce(is_json(strip("output")), F.lit(False)).alias("output_is_json"))


@query("PRJ-02", f"select obs_key, {q.iso('start_time')} as start_iso, {q.iso('end_time')} as end_iso from observations")
def prj_02(spark, d):
    return table(spark, d, "observations").select("obs_key", iso_text("start_time").alias("start_iso"), iso_text("end_time").alias("end_iso"))


_TS = "case when regexp_matches({c}, '(Z|[+-]\\d\\d:\\d\\d)$') then {c} else {c} || 'Z' end"


@query("PRJ-03", f"select obs_key, epoch_us(try_cast(x as timestamptz)) as end_us, epoch_us(try_cast(x as timestamptz)) is null as unparsed from (select obs_key, case when regexp_matches({q.non_blank('end_time')}, '{q.ISO}') then {_TS.format(c=q.iso('end_time'))} end as x from observations)")
def prj_03(spark, d):
    us = F.unix_micros(iso_instant("end_time"))
    return table(spark, d, "observations").select("obs_key", us.alias("end_us"), us.isNull().alias("unparsed"))


@query("PRJ-04", f"with {q.OBS} select obs_key, type, raw_type, is_trace_root, session_id, user_id, trace_name from obs")
def prj_04(spark, d):
    return _obs(spark, d).select("obs_key", "type", "raw_type", "is_trace_root", "session_id", "user_id", "trace_name")


_CALLS = f"""with {q.OBS}, c as (select trace_id, id as observation_id, cast(row_number() over (partition by trace_id order by ord) as integer) as call_order, {q.filled(q.get('i', 'query'), q.get('i', 'sys.query'))} as query, start_time, end_time, json_extract(o, '$.result') as res from ordered where is_retrieval)"""


@query("PRJ-05", f"""{_CALLS}, h as (select trace_id, call_order, unnest(from_json(res, '["json"]')) as h, generate_subscripts(from_json(res, '["json"]'), 1) as rank from c)
select trace_id, call_order, cast(rank as integer) as rank, cast(json_extract_string(h, '$.metadata.position') as integer) as hit_position, cast(json_extract_string(h, '$.metadata.score') as double) as score, json_extract_string(h, '$.metadata.document_name') as document_name, json_extract_string(h, '$.metadata.segment_id') as segment_id, json_extract_string(h, '$.title') as title from h""")
def prj_05(spark, d):
    """Hits of all retrieval calls, metadata flattened."""
    return S.simplified_hits(S.retrieval_calls(_obs(spark, d)))


@query("PRJ-10", f"{_CALLS} select trace_id, call_order, cast(coalesce(json_array_length(res), 0) as integer) as n_hits from c")
def prj_10(spark, d):
    """1-based positions: the number of hits per call is the greatest of them."""
    calls = S.retrieval_calls(_obs(spark, d))
    return calls.groupBy("trace_id", "call_order").agg(F.coalesce(F.max(F.col("pos") + 1), F.lit(0)).cast("int").alias("n_hits"))


@query("WIN-10", f"with {q.EXACT} select sample_id, call_order, hit_position, result_count from calls")
def win_10(spark, d):
    from ..operators.judge import exact_ranks

    return exact_ranks(table(spark, d, "samples"), table(spark, d, "retrieval_results"))


@query("LAT-01", f"""with {q.OBS}, t as (select obs_key, try_cast({_TS.format(c='start_time')} as timestamptz) as s, try_cast({_TS.format(c='end_time')} as timestamptz) as e from obs where regexp_matches(start_time, '{q.ISO}') and regexp_matches(end_time, '{q.ISO}'))
select obs_key, cast(trunc((epoch_us(e) - epoch_us(s)) / 1000.0) as bigint) as latency_ms from t where s is not null and e is not null""")
def lat_01(spark, d):
    """Latency of observations whose both ends can be read."""
    o = table(spark, d, "observations").select("obs_key", latency_ms("start_time", "end_time").alias("latency_ms"))
    return o.where("latency_ms is not null")


_RUN = "case when user_id like 'rag_eval:%' and len(string_split(user_id, ':')) >= 3 then string_split(user_id, ':')[2] end"
_QID = "case when user_id like 'rag_eval:%' and len(string_split(user_id, ':')) >= 3 then array_to_string(string_split(user_id, ':')[3:], ':') end"


@query("PRJ-06", f"select sample_id, {_RUN} as run, {_QID} as question from samples")
def prj_06(spark, d):
    run, question = S.run_of_user(F.col("user_id"))
    return table(spark, d, "samples").select("sample_id", run.alias("run"), question.alias("question"))


@query("PRJ-07", f"select delivery_id, {_RUN} as run, {_QID} as question from traces")
def prj_07(spark, d):
    run, question = S.run_of_user(F.col("user_id"))
    return table(spark, d, "traces").select("delivery_id", run.alias("run"), question.alias("question"))


@query("PRJ-08", "select sample_id, 'rag_eval:' || coalesce(run_id, '') || ':' || coalesce(question_id, '') as user_field from samples")
def prj_08(spark, d):
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return table(spark, d, "samples").select("sample_id", F.concat_ws(":", F.lit("rag_eval"), blank("run_id"), blank("question_id")).alias("user_field"))


@query("PRJ-09", f"select question_row, coalesce(nullif(question_id, ''), left(md5({q.strip('question')}), 12)) as question_id from questions")
def prj_09(spark, d):
    return table(spark, d, "questions").select("question_row", F.coalesce(F.nullif("question_id", F.lit("")), short_md5(strip("question"))).alias("question_id"))


@query("PRJ-11", f"select question_row, {q.non_blank('question')} as question, nullif(difficulty, '') as difficulty, nullif(topic, '') as topic from questions where {q.non_blank('question')} is not null")
def prj_11(spark, d):
    t = table(spark, d, "questions").select("question_row", non_blank("question").alias("question"), F.nullif("difficulty", F.lit("")).alias("difficulty"), F.nullif("topic", F.lit("")).alias("topic"))
    return t.where("question is not null")


@query("PRJ-12", "select 'batch_qa_' || cast(row_number() over (partition by file_name order by line_no, question_row) - 1 as varchar) || '_' || file_name as trace_id, question_row, question, coalesce(reference_answer, '') as reference_answer, 'rag_eval:' || question_set_id || ':' || question_id as user_id from questions")
def prj_12(spark, d):
    """Responses of a batch as samples with pseudo ids: index within the batch and the batch's name."""
    t = table(spark, d, "questions").select("file_name", "line_no", "question_row", "question", "reference_answer", "question_set_id", "question_id")
    t = numbered(t, ["file_name"], [F.col("line_no"), F.col("question_row")], "n")
    return t.select(F.concat(F.lit("batch_qa_"), (F.col("n") - 1).cast("string"), F.lit("_"), "file_name").alias("trace_id"), "question_row", "question", F.coalesce("reference_answer", F.lit("")).alias("reference_answer"), F.concat(F.lit("rag_eval:"), "question_set_id", F.lit(":"), "question_id").alias("user_id"))


@query("PRJ-13", f"select chunk_row, segment_id, chunk_position, document_id, coalesce(summary, '') as summary, {q.content_hash('content')} as content_hash, cast(length(content) as integer) as n_chars from chunk_catalog")
def prj_13(spark, d):
    return table(spark, d, "chunk_catalog").select("chunk_row", "segment_id", "chunk_position", "document_id", F.coalesce("summary", F.lit("")).alias("summary"), content_hash("content").alias("content_hash"), F.length("content").alias("n_chars"))


@query("PRJ-15", f"select hit_id, {q.content_hash('content')} as content_hash from retrieval_results")
def prj_15(spark, d):
    return table(spark, d, "retrieval_results").select("hit_id", content_hash("content").alias("content_hash"))


@query("PRJ-16", f"select document_id, {q.content_hash('text')} as content_hash from create_document")
def prj_16(spark, d):
    return table(spark, d, "create_document").select("document_id", content_hash("text").alias("content_hash"))


_PARTS = [q.strip(f"coalesce({c}, '')") for c in ("question_mode", "question", "retrieval_query", "final_answer")] + [q.gold()]


@query("PRJ-17", f"select sample_id, left(md5({' || chr(10) || '.join(_PARTS)}), 12) as judge_key from samples")
def prj_17(spark, d):
    return table(spark, d, "samples").select("sample_id", judge_key().alias("judge_key"))


def judge_key():
    """The content under which two samples need only one verdict."""
    parts = [strip(F.coalesce(F.col(c), F.lit(""))) for c in ("question_mode", "question", "retrieval_query", "final_answer")]
    return short_md5(F.concat_ws("\n", *parts, gold_evidence()))


@query("PRJ-18", f"select sample_id, {q.gold()} as gold from samples")
def prj_18(spark, d):
    return table(spark, d, "samples").select("sample_id", gold_evidence().alias("gold"))


@query("PRJ-19", f"select hit_id, {q.match_form('content')} as form from retrieval_results where content is not null")
def prj_19(spark, d):
    return table(spark, d, "retrieval_results").where("content is not null").select("hit_id", match_form("content").alias("form"))


@query("PRJ-20", f"""select document_id, {q.strip("regexp_replace(regexp_replace(text, '<metadata>\\s*\\{[\\s\\S]*?\\}\\s*</metadata>\\s*', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} as cleaned from create_document""")
def prj_20(spark, d):
    return table(spark, d, "create_document").select("document_id", clean_content("text").alias("cleaned"))


_LIMIT = "case rank_position when 1 then 2000 when 2 then 1200 when 3 then 1200 else 1000 end"


@query("PRJ-21", f"select hit_id, '[' || rank_position || '] ' || coalesce(document_name || ' ', '') || chr(10) || case when length(content) > {_LIMIT} then left(content, {_LIMIT}) || '...' else coalesce(content, '-') end as block from retrieval_results")
def prj_21(spark, d):
    """One retrieval result as it goes into a model's prompt, cut at the limit of its rank."""
    limit = F.when(F.col("rank_position") == 1, 2000).when(F.col("rank_position") <= 3, 1200).otherwise(1000)
    body = F.when(F.length("content") > limit, F.concat(F.substring(F.col("content"), F.lit(1), limit), F.lit("..."))).otherwise(F.coalesce("content", F.lit("-")))
    head = F.concat(F.lit("["), F.col("rank_position").cast("string"), F.lit("] "), F.coalesce(F.concat("document_name", F.lit(" ")), F.lit("")))
    return table(spark, d, "retrieval_results").select("hit_id", F.concat(head, F.lit("\n"), body).alias("block"))


@query("PRJ-22", "select obs_key, case when json_valid(nullif(regexp_extract('verdict: ' || output || ' end', '(?s)\\{.*\\}', 0), '')) then regexp_extract(output, '(?s)\\{.*\\}', 0) end as verdict from observations where type = 'GENERATION'")
def prj_22(spark, d):
    t = table(spark, d, "observations").where("type = 'GENERATION'")
    return t.select("obs_key", first_object(F.concat(F.lit("verdict: "), "output", F.lit(" end"))).alias("verdict"))


@query("PRJ-39", "select obs_key, cast(json_array_length(case when json_valid(x) then x end) as integer) as n_items from (select obs_key, nullif(regexp_extract(output, '(?s)\\[.*\\]', 0), '') as x from observations where type = 'SPAN')")
def prj_39(spark, d):
    """Lists in replies: the widest [...] span, parsed."""
    t = table(spark, d, "observations").where("type = 'SPAN'")
    return t.select("obs_key", F.json_array_length(first_array("output")).alias("n_items"))


@query("PRJ-41", f"select question_row, {q.squeeze('question')} as key from questions")
def prj_41(spark, d):
    return table(spark, d, "questions").select("question_row", squeeze("question").alias("key"))


@query("SRC-01", f"select cast(count(*) as bigint) as n_rows, 2 + (select count(*) from observations where {q.non_blank('traceid')} is null) as n_bad, count(distinct traceid) as n_traces from observations where {q.non_blank('traceid')} is not null")
def src_01(spark, d):
    """The JSONL scan with its quarantine: the store is written as JSON lines, with a broken one, one without an id and a blank one."""
    path = new_path(spark, "jsonl")
    write_jsonl(table(spark, d, "observations").select("obs_key", F.col("traceid").alias("traceId"), "id", "type"), path)
    spark.createDataFrame([("{broken",), ('{"id": "x"}',), ("  ",)], "value string").coalesce(1).write.mode("append").text(path)
    good, bad = read_jsonl(spark, path, "obs_key bigint, traceId string, id string, type string", "traceId")
    return good.agg(F.count("*").alias("n_rows"), F.countDistinct("traceId").alias("n_traces")).crossJoin(bad.agg(F.count("*").alias("n_bad"))).select("n_rows", "n_bad", "n_traces")  # one row each


@query("SRC-07", "select kind, count(*) as n from (select 'trace' as kind from traces union all select 'observation' from observations where type <> 'TRACE') group by 1")
def src_07(spark, d):
    t = table(spark, d, "traces").select(F.lit("trace").alias("kind"))
    o = table(spark, d, "observations").where("type != 'TRACE'").select(F.lit("observation").alias("kind"))
    return t.unionByName(o).groupBy("kind").agg(F.count("*").alias("n"))


@query("AGG-23", "select case when type = 'TRACE' then 'trace' else 'observation' end as kind, count(*) as n from observations group by 1")
def agg_23(spark, d):
    return table(spark, d, "observations").groupBy(F.when(F.col("type") == "TRACE", "trace").otherwise("observation").alias("kind")).agg(F.count("*").alias("n"))


@query("AGG-02", f"select run, count(*) as n_samples from (select {_RUN} as run from samples) group by 1")
def agg_02(spark, d):
    """Samples per run; NULL holds those that no run claims."""
    run, _ = S.run_of_user(F.col("user_id"))
    return table(spark, d, "samples").groupBy(run.alias("run")).agg(F.count("*").alias("n_samples"))


@query("AGG-24", f"with {q.OBS} select cast(count(*) as bigint) as n_observations, count(distinct trace_id) as n_traces, count(distinct session_id) as n_sessions, count(distinct user_id) as n_users from obs")
def agg_24(spark, d):
    return _obs(spark, d).agg(F.count("*").alias("n_observations"), *[F.countDistinct(c).alias(f"n_{c.split('_')[0]}s") for c in ("trace_id", "session_id", "user_id")])


_MASK = "case when length({c}) > 12 then left({c}, 6) || '...' || right({c}, 4) else '***' end"


@query("PRJ-33", f"select delivery_id, {_MASK.format(c='user_id')} as masked from traces where user_id is not null")
def prj_33(spark, d):
    m = F.when(F.length("user_id") > 12, F.concat(F.left("user_id", F.lit(6)), F.lit("..."), F.right("user_id", F.lit(4)))).otherwise("***")
    return table(spark, d, "traces").where("user_id is not null").select("delivery_id", m.alias("masked"))


@query("PRJ-30", "select distinct collector_id, 'proj_' || left(sha256(lower(collector_name) || '|' || collector_id), 16) as project_id from collectors")
def prj_30(spark, d):
    key = F.concat(F.lower("collector_name"), F.lit("|"), "collector_id")
    return table(spark, d, "collectors").select("collector_id", F.concat(F.lit("proj_"), F.left(F.sha2(key, 256), F.lit(16))).alias("project_id")).distinct()


_N_ID = "length(coalesce(document_id, ''))"
_GIVEN = "deleted_at is null"  # deleted documents come back without an id


@query("PRJ-34", f"""select document_id as key, case when {_GIVEN} then document_id else '' end as document_id, coalesce({q.strip('document_name')}, '') as file_name, coalesce({q.non_blank('document_name')}, '') as title, list_filter([{q.strip("coalesce(dataset_id, '')")}, {q.strip("coalesce(doc_form, '')")}], lambda x: x <> '') as topics,
case when {_GIVEN} then 'waiting' else 'completed' end as status, {_GIVEN} or doc_form is not null as success, case when {_GIVEN} or doc_form is not null then '' else '{I.NO_ID}' end as error from create_document""")
def prj_34(spark, d):
    """Items of a store in differing shapes (names of fields, lists as arrays or texts), brought to one."""
    n = F.length(F.coalesce("document_id", F.lit(""))) + F.length(F.coalesce("document_name", F.lit("")))
    name = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (by % len(names) + 1).cast("int"))
    topics = F.when(n % 2 == 0, F.to_json(F.array(F.coalesce("dataset_id", F.lit("")), F.coalesce("doc_form", F.lit(""))))).otherwise(F.concat_ws(" , ", F.coalesce("dataset_id", F.lit("")), F.coalesce("doc_form", F.lit("")), F.lit("")))
    fields = F.map_from_arrays(F.array(name(I.ID_NAMES, n), name(I.FILE_NAMES, n), F.lit("topics"), F.lit("document_type"), F.lit("document_summary")), F.array(F.when(F.col("deleted_at").isNull(), F.col("document_id")), F.col("document_name"), topics, F.col("doc_form"), F.when(F.col("doc_form").isNotNull(), F.lit("about"))))
    item = I.ingested(F.to_json(fields), F.lit("p"), F.lit(None).cast("string"))
    return table(spark, d, "create_document").select(F.col("document_id").alias("key"), item.alias("i")).select("key", *[f"i.{c}" for c in ("document_id", "file_name", "title", "topics", "status", "success", "error")])


@query("PRJ-49", f"select document_id as key, case when {_N_ID} % 5 < 4 then document_id end as found from create_document")
def prj_49(spark, d):
    """The id in five shapes of a result: at the top, in the outputs, the only one of a list in either, one of two."""
    doc, n = F.col("document_id"), F.length(F.coalesce("document_id", F.lit(""))) % 5
    shapes = [F.to_json(F.struct(doc.alias("document_id"))), F.to_json(F.struct(F.struct(doc.alias("document_id")).alias("outputs"))), F.to_json(F.struct(F.struct(F.array(doc).alias("document_ids")).alias("outputs"))), F.to_json(F.struct(F.array(doc).alias("document_ids")))]
    result = F.to_json(F.struct(F.array(doc, F.lit("other")).alias("document_ids")))
    for k, shape in enumerate(shapes):
        result = F.when(n == k, shape).otherwise(result)
    return table(spark, d, "create_document").select(doc.alias("key"), I.document_id_of(result).alias("found"))


@query("PRJ-48", "select snapshot_id, 'processed/' || coalesce(project_id, 'none') || '/' || snapshot_type || '/' || snapshot_id as path from snapshots")
def prj_48(spark, d):
    return table(spark, d, "snapshots").select("snapshot_id", F.concat_ws("/", F.lit("processed"), F.coalesce("project_id", F.lit("none")), "snapshot_type", "snapshot_id").alias("path"))


@query("PRJ-26", "select hit_id, case when length(content) > 120 then left(content, 120) || '...' else coalesce(content, '') end as shown, left(segment_id, 8) as short_id from retrieval_results")
def prj_26(spark, d):
    shown = F.when(F.length("content") > 120, F.concat(F.left("content", F.lit(120)), F.lit("..."))).otherwise(F.coalesce("content", F.lit("")))
    return table(spark, d, "retrieval_results").select("hit_id", shown.alias("shown"), F.left("segment_id", F.lit(8)).alias("short_id"))


@query("PRJ-27", "select document_id, left(regexp_replace(trim(document_name), '[\\\\/:*?\"<>|\\s]+', '_', 'g'), 50) || '_' || right(document_id, 8) || '.md' as file_name from create_document")
def prj_27(spark, d):
    safe = F.left(F.regexp_replace(F.trim("document_name"), r'[\\/:*?"<>|\s]+', "_"), F.lit(50))
    return table(spark, d, "create_document").select("document_id", F.concat(safe, F.lit("_"), F.right("document_id", F.lit(8)), F.lit(".md")).alias("file_name"))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql


