"""Chunk catalog, question sets and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, non_blank, short_md5, squeeze, strip
from ..operators import candidates as C
from ..operators import chunking as K
from ..operators import generation as N
from ..operators.samples import run_of_user
from ..runtime import table
from . import sqltext as q
from .define import Registry

R = Registry()
query = R.query
SEED = "20240229"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_catalog")


_NO = " or ".join(f"regexp_matches({q.strip('content')}, '{p}')" for p in C.NO_CONTENT)
_CONTENT = f"coalesce({q.strip('content')}, '')"
_REJECT = f"""rj as (select c.*, case when status is distinct from 'completed' then 'status_not_completed' when not coalesce(enabled, true) then 'disabled' when content_hash in (select content_hash from chunk_catalog where content_hash <> '' group by 1 having count(*) > 1) then 'duplicate'
    when {_CONTENT} = '' then 'empty' when length({_CONTENT}) < 20 then 'too_short' when {_NO} then 'title_or_page' end as reject_reason from chunk_catalog c)"""


@query("FLT-01", f"with {_REJECT} select chunk_row, reject_reason from rj")
def flt_01(spark, d):
    return C.with_reject_reason(_catalog(spark, d)).select("chunk_row", "reject_reason")


@query("FLT-02", f"with {_REJECT} select chunk_row from rj where reject_reason is null and document_id in (select document_id from create_document where doc_form = 'text_model')")
def flt_02(spark, d):
    docs = table(spark, d, "create_document").where("doc_form = 'text_model'").select("document_id")
    return C.with_reject_reason(_catalog(spark, d)).where("reject_reason is null").join(docs, "document_id", "left_semi").select("chunk_row")


_Q = q.strip("coalesce(retrieval_query, '')")
_ZH = "len(regexp_extract_all({c}, '[一-鿿]')) >= 0.3 * greatest(length({c}), 1)"
_EN = "len(regexp_extract_all({c}, '[A-Za-z]')) >= 0.5 * greatest(length({c}), 1)"
_WORDS = " or ".join(f"contains(lower(x), '{w}')" for w in C.QUESTION_WORDS)
_LINKED = "(" + " or ".join(f"regexp_matches(x, '{p}')" for p in C.LINKS) + ")"


def _errors_sql(label: str) -> str:
    """The names of the rules that the query x breaks, as a list."""
    return f"""case when x = '' then ['empty'] else list_filter([
 case when {q.non_blank(label)} is null then 'no_label' end, case when {_WORDS} then 'question_word' end, case when regexp_matches(x, '[?？]') then 'question_mark' end,
 case when {_ZH.format(c='x')} and length(x) < 3 then 'too_short' when {_ZH.format(c='x')} and length(x) > 30 then 'too_long' when not ({_ZH.format(c='x')}) and {_EN.format(c='x')} and len(string_split_regex(x, '{q.WS}+')) > 15 then 'too_long' end,
 case when {_LINKED} and len(list_filter(list_transform(string_split_regex(x, '[、，,]'), lambda t: {q.strip('t')}), lambda t: length(t) >= 2)) >= 3 then 'several_concepts' end], lambda e: e is not null) end"""


@query("FLT-03", f"with s as (select sample_id, {_Q} as x, topic from samples) select sample_id, array_to_string({_errors_sql('topic')}, ',') as errors from s")
def flt_03(spark, d):
    return table(spark, d, "samples").select("sample_id", F.array_join(C.query_errors(F.col("retrieval_query"), F.col("topic")), ",").alias("errors"))


_PAIRS2 = "flatten(list_transform(regexp_extract_all(x, '[一-鿿]+'), lambda r: case when length(r) <= 2 then [r] else list_transform(range(1, length(r)), lambda i: r[i:i + 1]) end))"
_TERMS = r"list_concat(regexp_extract_all(x, '[A-Za-z][A-Za-z0-9_-]+'), regexp_extract_all(x, '\d+(?:\.\d+)*(?:\s*[条款项号])?'))"


_GROUNDED = f"(x <> '' and c <> '' and (len(list_filter(list_concat({_PAIRS2}, {_TERMS}), lambda t: contains(c, lower(t)))) > 0 or len(list_filter(list_concat(regexp_extract_all(x, '[一-鿿]+'), {_TERMS}), lambda t: length(t) > 2)) = 0))"


@query("FLT-04", f"""with g as (select sample_id, hit_id, {_Q} as x, lower(coalesce({q.strip('content')}, '')) as c from samples join (select hit_id, trace_id, content from retrieval_results where content is not null) using (trace_id))
select sample_id, hit_id, {_GROUNDED} as grounded from g""")
def flt_04(spark, d):
    """Groundedness of every retrieval query in the contents that were returned for it."""
    h = table(spark, d, "retrieval_results").where("content is not null").select("hit_id", "trace_id", "content")
    s = table(spark, d, "samples").select("sample_id", "trace_id", "retrieval_query")
    return s.join(h, "trace_id").select("sample_id", "hit_id", C.grounded(F.col("retrieval_query"), F.col("content")).alias("grounded"))


@query("FLT-05", f"select question_row, {_ZH.format(c='question')} as zh, {_EN.format(c='question')} as en, cast(length(question) as integer) as n from questions")
def flt_05(spark, d):
    c = F.col("question")
    return table(spark, d, "questions").select("question_row", C.mostly_chinese(c).alias("zh"), C.mostly_english(c).alias("en"), F.length(c).alias("n"))


@query("FLT-06", "select question_row from questions where expected_segment_id is not null and expected_segment_id in (select segment_id from chunk_catalog)")
def flt_06(spark, d):
    ids = _catalog(spark, d).select(F.col("segment_id").alias("expected_segment_id"))
    return table(spark, d, "questions").join(ids, "expected_segment_id", "left_semi").select("question_row")


_BIND = ["expected_segment_id", "dataset_id", "document_id", "snapshot_id"]


@query("FLT-07", f"select question_row, array_to_string(list_filter([{', '.join(f'''case when {q.non_blank(c)} is null then '{c}' end''' for c in _BIND)}], lambda x: x is not null), ',') as missing from questions")
def flt_07(spark, d):
    missing = F.array_compact(F.array(*[F.when(non_blank(c).isNull(), c) for c in _BIND]))
    return table(spark, d, "questions").select("question_row", F.array_join(missing, ",").alias("missing"))


@query("FLT-08", f"with {_REJECT}, a as (select document_id, count(*) filter (reject_reason is null) as available from rj where document_id is not null group by 1), w as (select document_id, count(*) as requested from questions where document_id is not null group by 1) select w.document_id, requested, coalesce(available, 0) as available from w left join a using (document_id) where requested > coalesce(available, 0)")
def flt_08(spark, d):
    a = C.with_reject_reason(_catalog(spark, d)).where("document_id is not null").groupBy("document_id").agg(F.count_if(F.col("reject_reason").isNull()).alias("available"))
    w = table(spark, d, "questions").where("document_id is not null").groupBy("document_id").agg(F.count("*").alias("requested"))
    return w.join(a, "document_id", "left").withColumn("available", F.coalesce("available", F.lit(0))).where("requested > available")


def _bare(c: str) -> str:
    t = rf"regexp_replace(regexp_replace(regexp_replace({c}, '^\s*\d+[.\-]\d+[.\d]*\s*', ''), '[（(][^）)]*[）)]', '', 'g'), '[《》「」\"“”]', '', 'g')"
    return q.strip(t)


def _nows(c: str) -> str:
    return f"regexp_replace({c}, '{q.WS}+', '', 'g')"


_RWORDS = " or ".join(f"contains(x, '{w}')" for w in C.RETRIEVAL_WORDS)


@query("FLT-09", f"""with c as (select segment_id, arg_min(coalesce(content, ''), chunk_row) as chunk from chunk_catalog where segment_id is not null group by 1),
s as (select question_row, coalesce({q.strip('question')}, '') as x, coalesce({q.strip('reference_answer')}, '') as r, coalesce({q.strip('source_excerpt')}, '') as e, coalesce(chunk, '') as chunk from questions left join c on c.segment_id = expected_segment_id)
select question_row, case when x = '' then 'empty' when regexp_matches(x, '[?？]') then 'question_mark' when {_RWORDS} then 'question_word' when r <> '' and length(r) < 15 then 'short_evidence'
 when r <> '' and not contains({_nows('chunk')}, {_nows('r')}) then 'not_in_chunk' when r <> '' and {_bare('x')} <> '' and contains({_bare('r')}, {_bare('x')}) then 'copied' when e <> '' and r <> '' and e <> r then 'excerpt_differs' end as error from s""")
def flt_09(spark, d):
    """Retrieval questions against the chunk they are bound to."""
    chunk = _catalog(spark, d).where("segment_id is not null").groupBy("segment_id").agg(F.min_by("content", "chunk_row").alias("chunk"))
    qs = table(spark, d, "questions").join(chunk, F.col("expected_segment_id") == F.col("segment_id"), "left")
    return qs.select("question_row", C.retrieval_question_error(F.col("question"), F.col("reference_answer"), F.col("source_excerpt"), F.col("chunk")).alias("error"))


@query("FLT-10", f"select question_row, length({q.strip('reference_answer')}) >= 15 as valid_evidence, contains({q.strip('reference_answer')}, {q.strip('question')}) as copied from questions where reference_answer is not null")
def flt_10(spark, d):
    r = strip("reference_answer")
    return table(spark, d, "questions").where("reference_answer is not null").select("question_row", (F.length(r) >= C.MIN_EVIDENCE).alias("valid_evidence"), F.contains(r, strip("question")).alias("copied"))


@query("FLT-12", "select snapshot_id, array_to_string(list_filter([case when coalesce(project_id, '') = '' then 'project_id' end, case when not coalesce(has_observations, false) then 'has_observations' end, case when coalesce(trace_count, 0) <= 0 then 'trace_count' end], lambda x: x is not null), ',') as problems from snapshots")
def flt_12(spark, d):
    checks = F.array_compact(F.array(F.when(F.coalesce("project_id", F.lit("")) == "", "project_id"), F.when(~F.coalesce("has_observations", F.lit(False)), "has_observations"), F.when(F.coalesce("trace_count", F.lit(0)) <= 0, "trace_count")))
    return table(spark, d, "snapshots").select("snapshot_id", F.array_join(checks, ",").alias("problems"))


@query("FLT-13", f"select c.chunk_row, c.dataset_id, coalesce(c.chunk_row > f.first, false) as already_there from chunk_catalog c left join (select dataset_id, content_hash, min(chunk_row) as first from chunk_catalog where status = 'completed' group by 1, 2) f on f.dataset_id = c.dataset_id and f.content_hash = c.content_hash where c.content_hash <> ''")
def flt_13(spark, d):
    """Whether the same content was ingested into the same dataset before: the first completed row decides, by one aggregate."""
    c = _catalog(spark, d).where("content_hash != ''")
    first = c.where("status = 'completed'").groupBy("dataset_id", "content_hash").agg(F.min("chunk_row").alias("first"))
    return c.join(first, ["dataset_id", "content_hash"], "left").select("chunk_row", "dataset_id", F.coalesce(F.col("first") < F.col("chunk_row"), F.lit(False)).alias("already_there"))


@query("FLT-20", f"with {_REJECT} select case when reject_reason in ('empty', 'too_short', 'title_or_page') then 'content' when reject_reason = 'duplicate' then 'duplicate' when reject_reason is not null then 'state' else 'passed' end as category, count(*) as n from rj group by 1")
def flt_20(spark, d):
    r = F.col("reject_reason")
    cat = F.when(r.isin("empty", "too_short", "title_or_page"), "content").when(r == "duplicate", "duplicate").when(r.isNotNull(), "state").otherwise("passed")
    return C.with_reject_reason(_catalog(spark, d)).groupBy(cat.alias("category")).agg(F.count("*").alias("n"))


@query("FLT-26", "select document_id, lower(regexp_extract(document_name, '\\.([A-Za-z0-9]+)$', 1)) in ('txt', 'md', 'docx', 'xlsx', 'xls', 'csv') as supported from create_document")
def flt_26(spark, d):
    ext = F.lower(F.regexp_extract("document_name", r"\.([A-Za-z0-9]+)$", 1))
    return table(spark, d, "create_document").select("document_id", ext.isin("txt", "md", "docx", "xlsx", "xls", "csv").alias("supported"))


@query("FLT-27", "select trace_id, starts_with(user_id, 'rag_eval:') as evaluation, starts_with(user_id, 'svc-') as service from traces where user_id is not null")
def flt_27(spark, d):
    return table(spark, d, "traces").where("user_id is not null").select("trace_id", F.startswith("user_id", F.lit("rag_eval:")).alias("evaluation"), F.startswith("user_id", F.lit("svc-")).alias("service"))


@query("AGG-15", "select content_hash, count(*) as n, min(chunk_row) as first_row from chunk_catalog where content_hash <> '' group by 1 having count(*) > 1")
def agg_15(spark, d):
    return _catalog(spark, d).where("content_hash != ''").groupBy("content_hash").agg(F.count("*").alias("n"), F.min("chunk_row").alias("first_row")).where("n > 1")


@query("AGG-22", f"with {_REJECT} select dataset_id, count(*) as n_chunks, count(distinct document_id) as n_documents, count(*) filter (reject_reason is null) as n_candidates, sum(tokens) as tokens from rj group by 1")
def agg_22(spark, d):
    return C.with_reject_reason(_catalog(spark, d)).groupBy("dataset_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("document_id").alias("n_documents"), F.count_if(F.col("reject_reason").isNull()).alias("n_candidates"), F.sum("tokens").alias("tokens"))


_DRAW = f"sha256('{SEED}:' || {{k}})"


@query("SRT-05", f"with {_REJECT} select chunk_row, cast(rn as integer) as place from (select chunk_row, row_number() over (order by {_DRAW.format(k='cast(chunk_row as varchar)')}) as rn from rj where reject_reason is null) where rn <= 100")
def srt_05(spark, d):
    """A seeded sample without replacement: the first 100 in hash order (a sampling operator)."""
    c = C.with_reject_reason(_catalog(spark, d)).where("reject_reason is null").select("chunk_row").withColumn("draw", C.draw(F.col("chunk_row").cast("string"), SEED))
    top = c.orderBy("draw").limit(100)
    return top.select("chunk_row", F.row_number().over(Window.orderBy("draw")).alias("place"))  # 100 rows


@query("SRT-06", f"with {_REJECT} select document_id, chunk_row, cast(rn as integer) as pool_no from (select document_id, chunk_row, row_number() over (partition by document_id order by {_DRAW.format(k="document_id || ':' || chunk_row")}, chunk_row) as rn from rj where reject_reason is null and document_id is not null) where rn <= 3")
def srt_06(spark, d):
    c = C.with_reject_reason(_catalog(spark, d)).where("reject_reason is null and document_id is not null").select("document_id", F.col("chunk_row"))
    return C.sample_per_group(c, "document_id", "chunk_row", SEED, 2)


@query("SET-01", f"select question_row from (select question_row, row_number() over (partition by {q.squeeze('question')} order by question_row) as rn from questions where {q.squeeze('question')} <> '') where rn = 1")
def set_01(spark, d):
    return C.repeated_questions(table(spark, d, "questions").select("question_row", "question"), "question_row").select("question_row")


@query("SET-02", "select question_row from (select question_row, row_number() over (partition by coalesce(document_id, ''), coalesce(target_label, '') order by question_row) as rn from questions) where rn = 1")
def set_02(spark, d):
    """The first question of every (record, field)."""
    key = F.concat_ws("\x1f", F.coalesce("document_id", F.lit("")), F.coalesce("target_label", F.lit("")))
    return C.first_by(table(spark, d, "questions").select("question_row", "document_id", "target_label"), key, "question_row").select("question_row")


@query("SET-03", f"select question_row from (select question_row, row_number() over (partition by expected_segment_id order by coalesce(document_id, ''), question_row) as rn from questions where expected_segment_id <> '') where rn = 1 order by question_row limit 500")
def set_03(spark, d):
    """Per-document results put together, one question per candidate, cut at a total (the operator's cap)."""
    t = table(spark, d, "questions").where("expected_segment_id != ''")
    one = t.groupBy("expected_segment_id").agg(F.min(F.struct(F.coalesce("document_id", F.lit("")), F.col("question_row"))).alias("m"))
    return one.select(F.col("m.question_row").alias("question_row")).orderBy("question_row").limit(500)


@query("SET-04", "select min(obs_key) as obs_key from observations where id is not null group by id union all select obs_key from observations where id is null")
def set_04(spark, d):
    """Append of unseen ids: the first row of every id, rows without an id always."""
    o = table(spark, d, "observations").select("obs_key", "id")
    return o.where("id is not null").groupBy("id").agg(F.min("obs_key").alias("obs_key")).select("obs_key").unionByName(o.where("id is null").select("obs_key"))


@query("SET-05", f"with a as (select lower(replace(trim(trace_id), '-', '')) as k from traces where trim(trace_id) <> ''), b as (select traceid as k from observations) select (select count(distinct k) from a where k not in (select k from b)) as only_traces, (select count(distinct k) from b where k not in (select k from a)) as only_observations")
def set_05(spark, d):
    """Equality of the id sets of both stores: what either has alone."""
    key = F.lower(F.replace(F.trim("trace_id"), F.lit("-"), F.lit("")))
    a = table(spark, d, "traces").where("trim(trace_id) != ''").select(key.alias("k")).distinct().withColumn("x", F.lit(1))
    b = table(spark, d, "observations").select(F.col("traceid").alias("k")).distinct().withColumn("y", F.lit(1))
    return a.join(b, "k", "full").agg(F.count_if(F.col("y").isNull()).alias("only_traces"), F.count_if(F.col("x").isNull()).alias("only_observations"))


@query("SET-06", "select distinct traceid as trace_id from observations where type = 'TRACE'")
def set_06(spark, d):
    return table(spark, d, "observations").where("type = 'TRACE'").select(F.col("traceid").alias("trace_id")).distinct()


@query("SET-09", "with newest as (select run_id, max(created_at) as m from samples where question_mode = 'chunk_exact' group by 1) select s.sample_id from samples s left join newest n using (run_id) where question_mode is distinct from 'chunk_exact' or s.created_at = n.m")
def set_09(spark, d):
    """A retry supersedes: of a run's exact-match rows only those of the newest batch stay."""
    s = table(spark, d, "samples").select("sample_id", "run_id", "question_mode", "created_at")
    exact = F.col("question_mode").eqNullSafe("chunk_exact")
    newest = s.where(exact).groupBy("run_id").agg(F.max("created_at").alias("m"))
    return s.where(~exact).select("sample_id").unionByName(s.where(exact).join(newest, "run_id").where("created_at = m").select("sample_id"))


@query("SRC-02", f"with x as (select *, row_number() over (partition by question_id order by file_name desc, line_no desc, question_row desc) as rn from questions where question_id <> '') select question_id, question_row from x where rn = 1")
def src_02(spark, d):
    """The question index by id: the last file and line win."""
    t = table(spark, d, "questions").where("question_id != ''")
    return t.groupBy("question_id").agg(F.max(F.struct("file_name", "line_no", "question_row")).alias("m")).select("question_id", F.col("m.question_row").alias("question_row"))


@query("SRC-03", f"select question_set_id, left(md5({q.strip('question')}), 12) as legacy_id, count(distinct {q.strip('question')}) = 1 as usable, max(question_row) as question_row from questions where question_mode = 'chunk_exact' group by 1, 2")
def src_03(spark, d):
    """Ids of old exact-match questions, recovered from the text; several texts under one id make it unusable."""
    t = table(spark, d, "questions").where("question_mode = 'chunk_exact'").select("question_set_id", strip("question").alias("text"), "question_row")
    return t.groupBy("question_set_id", short_md5(F.col("text")).alias("legacy_id")).agg((F.countDistinct("text") == 1).alias("usable"), F.max("question_row").alias("question_row"))


@query("SRC-31", f"select question_set_id, question_id, arg_max(topic, (file_name, line_no, question_row)) as topic from questions where question_set_id <> '' and question_id <> '' and topic is not null group by 1, 2")
def src_31(spark, d):
    t = table(spark, d, "questions").where("question_set_id != '' and question_id != '' and topic is not null")
    return t.groupBy("question_set_id", "question_id").agg(F.max_by("topic", F.struct("file_name", "line_no", "question_row")).alias("topic"))


@query("SRC-32", "select run_id, question_id, max(sample_id) as sample_id from samples where question_id <> '' group by 1, 2")
def src_32(spark, d):
    return table(spark, d, "samples").where("question_id != ''").groupBy("run_id", "question_id").agg(F.max("sample_id").alias("sample_id"))


@query("SRC-33", "with r as (select max(run_id) as run_id from samples) select sample_id from samples s, r where s.run_id = r.run_id or s.trace_id in (select trace_id from samples x where x.run_id = r.run_id)")
def src_33(spark, d):
    """Rows of a run by its id or by its traces: the disjunction as a union of two joins."""
    s = table(spark, d, "samples").select("sample_id", "run_id", "trace_id")
    run = s.agg(F.max("run_id").alias("run_id"))
    mine = s.join(run, "run_id", "left_semi")
    return mine.select("sample_id").unionByName(s.join(mine.select("trace_id"), "trace_id", "left_semi").select("sample_id")).distinct()


_BF = f"""s as (select *, {q.strip("coalesce(question, '')")} as qt, case when user_id like 'rag_eval:%' and len(string_split(user_id, ':')) >= 3 then array_to_string(string_split(user_id, ':')[3:], ':') end as uq from samples),
by_id as (select question_id, arg_max(reference_answer, (file_name, line_no, question_row)) filter (reference_answer <> '') as ra from questions where question_id <> '' group by 1),
ids as (select distinct question_id from questions where question_id <> ''),
by_text as (select {q.strip('question')} as t, arg_max(coalesce(reference_answer, ''), (file_name, line_no, question_row)) as ra, arg_max(coalesce(question_mode, ''), (file_name, line_no, question_row)) as mode from questions where {q.non_blank('question')} is not null group by 1),
last_id as (select question_id, arg_max(coalesce(reference_answer, ''), (file_name, line_no, question_row)) as ra from questions where question_id <> '' group by 1)"""


@query("JOI-01", f"""with {_BF} select sample_id, case when {q.non_blank('s.reference_answer')} is not null then 'own' when l.question_id is not null then 'id' when t.t is not null and t.mode <> 'chunk_exact' then 'text' else 'none' end as tier,
 coalesce(nullif(s.reference_answer, ''), case when l.question_id is not null then nullif(l.ra, '') when t.mode <> 'chunk_exact' then nullif(t.ra, '') end) as reference_answer
 from s left join last_id l on l.question_id = coalesce(nullif(s.question_id, ''), s.uq) left join by_text t on t.t = s.qt""")
def joi_01(spark, d):
    """Backfill by ranked joins: own value, then the question's id, then its text unless that question is exact-mode."""
    qs = table(spark, d, "questions")
    order = F.struct("file_name", "line_no", "question_row")
    by_id = qs.where("question_id != ''").groupBy(F.col("question_id").alias("qid")).agg(F.max_by(F.coalesce("reference_answer", F.lit("")), order).alias("id_answer"))
    by_text = qs.where(non_blank("question").isNotNull()).groupBy(strip("question").alias("qt")).agg(F.max_by(F.struct(F.coalesce("reference_answer", F.lit("")).alias("ra"), F.coalesce("question_mode", F.lit("")).alias("mode")), order).alias("by_text"))
    _, from_user = run_of_user(F.col("user_id"))
    s = table(spark, d, "samples").select("sample_id", "reference_answer", F.coalesce(F.nullif("question_id", F.lit("")), from_user).alias("qid"), strip(F.coalesce("question", F.lit(""))).alias("qt"))
    j = s.join(by_id, "qid", "left").join(by_text, "qt", "left")
    hit_id = F.col("id_answer").isNotNull()
    hit_text = F.col("by_text").isNotNull() & (F.col("by_text.mode") != "chunk_exact")
    tier = F.when(non_blank("reference_answer").isNotNull(), "own").when(hit_id, "id").when(hit_text, "text").otherwise("none")
    found = F.when(hit_id, F.nullif("id_answer", F.lit(""))).when(hit_text, F.nullif(F.col("by_text.ra"), F.lit("")))
    return j.select("sample_id", tier.alias("tier"), F.coalesce(F.nullif("reference_answer", F.lit("")), found).alias("reference_answer"))


@query("JOI-02", "with m as (select run_id, min(question_set_id) as set_id from samples where question_set_id <> '' group by 1) select sample_id, m.set_id as question_set_id from samples left join m using (run_id)")
def joi_02(spark, d):
    s = table(spark, d, "samples").select("sample_id", "run_id", "question_set_id")
    m = s.where("question_set_id != ''").groupBy("run_id").agg(F.min("question_set_id").alias("set_id"))
    return s.drop("question_set_id").join(m, "run_id", "left").select("sample_id", F.col("set_id").alias("question_set_id"))


@query("JOI-03", "with m as (select trace_id, min(run_id) as run_id from samples where run_id <> '' group by 1) select hit_id, m.run_id from retrieval_results left join m using (trace_id)")
def joi_03(spark, d):
    """Rows without a run get it from their trace's sample."""
    m = table(spark, d, "samples").where("run_id != ''").groupBy("trace_id").agg(F.min("run_id").alias("run_id"))
    return table(spark, d, "retrieval_results").select("hit_id", "trace_id").join(m, "trace_id", "left").select("hit_id", "run_id")


@query("JOI-04", "with m as (select run_id, min(config_id) as c from samples where config_id <> '' group by 1) select sample_id, coalesce(nullif(config_id, ''), m.c) as config_id from samples left join m using (run_id)")
def joi_04(spark, d):
    s = table(spark, d, "samples").select("sample_id", "run_id", "config_id")
    m = s.where("config_id != ''").groupBy("run_id").agg(F.min("config_id").alias("c"))
    return s.join(m, "run_id", "left").select("sample_id", F.coalesce(F.nullif("config_id", F.lit("")), "c").alias("config_id"))


@query("JOI-05", "select run_id, arg_min(question_set_id, sample_id) as question_set_id from samples where question_set_id <> '' group by 1")
def joi_05(spark, d):
    return table(spark, d, "samples").where("question_set_id != ''").groupBy("run_id").agg(F.min_by("question_set_id", "sample_id").alias("question_set_id"))


_TK = "lower(replace(trim(trace_id), '-', ''))"


@query("JOI-13", f"select distinct {_TK} as trace_id from traces where trim(trace_id) <> '' and {_TK} not in (select traceid from observations)")
def joi_13(spark, d):
    """Traces without observations."""
    key = F.lower(F.replace(F.trim("trace_id"), F.lit("-"), F.lit("")))
    t = table(spark, d, "traces").where("trim(trace_id) != ''").select(key.alias("trace_id")).distinct()
    return t.join(table(spark, d, "observations").select(F.col("traceid").alias("trace_id")), "trace_id", "left_anti")


@query("JOI-14", f"with t as (select distinct {_TK} as k from traces where trim(trace_id) <> '') select count(*) as total, count(*) filter (k in (select traceid from observations)) as covered, round(100.0 * count(*) filter (k in (select traceid from observations)) / count(*), 1) as pct from t")
def joi_14(spark, d):
    key = F.lower(F.replace(F.trim("trace_id"), F.lit("-"), F.lit("")))
    t = table(spark, d, "traces").where("trim(trace_id) != ''").select(key.alias("k")).distinct()
    o = table(spark, d, "observations").select(F.col("traceid").alias("k")).distinct().withColumn("there", F.lit(1))
    return t.join(o, "k", "left").agg(F.count("*").alias("total"), F.count("there").alias("covered")).withColumn("pct", F.round(100.0 * F.col("covered") / F.col("total"), 1))


@query("JOI-15", "select snapshot_id, (select count(*) from samples s where s.snapshot_id = n.snapshot_id) + (select count(*) from questions x where x.snapshot_id = n.snapshot_id) as n_references from snapshots n")
def joi_15(spark, d):
    """References to every snapshot."""
    refs = table(spark, d, "samples").select("snapshot_id").unionByName(table(spark, d, "questions").select("snapshot_id")).groupBy("snapshot_id").agg(F.count("*").alias("n"))
    return table(spark, d, "snapshots").select("snapshot_id").join(refs, "snapshot_id", "left").select("snapshot_id", F.coalesce("n", F.lit(0)).alias("n_references"))


_STEM = "lower(regexp_replace(document_name, '\\.[A-Za-z0-9]+$', ''))"


@query("JOI-16", f"""with f as (select distinct document_name as wanted, {_STEM} as stem from chunk_catalog where document_name is not null), c as (select document_id, document_name, {_STEM} as stem, created_at from create_document where deleted_at is null),
m as (select wanted, document_id, row_number() over (partition by wanted order by (c.document_name = wanted) desc, c.created_at desc, document_id) as rn from f join c using (stem)) select wanted, document_id from m where rn = 1""")
def joi_16(spark, d):
    """A document by name: exact before stem, then the newest; an equi-join on the stem."""
    stem = F.lower(F.regexp_replace("document_name", r"\.[A-Za-z0-9]+$", ""))
    f = _catalog(spark, d).where("document_name is not null").select(F.col("document_name").alias("wanted"), stem.alias("stem")).distinct()
    c = table(spark, d, "create_document").where("deleted_at is null").select("document_id", "document_name", stem.alias("stem"), "created_at")
    best = F.min_by("document_id", F.struct((F.col("document_name") != F.col("wanted")).alias("inexact"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), "document_id"))
    return f.join(c, "stem").groupBy("wanted").agg(best.alias("document_id"))


@query("JOI-17", "select config_id, run_id, count(*) as n from samples where config_id is not null group by 1, 2")
def joi_17(spark, d):
    return table(spark, d, "samples").where("config_id is not null").groupBy("config_id", "run_id").agg(F.count("*").alias("n"))


# --- chunking and question sets -----------------------------------------------------------------------------------

_SECTIONS = f"""ln as (select document_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from create_document where text is not null),
hd as (select *, regexp_matches(line, '^#{{1,6}}\\s+(.+)') as h from ln), gr as (select *, sum(cast(h as integer)) over (partition by document_id order by n rows unbounded preceding) as g from hd),
sec as (select document_id, g, coalesce(max(case when h then {q.strip("regexp_extract(line, '^#{1,6}\\s+(.+)', 1)")} end), '(前言)') as title, string_agg(line, chr(10) order by n) filter (not h) as body, count(*) filter (not h) as n_lines from gr group by 1, 2)"""


@query("CHK-01", f"with {_SECTIONS} select document_id, cast(row_number() over (partition by document_id order by g) as integer) as section_no, title as section_title, body from sec where n_lines > 0")
def chk_01(spark, d):
    return K.sections(table(spark, d, "create_document"), "document_id", "text").withColumnRenamed("key", "document_id")


@query("CHK-02", f"select document_id, cast(len(list_filter(list_transform(string_split_regex(text, '\\n{q.WS}*\\n'), lambda x: {q.non_blank('x')}), lambda x: x is not null)) as integer) as n_paragraphs from create_document where text is not null")
def chk_02(spark, d):
    return table(spark, d, "create_document").where("text is not null").select("document_id", F.size(K.paragraphs(F.col("text"))).alias("n_paragraphs"))


@query("CHK-03", f"select document_id, cast(len(list_filter(regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+$'), lambda x: {q.non_blank('x')} is not null)) as integer) as n_sentences from create_document where text is not null")
def chk_03(spark, d):
    return table(spark, d, "create_document").where("text is not null").select("document_id", F.size(K.sentences(F.col("text"))).alias("n_sentences"))


@query("CHK-05")
def chk_05(spark, d):
    """The full chunker over every document."""
    return K.chunk_documents(table(spark, d, "create_document"), "document_id", "text").withColumnRenamed("key", "document_id")


@query("CHK-04")
def chk_04(spark, d):
    """Greedy packing at a smaller limit, without merging chunks to a cap."""
    return K.chunk_documents(table(spark, d, "create_document"), "document_id", "text", 1200, 1 << 30).withColumnRenamed("key", "document_id").drop("text")


@query("CHK-06", f"with {_SECTIONS} select document_id, cast(sum(length(body)) as bigint) as n_chars, count(*) filter (n_lines > 0) as n_sections from sec group by 1")
def chk_06(spark, d):
    s = K.sections(table(spark, d, "create_document"), "document_id", "text").groupBy(F.col("key").alias("document_id")).agg(F.sum(F.length("body")).alias("n_chars"), F.count("*").alias("n_sections"))
    docs = table(spark, d, "create_document").where("text is not null").select("document_id")
    return docs.join(s, "document_id", "left").select("document_id", "n_chars", F.coalesce("n_sections", F.lit(0)).alias("n_sections"))


@query("LLM-02", f"with {_SECTIONS}, c as (select document_id, count(*) filter (n_lines > 0) as n, bool_or(n_lines > 0 and title <> '(前言)') as titled from sec group by 1), k as (select document_id, case when n = 1 and not titled then 0 else n end as n from c) select d.document_id, case when length(text) < 3000 then 'fast' when length(text) < 15000 and coalesce(n, 0) <= 3 then 'fast' when length(text) <= 50000 then 'balanced' else 'deep' end as strategy from create_document d left join k using (document_id) where text is not null")
def llm_02(spark, d):
    """The generation strategy of a document by its length and structure."""
    s = K.sections(table(spark, d, "create_document"), "document_id", "text").groupBy(F.col("key").alias("document_id")).agg(F.count("*").alias("n"), F.bool_or(F.col("section_title") != K.PREFACE).alias("titled"))
    docs = table(spark, d, "create_document").where("text is not null").select("document_id", F.length("text").alias("len")).join(s, "document_id", "left")
    n = F.when((F.col("n") == 1) & ~F.col("titled"), 0).otherwise(F.coalesce("n", F.lit(0)))
    return docs.select("document_id", K.strategy(F.col("len"), n).alias("strategy"))


@query("WIN-02", f"""with u as (select question_row, coalesce(topic, '') as sec, row_number() over (partition by {q.squeeze('question')} order by question_row) as dup from questions where {q.squeeze('question')} <> ''), r as (select *, row_number() over (partition by sec order by question_row) as rr, min(question_row) over (partition by sec) as f from u where dup = 1)
select question_row from r order by rr, f limit 200""")
def win_02(spark, d):
    """Deduplicated questions cut to 200 in turns over the topics (the operator's cap)."""
    u = C.repeated_questions(table(spark, d, "questions").select("question_row", "question", F.coalesce("topic", F.lit("")).alias("sec")), "question_row")
    return C.round_robin(u, "sec", "question_row", 200).select("question_row")


@query("WIN-03", """with b as (select dataset_id, document_id, chunk_row, length(content) as w from chunk_catalog where document_id is not null and length(content) > 0),
g as (select *, count(*) over p as n, sum(w) over p as s, row_number() over (partition by document_id order by chunk_row) as i from b window p as (partition by document_id)),
h as (select *, w * 5.0 / s as raw, greatest(1, floor(w * 5.0 / s)) as base from g), k as (select *, 5 - sum(base) over (partition by document_id) as diff, raw - floor(raw) as rest from h),
l as (select *, row_number() over (partition by document_id order by rest desc, i) as up, row_number() over (partition by document_id order by (base <= 1), rest, i) as down from k)
select chunk_row, cast(case when n >= 5 then cast(i <= 5 as integer) when diff > 0 then base + cast(up <= diff as integer) else base - cast(base > 1 and down <= -diff as integer) end as bigint) as share from l""")
def win_03(spark, d):
    """Five questions per document apportioned to its chunks by length."""
    c = _catalog(spark, d).where("document_id is not null and length(content) > 0").select("document_id", "chunk_row", F.length("content").cast("double").alias("w"))
    return C.apportion(c, ["document_id"], "chunk_row", "w", 5).select("chunk_row", "share")


@query("WIN-04")
def win_04(spark, d):
    """Merging of small neighbours within a section: sizes after the merge."""
    return K.chunk_documents(table(spark, d, "create_document"), "document_id", "text", K.MAX_CHARS, 1 << 30).groupBy(F.col("key").alias("document_id")).agg(F.count("*").alias("n_chunks"), F.min("char_count").alias("least"))


@query("LLM-01", f"select question_mode, count(*) as raw_count, count(distinct {q.squeeze('question')}) as final_count, count(*) - count(distinct {q.squeeze('question')}) as eliminated from questions where {q.squeeze('question')} <> '' group by 1")
def llm_01(spark, d):
    """The accounting of generation: raw, deduplicated and eliminated questions per mode."""
    t = table(spark, d, "questions").select("question_mode", squeeze("question").alias("k")).where("k != ''")
    return t.groupBy("question_mode").agg(F.count("*").alias("raw_count"), F.countDistinct("k").alias("final_count")).withColumn("eliminated", F.col("raw_count") - F.col("final_count"))


@query("LLM-07", "select chunk_row, case when length(content) > 300 then left(content, 200) || '...' || right(content, 100) else content end as excerpt from chunk_catalog")
def llm_07(spark, d):
    """Head and tail of long candidates, as they go into a prompt."""
    cut = F.concat(F.left("content", F.lit(200)), F.lit("..."), F.right("content", F.lit(100)))
    return _catalog(spark, d).select("chunk_row", F.when(F.length("content") > 300, cut).otherwise(F.col("content")).alias("excerpt"))


_TARGET = 5  # questions a document should have
_USED = f"us as (select distinct {q.squeeze('source_excerpt')} as e from questions where source_excerpt <> '')"


@query("LLM-03", f"""with {_USED}, have as (select document_id, count(*) as n from questions where document_id is not null group by 1),
pool as (select c.document_id, c.chunk_row, {_TARGET} - coalesce(h.n, 0) as missing, row_number() over (partition by c.document_id order by coalesce(chunk_position, 0), chunk_row) as i, count(*) over (partition by c.document_id) as k from chunk_catalog c left join have h using (document_id) where enabled and content is not null and c.document_id is not null and {q.squeeze('content')} not in (select e from us)),
t as (select document_id, chunk_row, cast(r as integer) as round, least({N.AT_ONCE}, missing - {N.AT_ONCE} * ((r - 1) * k + i - 1)) as n from pool, range(1, {N.ROUNDS} + 1) v(r) where missing > 0)
select document_id, chunk_row, round, cast(n as integer) as n from t where n > 0""")
def llm_03(spark, d):
    """Extra rounds: what each chunk whose text isn't used as evidence yet is asked for, until every document would have its five questions."""
    t = table(spark, d, "questions")
    used = t.where("source_excerpt != ''").select(squeeze("source_excerpt").alias("e")).distinct()
    pool = _catalog(spark, d).where("enabled and content is not null and document_id is not null").withColumn("e", squeeze("content")).join(used, "e", "left_anti").select(F.col("document_id").alias("doc"), F.col("chunk_row").alias("chunk"), F.coalesce("chunk_position", F.lit(0)).alias("place"))
    have = t.where("document_id is not null").groupBy(F.col("document_id").alias("doc")).agg(F.count("*").alias("n"))
    missing = pool.select("doc").distinct().join(have, "doc", "left").select("doc", (F.lit(_TARGET) - F.coalesce("n", F.lit(0))).alias("missing"))
    return N.extra_requests(pool, missing).select(F.col("doc").alias("document_id"), F.col("chunk").alias("chunk_row"), "round", "n")


def _qgen_sql(mode: str, n: str) -> str:
    text = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    one, many = N.COVERAGE[mode]
    values = {"content": "coalesce(content, '')", "num_questions": f"{n}::varchar", "difficulty": "'mixed'", "topic_hint_section": "''", "coverage_instruction": f"case when {n} <= 1 then {text(one)} else replace({text(many)}, '{{n}}', {n}::varchar) end",
              "section_context": f"case when nullif(document_name, '') is not null then replace({text(N.SECTION)}, '{{title}}', document_name) || coalesce({text(N.STRUCTURE)} || nullif(summary, ''), '') else '' end"}
    out = text(N.TEMPLATES[mode])
    for place in ("content", "num_questions", "difficulty", "topic_hint_section", "section_context", "coverage_instruction"):
        if "{" + place + "}" in N.TEMPLATES[mode]:
            out = f"replace({out}, '{{{place}}}', {values[place]})"
    return out


_N_ASKED = "least(greatest(length(coalesce(content, '')) // 400, 1), 3)"


@query("LLM-04", f"with p as (select chunk_row, {_qgen_sql('qa', _N_ASKED)} as a, {_qgen_sql('retrieval', _N_ASKED)} as b from chunk_catalog) select chunk_row, md5(a) as qa_md5, md5(b) as retrieval_md5, length(a) as n_chars from p")
def llm_04(spark, d):
    """The generation prompts of every chunk, for questions with answers and for search queries, as digests."""
    c = _catalog(spark, d)
    n = F.least(F.greatest(F.floor(F.length(F.coalesce("content", F.lit(""))) / 400), F.lit(1)), F.lit(3))
    prompt = lambda mode: N.generation_prompt(mode, F.col("content"), n, F.lit("mixed"), F.lit(None).cast("string"), F.col("document_name"), F.col("summary"))
    return c.select("chunk_row", F.md5(prompt("qa")).alias("qa_md5"), F.md5(prompt("retrieval")).alias("retrieval_md5"), F.length(prompt("qa")).cast("bigint").alias("n_chars"))


_PLANNED = f"""cand as (select distinct document_id as doc, segment_id as cid from chunk_catalog where document_id is not null and segment_id is not null),
it as (select question_row as seq, document_id as doc, coalesce({q.strip('expected_segment_id')}, '') as cid, query_style as style, coalesce({q.non_blank('source_excerpt')}, {q.non_blank('topic')}) as fact, target_label as label, topic as question from questions where document_id is not null and question_mode = 'chunk_exact'),
kn as (select it.*, c.cid is not null as known from it left join cand c on c.doc = it.doc and c.cid = it.cid),
fs as (select *, coalesce(known and seq = min(case when known then seq end) over (partition by doc, cid), false) as is_first from kn),
rs as (select *, case when cid = '' then 'no_candidate' when not known then 'unknown_candidate' when not is_first then 'repeated' when fact is null then 'no_fact' when {q.non_blank('label')} is null then 'no_label' end as reason from fs),
pl as (select *, case when reason is not null then reason when row_number() over (partition by doc, reason is null order by seq) <= {_TARGET} then 'planned' else 'beyond_target' end as outcome from rs)"""


def _plan_of_questions(spark, d):
    """The exact-match questions as the items of a plan, and the chunks they choose from."""
    t = table(spark, d, "questions").where("document_id is not null and question_mode = 'chunk_exact'")
    items = t.select(F.col("document_id").alias("doc"), F.col("question_row").alias("seq"), F.col("expected_segment_id").alias("candidate_id"), F.col("query_style").alias("style"), F.col("source_excerpt").alias("fact"), F.col("topic").alias("intent"), F.col("target_label").alias("label"), F.array().cast("array<string>").alias("modifiers"), F.col("topic").alias("query"))
    candidates = _catalog(spark, d).where("document_id is not null and segment_id is not null").select(F.col("document_id").alias("doc"), F.col("segment_id").alias("candidate_id"), "content", "chunk_row")
    return items, candidates


@query("LLM-06", f"with {_PLANNED} select seq as question_row, outcome, case when style in {N.STYLES} then style else '{N.ANY_STYLE}' end as style, fact from pl")
def llm_06(spark, d):
    """A plan checked: unknown, repeated and incomplete items rejected, styles outside the list replaced, at most five a document."""
    items, candidates = _plan_of_questions(spark, d)
    return N.plan_items(items.drop("query"), candidates, _TARGET).select(F.col("seq").alias("question_row"), "outcome", "style", "fact")


@query("LLM-05", f"""with {_PLANNED}, ct as (select document_id as doc, segment_id as cid, lower(coalesce({q.strip('arg_min(content, chunk_row)')}, '')) as c from chunk_catalog where document_id is not null and segment_id is not null and content is not null group by 1, 2),
qs as (select pl.doc, pl.seq, pl.cid, {q.strip("coalesce(question, '')")} as x, coalesce(ct.c, '') as c, label, exists (select 1 from pl p where p.doc = pl.doc and p.cid = pl.cid and p.outcome = 'planned') as planned from pl left join ct on ct.doc = pl.doc and ct.cid = pl.cid),
f2 as (select *, coalesce(planned and seq = min(case when planned then seq end) over (partition by doc, cid), false) as is_first from qs),
st as (select doc, case when cid = '' then 'no_candidate' when not planned then 'not_planned' when not is_first then 'repeated' when x = '' then 'no_query' when len({_errors_sql('label')}) = 0 and {_GROUNDED} then 'passed' else 'rejected' end as status from f2)
select doc as document_id, count(*) as n_items, count(*) filter (status = 'passed') as n_passed, count(*) filter (status = 'rejected') as n_rejected, count(*) filter (status = 'repeated') as n_repeated from st group by 1""")
def llm_05(spark, d):
    """Queries (the topics) bound to their planned candidates and checked (rules of a query, groundedness), counted per document."""
    items, candidates = _plan_of_questions(spark, d)
    contents = candidates.where("content is not null").groupBy("doc", "candidate_id").agg(F.min_by("content", "chunk_row").alias("content"))
    plan = N.plan_items(items.drop("query"), candidates, _TARGET)
    bound = N.bind_queries(items.select("doc", "seq", "candidate_id", "query", "label"), plan, contents)
    n = lambda s: F.count_if(F.col("status") == s)
    return bound.groupBy(F.col("doc").alias("document_id")).agg(F.count("*").alias("n_items"), n("passed").alias("n_passed"), n("rejected").alias("n_rejected"), n("repeated").alias("n_repeated"))


@query("PRJ-42", r"select question_row, regexp_replace(regexp_replace(regexp_replace(question, '^\s*\d+[.\-]\d+[.\d]*\s*', ''), '[（(][^）)]*[）)]', '', 'g'), '[《》「」""“”]', '', 'g') as bare from questions")
def prj_42(spark, d):
    t = F.regexp_replace("question", r"^\s*\d+[.\-]\d+[.\d]*\s*", "")
    return table(spark, d, "questions").select("question_row", F.regexp_replace(F.regexp_replace(t, r"[（(][^）)]*[）)]", ""), "[《》「」\"“”]", "").alias("bare"))


@query("PRJ-45", "select document_id, trim(regexp_replace(lower(document_name), '[^a-z0-9一-鿿]+', '_', 'g'), '_') as slug from create_document")
def prj_45(spark, d):
    return table(spark, d, "create_document").select("document_id", F.regexp_replace(F.regexp_replace(F.lower("document_name"), "[^a-z0-9一-鿿]+", "_"), "^_+|_+$", "").alias("slug"))


@query("PRJ-46", f"select document_id, dataset_id, {q.content_hash('text')} as content_hash, case when deleted_at is null then 'success' else 'deleted' end as ingestion_status from create_document")
def prj_46(spark, d):
    return table(spark, d, "create_document").select("document_id", "dataset_id", content_hash("text").alias("content_hash"), F.when(F.col("deleted_at").isNull(), "success").otherwise("deleted").alias("ingestion_status"))


@query("PRJ-38", "select sample_id, left(coalesce(nullif(source_excerpt, ''), reference_answer, ''), 160) as gold from samples")
def prj_38(spark, d):
    return table(spark, d, "samples").select("sample_id", F.left(F.coalesce(F.nullif("source_excerpt", F.lit("")), "reference_answer", F.lit("")), F.lit(160)).alias("gold"))


@query("PRJ-24", "select obs_key, case when input like '/%' then '[REDACTED_PATH]' when length(input) > 200 then left(input, 200) || '...' else input end as input from observations")
def prj_24(spark, d):
    """Payloads for reports: absolute paths hidden, long texts cut."""
    c = F.col("input")
    return table(spark, d, "observations").select("obs_key", F.when(c.startswith("/"), "[REDACTED_PATH]").when(F.length(c) > 200, F.concat(F.left(c, F.lit(200)), F.lit("..."))).otherwise(c).alias("input"))


@query("PRJ-37", "select doc_id, try_cast(regexp_extract(text, '(?i)(?:chunk[_\\s]?size|max[_\\s]?size|切分)[^\\d]{0,40}(\\d+)', 1) as bigint) as chunk_size from documents")
def prj_37(spark, d):
    """Values behind key words in free text."""
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"(?i)(?:chunk[_\s]?size|max[_\s]?size|切分)[^\d]{0,40}(\d+)", 1).try_cast("bigint").alias("chunk_size"))




def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
