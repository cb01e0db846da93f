"""Judging, metrics, reports and run comparison.

No model can be asked here. Answers are judged exactly: one is correct if it contains its reference or is contained in it, and
grounded if a result contains it, in the normal form of containment tests. Retrieval samples that only a model could
settle have the error ``not_judged``. The model's stage itself runs over an injected client (JDG-07, JDG-08).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import non_blank
from ..operators import judge as J
from ..operators import model as M
from ..operators import prompts as T
from ..operators import reports as P
from ..operators.ranking import numbered
from ..runtime import materialise, new_path, table
from ..sources import files
from . import sqltext as q
from .assembly import judge_key
from .define import Registry

R = Registry()
query = R.query
K = 5  # configured result window of the reports


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieval_results")


def results(spark: SparkSession, d: str) -> DataFrame:
    """Judge results of all samples."""
    pre = J.prescreened(_samples(spark, d), _hits(spark, d))
    s = _samples(spark, d).select("sample_id", "question_id", "question_set_id", "source_file_name", "topic", "difficulty", "source_format", "document_id", "config_id", "question", "final_answer", "reference_answer")
    r = pre.join(s, "sample_id")
    pending = (F.col("track") == "chunk_exact") & (F.coalesce("chunk_exact_status", F.lit("")) != "")
    said, asked = J.match_form("final_answer"), J.match_form("reference_answer")
    right = F.when(F.col("track") == "strict_qa", F.contains(said, asked) | F.contains(asked, said)).when(F.col("track") == "grounded_qa", F.col("answer_rank").isNotNull())
    return r.withColumns(
        {
            "has_reference": non_blank("reference_answer").isNotNull(),
            "answer_correct": F.when(non_blank("final_answer").isNotNull(), right.cast("int")),
            "retrieval_evaluable": ~((F.col("track") == "not_evaluable") | pending),
            "error": F.when((F.col("track") == "retrieval") & (F.col("rule") == "needs_model"), "not_judged"),
        }
    ).drop("final_answer", "reference_answer")


_RES = f"with {q.EXACT}, {q.PRE}, {q.RESULTS}"
_TOPS = ", ".join(f"avg(case when track = 'retrieval' and retrieval_evaluable then coalesce(top{k}_hit, 0) end) as retrieval_top{k}_hit_rate" for k in (1, 3, 5))
_METRICS = f"""count(*) as total, count(*) filter (error is null) as evaluated, count(*) filter (error is not null) as errors, count(*) filter (error is null and track = 'retrieval' and retrieval_evaluable) as retrieval_track_count,
{', '.join(f"count(*) filter (error is null and track = '{t}') as {t}_track_count" for t in ('strict_qa', 'grounded_qa', 'chunk_exact'))},
{', '.join(f"avg(case when error is null and track = 'retrieval' and retrieval_evaluable then coalesce(top{k}_hit, 0) end) as retrieval_top{k}_hit_rate" for k in (1, 3, 5))},
{', '.join(f"avg(case when error is null and track = '{t}_qa' then coalesce(answer_correct, 0) end) as {t}_qa_answer_rate" for t in ('strict', 'grounded'))},
count(*) filter (error is null and track = 'chunk_exact' and retrieval_evaluable and top1_hit is not null) as chunk_exact_evaluable_count,
{', '.join(f"avg(case when error is null and track = 'chunk_exact' and retrieval_evaluable then top{k}_hit end) as chunk_exact_top{k}_hit_rate" for k in (1, 3, 5, 10))},
{', '.join(f"avg(case when error is null then top{k}_hit end) as top{k}_hit_rate" for k in (1, 3, 5))}"""


@query("JDG-01", f"select sample_id, {q.track()} as track from samples")
def jdg_01(spark, d):
    return _samples(spark, d).select("sample_id", J.track().alias("track"))


@query("JDG-02", f"with {q.EXACT}, {q.PRE} select * exclude (answer_rank) from pre")
def jdg_02(spark, d):
    return J.prescreened(_samples(spark, d), _hits(spark, d)).drop("answer_rank")


@query("JDG-03", f"with {q.EXACT}, {q.PRE} select sample_id, n_results, n_content, gold_rank from ranks")
def jdg_03(spark, d):
    return J.evidence_ranks(_samples(spark, d), _hits(spark, d)).drop("answer_rank")


@query("JOI-12", f"with {q.EXACT}, {q.PRE} select sample_id, gold_rank from ranks where gold_rank is not null")
def joi_12(spark, d):
    """First rank whose content contains the gold evidence."""
    return J.evidence_ranks(_samples(spark, d), _hits(spark, d)).where("gold_rank is not null").select("sample_id", "gold_rank")


@query("JDG-04", f"with {q.EXACT} select * from exact")
def jdg_04(spark, d):
    return J.exact_judged(_samples(spark, d), _hits(spark, d))


@query("JOI-11", f"with {q.EXACT} select sample_id, call_order, hit_position from calls where hit_position is not null")
def joi_11(spark, d):
    """First rank per call by segment or content: a disjunctive equality behind the equi-join on the trace."""
    return J.exact_ranks(_samples(spark, d), _hits(spark, d)).where("hit_position is not null").select("sample_id", "call_order", "hit_position")


@query("JDG-05", f"with {q.EXACT} select sample_id, coalesce(case when retrieval_evaluable then cast(hit_evidence_position <= 5 as integer) end, 0) as top5_hit, coalesce(cast(hit_evidence_position <= 10 as integer), 0) as top10_hit from exact where retrieval_evaluable")
def jdg_05(spark, d):
    """Older results without a top-10 field get it by scanning again; their top 5 follows from the position."""
    old = J.exact_judged(_samples(spark, d), _hits(spark, d)).where("retrieval_evaluable").select("sample_id", F.when(F.col("hit_evidence_position") <= 5, F.col("hit_evidence_position")).alias("position"), F.lit(None).cast("int").alias("top10_hit"))
    again = J.exact_ranks(_samples(spark, d), _hits(spark, d)).groupBy("sample_id").agg(F.min("hit_position").alias("scanned"))
    top = lambda c, k: F.coalesce((F.col(c) <= k).cast("int"), F.lit(0))
    return old.join(again, "sample_id", "left").select("sample_id", top("position", 5).alias("top5_hit"), F.coalesce("top10_hit", top("scanned", 10)).alias("top10_hit"))


@query("JDG-06", f"with {q.EXACT}, {q.PRE}, k as (select p.sample_id, rule, left(md5({' || chr(10) || '.join([q.strip(f'''coalesce({c}, '')''') for c in ('question_mode', 'question', 'retrieval_query', 'final_answer')] + [q.gold()])}), 12) as key from pre p join samples using (sample_id)) select key as judge_key, count(*) as n_samples, min(sample_id) as first_sample from k where rule = 'needs_model' group by 1")
def jdg_06(spark, d):
    """What a model has to judge: one call per distinct content, whose verdict is joined back to all its samples."""
    keys = _samples(spark, d).select("sample_id", judge_key().alias("judge_key"))
    open_ = J.prescreened(_samples(spark, d), _hits(spark, d)).where("rule = 'needs_model'").select("sample_id")
    return open_.join(keys, "sample_id").groupBy("judge_key").agg(F.count("*").alias("n_samples"), F.min("sample_id").alias("first_sample"))


_SHOWN = f"""shown as (select trace_id, rank_position, hit_id, concat_ws(' ', '[' || rank_position || ']', nullif(document_name, ''), '(score: ' || printf('%.4f', score) || ')') as label,
  {q.strip(r"regexp_replace(regexp_replace(coalesce(nullif(content, ''), '" + T.NO_CONTENT + r"'), '<metadata>\\s*\\{[\\s\\S]*?\\}\\s*</metadata>\\s*', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} as body,
  row_number() over (partition by trace_id order by rank_position, hit_id) as i from retrieval_results where call_order = 1),
cutted as (select trace_id, i, case when length(body) > lim then left(body, lim) || '{T.CUT}' else body end as body, label from (select *, coalesce([{', '.join(map(str, T.CONTENT_LIMITS))}][i], {T.CONTENT_LIMITS[-1]}) as lim from shown)),
lst as (select trace_id, cast(count(*) as integer) as n_results, list(case when label <> '' then label || chr(10) else '' end || body order by i) as blocks, string_agg('--- 检索结果 ' || i || ' ---' || chr(10) || case when label <> '' then label || chr(10) else '' end || body, chr(10) || chr(10) order by i) as listing from cutted group by 1)"""


def _sql_text(t: str) -> str:
    return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_prompt() -> str:
    """The prompt of a sample as SQL, from the same templates."""
    values = {
        "question": f"coalesce(nullif(question, ''), '{T.NOTHING}')",
        "retrieval_query": f"coalesce(nullif(retrieval_query, ''), '{T.NOTHING}')",
        "retrieval_results": f"coalesce(listing, '{T.NO_RESULTS}')",
        "final_answer": f"coalesce(nullif(final_answer, ''), '{T.NOTHING}')",
        "gold_evidence": f"coalesce(nullif({q.gold()}, ''), '{T.NO_GOLD}')",
        "reference_answer": f"coalesce(nullif(reference_answer, ''), '{T.NOTHING}')",
        "source_excerpt": f"coalesce(nullif(source_excerpt, ''), '{T.NOTHING}')",
    }
    whens = []
    for name, template in T.TEMPLATES.items():
        filled = _sql_text(template)
        for place, value in values.items():
            if "{" + place + "}" in template:
                filled = f"replace({filled}, '{{{place}}}', {value})"
        whens.append(f"when track = '{name}' then {filled}")
    hint = f"case when track = 'retrieval' and rule_hint is not null then replace({_sql_text(T.HINT)}, '{{rank}}', cast(rule_hint as varchar)) else '' end"
    return f"case {' '.join(whens)} end || {hint}"


_PROMPTS = f"with {q.EXACT}, {q.PRE}, {_SHOWN}, pr as (select p.sample_id, p.track, p.rule, coalesce(l.n_results, 0) as n_results, l.blocks, {_sql_prompt()} as prompt, {q.gold()} as gold, {q.strip(chr(39) + chr(39) + ' || s.final_answer')} as said, {q.strip('s.reference_answer')} as ref from pre p join samples s using (sample_id) left join lst l on l.trace_id = s.trace_id)"


def _prompts(spark, d):
    pre = J.prescreened(_samples(spark, d), _hits(spark, d)).select("sample_id", "track", "rule", "rule_hint")
    return T.prompts(_samples(spark, d).join(pre, "sample_id"), _hits(spark, d)).join(pre.select("sample_id", "rule"), "sample_id")


@query("JDG-10", f"{_PROMPTS} select sample_id, track, length(prompt) as n_chars, md5(prompt) as prompt_md5 from pr")
def jdg_10(spark, d):
    """The whole prompt of every sample by the template of its track, as size and digest."""
    return _prompts(spark, d).select("sample_id", "track", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


@query("JDG-07", f"""{_PROMPTS}, a as (select *, list_position(list_transform(blocks[:5], lambda x: contains(x, gold)), true) as pos0, case when coalesce(ref, '') <> '' and track = 'strict_qa' then contains(said, ref) or contains(ref, said) else coalesce(len(list_filter(blocks, lambda x: contains(x, said))) > 0, false) end as good from pr where rule = 'needs_model'),
b as (select *, nullif(coalesce(pos0, 0), 0) as pos from a)
select sample_id, case when track = 'retrieval' then cast(pos as integer) end as position, {', '.join(f"case when track = 'retrieval' then cast(coalesce(pos <= {k}, false) as integer) end as top{k}" for k in (1, 3, 5))}, case when track <> 'retrieval' then cast(coalesce(said, '') <> '' and good as integer) end as answer_correct, cast(null as varchar) as problem from b""")
def jdg_07(spark, d):
    """The model's stage over its prompts with an injected client that looks for evidence and answers word for word; replies parsed and checked."""
    asked = materialise(_prompts(spark, d).where("rule = 'needs_model'").withColumn("judge_key", F.md5("prompt")), "prompts")
    distinct = asked.groupBy("judge_key").agg(F.min("prompt").alias("prompt"))  # one call per content
    called = M.call_model(distinct, M.exact_reader, pause=lambda s: None)
    v = asked.drop("prompt").join(called, "judge_key").withColumn("v", M.verdict(F.col("reply"), F.col("track"), F.col("n_results")))
    return v.select("sample_id", "v.position", "v.top1", "v.top3", "v.top5", "v.answer_correct", F.coalesce("error", "v.problem").alias("problem"))


@query("JDG-08", "with a as (select sample_id, case when coalesce(final_answer, '') = '' then 1 else least(sample_id % 6 + 1, 4) end as tries, case when coalesce(final_answer, '') = '' then 'HTTP 400' when sample_id % 6 > 3 then case when sample_id % 2 = 0 then 'HTTP 429' else 'timeout' end end as error from samples) select sample_id, cast(tries as integer) as tries, error from a")
def jdg_08(spark, d):
    """Calls over a service that is overloaded or slow for some and refuses empty answers: what passes is tried again, up to four tries in all."""

    def client_for() -> M.Client:
        seen: dict[str, int] = {}

        def client(prompt: str) -> str:
            key, _, answer = prompt.partition("\n")
            seen[key] = n = seen.get(key, 0) + 1
            if not answer:
                raise M.ServiceError("HTTP 400", 400)
            if n <= int(key) % 6:
                raise M.ServiceError("HTTP 429", 429, "0") if int(key) % 2 == 0 else TimeoutError("timeout")
            return "{}"

        return client

    key = F.col("sample_id").cast("string")
    rows = _samples(spark, d).select(key.alias("judge_key"), F.concat(key, F.lit("\n"), F.coalesce("final_answer", F.lit(""))).alias("prompt"))
    return M.call_model(rows, client_for(), pause=lambda s: None).select(F.col("judge_key").cast("bigint").alias("sample_id"), "tries", "error")


_KEY = "left(md5(" + " || chr(10) || ".join([q.strip(f"coalesce({c}, '')") for c in ("question_mode", "question", "retrieval_query", "final_answer")] + [q.gold()]) + "), 12)"
_EXISTING = "ex as (select trace_id, true as judged, bool_and(coalesce(final_answer, '') = '') as failed from samples where created_at < (select date_trunc('month', max(created_at)) from samples) group by 1)"


@query("JDG-09", f"""with {q.EXACT}, {q.PRE}, {_EXISTING}, st as (select p.sample_id, p.rule = 'needs_model' as needs, {_KEY} as key, case when ex.judged is null then 'new' when failed then 'retry' else 'success' end as state from pre p join samples using (sample_id) left join ex on ex.trace_id = p.trace_id),
m as (select 'incremental' as mode, * from st where state <> 'success' union all select 'retry_failed', * from st where state = 'retry' union all select 'force_all', * from st union all select 'quick_test', * from (select * from st where needs and state <> 'success' order by state = 'retry', sample_id limit 1))
select mode, count(*) as n_samples, count(*) filter (state = 'new') as n_new, count(*) filter (state = 'retry') as n_retry, count(*) filter (state = 'success') as n_again, count(distinct case when needs then key end) as n_calls from m group by 1""")
def jdg_09(spark, d):
    """What a judge run would take up in each mode, where all samples before the last month have results and empty answers had failed."""
    s = _samples(spark, d)
    last = s.agg(F.date_trunc("month", F.max("created_at")).cast("timestamp_ntz").alias("since"))
    existing = s.crossJoin(last).where("created_at < since").select("trace_id", F.when(F.coalesce("final_answer", F.lit("")) == "", "failed").alias("error"))
    pre = J.prescreened(s, _hits(spark, d)).select("sample_id", (F.col("rule") == "needs_model").alias("needs_model"))
    open_ = materialise(pre.join(s.select("sample_id", "trace_id", judge_key().alias("judge_key")), "sample_id"), "plan")
    out = None
    for mode in M.PLAN_MODES:
        one = M.plan_counts(M.run_plan(open_, existing, mode)).select(F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.unionByName(one)
    return out.where("n_samples > 0")


@query("AGG-03", f"{_RES} select {_METRICS} from results")
def agg_03(spark, d):
    return J.metrics(results(spark, d), [])


@query("AGG-05", f"{_RES} select run_id, {_METRICS} from results group by run_id")
def agg_05(spark, d):
    return J.metrics(results(spark, d), ["run_id"])


@query("AGG-04", f"""with {q.EXACT} select count(*) as total, count(*) filter (chunk_exact_status = 'missing_binding') as missing_binding, count(*) filter (chunk_exact_status = 'no_trace') as no_trace, count(*) filter (chunk_exact_status = 'no_retrieval') as no_retrieval,
count(*) filter (retrieval_evaluable and retrieval_top1_hit is not null) as evaluable, {', '.join(f'avg(case when retrieval_evaluable then retrieval_top{k}_hit end) as top{k}_rate' for k in (1, 3, 5, 10))} from exact""")
def agg_04(spark, d):
    e = J.exact_judged(_samples(spark, d), _hits(spark, d))
    pending = [F.count_if(F.col("chunk_exact_status") == s).alias(s) for s in ("missing_binding", "no_trace", "no_retrieval")]
    rates = [F.avg(F.when(F.col("retrieval_evaluable"), F.col(f"retrieval_top{k}_hit"))).alias(f"top{k}_rate") for k in (1, 3, 5, 10)]
    return e.agg(F.count("*").alias("total"), *pending, F.count_if(F.col("retrieval_evaluable") & F.col("retrieval_top1_hit").isNotNull()).alias("evaluable"), *rates)


_DIMS = ["source_file_name", "topic", "difficulty", "source_format"]
_GROUPED = " union all ".join(f"select '{c}' as dimension, coalesce(nullif({c}, ''), '(unknown)') as value, count(*) filter (track = 'retrieval' and retrieval_evaluable) as n, {', '.join(f'''avg(case when track = 'retrieval' and retrieval_evaluable then coalesce(top{k}_hit, 0) end) as top{k}_rate''' for k in (1, 3, 5))}, avg(case when track = 'strict_qa' then coalesce(answer_correct, 0) end) as strict_rate, avg(case when track = 'grounded_qa' then coalesce(answer_correct, 0) end) as grounded_rate from results where error is null and track in ('retrieval', 'strict_qa', 'grounded_qa') group by 2" for c in _DIMS)


@query("AGG-06", f"{_RES} {_GROUPED}")
def agg_06(spark, d):
    return P.grouped_rates(results(spark, d), _DIMS)


_LAYER = "count(*) as n, " + ", ".join(f"sum(coalesce(top{k}_hit, 0)) as t{k}" for k in (1, 3, 5, 10))
_EVAL = "from results r where track = 'chunk_exact' and retrieval_evaluable"


def _exact_results(spark, d):
    return results(spark, d).where("track = 'chunk_exact' and retrieval_evaluable")


def _meta(spark, d):
    """Question metadata, the last row of a (set, id) winning."""
    m = table(spark, d, "questions").where("question_id is not null")
    return m.groupBy("question_set_id", "question_id").agg(F.max_by(F.struct("query_style", "document_id"), F.struct("file_name", "line_no", "question_row")).alias("meta"))


_META = "meta as (select question_set_id, question_id, arg_max(query_style, (file_name, line_no, question_row)) as style, arg_max(coalesce(document_id, '-'), (file_name, line_no, question_row)) as doc from (select *, row_number() over (partition by question_set_id, question_id order by file_name desc, line_no desc, question_row desc) as rn from questions where question_id is not null) where rn = 1 group by 1, 2)"


@query("AGG-07", f"{_RES}, {_META}, e as (select r.*, m.style from results r left join meta m using (question_set_id, question_id) where track = 'chunk_exact' and retrieval_evaluable) select 'query_style' as dimension, coalesce(nullif(style, ''), '(unknown)') as value, {_LAYER} from e group by 2 union all select 'document', coalesce(nullif(source_file_name, ''), '(unknown)'), {_LAYER} from e group by 2")
def agg_07(spark, d):
    e = _exact_results(spark, d).join(_meta(spark, d), ["question_set_id", "question_id"], "left")
    dims = {"query_style": F.col("meta.query_style"), "document": F.col("source_file_name")}
    named = F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(F.nullif(c, F.lit("")), F.lit(P.UNKNOWN)).alias("value")) for n, c in dims.items()])
    return e.withColumn("g", F.explode(named)).groupBy("g.dimension", "g.value").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(f"top{k}_hit", F.lit(0))).alias(f"t{k}") for k in J.KS])


@query("PRJ-47", f"{_RES}, {_META} select sample_id, coalesce(nullif(document_id, ''), m.doc) as document_id, m.style as query_style from results r left join meta m using (question_set_id, question_id)")
def prj_47(spark, d):
    """Metadata of a result from the question that was asked: own value first, else the question's."""
    r = results(spark, d).select("sample_id", "question_set_id", "question_id", "document_id").join(_meta(spark, d), ["question_set_id", "question_id"], "left")
    doc = F.when(F.col("meta").isNotNull(), F.coalesce("meta.document_id", F.lit("-")))
    return r.select("sample_id", F.coalesce(F.nullif("document_id", F.lit("")), doc).alias("document_id"), F.col("meta.query_style").alias("query_style"))


@query("AGG-08", f"{_RES} select case when top1_hit = 1 then 'top1' when hit_evidence_position between 2 and 3 then 'top2_3' when hit_evidence_position between 4 and 5 then 'top4_5' when hit_evidence_position between 6 and 10 or top10_hit = 1 then 'top6_10' else 'top10_miss' end as bucket, count(*) as n {_EVAL} group by 1")
def agg_08(spark, d):
    return _exact_results(spark, d).groupBy(P.rank_bucket(F.col("hit_evidence_position"), F.col("top1_hit"), F.col("top10_hit")).alias("bucket")).agg(F.count("*").alias("n"))


_WINDOW = f"win as (select r.*, coalesce(n.n, 0) as returned, least({K}, coalesce(n.n, 0)) as effective_k from results r left join (select trace_id, count(*) as n from retrieval_results where call_order = 1 group by 1) n using (trace_id) where track = 'chunk_exact' and retrieval_evaluable)"


def _windows(spark, d):
    returned = _hits(spark, d).where("call_order = 1").groupBy("trace_id").agg(F.count("*").alias("returned"))
    r = _exact_results(spark, d).join(returned, "trace_id", "left").withColumn("returned", F.coalesce("returned", F.lit(0)))
    return r.withColumn("effective_k", F.least(F.lit(K), "returned"))


@query("AGG-09", f"{_RES}, {_WINDOW} select case when returned >= {K} then 'full_window' else 'partial_window' end as recall_window, count(*) as n, avg(effective_k) as mean_k from win group by 1")
def agg_09(spark, d):
    return _windows(spark, d).groupBy(F.when(F.col("returned") >= K, "full_window").otherwise("partial_window").alias("recall_window")).agg(F.count("*").alias("n"), F.avg("effective_k").alias("mean_k"))


@query("AGG-10", f"{_RES}, {_WINDOW} select case when returned <= 3 then '1-3' when returned <= 5 then '4-5' when returned < 10 then '6-9' else '10+' end as bucket, count(*) as n from win group by 1")
def agg_10(spark, d):
    return _windows(spark, d).groupBy(P.return_bucket(F.col("returned"), 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("AGG-11", f"{_RES}, {_WINDOW} select coalesce(nullif(source_file_name, ''), '(unknown)') as document, count(*) as n, avg(returned) as mean_returned, count(*) filter (returned < {K}) as n_partial, {', '.join(f'sum(coalesce(top{k}_hit, 0)) as t{k}' for k in (1, 3, 5, 10))}, count(*) filter (coalesce(top10_hit, 0) = 0) as miss10 from win group by 1")
def agg_11(spark, d):
    doc = F.coalesce(F.nullif("source_file_name", F.lit("")), F.lit(P.UNKNOWN))
    return _windows(spark, d).groupBy(doc.alias("document")).agg(F.count("*").alias("n"), F.avg("returned").alias("mean_returned"), F.count_if(F.col("returned") < K).alias("n_partial"), *[F.sum(F.coalesce(f"top{k}_hit", F.lit(0))).alias(f"t{k}") for k in J.KS], F.count_if(F.coalesce("top10_hit", F.lit(0)) == 0).alias("miss10"))


@query("AGG-12", f"{_RES} select run_id, count(*) filter (error is not null) as n_errors, count(*) filter (track = 'not_evaluable') as n_not_evaluable, count(*) filter (coalesce(chunk_exact_status, '') <> '') as n_pending, count(*) filter (coalesce(source_file_name, '') = '') as n_no_file from results group by 1")
def agg_12(spark, d):
    """Data-quality counters per run."""
    blank = F.coalesce("source_file_name", F.lit("")) == ""
    return results(spark, d).groupBy("run_id").agg(F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.count_if(F.col("track") == "not_evaluable").alias("n_not_evaluable"), F.count_if(F.coalesce("chunk_exact_status", F.lit("")) != "").alias("n_pending"), F.count_if(blank).alias("n_no_file"))


@query("FLT-24", f"{_RES}, t as (select run_id, count(*) as n from results group by 1) select (select sum(n) from t) = (select count(*) from results) as totals_agree, (select count(*) from results where top1_hit > coalesce(top3_hit, 0) or top3_hit > coalesce(top5_hit, 0) or top5_hit > coalesce(top10_hit, 0)) as n_not_monotonous")
def flt_24(spark, d):
    """Cross-checks of a report: totals over runs against all, and hits that don't grow with k."""
    r = results(spark, d)
    worse = (F.col("top1_hit") > F.coalesce("top3_hit", F.lit(0))) | (F.col("top3_hit") > F.coalesce("top5_hit", F.lit(0))) | (F.col("top5_hit") > F.coalesce("top10_hit", F.lit(0)))
    per_run = r.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(worse).alias("w"))
    all_ = r.agg(F.count("*").alias("total"))
    return per_run.agg(F.sum("n").alias("s"), F.sum("w").alias("n_not_monotonous")).crossJoin(all_).select((F.col("s") == F.col("total")).alias("totals_agree"), "n_not_monotonous")


def _pair(spark, d):
    """The two runs with most samples (ties by id) as old and new."""
    gold = _samples(spark, d).select("sample_id", J.match_form(J.gold_evidence()).alias("gold"))
    r = results(spark, d).select("sample_id", "run_id", "question_id", "trace_id", "top5_hit").join(gold, "sample_id")
    runs = [x.run_id for x in _samples(spark, d).where("run_id is not null").groupBy("run_id").count().orderBy(F.desc("count"), "run_id").limit(2).collect()]
    runs += [None] * (2 - len(runs))
    return P.evidence_aligned(r.where(F.col("run_id") == F.lit(runs[0])), r.where(F.col("run_id") == F.lit(runs[1])), _hits(spark, d))


_PAIR = f"""{_RES}, top2 as (select run_id, row_number() over (order by count(*) desc, run_id) as rn from samples where run_id is not null group by 1),
side as (select question_id, rn, arg_max(coalesce(r.trace_id, ''), r.sample_id) as tid, arg_max(g.g, r.sample_id) as gold, arg_max(coalesce(top5_hit, -1), r.sample_id) as h from results r join top2 using (run_id) join golds g on g.sample_id = r.sample_id where rn <= 2 and question_id is not null and question_id <> '' group by 1, 2),
al0 as (select coalesce(a.question_id, b.question_id) as question_id, a.question_id is not null as has_old, b.question_id is not null as has_new, a.tid as ot, b.tid as nt, coalesce(nullif(a.gold, ''), nullif(b.gold, '')) as gold, nullif(a.h, -1) as oh, nullif(b.h, -1) as nh
  from (select * from side where rn = 1) a full join (select * from side where rn = 2) b on a.question_id = b.question_id),
rk as (select question_id, min(case when t.trace_id = ot then rank end) as o, min(case when t.trace_id = nt then rank end) as n from al0 join hits1 t on (t.trace_id = ot or t.trace_id = nt) where rank <= 10 and form <> '' and gold is not null and contains(form, gold) group by 1),
al as (select al0.*, o, n from al0 left join rk using (question_id))"""


@query("JOI-07", f"{_PAIR} select question_id, o as old_rank, n as new_rank, has_old, has_new from al")
def joi_07(spark, d):
    p = _pair(spark, d)
    return p.select("question_id", F.col("old.rank").alias("old_rank"), F.col("new.rank").alias("new_rank"), F.col("old").isNotNull().alias("has_old"), F.col("new").isNotNull().alias("has_new"))


@query("AGG-14", f"{_PAIR} select case when not has_old or not has_new then 'unpaired' when o is not null and n is null then 'evidence_lost' when o is not null and n > o then 'ranking_regression' when oh <> nh then 'judge_disagreement' else 'unchanged' end as kind, count(*) as n from al group by 1")
def agg_14(spark, d):
    return _pair(spark, d).groupBy(P.diff_class().alias("kind")).agg(F.count("*").alias("n"))


@query("AGG-13", f"""{_PAIR}, c as (select k, coalesce(o <= k, false) as was, coalesce(n <= k, false) as now, n is null as gone from al, (values (1), (3), (5)) v(k) where has_old and has_new)
select k, count(*) filter (was) as old_hits, count(*) filter (now) as new_hits, count(*) filter (was and not now and gone) as evidence_lost, count(*) filter (was and not now and not gone) as ranking_drop, count(*) filter (not was and now) as gain, count(*) filter (was = now) as neutral,
count(*) filter (was and not now) as loss, count(*) filter (now) - count(*) filter (was) as delta from c group by 1""")
def agg_13(spark, d):
    return P.cutoff_stats(_pair(spark, d))


@query("SET-08", f"{_PAIR} select question_id from al")
def set_08(spark, d):
    return _pair(spark, d).select("question_id")


@query("SET-07", f"{_RES} select trace_id, sample_id from (select trace_id, sample_id, row_number() over (partition by trace_id order by (error is not null), sample_id desc) as rn from results) where rn = 1")
def set_07(spark, d):
    """One result per trace over all runs: one without error wins, then the latest."""
    best = F.max(F.struct(F.col("error").isNull().alias("ok"), "sample_id"))
    return results(spark, d).groupBy("trace_id").agg(best.alias("b")).select("trace_id", "b.sample_id")


@query("JOI-08", f"{_RES} select r.sample_id, case when s.trace_id is null then 'no_trace' else 'ok' end as diagnostic_status, r.track from results r left join (select distinct lower(replace(trim(trace_id), '-', '')) as trace_id from traces where trim(trace_id) <> '') s on s.trace_id = lower(replace(trim(r.trace_id), '-', ''))")
def joi_08(spark, d):
    """Results beside their stored trace, with a status where it is missing."""
    key = lambda c: F.lower(F.replace(F.trim(c), F.lit("-"), F.lit("")))
    stored = table(spark, d, "traces").where("trim(trace_id) != ''").select(key("trace_id").alias("k")).distinct().withColumn("there", F.lit(True))
    r = results(spark, d).select("sample_id", "track", key("trace_id").alias("k")).join(stored, "k", "left")
    return r.select("sample_id", F.when(F.col("there").isNull(), "no_trace").otherwise("ok").alias("diagnostic_status"), "track")


@query("AGG-25", f"""{_RES}, f as (select sample_id, run_id, case when coalesce(top5_hit, 0) = 0 then 'top5_miss' else 'sorting_issue' end as class from results where error is null and track in ('retrieval', 'chunk_exact') and retrieval_evaluable and top1_hit = 0)
select class, sample_id, cast(rn as integer) as place from (select *, row_number() over (partition by class order by sample_id) as rn from f) where rn <= 50""")
def agg_25(spark, d):
    """Up to 50 records per class of failure: a top-k report."""
    r = results(spark, d).where("error is null and track in ('retrieval', 'chunk_exact') and retrieval_evaluable and top1_hit = 0")
    f = r.select("sample_id", F.when(F.coalesce("top5_hit", F.lit(0)) == 0, "top5_miss").otherwise("sorting_issue").alias("class"))
    return P.capped(f, ["class"], [F.col("sample_id")], 50)


@query("JOI-09", f"{_RES}, n as (select document_id, count(*) as chunks from chunk_catalog where document_id is not null group by 1) select r.sample_id, r.hit_evidence_position, n.chunks from results r left join n on n.document_id = r.document_id where track = 'chunk_exact'")
def joi_09(spark, d):
    chunks = table(spark, d, "chunk_catalog").where("document_id is not null").groupBy("document_id").agg(F.count("*").alias("chunks"))
    return results(spark, d).where("track = 'chunk_exact'").join(chunks, "document_id", "left").select("sample_id", "hit_evidence_position", "chunks")


@query("JOI-10", f"{_RES}, m as (select sample_id, trace_id, hit_evidence_position from results where track = 'chunk_exact' and retrieval_evaluable and top1_hit = 0), h as (select trace_id, max(score) filter (rank_position = 1) as top1_score, max(score) as best_score from retrieval_results group by 1) select m.sample_id, top1_score, best_score, best_score > top1_score as rank_score_mismatch from m left join h using (trace_id)")
def joi_10(spark, d):
    """Evidence of misses at rank 1: scores beside ranks."""
    m = _exact_results(spark, d).where("top1_hit = 0").select("sample_id", "trace_id")
    h = _hits(spark, d).groupBy("trace_id").agg(F.max(F.when(F.col("rank_position") == 1, F.col("score"))).alias("top1_score"), F.max("score").alias("best_score"))
    return m.join(h, "trace_id", "left").select("sample_id", "top1_score", "best_score", (F.col("best_score") > F.col("top1_score")).alias("rank_score_mismatch"))


@query("AGG-20", f"{_RES} select case when error is not null then 'error' when coalesce(top5_hit, 0) = 0 then 'top5_miss' when answer_correct = 0 then 'wrong_answer' else 'sorting_issue' end as failure_type, coalesce(nullif(source_file_name, ''), nullif(question_set_id, ''), '(unknown)') as source_key, count(*) as n from results where error is not null or coalesce(top5_hit, 0) = 0 or coalesce(top1_hit, 0) = 0 or answer_correct = 0 group by 1, 2")
def agg_20(spark, d):
    return _failures(spark, d).groupBy("failure_type", "source_key").agg(F.count("*").alias("n"))


def _failures(spark, d):
    return _failure_rows(results(spark, d))


def _failure_rows(r):
    miss5, miss1 = F.coalesce("top5_hit", F.lit(0)) == 0, F.coalesce("top1_hit", F.lit(0)) == 0
    bad = F.col("error").isNotNull() | miss5 | miss1 | F.coalesce(F.col("answer_correct") == 0, F.lit(False))
    kind = F.when(F.col("error").isNotNull(), "error").when(miss5, "top5_miss").when(F.col("answer_correct") == 0, "wrong_answer").otherwise("sorting_issue")
    key = F.coalesce(F.nullif("source_file_name", F.lit("")), F.nullif("question_set_id", F.lit("")), F.lit(P.UNKNOWN))
    return r.where(bad).select("sample_id", kind.alias("failure_type"), key.alias("source_key"))


@query("AGG-21", f"{_RES}, f as (select sample_id, case when error is not null then 'error' when coalesce(top5_hit, 0) = 0 then 'top5_miss' when answer_correct = 0 then 'wrong_answer' else 'sorting_issue' end as failure_type, coalesce(nullif(source_file_name, ''), nullif(question_set_id, ''), '(unknown)') as source_key from results where error is not null or coalesce(top5_hit, 0) = 0 or coalesce(top1_hit, 0) = 0 or answer_correct = 0) select sample_id, failure_type, source_key, cast((row_number() over (partition by failure_type, source_key order by sample_id) - 1) // 4 as bigint) as batch from f")
def agg_21(spark, d):
    """Sub-batches of four within a failure group."""
    n = numbered(_failures(spark, d), ["failure_type", "source_key"], [F.col("sample_id")], "n")
    return n.select("sample_id", "failure_type", "source_key", F.floor((F.col("n") - 1) / 4).alias("batch"))


@query("AGG-19", f"{_RES} select source_file_name, count(*) as n, sum(coalesce(top1_hit, 0)) as hits1, sum(coalesce(top5_hit, 0)) as hits5, count(*) >= 3 as sufficient from results where error is null and track = 'retrieval' group by 1")
def agg_19(spark, d):
    r = results(spark, d).where("error is null and track = 'retrieval'").groupBy("source_file_name")
    return r.agg(F.count("*").alias("n"), F.sum(F.coalesce("top1_hit", F.lit(0))).alias("hits1"), F.sum(F.coalesce("top5_hit", F.lit(0))).alias("hits5"), (F.count("*") >= 3).alias("sufficient"))


@query("AGG-18", f"{_RES} select 'track' as part, track as value, count(*) as n from results group by 2 union all select 'rule', rule, count(*) from results group by 2 union all select 'status', coalesce(chunk_exact_status, '-'), count(*) from results group by 2")
def agg_18(spark, d):
    """The overview of an analysis: counts by track, rule and status in one pass."""
    parts = F.array(F.struct(F.lit("track").alias("part"), F.col("track").alias("value")), F.struct(F.lit("rule").alias("part"), F.col("rule").alias("value")), F.struct(F.lit("status").alias("part"), F.coalesce("chunk_exact_status", F.lit("-")).alias("value")))
    return results(spark, d).select(F.explode(parts).alias("p")).groupBy("p.part", "p.value").agg(F.count("*").alias("n"))


_RUN_TEXTS = ["run_id", "config_id", "config_name", "knowledge_base_version", "workflow_version", "question_set_name", "question_set_id", "started_at", "status"]
_RUN_COUNTS = ["question_count", "batch_success", "batch_total", "raw_count", "processed_count", "judge_count", "retrieval_track_count"]
_RUN_TYPES = [(c, "string") for c in _RUN_TEXTS] + [(c, "bigint") for c in _RUN_COUNTS] + [(f"retrieval_top{k}_hit_rate", "double") for k in (1, 3, 5)]
_RUN_TYPES += [x for t in ("strict_qa", "grounded_qa") for x in ((f"{t}_count", "bigint"), (f"{t}_answer_rate", "double"))] + [("chunk_exact_count", "bigint")]
_RUN_TYPES += [(f"chunk_exact_top{k}_hit_rate", "double") for k in J.KS] + [("top10_miss_count", "bigint"), ("sorting_issue_count", "bigint"), ("errors", "bigint"), ("config_snapshot_summary", "string")]
_TRACED = "st as (select distinct lower(replace(trim(trace_id), '-', '')) as k from traces where trim(trace_id) <> '')"


def _csv_round_trip(spark, df, name: str, types: list[tuple[str, str]]):
    """A table written as CSV and read again: NULL texts come back empty."""
    path = new_path(spark, name)
    files.write_csv(df.select(*[c for c, _ in types]).fillna("", [c for c, t in types if t == "string"]), path)
    return files.read_csv(spark, path, ", ".join(f"{c} {t}" for c, t in types))


@query("SNK-14", f"""{_RES}, {_TRACED}, m as (select run_id, {_METRICS}, count(*) filter (error is null and track = 'chunk_exact' and coalesce(top10_hit, 0) = 0) as top10_miss_count, count(*) filter (error is null and track = 'retrieval' and retrieval_evaluable and coalesce(top1_hit, 0) = 0 and top5_hit = 1) as sorting_issue_count from results where run_id is not null group by 1),
s as (select run_id, min(config_id) as config_id, min(question_set_id) as question_set_id, strftime(min(created_at), '%Y-%m-%dT%H:%M:%S') as started_at, count(*) as question_count, count(*) filter ({q.non_blank('final_answer')} is not null) as batch_success, count(st.k) as raw_count from samples left join st on st.k = lower(replace(trim(trace_id), '-', '')) where run_id is not null group by 1),
qn as (select question_set_id, min(question_set_name) as question_set_name from questions group by 1)
select run_id, coalesce(config_id, '') as config_id, '' as config_name, '' as knowledge_base_version, '' as workflow_version, coalesce(question_set_name, '') as question_set_name, coalesce(question_set_id, '') as question_set_id, coalesce(started_at, '') as started_at, '' as status, question_count, batch_success, question_count as batch_total, raw_count, question_count as processed_count, evaluated as judge_count, retrieval_track_count,
{', '.join(f'retrieval_top{k}_hit_rate' for k in (1, 3, 5))}, strict_qa_track_count as strict_qa_count, strict_qa_answer_rate, grounded_qa_track_count as grounded_qa_count, grounded_qa_answer_rate, chunk_exact_track_count as chunk_exact_count, {', '.join(f'chunk_exact_top{k}_hit_rate' for k in J.KS)}, top10_miss_count, sorting_issue_count, errors, coalesce('config_id=' || config_id, '') as config_snapshot_summary
from s join m using (run_id) left join qn using (question_set_id)""")
def snk_14(spark, d):
    """The runs CSV, all 32 columns; what no table holds (names and versions of configurations) stays empty."""
    r = results(spark, d).where("run_id is not null")
    ok = F.col("error").isNull()
    extra = r.groupBy("run_id").agg(F.count_if(ok & (F.col("track") == "chunk_exact") & (F.coalesce("top10_hit", F.lit(0)) == 0)).alias("top10_miss_count"), F.count_if(ok & (F.col("track") == "retrieval") & F.col("retrieval_evaluable") & (F.coalesce("top1_hit", F.lit(0)) == 0) & (F.col("top5_hit") == 1)).alias("sorting_issue_count"))
    key = lambda c: F.lower(F.replace(F.trim(c), F.lit("-"), F.lit("")))
    stored = table(spark, d, "traces").where("trim(trace_id) != ''").select(key("trace_id").alias("k")).distinct().withColumn("stored", F.lit(1))
    s = _samples(spark, d).where("run_id is not null").withColumn("k", key("trace_id")).join(stored, "k", "left")
    s = s.groupBy("run_id").agg(F.min("config_id").alias("config_id"), F.min("question_set_id").alias("question_set_id"), F.date_format(F.min("created_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"), F.count("*").alias("question_count"), F.count_if(non_blank("final_answer").isNotNull()).alias("batch_success"), F.count("stored").alias("raw_count"))
    names = table(spark, d, "questions").groupBy("question_set_id").agg(F.min("question_set_name").alias("question_set_name"))
    out = s.join(J.metrics(r, ["run_id"]), "run_id").join(extra, "run_id").join(names, "question_set_id", "left")
    out = out.withColumnsRenamed({"evaluated": "judge_count", **{f"{t}_track_count": f"{t}_count" for t in ("strict_qa", "grounded_qa", "chunk_exact")}})
    blank = {c: F.lit("") for c in ("config_name", "knowledge_base_version", "workflow_version", "status")}
    out = out.withColumns({**blank, "batch_total": F.col("question_count"), "processed_count": F.col("question_count"), "config_snapshot_summary": F.concat(F.lit("config_id="), "config_id")})
    return _csv_round_trip(spark, out, "runs", _RUN_TYPES)


_FAIL_TEXTS = ["category", "run_id", "trace_id", "config_id", "config_name", "question_id", "question_set_id", "question", "retrieval_query", "gold_evidence", "evaluation_track"]
_FAIL_TYPES = [("sample_id", "bigint")] + [(c, "string") for c in _FAIL_TEXTS] + [("hit_evidence_position", "int"), ("judge_reason", "string"), ("retrieval_result_count", "bigint")]
_FAIL_TYPES += [(c, "string") for c in ("diagnostic_status", "source_format", "source_file_name", "topic", "difficulty", "evidence_sheet", "evidence_range", "knowledge_base_version", "workflow_version")]
_FAIL_TYPES += [x for k in range(1, 6) for x in ((f"retrieval_{k}_document_name", "string"), (f"retrieval_{k}_score", "double"), (f"retrieval_{k}_content", "string"))]
_FAILED = "error is null and track = 'retrieval' and retrieval_evaluable and coalesce(top1_hit, 0) = 0"


@query("SNK-15", f"""{_RES}, h as (select trace_id, count(*) as n, {', '.join(f"max(document_name) filter (i = {k}) as d{k}, max(score) filter (i = {k}) as s{k}, max(content) filter (i = {k}) as c{k}" for k in range(1, 6))} from (select *, row_number() over (partition by trace_id order by rank_position, hit_id) as i from retrieval_results where call_order = 1) group by 1)
select r.sample_id, case when coalesce(top5_hit, 0) = 0 then 'top5_miss' else 'sorting_issue' end as category, {', '.join(f"coalesce({c}, '') as {c.split('.')[1]}" for c in ('r.run_id', 'r.trace_id', 'r.config_id', 'r.question_id', 'r.question_set_id', 'r.question'))}, coalesce(nullif(s.retrieval_query, ''), r.question, '') as retrieval_query, {q.gold().replace('source_excerpt', 's.source_excerpt').replace('reference_answer', 's.reference_answer')} as gold_evidence, track as evaluation_track, hit_evidence_position, rule as judge_reason, coalesce(h.n, 0) as retrieval_result_count, case when h.n is null then 'no_results' else 'ok' end as diagnostic_status,
{', '.join(f"coalesce(r.{c}, '') as {c}" for c in ('source_format', 'source_file_name', 'topic', 'difficulty'))}, {', '.join(f"'' as {c}" for c in ('config_name', 'evidence_sheet', 'evidence_range', 'knowledge_base_version', 'workflow_version'))}, {', '.join(f"coalesce(d{k}, '') as retrieval_{k}_document_name, s{k} as retrieval_{k}_score, coalesce(c{k}, '') as retrieval_{k}_content" for k in range(1, 6))}
from results r join samples s using (sample_id) left join h on h.trace_id = r.trace_id where {_FAILED}""")
def snk_15(spark, d):
    """The CSV of failed retrieval samples (missed, or found too low), their first five results unrolled; every failure, whole contents."""
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy("rank_position", "hit_id"))  # a trace's results are few
    got = _hits(spark, d).where("call_order = 1").withColumn("i", place)
    at = lambda c, k: F.max(F.when(F.col("i") == k, F.col(c)))
    wide = got.groupBy("trace_id").agg(F.count("*").alias("n"), *[at(c, k).alias(f"retrieval_{k}_{c}") for k in range(1, 6) for c in ("document_name", "score", "content")])
    own = _samples(spark, d).select("sample_id", "retrieval_query", J.gold_evidence().alias("gold_evidence"))
    out = results(spark, d).where(_FAILED).join(own, "sample_id").join(wide, "trace_id", "left")
    out = out.withColumns({
        "category": F.when(F.coalesce("top5_hit", F.lit(0)) == 0, "top5_miss").otherwise("sorting_issue"), "retrieval_query": F.coalesce(F.nullif("retrieval_query", F.lit("")), "question"), "evaluation_track": F.col("track"), "judge_reason": F.col("rule"),
        "retrieval_result_count": F.coalesce("n", F.lit(0)), "diagnostic_status": F.when(F.col("n").isNull(), "no_results").otherwise("ok"), **{c: F.lit("") for c in ("config_name", "evidence_sheet", "evidence_range", "knowledge_base_version", "workflow_version")},
    })
    return _csv_round_trip(spark, out, "failed", _FAIL_TYPES)


_EXACT_TYPES = [("sample_id", "bigint")] + [(c, "string") for c in ("run_id", "question_set_id", "question_id", "query", "evaluation_track", "expected_segment_id", "expected_content_hash", "chunk_exact_status")]
_EXACT_TYPES += [("hit_evidence_position", "int"), *[(f"top{k}_hit", "int") for k in J.KS], ("returned_segment_ids", "string"), ("retrieval_scores", "string")]


@query("SNK-16", f"""{_RES}, h as (select trace_id, string_agg(coalesce(segment_id, document_name, ''), '; ' order by call_order, rank_position, hit_id) as ids, string_agg(coalesce(printf('%.4f', score), ''), '; ' order by call_order, rank_position, hit_id) as scores from retrieval_results group by 1)
select r.sample_id, {', '.join(f"coalesce({c}, '') as {n}" for c, n in (('r.run_id', 'run_id'), ('r.question_set_id', 'question_set_id'), ('r.question_id', 'question_id'), ('r.question', 'query'), ('s.expected_segment_id', 'expected_segment_id'), ('s.expected_content_hash', 'expected_content_hash'), ('r.chunk_exact_status', 'chunk_exact_status'), ('h.ids', 'returned_segment_ids'), ('h.scores', 'retrieval_scores')))}, track as evaluation_track, hit_evidence_position, {', '.join(f'top{k}_hit' for k in J.KS)} from results r join samples s using (sample_id) left join h on h.trace_id = r.trace_id where track = 'chunk_exact' and error is null""")
def snk_16(spark, d):
    """The CSV of exact-match results: binding, hits, and every segment and score that was returned, over all calls in order."""
    row = F.struct("call_order", "rank_position", "hit_id", F.coalesce("segment_id", "document_name", F.lit("")).alias("s"), F.when(F.col("score").isNull(), "").otherwise(F.format_string("%.4f", "score")).alias("v"))
    h = _hits(spark, d).groupBy("trace_id").agg(F.array_sort(F.collect_list(row)).alias("x"))  # as many as a trace's calls return
    joined = lambda c: F.array_join(F.transform("x", lambda r: r[c]), "; ")
    own = _samples(spark, d).select("sample_id", "expected_segment_id", "expected_content_hash")
    out = results(spark, d).where("track = 'chunk_exact' and error is null").join(own, "sample_id").join(h, "trace_id", "left")
    out = out.withColumns({"query": F.col("question"), "evaluation_track": F.col("track"), "returned_segment_ids": joined("s"), "retrieval_scores": joined("v")})
    return _csv_round_trip(spark, out, "exact", _EXACT_TYPES)


@query("SRT-03", f"{_RES} select sample_id, cast(rn as integer) as place from (select sample_id, row_number() over (order by coalesce(source_file_name, ''), trace_id, sample_id) as rn from results where top5_hit = 0) where rn <= 20")
def srt_03(spark, d):
    """The first twenty failures by file and trace: a report's limit."""
    f = results(spark, d).where("top5_hit = 0").select("sample_id", F.coalesce("source_file_name", F.lit("")).alias("f"), "trace_id", F.lit(0).alias("one"))
    return P.capped(f, ["one"], [F.col("f"), F.col("trace_id"), F.col("sample_id")], 20).select("sample_id", "place")


@query("JOI-06", f"{_RES} select s.run_id, count(*) as n_samples, count(r.sample_id) filter (r.error is null) as n_judged, count(distinct t.k) as n_traces from samples s left join results r using (sample_id) left join (select distinct lower(replace(trim(trace_id), '-', '')) as k from traces where trim(trace_id) <> '') t on t.k = lower(replace(trim(s.trace_id), '-', '')) group by 1")
def joi_06(spark, d):
    """The state of every run: samples, judged ones, and traces that are stored."""
    key = lambda c: F.lower(F.replace(F.trim(c), F.lit("-"), F.lit("")))
    stored = table(spark, d, "traces").where("trim(trace_id) != ''").select(key("trace_id").alias("k")).distinct().withColumn("stored", F.col("k"))
    r = results(spark, d).select("sample_id", F.col("error").isNull().alias("judged"))
    s = _samples(spark, d).select("sample_id", "run_id", key("trace_id").alias("k")).join(r, "sample_id", "left").join(stored, "k", "left")
    return s.groupBy("run_id").agg(F.count("*").alias("n_samples"), F.count_if("judged").alias("n_judged"), F.countDistinct("stored").alias("n_traces"))


def _sql_label() -> str:
    row = lambda icon, title, status, text: f"{{'icon': '{icon}', 'title': {title}, 'status': '{status}', 'description': '{text}'}}"
    tops = "list_filter([" + ", ".join(f"case when top{k}_hit = 1 then 'Top{k} {J.HIT}' when top{k}_hit is not null then 'Top{k} {J.MISS}' end" for k in (1, 3, 5)) + "], lambda x: x is not null)"
    hits = lambda nothing: f"coalesce(nullif(array_to_string({tops}, '{J.BAR}'), ''), '{nothing}')"
    text = lambda t: (t[0], f"'{t[1]}'", t[2], t[3])
    whens = [f"when track = 'retrieval' then {row('🔍', hits('无检索结果'), 'retrieval', '检索命中评测')}"]
    for track, (good, bad) in J.TITLES.items():
        whens += [f"when track = '{track}' and coalesce(answer_correct, 0) = 1 then {row(*text(good))}", f"when track = '{track}' then {row(*text(bad))}"]
    whens.append(f"when track = 'not_evaluable' then {row(*text(J.NOT_EVALUABLE))}")
    whens += [f"when track = 'chunk_exact' and chunk_exact_status = '{k}' then {row('⚠️', chr(39) + t + chr(39), 'chunk_exact_pending', x)}" for k, (t, x) in J.PENDING.items()]
    whens.append(f"when track = 'chunk_exact' then {row('🎯', hits('待判定'), 'chunk_exact', '精确匹配评测（segment_id / content_hash）')}")
    return f"case {' '.join(whens)} else {row(*text(J.UNKNOWN_TRACK))} end"


@query("PRJ-23", f"{_RES} select sample_id, l.icon as icon, l.title as title, l.status as status, l.description as description from (select sample_id, {_sql_label()} as l from results)")
def prj_23(spark, d):
    """How each result is shown: icon, title, status and description by track."""
    return results(spark, d).select("sample_id", J.status_label().alias("l")).select("sample_id", "l.*")


@query("FLT-11", f"{_RES} select sample_id, case when hit_evidence_position is null then (coalesce(top1_hit, 0), coalesce(top3_hit, 0), coalesce(top5_hit, 0)) = (0, 0, 0) when hit_evidence_position <= 5 then (top1_hit, top3_hit, top5_hit) = (cast(hit_evidence_position <= 1 as integer), cast(hit_evidence_position <= 3 as integer), 1) else top5_hit = 0 end as consistent from results")
def flt_11(spark, d):
    """A verdict is consistent if its hits follow from its position."""
    p = F.col("hit_evidence_position")
    zero = sum((F.coalesce(f"top{k}_hit", F.lit(0)) for k in (1, 3, 5)), F.lit(0)) == 0
    fits = (F.col("top1_hit") == (p <= 1).cast("int")) & (F.col("top3_hit") == (p <= 3).cast("int")) & (F.col("top5_hit") == 1)
    return results(spark, d).select("sample_id", F.when(p.isNull(), zero).when(p <= 5, fits).otherwise(F.col("top5_hit") == 0).alias("consistent"))


#: The parts of a run report in order, each a SELECT of (part, cells): the SQL twin of ``report_rows``.
_OR_ZERO = "coalesce(top{k}_hit, 0)"
_REPORT_SQL = f"""{_RES}, rep as (
  select 1 as part, [track, count(*)::varchar, count(*) filter (error is not null)::varchar, {', '.join(f"sum(case when error is null then {_OR_ZERO.format(k=k)} else 0 end)::varchar" for k in J.KS)}, sum(case when error is null then coalesce(answer_correct, 0) else 0 end)::varchar] as cells from results group by track
  union all select 2, [dimension, value, count(*)::varchar, sum({_OR_ZERO.format(k=1)})::varchar, sum({_OR_ZERO.format(k=5)})::varchar] from (select unnest([{', '.join(f"{{'dimension': '{c}', 'value': coalesce(nullif({c}, ''), '(unknown)'), 'top1_hit': top1_hit, 'top5_hit': top5_hit}}" for c in _DIMS)}], recursive := true) from results where error is null and track = 'retrieval') group by dimension, value
  union all select 3, [case when top1_hit = 1 then 'top1' when hit_evidence_position between 2 and 3 then 'top2_3' when hit_evidence_position between 4 and 5 then 'top4_5' when hit_evidence_position between 6 and 10 or top10_hit = 1 then 'top6_10' else 'top10_miss' end, count(*)::varchar] {_EVAL} group by case when top1_hit = 1 then 'top1' when hit_evidence_position between 2 and 3 then 'top2_3' when hit_evidence_position between 4 and 5 then 'top4_5' when hit_evidence_position between 6 and 10 or top10_hit = 1 then 'top6_10' else 'top10_miss' end
  union all select 4, [failure_type, source_key, count(*)::varchar] from (select case when error is not null then 'error' when coalesce(top5_hit, 0) = 0 then 'top5_miss' when answer_correct = 0 then 'wrong_answer' else 'sorting_issue' end as failure_type, coalesce(nullif(source_file_name, ''), nullif(question_set_id, ''), '(unknown)') as source_key from results where error is not null or coalesce(top5_hit, 0) = 0 or coalesce(top1_hit, 0) = 0 or answer_correct = 0) group by failure_type, source_key)"""
PARTS = {1: ("Tracks", ["track", "samples", "errors", "top1", "top3", "top5", "top10", "correct"]), 2: ("Groups", ["dimension", "value", "samples", "top1", "top5"]), 3: ("Ranks", ["rank", "samples"]), 4: ("Failures", ["failure", "source", "samples"])}


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """(part, cells): the tables of a report, each from one grouped aggregate; as many rows as there are groups."""
    r = materialise(results(spark, d), "results")
    ok = F.col("error").isNull()
    total = lambda c: F.sum(F.when(ok, F.coalesce(c, F.lit(0))).otherwise(0)).cast("string")
    n = F.count("*").cast("string")
    cells = lambda df, part, *cs: df.select(F.lit(part).alias("part"), F.array(*cs).alias("cells"))
    tracks = cells(r.groupBy("track").agg(n.alias("n"), F.count_if(~ok).cast("string").alias("e"), *[total(f"top{k}_hit").alias(f"t{k}") for k in J.KS], total("answer_correct").alias("a")), 1, "track", "n", "e", "t1", "t3", "t5", "t10", "a")
    dims = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.nullif(c, F.lit("")), F.lit(P.UNKNOWN)).alias("value")) for c in _DIMS])
    groups = r.where("error is null and track = 'retrieval'").withColumn("g", F.explode(dims)).groupBy("g.dimension", "g.value").agg(n.alias("n"), total("top1_hit").alias("t1"), total("top5_hit").alias("t5"))
    ranks = r.where("track = 'chunk_exact' and retrieval_evaluable").groupBy(P.rank_bucket(F.col("hit_evidence_position"), F.col("top1_hit"), F.col("top10_hit")).alias("rank")).agg(n.alias("n"))
    failures = _failure_rows(r).groupBy("failure_type", "source_key").agg(n.alias("n"))
    return tracks.unionByName(cells(groups, 2, "dimension", "value", "n", "t1", "t5")).unionByName(cells(ranks, 3, "rank", "n")).unionByName(cells(failures, 4, "failure_type", "source_key", "n"))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
