"""Building blocks of the SQL twins, so that each rule is written once."""

from __future__ import annotations

ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(?:\.(\d{1,9}))?(Z|[+-]\d{2}(?::?\d{2})?)?$"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]"


def strip(c: str) -> str:
    return f"trim({c}, {BLANKS})"


def non_blank(c: str) -> str:
    return f"nullif({strip(c)}, '')"


def squeeze(c: str) -> str:
    return f"regexp_replace(lower({c}), '{WS}+', '', 'g')"


def obj(c: str) -> str:
    return f"(case when ltrim({c}) like '{{%' and json_valid({c}) then {c} end)"


def get(o: str, key: str) -> str:
    return f"json_extract_string({o}, '$.\"{key}\"')"


def filled(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cols) + ")"


def iso(c: str) -> str:
    t = non_blank(c)
    g = lambda n: f"regexp_extract({t}, '{ISO}', {n})"
    frac = f"left(rpad({g(4)}, 6, '0'), 6)"
    zone = rf"regexp_replace(regexp_replace({g(5)}, '^([+-]\d{{2}})(\d{{2}})$', '\1:\2'), '^([+-]\d{{2}})$', '\1:00')"
    return f"(case when regexp_matches({t}, '{ISO}') then {g(1)} || 'T' || {g(2)} || case when {g(3)} = '' then ':00' else {g(3)} end || case when {frac} = '000000' then '' else '.' || {frac} end || case when {zone} in ('+00:00', '-00:00') then 'Z' else {zone} end else {t} end)"


def content_hash(c: str) -> str:
    return f"case when coalesce({strip(c)}, '') = '' then '' else sha256(replace({strip(c)}, chr(13) || chr(10), chr(10))) end"


def track() -> str:
    ex, ref, mode = non_blank("source_excerpt"), non_blank("reference_answer"), f"coalesce({non_blank('question_mode')}, '')"
    return f"case when {mode} = 'chunk_exact' then 'chunk_exact' when {mode} = 'retrieval' and ({ex} is not null or {ref} is not null) then 'retrieval' when {mode} = 'retrieval' then 'not_evaluable' when {ref} is not null then 'strict_qa' else 'grounded_qa' end"


def gold() -> str:
    return f"coalesce({non_blank('source_excerpt')}, {non_blank('reference_answer')}, '')"


def match_form(c: str) -> str:
    wide = "".join(chr(p) for p in range(0xFF01, 0xFF5F)) + "　"
    narrow = ("".join(chr(p - 0xFEE0) for p in range(0xFF01, 0xFF5F)) + " ").replace("'", "''")
    t = f"translate(coalesce({c}, ''), '{wide}', '{narrow}')"
    for pattern, keep in ((r"`([^`]*)`", r"\1"), (r"\*{1,2}([^*]*)\*{1,2}", r"\1"), (r"__([^_]*)__", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"<[^>]+>", ""), (WS + "+", " "), ("^ | $", "")):
        t = f"regexp_replace({t}, '{pattern}', '{keep}', 'g')"
    return f"translate({t}, '，。！？；：（）【】「」、', ',.!?;:()[][],')"


OBS = f"""obs as (select obs_key, id, traceid as trace_id, case when type = 'TRACE' then 'SPAN' else type end as type, type as raw_type, type = 'TRACE' as is_trace_root, name,
    {iso('start_time')} as start_time, {iso('end_time')} as end_time, {filled('tracename', 'name')} as trace_name, nullif(providedmodelname, '') as model, input, output, o, i, m,
    {filled('sessionid', get('m', 'conversation_id'), get('m', 'session_id'), get('m', 'sessionId'))} as session_id,
    {filled('userid', get('m', 'user_id'), get('m', 'userId'), get('i', 'sys.user_id'))} as user_id
  from (select *, {obj('input')} as i, {obj('output')} as o, {obj('metadata')} as m from observations)),
ordered as (select *, row_number() over (partition by trace_id order by coalesce(start_time, ''), is_trace_root desc, coalesce(name, ''), coalesce(id, ''), obs_key) as ord,
    {get('m', 'node_type')} = 'knowledge-retrieval' as is_retrieval, (raw_type = 'GENERATION' or coalesce({get('m', 'node_type')} = 'llm', false) or coalesce(name = 'LLM', false)) as is_llm,
    is_trace_root or coalesce(name = 'message', false) as strong from obs)"""

EXACT = f"""want as (select sample_id, trace_id, run_id, {non_blank('expected_segment_id')} as eid, {non_blank('expected_content_hash')} as eh from samples),
got as (select trace_id, call_order, rank_position as rank, {non_blank('segment_id')} as sid, nullif({content_hash('content')}, '') as h from retrieval_results),
calls as (select sample_id, call_order, min(case when rank <= 10 and (eid = sid or eh = h) then rank end) as hit_position, cast(count(*) as integer) as result_count from want join got using (trace_id) group by 1, 2),
per as (select sample_id, min(hit_position) as pos, cast(count(*) as integer) as n_calls, cast(count(hit_position) as integer) as n_hit from calls group by 1),
exact0 as (select s.sample_id, s.trace_id, s.run_id, p.pos, p.n_calls, p.n_hit,
    case when w.eid is null and w.eh is null then 'missing_binding' when {non_blank('s.trace_id')} is null or s.trace_id like 'batch_qa_%' then 'no_trace' when p.n_calls is null then 'no_retrieval' else '' end as st
  from (select * from samples where {track()} = 'chunk_exact') s join want w using (sample_id) left join per p using (sample_id)),
exact as (select sample_id, trace_id, run_id, {', '.join(f"case when st = '' then coalesce(cast(pos <= {k} as integer), 0) end as retrieval_top{k}_hit" for k in (1, 3, 5, 10))},
    case when st = '' then pos end as hit_evidence_position, st as chunk_exact_status, st = '' as retrieval_evaluable, case when st = '' then n_calls end as retrieval_call_count, case when st = '' then n_hit end as subquery_hit_count from exact0)"""

PRE = f"""golds as (select sample_id, trace_id, {match_form(gold())} as g, {match_form('final_answer')} as said from samples),
hits1 as (select trace_id, rank_position as rank, {non_blank('content')} as content, {match_form(non_blank('content'))} as form from retrieval_results where call_order = 1),
ranks as (select sample_id, cast(count(*) as integer) as n_results, cast(count(*) filter (content is not null and rank <= 5) as integer) as n_content,
    min(case when content is not null and rank <= 10 and length(g) >= 8 and contains(form, g) then rank end) as gold_rank, min(case when content is not null and said <> '' and contains(form, said) then rank end) as answer_rank from golds join hits1 using (trace_id) group by 1),
ruled as (select s.*, r.n_results, r.n_content, r.gold_rank, r.answer_rank, e.hit_evidence_position as ep, e.chunk_exact_status, coalesce(r.n_results, 0) = 0 as none, {non_blank('s.question')} is null as no_q, {non_blank('s.final_answer')} is null as no_a
  from (select *, {track()} as track from samples) s left join ranks r using (sample_id) left join exact e using (sample_id)),
named as (select *, case when track = 'not_evaluable' then 'not_evaluable' when track = 'chunk_exact' then 'chunk_exact' when no_q then 'no_question' when track = 'retrieval' and none then 'empty_results'
    when track = 'retrieval' and n_content = 0 then 'no_content' when track = 'retrieval' and gold_rank = 1 then 'exact_contains_top1' when track = 'retrieval' then 'needs_model' when none and no_a then 'no_retrieval_no_answer'
    when none then 'needs_model' when no_a then 'no_answer' else 'needs_model' end as rule from ruled),
placed as (select *, case when rule = 'exact_contains_top1' then 1 when rule = 'chunk_exact' then ep end as position, rule = 'needs_model' or (rule = 'chunk_exact' and coalesce(chunk_exact_status, '') <> '') as pending from named),
pre as (select sample_id, trace_id, run_id, track, rule, {', '.join(f"case when not pending then coalesce(cast(position <= {k} as integer), 0) end as top{k}_hit" for k in (1, 3, 5, 10))}, position as hit_evidence_position, chunk_exact_status,
    case when rule = 'needs_model' and track = 'retrieval' and gold_rank between 2 and 5 then gold_rank end as rule_hint, answer_rank from placed)"""

#: Judge results over the test tables: rule verdicts, and for answers the exact judge (see plans.judging).
RESULTS = f"""results as (select p.*, s.question_id, s.question_set_id, s.source_file_name, s.topic, s.difficulty, s.source_format, s.document_id, s.config_id, s.question, {non_blank('s.reference_answer')} is not null as has_reference,
    case when {non_blank('s.final_answer')} is null then null when track = 'strict_qa' then cast(contains({match_form('s.final_answer')}, {match_form('s.reference_answer')}) or contains({match_form('s.reference_answer')}, {match_form('s.final_answer')}) as integer) when track = 'grounded_qa' then cast(answer_rank is not null as integer) end as answer_correct,
    not (track = 'not_evaluable' or (track = 'chunk_exact' and coalesce(p.chunk_exact_status, '') <> '')) as retrieval_evaluable,
    case when track = 'retrieval' and rule = 'needs_model' then 'not_judged' end as error from pre p join samples s using (sample_id))"""
