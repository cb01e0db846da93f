"""Operators on small frames: fixed cases, nulls, ties, repeated rows, empty tables, clashing names."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelake.functions import jsons, text, times
from tracelake.operators import candidates as C
from tracelake.operators import chunking as K
from tracelake.operators import configs, grids, judge, reports, samples
from tracelake.operators.retrieval import top_k

OBS = "obs_key long, id string, traceid string, type string, name string, start_time string, end_time string, input string, output string, metadata string, sessionid string, userid string, tracename string, providedmodelname string, ord string"


def obs(spark, rows):
    keys = ["id", "traceid", "type", "name", "start_time", "end_time", "input", "output", "metadata", "sessionid", "userid", "tracename", "providedmodelname"]
    return spark.createDataFrame([(k, *[r.get(c) for c in keys], "x") for k, r in enumerate(rows)], OBS)


def assemble(spark, rows):
    return {r.trace_id: r for r in samples.assemble_samples(samples.normalised_observations(obs(spark, rows))).collect()}


def test_assembly(spark):
    root = dict(id="r", traceid="t", type="TRACE", name="chat", start_time="2026-08-05T10:00:00Z", input='{"sys.query": "q"}', output='{"answer": "root answer"}', userid="rag_eval:run:q:1")
    hit = '{"result": [{"title": "a", "metadata": {"position": 1, "score": 0.5, "segment_id": "s%d"}}]}'
    calls = [dict(id=f"c{k}", traceid="t", type="SPAN", name="kr", start_time=f"2026-08-05T10:00:0{k}Z", input='{"query": "q%d"}' % k, output=hit % k, metadata='{"node_type": "knowledge-retrieval"}') for k in (2, 1, 3)]
    model = dict(id="g", traceid="t", type="GENERATION", name="llm", start_time="2026-08-05T09:59:59Z", output='{"text": "model answer"}', providedmodelname="m")
    span = dict(id="s", traceid="u", type="SPAN", start_time=None, input="plain", output='{"answer": "weak"}', metadata="broken {")
    later = dict(id="s2", traceid="u", type="SPAN", start_time="2026-01-01T00:00:00Z", input="x", output='{"answer": "too late"}')
    out = assemble(spark, [root, *calls, model, span, later])
    t, u = out["t"], out["u"]
    assert (t.question, t.retrieval_query, t.retrieval_call_count, t.user_id, t.llm_model) == ("q", "q3", 3, "rag_eval:run:q:1", "m")
    assert t.final_answer == "model answer" and t.earliest_obs_time == "2026-08-05T09:59:59Z" and t.trace_timestamp == "2026-08-05T10:00:00Z"
    assert u.final_answer == "weak" and u.root_input == "plain" and u.root_output == '{"answer": "weak"}'
    assert assemble(spark, []) == {}
    hits = samples.simplified_hits(samples.retrieval_calls(samples.normalised_observations(obs(spark, calls)))).collect()
    assert sorted((h.call_order, h.segment_id) for h in hits) == [(1, "s1"), (2, "s2"), (3, "s3")]


@pytest.mark.parametrize(
    ("mode", "excerpt", "reference", "want"),
    [("chunk_exact", None, None, "chunk_exact"), ("retrieval", "e", None, "retrieval"), ("retrieval", " ", "r", "retrieval"), ("retrieval", "", None, "not_evaluable"), ("qa", None, "r", "strict_qa"), (" ", "e", None, "grounded_qa"), (None, None, "r", "strict_qa")],
)
def test_tracks(spark, mode, excerpt, reference, want):
    df = spark.createDataFrame([(mode, excerpt, reference)], "question_mode string, source_excerpt string, reference_answer string")
    assert df.select(judge.track()).first()[0] == want


SAMPLES = "sample_id long, trace_id string, run_id string, question string, question_mode string, final_answer string, reference_answer string, source_excerpt string, expected_segment_id string, expected_content_hash string, rank int"
HITS = "trace_id string, call_order int, rank_position int, segment_id string, content string, sample_id string"


def test_judges(spark):
    gold = "the bond runs for thirty days"
    s = spark.createDataFrame(
        [
            (1, "t1", "r", "q", "chunk_exact", None, None, None, "s1", None, 0), (2, "t1", "r", "q", "chunk_exact", None, None, None, " ", None, 0), (3, "batch_qa_1", "r", "q", "chunk_exact", None, None, None, "s1", None, 0),
            (4, "none", "r", "q", "chunk_exact", None, None, None, "s1", None, 0), (5, "t2", "r", "q", "retrieval", None, None, gold, None, None, 0), (6, "t3", "r", "q", "retrieval", None, None, gold, None, None, 0),
            (7, "t4", "r", "q", "retrieval", None, None, gold, None, None, 0), (8, "t5", "r", "q", "retrieval", None, None, gold, None, None, 0), (9, "t2", "r", " ", "qa", "a", "ref", None, None, None, 0), (10, "t2", "r", "q", "qa", None, "ref", None, None, None, 0),
        ],
        SAMPLES,
    )
    h = spark.createDataFrame(
        [("t1", 1, 1, "s9", None, ""), ("t1", 1, 4, "s1", None, ""), ("t1", 2, 2, " s1 ", None, ""), ("t2", 1, 1, "x", f"so **{gold}**.", ""), ("t3", 1, 1, "x", "no", ""), ("t3", 1, 3, "x", gold, ""), ("t4", 1, 1, "x", " ", "")], HITS
    )
    out = {r.sample_id: r for r in judge.prescreened(s, h).collect()}
    assert (out[1].hit_evidence_position, out[1].top1_hit, out[1].top3_hit) == (2, 0, 1)
    assert [out[k].chunk_exact_status for k in (1, 2, 3, 4)] == ["", "missing_binding", "no_trace", "no_retrieval"] and out[2].top10_hit is None
    assert [out[k].rule for k in (5, 6, 7, 8, 9, 10)] == ["exact_contains_top1", "needs_model", "no_content", "empty_results", "no_question", "no_answer"]
    assert out[6].rule_hint == 3 and out[5].top1_hit == 1 and out[8].top5_hit == 0
    exact = {r.sample_id: r for r in judge.exact_judged(s, h).collect()}
    assert exact[1].retrieval_call_count == 2 and exact[1].subquery_hit_count == 2 and not exact[2].retrieval_evaluable


def test_metrics_have_their_own_denominators(spark):
    rows = [(1, "retrieval", 1, 1, 1, 1, None, True, None), (1, "retrieval", 0, 1, 1, 1, None, True, None), (1, "retrieval", 0, 0, 0, 0, None, False, None), (1, "strict_qa", None, None, None, None, 1, True, None), (1, "strict_qa", None, None, None, None, 0, True, "timeout"), (1, "chunk_exact", 1, 1, 1, None, None, True, None)]
    r = spark.createDataFrame(rows, "run_id int, track string, top1_hit int, top3_hit int, top5_hit int, top10_hit int, answer_correct int, retrieval_evaluable boolean, error string")
    m = judge.metrics(r, []).first()
    assert (m.total, m.errors, m.retrieval_track_count, m.retrieval_top1_hit_rate, m.strict_qa_answer_rate, m.grounded_qa_answer_rate) == (6, 1, 2, 0.5, 1.0, None)
    assert m.chunk_exact_top1_hit_rate == 1.0 and m.chunk_exact_top10_hit_rate is None
    assert judge.metrics(r.where("1 = 0"), []).first().total == 0


def test_run_comparison(spark):
    cols = "question_id string, sample_id long, rank int, top5_hit int"
    old = spark.createDataFrame([("a", 1, 1, 1), ("b", 2, 2, 1), ("c", 3, None, 0), ("d", 4, 1, 1), ("a", 0, 9, 0), (None, 9, 1, 1)], cols)
    new = spark.createDataFrame([("a", 5, None, 0), ("b", 6, 4, 1), ("c", 7, 1, 1), ("e", 8, 1, 1)], cols)
    pairs = reports.aligned(old, new)
    kinds = {r.question_id: r.k for r in pairs.select("question_id", reports.diff_class().alias("k")).collect()}
    assert kinds == {"a": "evidence_lost", "b": "ranking_regression", "c": "judge_disagreement", "d": "unpaired", "e": "unpaired"}
    k3 = {r.k: r for r in reports.cutoff_stats(pairs).collect()}[3]
    assert (k3.old_hits, k3.new_hits, k3.evidence_lost, k3.ranking_drop, k3.gain, k3.loss, k3.delta) == (2, 1, 1, 1, 1, 2, -1)


def test_capped_is_a_top_k(spark):
    df = spark.createDataFrame([("a" if k % 3 else "b", k) for k in range(300)] * 2, "g string, k long")
    out = reports.capped(df, ["g"], [F.col("k")], 5).collect()
    assert sorted((r.g, r.place, r.k) for r in out)[:5] == [("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("a", 4, 2), ("a", 5, 4)] and len(out) == 10


def test_text_functions(spark):
    df = spark.createDataFrame([("　 Ab\tC \n", "x\r\ny "), ("", "  "), (None, None)], "a string, b string")
    r = df.select(text.strip("a").alias("s"), text.squeeze("a").alias("q"), text.non_blank("b").alias("n"), text.content_hash("b").alias("h"), text.first_filled("a", "b").alias("f")).collect()
    assert (r[0].s, r[0].q) == ("Ab\tC", "abc") and r[1].n is None and r[1].h == "" and r[2].h == "" and r[1].f == "  " and r[2].s is None
    import hashlib

    assert r[0].h == hashlib.sha256(b"x\ny").hexdigest()


def test_times_and_json(spark):
    df = spark.createDataFrame([("2026-08-05 10:00:00.5+0800",), ("2026-08-05T10:00Z",), ("soon",), (" ",), (None,)], "t string")
    assert [r[0] for r in df.select(times.iso_text("t")).collect()] == ["2026-08-05T10:00:00.500000+08:00", "2026-08-05T10:00:00Z", "soon", None, None]
    assert [r[0] is None for r in df.select(times.iso_instant("t")).collect()] == [False, False, True, True, True]
    j = spark.createDataFrame([('{"a": 1}',), ("5 apples",), ("[1]",), ('{"a": ',), ("5",), (None,)], "t string")
    assert [r[0] for r in j.select(jsons.is_json("t")).collect()] == [True, False, True, False, True, False]
    assert [r[0] for r in j.select(jsons.get(jsons.json_object("t"), "a")).collect()] == ["1", None, None, None, None, None]


def test_chunking(spark):
    doc = "preface\n# One\n" + "\n\n".join("句子。" * 40 for _ in range(4)) + "\n## Two\n\nshort\n# Three\n" + "word. " * 200
    chunks = K.chunk_text(doc, 300)
    assert all(len(t) <= 300 + K.MIN_CHARS for _, t in chunks) and [t for t, _ in chunks][0] == K.PREFACE and len(K.chunk_text(doc, 300, 3)) == 3
    assert K.chunk_text("", 300) == [] and K.chunk_text("one\n\ntwo") == [(K.BODY, "one\n\ntwo")]
    df = spark.createDataFrame([("d", doc, 1), ("e", None, 1), ("f", " ", 1)], "id string, text string, key int")
    assert {r.key for r in K.chunk_documents(df, "id", "text").collect()} == {"d"}
    got = [(r.section_no, r.section_title) for r in K.sections(df.where("id = 'd'"), "id", "text").collect()]
    assert got == [(1, K.PREFACE), (2, "One"), (3, "Two"), (4, "Three")]


def test_candidates(spark):
    cat = "chunk_row long, status string, enabled boolean, content_hash string, content string, repeated int"
    rows = [(1, "completed", True, "h1", "x" * 30, 0), (2, "error", True, "h2", "x" * 30, 0), (3, "completed", False, "h3", "x" * 30, 0), (4, "completed", True, "d", "x" * 30, 0), (5, "completed", None, "d", "x" * 30, 0), (6, "completed", True, "", " ", 0), (7, "completed", True, None, "short", 0), (8, "completed", True, "h8", "# " + "y" * 30, 0)]
    out = {r.chunk_row: r.reject_reason for r in C.with_reject_reason(spark.createDataFrame(rows, cat).drop("repeated")).collect()}
    assert out == {1: None, 2: "status_not_completed", 3: "disabled", 4: "duplicate", 5: "duplicate", 6: "empty", 7: "too_short", 8: "title_or_page"}
    q = spark.createDataFrame([("合同违约金比例", "x"), ("什么是违约金？", None), ("a", ""), (None, "x"), ("甲方、乙方、丙方责任", "x")], "q string, l string")
    assert [r[0] for r in q.select(C.query_errors(F.col("q"), F.col("l"))).collect()] == [[], ["no_label", "question_word", "question_mark"], ["no_label"], ["empty"], ["several_concepts"]]
    g = spark.createDataFrame([("违约金比例", "本合同违约金为5%"), ("unknown term", "本合同"), ("", "x"), ("ab", "zz")], "q string, c string")
    assert [r[0] for r in g.select(C.grounded(F.col("q"), F.col("c"))).collect()] == [True, False, False, True]


def test_apportion(spark):
    rows = [("a", 1, 10.0), ("a", 2, 30.0), ("a", 3, 60.0), ("b", 1, 1.0), ("b", 2, 1.0), ("c", 1, 97.0), ("c", 2, 1.0), ("c", 3, 1.0), ("c", 4, 1.0)]
    df = spark.createDataFrame(rows, "g string, i int, w double")
    out = {}
    for r in C.apportion(df, ["g"], "i", "w", 5).collect():
        out.setdefault(r.g, []).append((r.i, r.share))
    assert {k: [s for _, s in sorted(v)] for k, v in out.items()} == {"a": [1, 1, 3], "b": [3, 2], "c": [3, 1, 1, 1]} or sum(s for _, s in out["a"]) == 5


def test_grids(spark):
    doc = "title\nname | price | unit\nbolt | 1,000 | box\nnut |  | bag\ntotal | 9 | x"
    g = grids.cells(spark.createDataFrame([(1, doc), (2, None)], "doc_id long, text string"), "doc_id", "text")
    assert {r.row: r.is_summary for r in grids.row_profile(g).collect()} == {2: False, 3: False, 4: False, 5: True}
    assert grids.header_rows(g).first().header_row == 2 and [(r.label_row, r.value_row) for r in grids.value_pairs(g).collect()] == [(2, 3), (4, 5)]
    assert sorted((r.row, r.first_col, r.last_col) for r in grids.islands(g).collect()) == [(2, 1, 3), (3, 1, 3), (4, 1, 1), (4, 3, 3), (5, 1, 3)]
    assert grids.rendered(g).where("row = 4").first().evidence == "name：nut；unit：bag"
    n = spark.createDataFrame([(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (18278, "ZZZ")], "n int, l string")
    assert all(r.l == r.a and r.n == r.b for r in n.select("n", "l", grids.column_letters(F.col("n")).alias("a"), grids.column_number(F.col("l")).alias("b")).collect())


def test_configs(spark):
    df = spark.createDataFrame([(1, "a", 5, 2.0), (2, "a", 5, 1.0), (3, " a ", 5, 3.0), (4, "b", None, 1.0), (5, "b", None, 1.0), (6, "c", 1, 1.0)], "c long, x string, y int, created double")
    runs = spark.createDataFrame([(10, 1)], "run long, c long")
    plan = {r.c: (r.canonical, r.action) for r in configs.cleanup_plan(df, runs, "c", ["x", "y"], "created").collect()}
    assert plan == {1: (2, "archive"), 2: (2, "keep"), 3: (2, "delete"), 4: (4, "keep"), 5: (4, "delete")}
    base = spark.createDataFrame([("k", "v1")], "k string, state string")
    t = datetime(2025, 1, 1)
    edits = spark.createDataFrame([("k", t + timedelta(days=1), "v3", "n2"), ("k", t, "v2", "n1")], "k string, edited_at timestamp_ntz, value string, note string")
    r = configs.with_history(base, edits, "k", "state").first()
    assert r.state == "v3" and [h.before for h in r.history] == ["v1", "v2"]


def test_top_k(spark):
    import random

    rng = random.Random(1)
    rows = [(k, [rng.random() for _ in range(8)]) for k in range(150)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    import numpy as np

    m = {k: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for k, v in rows[:150]}
    want = {k: sorted((x for x in m if x != k), key=lambda x: (-float(m[k] @ m[x]), x))[:3] for k in range(0, 150, 20)}
    for block in (2048, 16):
        out = {}
        for r in top_k(df.where("vec_id % 20 = 0 and vec_id < 150"), df, "vec_id", "embedding", 3, block=block).collect():
            out.setdefault(r.query_id, {})[r.rank] = r.row_id
        assert {k: [v[i] for i in (1, 2, 3)] for k, v in out.items()} == want


def test_block_markdown_holds_every_row(spark):
    """All rows are rendered, in blocks of 30 under the header; a sheet of its header alone is one block."""
    cells = [(1, r, c, f"{r}.{c}") for r in range(1, 65) for c in (1, 2)] + [(2, 1, 1, "h"), (3, 3, 1, None), (3, 3, 2, "x"), (3, 40, 1, "y")]
    got = {(r.sheet, r.block): r.markdown.split("\n") for r in grids.block_markdown(spark.createDataFrame(cells, "sheet long, row int, col int, value string")).collect()}
    line = lambda r: f"| {r}.1 | {r}.2 |"
    assert got == {(1, 0): [line(r) for r in range(1, 32)], (1, 1): [line(1), *(line(r) for r in range(32, 62))], (1, 2): [line(1), *(line(r) for r in range(62, 65))], (2, 0): ["| h |"], (3, 0): ["|  | x |"], (3, 1): ["| y |"]}


def test_ranges_of_wide_rows(spark, tmp_path):
    """PRJ-44 names columns right of Z."""
    from tracelake.plans import tables

    lines = "|".join("x" * 30) + "\n" + "|".join("y" * 3)
    spark.createDataFrame([(7, "price-sheets", lines)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.cell_range for r in tables.prj_44(spark, str(tmp_path)).collect()} == {"A1:AD1", "A2:C2"}
