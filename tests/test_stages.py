"""The judge's stage, run plans, text forms, chunking by sizes, synchronisation and windows, against small cases and brute force."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracelake.functions.text import compatible
from tracelake.operators import chunking as K
from tracelake.operators import configs as C
from tracelake.operators import judge as J
from tracelake.operators import model as M
from tracelake.operators import prompts as T
from tracelake.operators.candidates import grounded
from tracelake.sources.files import write_files
from tracelake.streaming.sync import sync, synced, windowed


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, "k int, reply string, track string, n int")
    out = df.withColumn("v", M.verdict(F.col("reply"), F.col("track"), F.col("n"))).orderBy("k").select("v.*").collect()
    return [(r.top1, r.top3, r.top5, r.position, r.answer_correct, r.problem) for r in out]


def hits(a, b, c, p):
    return f'{{"retrieval_top1_hit": {a}, "retrieval_top3_hit": {b}, "retrieval_top5_hit": {c}, "hit_evidence_position": {p}}}'


def test_replies_are_read_and_checked(spark):
    cases = [
        ("Here it is: " + hits(0, 1, 1, 2) + " done", "retrieval", 5, (0, 1, 1, 2, None, None)),
        (hits(0, 0, 0, "null"), "retrieval", 5, (0, 0, 0, None, None, None)),
        (hits(1, 1, 1, "null"), "retrieval", 5, (None,) * 5 + ("position_against_hits",)),
        (hits(1, 1, 1, 2), "retrieval", 5, (None,) * 5 + ("position_against_hits",)),
        (hits(0, 0, 1, 5), "retrieval", 4, (None,) * 5 + ("bad_position",)),
        (hits(0, 0, 1, 6), "retrieval", 9, (None,) * 5 + ("bad_position",)),
        (hits(0, 0, 1, '"4"'), "retrieval", 9, (None,) * 5 + ("bad_position",)),
        (hits("true", 1, 1, 1), "retrieval", 5, (None,) * 5 + ("bad_hits",)),
        (hits(2, 1, 1, 1), "retrieval", 5, (None,) * 5 + ("bad_hits",)),
        ("no braces", "retrieval", 5, (None,) * 5 + ("no_json",)),
        (None, "strict_qa", 5, (None,) * 5 + ("no_json",)),
        ('{"answer_correct": 1}', "strict_qa", 0, (None, None, None, None, 1, None)),
        ('{"answer_correct": "1"}', "grounded_qa", 0, (None,) * 5 + ("bad_answer",)),
    ]
    assert verdicts(spark, [(k, r, t, n) for k, (r, t, n, _) in enumerate(cases)]) == [want for *_, want in cases]


def test_retries_by_class_of_failure():
    def failing(*errors):
        left = list(errors)

        def client(prompt):
            if left:
                raise left.pop(0)
            return "fine"

        return client

    pauses = []
    slow, busy, wrong = TimeoutError("t"), M.ServiceError("busy", 429, "7"), M.ServiceError("bad", 400)
    assert M.ask(failing(slow, busy, M.ServiceError("down", 503)), "p", pause=pauses.append) == ("fine", 4, None) and pauses == [1.0, 7.0, 4.0]
    assert M.ask(failing(wrong), "p", pause=pauses.append) == (None, 1, "bad")
    assert M.ask(failing(*[ConnectionError("gone")] * 9), "p", pause=lambda s: None) == (None, 4, "gone")
    assert M.ask(failing(ValueError("v")), "p", pause=lambda s: None) == (None, 1, "v") and M.pause_before(M.ServiceError("x", 429, "soon"), 2) == 4.0


SAMPLES = "sample_id long, trace_id string, judge_key string, needs_model boolean"


@pytest.mark.parametrize(
    ("mode", "want", "counts"),
    [("incremental", {2, 3, 4, 5}, (4, 3, 1, 0, 2)), ("retry_failed", {2}, (1, 0, 1, 0, 1)), ("force_all", {1, 2, 3, 4, 5, 6}, (6, 3, 1, 2, 3)), ("quick_test", {4}, (1, 1, 0, 0, 1))],
)
def test_run_plans(spark, mode, want, counts):
    samples = spark.createDataFrame([(1, "a", "k1", True), (2, "b", "k2", True), (3, "c", "k3", False), (4, "d", "k4", True), (5, "e", "k4", True), (6, "f", "k1", True)], SAMPLES)
    existing = spark.createDataFrame([("a", None), ("b", "timeout"), ("f", None)], "trace_id string, error string")
    plan = M.run_plan(samples, existing, mode)
    assert {r.sample_id for r in plan.collect()} == want and tuple(M.plan_counts(plan).first()) == counts


def test_quick_test_falls_back_to_failed_ones_and_to_nothing(spark):
    samples = spark.createDataFrame([(1, "a", "k1", True), (2, "b", "k2", True), (3, "c", "k3", False)], SAMPLES)
    done = spark.createDataFrame([("a", None), ("b", "e")], "trace_id string, error string")
    assert [r.sample_id for r in M.run_plan(samples, done, "quick_test").collect()] == [2]
    assert M.run_plan(samples, done.withColumn("error", F.lit(None).cast("string")), "incremental").where("needs_model").count() == 0
    with pytest.raises(ValueError):
        M.run_plan(samples, done, "all")


def test_prompts(spark):
    s = spark.createDataFrame([(1, "t", "retrieval", 3, "q {final_answer}", None, "x", "gold", None, None), (2, "none", "grounded_qa", None, "", None, "said", None, None, None), (3, "t", "chunk_exact", None, "q", None, "x", None, None, None)], "sample_id long, trace_id string, track string, rule_hint int, question string, retrieval_query string, final_answer string, source_excerpt string, reference_answer string, shadow string")
    h = spark.createDataFrame([(1, "t", 1, 1, 0.5, "doc", "<metadata>{\"a\": 1}</metadata> body " + "y" * 3000), (2, "t", 1, 2, None, None, None), (3, "t", 2, 1, 0.9, "other", "later call")], "hit_id long, trace_id string, call_order int, rank_position int, score double, document_name string, content string")
    out = {r.sample_id: r for r in T.prompts(s, h).collect()}
    assert "--- 检索结果 1 ---\n[1] doc (score: 0.5000)\nbody y" in out[1].prompt and T.CUT in out[1].prompt and f"--- 检索结果 2 ---\n[2]\n{T.NO_CONTENT}" in out[1].prompt and "later call" not in out[1].prompt
    assert "rank 3" in out[1].prompt and "q {final_answer}" in out[1].prompt and out[1].n_results == 2 and "[Evidence]\ngold" in out[1].prompt
    assert T.NO_RESULTS in out[2].prompt and T.NOTHING in out[2].prompt and out[3].prompt is None


def test_compatibility_normalization(spark):
    texts = ["ＨＴ－５３　ﬁle", "㎏½①²Ⅳ", "Café Å", "ｶﾞ", "⽤", "plain 中文", "", "\U0001d400", *[chr(p) for p in range(0x80, 0x2000, 7)]]
    out = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("t", compatible("t").alias("c")).collect()
    assert all(r.c == unicodedata.normalize("NFKC", r.t) for r in out)


def test_status_labels(spark):
    df = spark.createDataFrame([("retrieval", 0, 1, 1, None, None), ("strict_qa", None, None, None, 1, None), ("grounded_qa", None, None, None, None, None), ("chunk_exact", None, None, None, None, "no_trace"), ("chunk_exact", 1, 1, 1, None, ""), ("odd", None, None, None, None, None)], "track string, top1_hit int, top3_hit int, top5_hit int, answer_correct int, chunk_exact_status string")
    assert [(r.l.title, r.l.status) for r in df.select(J.status_label().alias("l")).collect()] == [("Top1 未命中｜Top3 命中｜Top5 命中", "retrieval"), ("回答正确", "correct"), ("回答缺乏依据", "not_grounded"), ("未关联 trace", "chunk_exact_pending"), ("Top1 命中｜Top3 命中｜Top5 命中", "chunk_exact"), ("未知评测类型", "unknown")]


def test_fingerprints(spark):
    import hashlib
    import json

    df = spark.createDataFrame([("c1", 5, "模型 \"a\"\n", " ", "k1", "s"), ("c2", 5, "模型 \"a\"", None, "k2", "t"), ("c3", 6, "😀", None, "k", "s")], "config_id string, top_k int, name string, note string, api_key string, token string")
    got = [r.f for r in df.select(C.fingerprint(df.columns).alias("f")).collect()]
    want = lambda d: hashlib.sha256(json.dumps(d, ensure_ascii=True, sort_keys=True).encode()).hexdigest()[:16]
    assert got[0] == got[1] == want({"top_k": "5", "name": '模型 "a"'}) and got[2] == want({"top_k": "6", "name": "😀"})
    assert "k1" not in df.select(C.summary(df.columns).alias("s")).first().s


def test_synonyms_ground_a_query(spark):
    df = spark.createDataFrame([("HVAC 合约", "the air conditioning contract")], "q string, c string")
    assert not df.select(grounded(F.col("q"), F.col("c"))).first()[0] and df.select(grounded(F.col("q"), F.col("c"), {"hvac": ["air conditioning"]})).first()[0]


def test_chunks_hold_every_text_and_the_cap_is_a_least_first_merge():
    def slowly(chunks, most):
        chunks = list(chunks)
        while len(chunks) > most:
            k = min(range(len(chunks)), key=lambda i: len(chunks[i][1]))
            k = min(k, len(chunks) - 2)
            chunks[k : k + 2] = [(chunks[k][0], chunks[k][1] + "\n\n" + chunks[k + 1][1])]
        return chunks

    rng = random.Random(2)
    for _ in range(200):
        chunks = [("s", "x" * rng.randrange(1, 30)) for _ in range(rng.randrange(1, 25))]
        assert K.at_most(chunks, 4) == slowly(chunks, 4)
    text = "intro\n# A\n" + "句子一。" * 300 + "\n\nshort\n## B\n## C\nlast"
    assert "".join("".join(t.split()) for _, t in K.chunk_text(text, 400, 1 << 30)) == "".join("".join(x for x in text.split("\n") if not x.startswith("#")).split())


def test_sections_agree_with_the_chunker(spark):
    texts = ["", "a\nb", "# A\n", "# A\n# B\nx\n\ny\n", "pre\n## T \nbody\n####### no\n#no\n# \n", "\n# Z\nz"]
    got = {}
    for r in K.sections(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").orderBy("key", "section_no").collect():
        got.setdefault(r.key, []).append((r.section_title, r.body))
    assert [got.get(k, []) for k in range(len(texts))] == [list(K._titled_spans(t)) for t in texts]


def test_synchronised_ids_come_once_however_late(spark, tmp_path):
    path, folder, schema = str(tmp_path / "in"), str(tmp_path / "out"), "id string, kind string, n long, epoch int"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        sync(spark.readStream.schema(schema).parquet(path), folder, "id", "kind", "TRACE", "n")

    add([("a", "SPAN", 1, 0), ("a", "TRACE", 2, 0), ("b", "SPAN", 3, 0), (None, None, 4, 0)])
    add([("a", "SPAN", 5, 0), ("b", "TRACE", 6, 0), ("c", "TRACE", 7, 0), ("c", "TRACE", 8, 0)])
    add([("d", None, 9, 0)])
    assert sorted(r.id for r in synced(spark, folder, "roots").collect()) == ["a", "c"]
    assert sorted((r.id or "", r.n) for r in synced(spark, folder, "rest").collect()) == [("", 4), ("b", 3), ("d", 9)]


def test_windows_keep_their_latest_state(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in ([(1, 0), (2, 10)], [(3, 20), (4, 4000)], [(5, 90000)]):
        spark.createDataFrame(part, "v int, s long").select("v", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("v int, at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    out = windowed(stream, str(tmp_path / "w"), "at", F.window("at", "1 hour"), [], [F.sum("v").alias("v"), F.count("*").alias("n")])
    assert sorted((r.v, r.n) for r in out.collect()) == [(4, 1), (5, 1), (6, 3)]


def test_files_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([("a.bin", bytearray(b"\x00\xff")), ("b.bin", bytearray(b""))], "n string, c binary")
    write_files(df, "n", "c", f"file://{tmp_path}/out")
    write_files(df, "n", "c", f"file://{tmp_path}/out")
    assert sorted((p.name, p.read_bytes()) for p in (tmp_path / "out").iterdir()) == [("a.bin", b"\x00\xff"), ("b.bin", b"")]


def test_numbers_within_hot_and_small_groups(spark):
    from tracelake.operators.ranking import numbered

    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 6 + [None, "a", "b"]), rng.randrange(10_000), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, k long")
    want, seen = {}, {}
    for g, o, k in sorted(rows, key=lambda r: (r[0] or "", r[0] is not None, r[1], r[2])):
        want[k] = seen[g] = seen.get(g, 0) + 1
    assert {r.k: r.n for r in numbered(df, ["g"], [F.col("o"), F.col("k")], "n").collect()} == want
    assert sorted(r.n for r in numbered(df, [], [F.desc("k")], "n").collect()) == list(range(1, 3001)) and numbered(df.where("1 = 0"), ["g"], [F.col("o")], "n").collect() == []
