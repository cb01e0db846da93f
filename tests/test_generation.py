"""Plans, bindings and extra rounds of question generation."""

from tracelake.operators import generation as N

ITEMS = "doc string, seq long, candidate_id string, style string, fact string, intent string, label string, modifiers array<string>, known string"


def test_plan(spark):
    rows = [
        ("d", 1, " c1 ", "lexical", "f", None, "l", ["a", " ", "b", "c"], ""), ("d", 2, "c1", "semantic", "f", None, "l", None, ""), ("d", 3, "zz", None, "f", None, "l", None, ""), ("d", 4, None, None, "f", None, "l", None, ""),
        ("d", 5, "c2", "odd", " ", "i", "l", None, ""), ("d", 6, "c3", None, None, None, "l", None, ""), ("d", 7, "c4", None, "f", None, " ", None, ""), ("d", 8, "c5", None, "f", None, "l", None, ""), ("e", 9, "c1", None, "f", None, "l", None, ""),
    ]
    candidates = spark.createDataFrame([("d", f"c{k}") for k in range(1, 6)] + [("d", "c1"), ("e", "x")], "doc string, candidate_id string")
    out = {r.seq: r for r in N.plan_items(spark.createDataFrame(rows, ITEMS), candidates, 2).collect()}
    assert {k: r.outcome for k, r in out.items()} == {1: "planned", 2: "repeated", 3: "unknown_candidate", 4: "no_candidate", 5: "planned", 6: "no_fact", 7: "no_label", 8: "beyond_target", 9: "unknown_candidate"}
    assert out[1].modifiers == ["a", "b"] and out[1].style == "lexical" and out[5].style == "semantic" and out[5].fact == "i"
    assert N.plan_items(spark.createDataFrame([], ITEMS), candidates, 2).collect() == []


def test_bindings(spark):
    plan = spark.createDataFrame([("d", "c1", "planned", "lexical"), ("d", "c2", "planned", "semantic"), ("d", "c3", "no_fact", "semantic")], "doc string, candidate_id string, outcome string, style string")
    queries = spark.createDataFrame([("d", 1, "c1", "bond amount", "l"), ("d", 2, "c1", "bond", "l"), ("d", 3, "c3", "bond", "l"), ("d", 4, "", "x", "l"), ("d", 5, "c2", "why is the bond due?", ""), ("d", 6, None, "x", "l")], "doc string, seq long, candidate_id string, query string, label string")
    contents = spark.createDataFrame([("d", "c1", "the bond amount is 5"), ("d", "c2", "nothing of it")], "doc string, candidate_id string, content string")
    out = {r.seq: r for r in N.bind_queries(queries, plan, contents).collect()}
    assert {k: r.status for k, r in out.items()} == {1: "passed", 2: "repeated", 3: "not_planned", 4: "no_candidate", 5: "rejected", 6: "no_candidate"}
    assert out[5].errors == ["no_label", "question_word", "question_mark", "not_grounded"] and out[1].style == "lexical" and out[2].errors is None


def brute(chunks, missing):
    out = []
    for r in (1, 2, 3):
        for c in chunks:
            if missing > 0:
                out.append((c, r, min(3, missing)))
                missing -= 3
    return out


def test_extra_rounds(spark):
    pool = spark.createDataFrame([("a", 10 + k, k) for k in range(2)] + [("b", 20, 0), ("c", 30, 0), ("e", 40, 0)], "doc string, chunk long, place int")
    missing = spark.createDataFrame([("a", 10), ("b", 100), ("c", 0), ("d", 5)], "doc string, missing int")
    got = {}
    for r in N.extra_requests(pool, missing).orderBy("round", "chunk").collect():
        got.setdefault(r.doc, []).append((r.chunk, r.round, r.n))
    assert got == {"a": brute([10, 11], 10), "b": brute([20], 100)}


def test_prompt_of_a_passage(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("text {difficulty}", 1, None, "", None), ("text", 3, "prices", "Terms", "A、B"), (None, 2, "", None, "x")], "content string, n int, hint string, title string, structure string")
    out = [r[0] for r in df.select(N.generation_prompt("qa", *[F.col(c) if c != "d" else F.lit("hard") for c in ("content", "n", "d", "hint", "title", "structure")])).collect()]
    assert "one question about the main point" in out[0] and "章节" not in out[0] and "主题方向：prices" in out[1] and "当前章节：「Terms」\n文档整体结构：A、B" in out[1] and "3 questions" in out[1] and "- difficulty: hard" in out[1]
    assert "整体结构" not in out[2] and "\n\n[Passage]\n\n" in out[2]
