from tracelake.llm import conversations as C

SCHEMA = "obs_key long, id string, traceid string, type string, trace_timestamp string, start_time string, input string, output string, metadata string, sessionid string, userid string, collector_id string, message string, session string, version string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "m", "s", "v") for r in data], SCHEMA)


def trace(k, t, q, a, s="s", u="u", at="2025-01-01T00:00:00Z", meta=None):
    return [(k, f"r{k}", t, "TRACE", at, at, q, None, meta, s, u, "c"), (k + 1, f"g{k}", t, "GENERATION", None, at, '{"model_mode": "chat"}', a, None, s, u, "c")]


def broken(spark, data):
    return {tuple(r) for r in C.broken_conversations(rows(spark, data)).collect()}


def test_broken(spark):
    data = [
        *trace(1, "t1", '{"sys.query": "hi"}', '{"text": "yes"}'),
        *trace(11, "t2", "plain", "plain reply", s="s2"),
        *trace(21, "t3", "plain", '{"answer": " 　"}', s="s2"),
        *trace(31, "t4", '{"sys.query": null}', "x", s="s3"),
        *trace(41, "t5", "q", None, s="s4")[:1],
        *trace(51, "t6", "q", "a", s="s5")[1:],
        *trace(61, "t7", "q", "a", s=None, u=None),
        *trace(71, "t8", '{"sys.query": "q", "sys.user_id": "w"}', None, s=None, u=None, meta='{"conversation_id": "c8"}'),
        *trace(81, " ", "q", None, s="s9"),
    ]
    assert broken(spark, data) == {("s2", "u"), ("s3", "u"), ("s4", "u"), ("s5", "u"), ("c8", "w")}


def test_user_of_any_row_and_first_reply_that_speaks(spark):
    asked, reply = trace(1, "t1", "q", None, u=None)
    span = (3, "s1", "t1", "SPAN", None, None, '{"sys.user_id": "w"}', None, None, None, None, "c")
    untyped = (4, "s2", "t1", None, None, None, '{"sys.user_id": "w"}', None, None, None, None, "c")
    assert broken(spark, [asked, reply, span]) == broken(spark, [asked, reply, untyped]) == {("s", "w")}
    assert broken(spark, trace(1, "t1", "q", '{"text": " ", "answer": "yes"}')) == set() and broken(spark, trace(1, "t1", "q", '{"text": " ", "answer": ""}')) == {("s", "u")}


def test_versions_retries_and_deletes(spark):
    ok = trace(1, "t1", "q", None)
    retry = (9, "g9", "t1", "GENERATION", None, None, '{"attempt": 2}', '{"text": "late"}', None, None, None, "c")
    assert broken(spark, ok) == {("s", "u")} and broken(spark, [*ok, retry]) == set()
    again = [*ok, retry, (10, "g9", "t1", "GENERATION", None, None, None, '{"text": "late"}', '{"status": "deleted"}', None, None, "c")]
    assert broken(spark, again) == {("s", "u")}
    edited = [*trace(1, "t1", "old", "a"), (5, "r1", "t1", "TRACE", None, None, "  ", None, None, "s", "u", "c")]
    assert broken(spark, edited) == {("s", "u")}
    assert broken(spark, trace(1, "t", "q", "a") * 3) == set() and broken(spark, []) == set()


def test_order_and_drop(spark):
    data = [*trace(1, "b", "q2", "a2", at="2025-01-02T00:00:00+08:00"), *trace(11, "a", "q1", "a1", at="1735700000"), *trace(21, "c", "q3", "a3", at="garbage"), *trace(31, "x", "q", " ", s="s2")]
    zones = spark.createDataFrame([("c", "Asia/Shanghai")], "collector_id string, zone_name string")
    out = C.rebuilt_conversations(rows(spark, data), zones).orderBy("turn_no", "role").collect()
    assert [(r.turn_no, r.role, r.content) for r in out] == [(1, "assistant", "a3"), (1, "user", "q3"), (2, "assistant", "a1"), (2, "user", "q1"), (3, "assistant", "a2"), (3, "user", "q2")]
