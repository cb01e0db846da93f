from datetime import datetime as dt

from tracelake.operators.references import Entity, ForeignKey, direct_orphans, life_spans, orphan_cascade, orphan_report

E = [Entity("parent", "pk", "pid", deleted="deleted_at"), Entity("child", "ck", "cid"), Entity("leaf", "lk")]
K = [ForeignKey("child", "pref", "parent"), ForeignKey("leaf", "cref", "child")]
PARENT = "pk long, pid string, created_at timestamp_ntz, deleted_at timestamp_ntz, key string"
CHILD = "ck long, cid string, pref string, created_at timestamp_ntz, at string"
LEAF = "lk long, cref string, created_at timestamp_ntz, spans int"
D = [dt(2025, m, 1) for m in range(1, 13)]


def frames(spark, parent, child, leaf):
    return {"parent": spark.createDataFrame(parent, PARENT), "child": spark.createDataFrame(child, CHILD), "leaf": spark.createDataFrame(leaf, LEAF)}


def test_reasons_and_cascade(spark):
    f = frames(
        spark,
        [(1, "A", D[0], None, ""), (2, "b", D[5], None, ""), (3, "c", D[0], D[2], ""), (4, "c", D[6], None, "")],
        [(10, "x", " a ", D[1], ""), (11, "y", "B", D[1], ""), (12, "z", "c", D[4], ""), (13, "w", "none", D[1], ""), (14, "v", "  ", D[1], ""), (15, "x", "zz", D[3], ""), (16, "u", None, None, ""), (17, "c", "C", D[7], "")],
        [(100, "x", D[5], 1), (101, "Y", D[5], 1), (102, "w", D[0], 1), (103, "q", D[5], 1), (104, "w", D[5], 1), (104 + 1, None, D[5], 1)],
    )
    got = {(r.table_name, r.row_key, r.reason, r.depth) for r in orphan_cascade(f, E, K).collect()}
    assert got == {
        ("child", 11, "late", 0), ("child", 12, "deleted", 0), ("child", 13, "missing", 0), ("child", 15, "missing", 0),
        ("leaf", 102, "late", 0), ("leaf", 103, "missing", 0), ("leaf", 101, "inherited", 1), ("leaf", 104, "inherited", 1),
    }
    assert sum(r.n_orphans for r in orphan_report(orphan_cascade(f, E, K)).collect()) == 8


def test_deleted_at_the_very_moment_and_no_time(spark):
    f = frames(spark, [(1, "a", D[0], D[3], ""), (2, "n", None, None, "")], [(10, "x", "a", D[3], ""), (11, "y", "a", None, ""), (12, "z", "n", D[0], "")], [])
    assert [(r.row_key, r.reason, r.period) for r in direct_orphans(f, E, K).collect()] == [(10, "deleted", "2025-04")]


def test_empty_tables(spark):
    assert orphan_cascade(frames(spark, [], [], []), E, K).collect() == []


def test_spans_of_a_hot_key_merge(spark):
    rows = [("k", D[i % 11], D[i % 11 + 1]) for i in range(500)] + [("k", dt(2027, 1, 1), None)]
    out = life_spans(spark.createDataFrame(rows, "key string, created timestamp_ntz, deleted timestamp_ntz"), salts=4).collect()
    assert len(out) == 1 and len(out[0].spans) == 2 and out[0].spans[0].s == D[0] and out[0].spans[0].e == D[11]
