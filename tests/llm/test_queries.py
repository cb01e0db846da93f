"""The training-data queries: SQL twins, and figures that hold over the smallest tables."""

from tests.twins import connect, differs
from tracelake.llm import queries as L
from tracelake.runtime import ship


def test_twins(spark, sf):
    ship(spark)
    queries, sql = L.queries(), L.oracle_sql()
    wrong = {n: d for n in sql if (d := differs(spark, connect(sf), queries[n], sql[n], sf))}
    assert not wrong


def test_invariants(spark, sf):
    ship(spark)
    q = L.queries()
    pieces = q["p7_pieces"](spark, sf).toPandas()
    assert (pieces["size"] <= 3000).all() and (pieces.groupby(["field_name", "item_key"])["piece_no"].max() == pieces.groupby(["field_name", "item_key"])["n_pieces"].first()).all()
    packed = q["p8_containers"](spark, sf).toPandas()
    assert packed.groupby(["shard", "container"])["n_tokens"].sum().max() <= 2048
    shares = q["p9_shares"](spark, sf).toPandas()
    assert (shares["most_repeats"] <= shares["max_repeats"]).all() and abs(shares["reached_share"].sum() - 1) < 1e-9
    found = q["p10_found"](spark, sf).toPandas()
    assert (found["doc_id_a"] < found["doc_id_b"]).all() and not found.duplicated().any()
    turns = q["p6_conversations"](spark, sf).toPandas()
    assert (turns.groupby(["sessionid", "userid"])["turn_no"].max() * 2 == turns.groupby(["sessionid", "userid"]).size()).all()
    broken = {tuple(r) for r in q["p6_found"](spark, sf).collect()}
    assert not broken & set(zip(turns["sessionid"], turns["userid"]))
