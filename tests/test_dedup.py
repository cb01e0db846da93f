import random
from datetime import datetime, timedelta

import pytest

from tracelake.streaming.dedup import batch_duplicates, duplicate_deliveries, read_stream

SCHEMA = "delivery_id long, trace_id string, received_at timestamp_ntz, key string, at string, bucket string"
T0 = datetime(2025, 1, 1)


def write(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def ids(df):
    out = [r.delivery_id for r in df.select("delivery_id").collect()]
    assert len(out) == len(set(out))
    return set(out)


def run(spark, path, **kw):
    rows = spark.read.parquet(path)
    got = ids(duplicate_deliveries(read_stream(spark, path, 1), rows, "trace_id", "received_at", "delivery_id", **kw))
    assert got == ids(batch_duplicates(rows, "trace_id", "received_at", "delivery_id"))
    return got


def test_order_spelling_nulls_and_clashing_columns(spark, tmp_path):
    day = timedelta(days=1)
    rows = [(1, "A-b", T0, "", "", ""), (2, " ab ", T0, "", "", ""), (3, "AB", T0 - day, "", "", ""), (4, None, T0, "", "", ""), (5, "", T0, "", "", ""), (6, " - ", T0, "", "", ""), (7, "-", T0, "", "", ""), (8, "x", None, "", "", ""), (9, "X", T0, "", "", ""), (10, "n", None, None, None, None), (11, "N", None, None, None, None)]
    assert run(spark, write(spark, str(tmp_path / "t"), [rows])) == {1, 2, 8, 11}


def test_late_rows_and_ids_that_return_after_expiry(spark, tmp_path):
    rng = random.Random(5)
    batches, k = [], 0
    for b in range(4):
        rows = []
        for _ in range(60):
            k += 1
            rows.append((k, f"id-{rng.randrange(40)}", T0 + timedelta(days=40 * b - rng.choice([0, 0, 0, 90]), seconds=rng.randrange(9)), "", "", ""))
        batches.append(rows)
    assert len(run(spark, write(spark, str(tmp_path / "t"), batches), delay="1 day", keep_ms=86_400_000)) > 150


def test_hot_identifier(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"i{i}", T0 + timedelta(seconds=i * 7 % 1000), "", "", "") for i in range(3000)]
    assert len(run(spark, write(spark, str(tmp_path / "t"), [rows]))) == 1999


def test_empty(spark, tmp_path):
    assert run(spark, write(spark, str(tmp_path / "t"), [[]])) == set()


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    path, folder = str(tmp_path / "t"), str(tmp_path / "state")
    write(spark, path, [[(1, "a", T0, "", "", ""), (2, "b", T0, "", "", "")]])
    assert run(spark, path, folder=folder) == set()
    write(spark, path, [[(3, "A", T0 + timedelta(hours=1), "", "", ""), (4, "B", T0 - timedelta(hours=1), "", "", "")]])
    assert run(spark, path, folder=folder) == {2, 3}
    with pytest.raises(Exception):
        read_stream(spark, str(tmp_path / "nothing"))


def test_the_state_alone_finds_what_came_in_time(spark, tmp_path):
    """Without late rows nothing is looked up: the verdicts of the state are the result; with them they aren't enough."""
    path, folder = str(tmp_path / "t"), str(tmp_path / "state")
    write(spark, path, [[(k, f"i{k % 50}", T0 + timedelta(seconds=k), "", "", "") for k in range(120)], [(200 + k, f"I-{k % 50}", T0 + timedelta(seconds=k), "", "", "") for k in range(60)]])
    got = run(spark, path, folder=folder)
    log = spark.read.parquet(f"{folder}/log")
    assert got == ids(log.where("verdict = 'dropped'")) and len(got) == 130
    for k in (0, 1, 2):  # Spark lets the watermark for late rows follow an epoch behind
        write(spark, path, [[(900 + k * 10, f"z{k}", T0 + timedelta(days=200 + k), "", "", "")]])
        run(spark, path, folder=folder)
    write(spark, path, [[(901, "i-1", T0, "", "", ""), (902, "new", T0, "", "", ""), (903, "i7", None, "", "", "")]])
    got = run(spark, path, folder=folder)
    assert {901, 903} & got and 902 not in got and not {902, 903} & {r.delivery_id for r in spark.read.parquet(f"{folder}/log").collect()}


def test_concurrent_streams(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    paths = [write(spark, str(tmp_path / f"t{n}"), [[(k, f"i{k % (5 + n)}", T0, "", "", "") for k in range(40)]]) for n in range(3)]
    with ThreadPoolExecutor(3) as pool:
        assert [len(x) for x in pool.map(lambda p: run(spark, p), paths)] == [35, 34, 33]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
