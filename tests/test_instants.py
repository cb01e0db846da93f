import itertools
import random
from datetime import datetime, timezone

from tracelake.operators import instants as I

US = 1_000_000


def at(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * US


def run(spark, rows, zones=(("a", "Europe/Berlin"), ("n", None), ("bad", "No/Where"), ("a", "Europe/Berlin")), block=I.BLOCK):
    df = spark.createDataFrame(rows, "k long, src string, t string, value string, cands string, source string")
    src = spark.createDataFrame(list(zones), "src string, zn string")
    return {r.record_key: r.epoch_us for r in I.normalise(df, ["t"], "k", "src", src, "zn", block).collect()}


def row(k, t, src="a"):
    return (k, src, t, "", "", "")


SINGLE = [
    ("2025-10-26 02:30:00", "a", at(2025, 10, 26, 0, 30)),  # twice: the first
    ("2025-03-30T02:30:00", "a", at(2025, 3, 30, 1, 30)),  # skipped: the offset before
    ("2025-03-30T02:30:00", "n", at(2025, 3, 30, 2, 30)),
    ("2025-03-30T02:30:00", "bad", at(2025, 3, 30, 2, 30)),
    ("2025-03-30T02:30:00", None, at(2025, 3, 30, 2, 30)),
    ("2025-09-02T11:46:42.218013997Z", "a", at(2025, 9, 2, 11, 46, 42) + 218013),
    ("2025年09月11日 下午12:20:49", "n", at(2025, 9, 11, 12, 20, 49)),
    ("2025年09月11日 上午12:20:49", "n", at(2025, 9, 11, 0, 20, 49)),
    ("Feb 11, 2026 11:09:57 PM", "n", at(2026, 2, 11, 23, 9, 57)),
    ("Sat, 01 Nov 2025 18:23:21 -0330", "a", at(2025, 11, 1, 21, 53, 21)),
    ("20250831T133217Z", "a", at(2025, 8, 31, 13, 32, 17)),
    ("2025-09-21 10:03:46 America/New_York", "a", at(2025, 9, 21, 14, 3, 46)),
    ("2025-09-21 10:03:46 EDT", "a", at(2025, 9, 21, 14, 3, 46)),
    ("1757033833.885", "a", 1757033833885000),
    ("1756341308148474999", "a", 1756341308148474),
    ("2025-02-29 10:00:00", "a", None),
    ("0000-00-00 00:00:00", "a", None),
    ("2025-01-01 24:00:00", "a", None),
    ("2025-01-01 10:00:00 Foo/Bar", "a", None),
    ("  ", "a", None),
    (None, "a", None),
    ("x" * 100_000, "a", None),
]


def test_single_values(spark):
    got = run(spark, [row(k, text, src) for k, (text, src, _) in enumerate(SINGLE)])
    assert {k: got.get(k) for k in range(len(SINGLE))} == {k: want for k, (_, _, want) in enumerate(SINGLE)}


def test_order_of_records_settles_day_and_month(spark):
    days = [f"{d:02d}/05/2025 08:00:00" for d in (1, 2, 3, 13, 14)] + ["06/05/2025 08:00:00"]
    got = run(spark, [row(k, t, "n") for k, t in enumerate(days)])
    assert [got[k] for k in range(5)] == [at(2025, 5, d, 8) for d in (1, 2, 3, 13, 14)]


def test_blocks_give_the_result_of_one_search(spark):
    rng = random.Random(3)
    rows = [row(k, f"{rng.randint(1, 14):02d}/{rng.randint(1, 12):02d}/2025 {rng.randint(0, 23):02d}:00:00", rng.choice(["a", "n"])) for k in range(120)]
    cost = {}
    for block in (1 << 20, 1, 7):
        got = run(spark, rows, block=block)
        cost[block] = len(got), got
    assert cost[1][0] == cost[7][0] == cost[1 << 20][0] > 100
    # equal penalties may be reached in several ways, so the blocks are held to the penalty itself
    for block in (1, 7):
        assert penalty(rows, cost[block][1]) == penalty(rows, cost[1 << 20][1])


def test_first_readings_alone_are_wrong(spark):
    """Month-first dates come out right by the search only: the first interpretation of each is day-first."""
    days = [f"{m:02d}/{d:02d}/2025 08:00:00" for m, d in ((4, 30), (5, 1), (5, 2), (5, 7), (5, 12), (5, 13))]
    want = [at(2025, m, d, 8) for m, d in ((4, 30), (5, 1), (5, 2), (5, 7), (5, 12), (5, 13))]
    df = spark.createDataFrame([row(k, t, "n") for k, t in enumerate(days)], "k long, src string, t string, value string, cands string, source string")
    found = I.readings(df, ["t"], "k", "src", spark.createDataFrame([("n", None)], "src string, zn string"), "zn")
    first = {r.record_key: r.cands[0].us for r in found.collect()}
    for block in (I.BLOCK, 2):
        got = {r.record_key: r.epoch_us for r in I.choose(found, block).collect()}
        assert [got[k] for k in range(6)] == want != [first[k] for k in range(6)]


def test_null_keys_and_sources_are_cut_too(spark):
    rows = [(None, None if k % 2 else "n", f"2025-01-{k % 28 + 1:02d} 10:00:00", "", "", "") for k in range(300)] + [(None, "n", "03/04/2025 10:00:00", "", "", "")]
    df = spark.createDataFrame(rows, "k long, src string, t string, value string, cands string, source string")
    got = I.normalise(df, ["t"], "k", "src", spark.createDataFrame([], "src string, zn string"), "zn", 20).collect()
    assert len(got) == 301 and sum(r.epoch_us in (at(2025, 4, 3, 10), at(2025, 3, 4, 10)) for r in got) == 1


def penalty(rows, got):
    total = 0.0
    for src in ("a", "n"):
        seq = [got[r[0]] for r in rows if r[1] == src and r[0] in got]
        total += sum(I.BACKWARD for a, b in zip(seq, seq[1:]) if b < a - I.BACKWARD_SLACK_US)
    return total


def test_solve_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        cands = [[{"fmt": f, "us": rng.randrange(10) * 4_000_000_000} for f in range(rng.randint(1, 3))] for _ in range(6)]
        before = (0, 8_000_000_000) if rng.random() < 0.5 else None
        after = (1, 8_000_000_000) if rng.random() < 0.5 else None

        def total(pick):
            seq = ([before] if before else []) + [(c[i]["fmt"], c[i]["us"]) for c, i in zip(cands, pick)] + ([after] if after else [])
            return sum(I.SWITCH * (a[0] != b[0]) + I.BACKWARD * (b[1] < a[1] - I.BACKWARD_SLACK_US) for a, b in zip(seq, seq[1:]))

        best = min(total(p) for p in itertools.product(*[range(len(c)) for c in cands]))
        assert total(I.solve(cands, before, after)) == best


def test_repeated_and_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [row(1, "1757033833"), row(1, "1757033833")]) == {1: 1757033833 * US}
