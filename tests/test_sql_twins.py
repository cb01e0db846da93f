"""Every core query with an SQL twin gives its rows, over the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

from tests.twins import connect, differs
from tracelake.plans import registry
from tracelake.runtime import ship

ALONE = ("p5", "STR-01", "events_")  # streams set session options while they start


def test_twins(spark, sf):
    ship(spark)
    queries, sql = registry.queries(), registry.oracle_sql()

    def one(name: str) -> str | None:
        found = differs(spark, connect(sf), queries[name], sql[name], sf)
        return found and f"{name}: {found}"

    names = [n for n in sql if not n.startswith(ALONE)]
    with ThreadPoolExecutor(4) as pool:
        wrong = [w for w in pool.map(one, names) if w]
    wrong += [w for w in map(one, [n for n in sql if n.startswith(ALONE)]) if w]
    assert not wrong, "\n".join(wrong)
