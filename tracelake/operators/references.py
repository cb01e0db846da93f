"""References to records that do not exist: direct orphans, and a fixpoint cascade down the foreign-key graph.

Method. Every reference is checked against the *life spans* of its target key (the disjoint intervals in which at
least one row with that key exists). A reference without any target row is ``missing``; one whose target only comes
later is ``late``; one whose target had gone is ``deleted``. Rows whose only targets are themselves orphans are
``inherited`` orphans: round by round, references are semi-joined with the keys orphaned in the round before, until
a round finds none.

Scale. Only keys and timestamps are shuffled. Life spans are built from distinct (key, created, deleted) triples,
first within salted parts of a key and then over the few spans that are left, so a key that holds a third of all
rows does not end in one task. No side is forced to be broadcast; the planner does it where its size allows.

Defined results. NULL or blank ids are no reference. A reference from a row without ``created_at`` can only be
``missing``: where a target row exists it counts as met, and its period is NULL. A target without ``created_at``
exists from the beginning. Repeated rows are reported once each, by their own row key; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import id_key
from ..runtime import materialise

SALTS = 16
BEGINNING, END = "timestamp_ntz'0001-01-01 00:00:00'", "timestamp_ntz'9999-12-31 23:59:59'"

ORPHANS = "table_name string, row_key bigint, row_id string, field_name string, reason string, period string, depth int, own_key string"


@dataclass(frozen=True)
class Entity:
    """A table: its unique row key (of any type; compared as text), the id under which others refer to it, and its life span."""

    name: str
    row_key: str
    id_field: str | None = None
    created: str = "created_at"
    deleted: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    table: str
    field: str
    target: str


def life_spans(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(key, created, deleted) -> (key, spans): the disjoint, ordered intervals in which a row with the key exists.

    Islands are merged twice, within (key, salt) and then within the key, so that no single task sees all rows of a
    hot key.
    """

    def islands(df: DataFrame, by: list[str]) -> DataFrame:
        before = Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
        opened = F.when(F.col("s") <= F.max("e").over(before), 0).otherwise(1)
        return df.withColumn("opened", opened).withColumn("island", F.sum("opened").over(upto)).groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")

    spans = rows.where("key is not null").select("key", F.coalesce("created", F.expr(BEGINNING)).alias("s"), F.coalesce("deleted", F.expr(END)).alias("e")).distinct()
    salted = spans.withColumn("salt", F.pmod(F.xxhash64("s", "e"), F.lit(salts)))
    merged = islands(islands(salted, ["key", "salt"]).drop("salt"), ["key"])
    return merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def _references(frame: DataFrame, entity: Entity, field: str) -> DataFrame:
    own = id_key(entity.id_field) if entity.id_field else F.lit(None).cast("string")
    at = F.col(entity.created).cast("timestamp_ntz")
    return frame.select(F.lit(entity.name).alias("table_name"), F.col(entity.row_key).try_cast("bigint").alias("row_key"), F.col(entity.row_key).cast("string").alias("row_id"), F.lit(field).alias("field_name"), id_key(field).alias("key"), at.alias("at"), own.alias("own_key")).where("key is not null")


def direct_orphans(frames: dict[str, DataFrame], entities: list[Entity], keys: list[ForeignKey]) -> DataFrame:
    """All references that no target row meets at the time of the referring row (columns as in ``ORPHANS``)."""
    by_name = {e.name: e for e in entities}
    found = None
    for target in dict.fromkeys(k.target for k in keys):
        goal = by_name[target]
        deleted = F.col(goal.deleted).cast("timestamp_ntz") if goal.deleted else F.lit(None).cast("timestamp_ntz")
        spans = life_spans(frames[target].select(id_key(goal.id_field).alias("key"), F.col(goal.created).cast("timestamp_ntz").alias("created"), deleted.alias("deleted")))
        refs = None
        for k in keys:
            if k.target == target:
                one = _references(frames[k.table], by_name[k.table], k.field)
                refs = one if refs is None else refs.unionByName(one)
        live = F.exists("spans", lambda x: (x["s"] <= F.col("at")) & (x["e"] > F.col("at")))
        reason = F.when(F.col("spans").isNull(), "missing").when(F.col("at").isNull() | live, F.lit(None)).when(F.col("spans")[0]["s"] > F.col("at"), "late").otherwise("deleted")
        orphans = refs.join(spans, "key", "left").withColumn("reason", reason).where("reason is not null")
        orphans = orphans.select("table_name", "row_key", "row_id", "field_name", "reason", F.date_format("at", "yyyy-MM").alias("period"), F.lit(0).alias("depth"), "own_key")
        found = orphans if found is None else found.unionByName(orphans)
    return found


def orphan_cascade(frames: dict[str, DataFrame], entities: list[Entity], keys: list[ForeignKey], max_rounds: int = 64) -> DataFrame:
    """Direct orphans (depth 0) and inherited ones (depth = round in which the fixpoint reached them).

    A key is orphaned when every row that carries it is an orphan; a reference is inherited when its key is orphaned
    and it is not an orphan already. ``max_rounds`` only guards against a cyclic graph that never settles; the number
    of rounds is otherwise the depth of the graph.
    """
    by_name = {e.name: e for e in entities}
    found = materialise(direct_orphans(frames, entities, keys), "orphans")
    newest = found
    for depth in range(1, max_rounds + 1):
        touched = [r[0] for r in newest.select("table_name").distinct().collect()]  # names of tables: as many as there are entities
        edges = [k for k in keys if k.target in touched]
        if not edges:
            return found
        step = None
        for target in dict.fromkeys(k.target for k in edges):
            goal = by_name[target]
            rows = frames[target].select(id_key(goal.id_field).alias("key"), F.col(goal.row_key).cast("string").alias("row_id")).where("key is not null")
            hit = found.where(F.col("table_name") == target).select("row_id").distinct().withColumn("hit", F.lit(1))
            fresh = newest.where(F.col("table_name") == target).select(F.col("own_key").alias("key")).where("key is not null").distinct()
            states = rows.join(fresh, "key", "left_semi").join(hit, "row_id", "left").groupBy("key").agg(F.count("*").alias("n"), F.count("hit").alias("n_hit"))
            gone = states.where("n = n_hit").select("key")
            for k in edges:
                if k.target == target:
                    one = _references(frames[k.table], by_name[k.table], k.field).join(gone, "key", "left_semi")
                    step = one if step is None else step.unionByName(one)
        step = step.join(found.select("table_name", "row_id", "field_name"), ["table_name", "row_id", "field_name"], "left_anti")
        step = step.select("table_name", "row_key", "row_id", "field_name", F.lit("inherited").alias("reason"), F.date_format("at", "yyyy-MM").alias("period"), F.lit(depth).alias("depth"), "own_key")
        newest = materialise(step, "orphans")
        if newest.isEmpty():
            return found
        found = found.unionByName(newest)
    raise ValueError(f"no fixpoint after {max_rounds} rounds")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, field, month and reason."""
    return orphans.groupBy("table_name", "field_name", "period", "reason").agg(F.count("*").alias("n_orphans"))
