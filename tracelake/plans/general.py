"""Queries of the general data-quality problems (references, instants, repeated deliveries) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.instants import normalise
from ..operators.references import Entity, ForeignKey, orphan_cascade, orphan_report
from ..runtime import table
from ..streaming.dedup import duplicate_deliveries, read_stream

ENTITIES = [
    Entity("questions", "question_row"),
    Entity("samples", "sample_id"),
    Entity("chunk_catalog", "chunk_row", "segment_id", deleted="deleted_at"),
    Entity("create_document", "document_id", "document_id", deleted="deleted_at"),
    Entity("snapshots", "snapshot_id", "snapshot_id", deleted="deleted_at"),
]
KEYS = [ForeignKey(t, f, target) for t in ("questions", "samples") for f, target in (("expected_segment_id", "chunk_catalog"), ("document_id", "create_document"), ("snapshot_id", "snapshots"))]
KEYS.append(ForeignKey("chunk_catalog", "document_id", "create_document"))
ORDER_KEYS = 1_000_000_000_000
TIME_FIELDS = ["trace_timestamp", "start_time", "created_at"]


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_cascade({e.name: table(spark, sf_dir, e.name) for e in ENTITIES}, ENTITIES, KEYS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).where("depth = 0").select("table_name", "row_key", "field_name", "reason", "period")


def p3_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).where("depth > 0").select("table_name", "row_key", "field_name", "period", "depth")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_cascade(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalise(table(spark, sf_dir, "observations"), TIME_FIELDS, "obs_key", "collector_id", table(spark, sf_dir, "collectors"), "zone_name")
    return found.where("not canonical").select(F.col("record_key").alias("obs_key"), "field_name", "epoch_us")


def p4_regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of all orders, written day-first or month-first as each priority's office does, read back by the search.

    Two of five dates can be read both ways; the records of an office come in the order of time.
    """
    priority, day = F.col("o_orderpriority"), F.col("o_orderdate").cast("date")
    text = F.when(F.substring(priority, 1, 1).isin("1", "3", "5"), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    rows = table(spark, sf_dir, "orders").select(priority.alias("office"), (F.unix_date(day).cast("bigint") * ORDER_KEYS + F.col("o_orderkey")).alias("seq"), F.concat(text, F.lit(" 00:00:00")).alias("o_orderdate"))
    offices = rows.select("office", F.lit("UTC").alias("zone")).distinct()
    found = normalise(rows, ["o_orderdate"], "seq", "office", offices, "zone")
    return found.select(F.pmod("record_key", F.lit(ORDER_KEYS)).alias("o_orderkey"), "epoch_us")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_deliveries(read_stream(spark, f"{sf_dir}/traces.parquet"), table(spark, sf_dir, "traces"), "trace_id", "received_at", "delivery_id")


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace store with exactly one delivery of each trace; rows without an id stay as they are."""
    traces = table(spark, sf_dir, "traces")
    return traces.join(p5_found(spark, sf_dir), "delivery_id", "left_anti").select("delivery_id", "trace_id", "batch_id", "received_at")


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_inherited, p3_report, p4_found, p4_regional, p5_found, p5_kept)}


_REFS = """refs as (
  select 'questions' as table_name, question_row as row_key, 'expected_segment_id' as field_name, 'chunk_catalog' as target, expected_segment_id as ref, created_at as at from questions
  union all select 'questions', question_row, 'document_id', 'create_document', document_id, created_at from questions
  union all select 'questions', question_row, 'snapshot_id', 'snapshots', snapshot_id, created_at from questions
  union all select 'samples', sample_id, 'expected_segment_id', 'chunk_catalog', expected_segment_id, created_at from samples
  union all select 'samples', sample_id, 'document_id', 'create_document', document_id, created_at from samples
  union all select 'samples', sample_id, 'snapshot_id', 'snapshots', snapshot_id, created_at from samples
  union all select 'chunk_catalog', chunk_row, 'document_id', 'create_document', document_id, created_at from chunk_catalog),
targets as (
  select 'chunk_catalog' as target, lower(trim(segment_id)) as k, created_at as c, deleted_at as d from chunk_catalog
  union all select 'create_document', lower(trim(document_id)), created_at, deleted_at from create_document
  union all select 'snapshots', lower(trim(snapshot_id)), created_at, deleted_at from snapshots),
direct as (
  select r.table_name, r.row_key, r.field_name, strftime(r.at, '%Y-%m') as period,
    case when count(t.k) = 0 then 'missing' when bool_or(t.c <= r.at and (t.d is null or t.d > r.at)) then null when min(t.c) > r.at then 'late' else 'deleted' end as reason
  from refs r left join targets t on t.target = r.target and t.k = lower(trim(r.ref)) where trim(r.ref) <> ''
  group by r.table_name, r.row_key, r.field_name, r.at),
found as (select table_name, row_key, field_name, reason, period from direct where reason is not null)"""
_INHERITED = """gone as (
  select lower(trim(c.segment_id)) as k from chunk_catalog c left join found f on f.table_name = 'chunk_catalog' and f.row_key = c.chunk_row
  group by 1 having count(*) = count(f.row_key)),
inherited as (
  select r.table_name, r.row_key, r.field_name, strftime(r.at, '%Y-%m') as period, 1 as depth from refs r join gone g on g.k = lower(trim(r.ref))
  where r.target = 'chunk_catalog' and not exists (select 1 from found f where f.table_name = r.table_name and f.row_key = r.row_key and f.field_name = r.field_name))"""
_KEY = r"nullif(regexp_replace(lower(trace_id), '[\s\-]+', '', 'g'), '')"
_DROPPED = f"select delivery_id from (select delivery_id, row_number() over (partition by {_KEY} order by received_at, delivery_id) as rn from traces where {_KEY} is not null) where rn > 1"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"with {_REFS} select * from found",
        "p3_inherited": f"with {_REFS}, {_INHERITED} select * from inherited",
        "p3_report": f"with {_REFS}, {_INHERITED}, every as (select table_name, field_name, period, reason from found union all select table_name, field_name, period, 'inherited' from inherited) select table_name, field_name, period, reason, count(*) as n_orphans from every group by all",
        "p4_regional": "select o_orderkey, epoch_us(cast(cast(o_orderdate as date) as timestamp)) as epoch_us from orders",
        "p5_found": _DROPPED,
        "p5_kept": f"select delivery_id, trace_id, batch_id, received_at from traces where delivery_id not in ({_DROPPED})",
    }
