"""Queries of the training-data problems over the test tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, table
from . import conversations, lookalikes, mixing, near_duplicates, packing, pairs, splitting, tokens


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "samples").select(F.lit("samples.question").alias("field_name"), F.col("sample_id").alias("key"), F.col("question").alias("text"))
    two = table(spark, sf_dir, "retrieval_results").select(F.lit("retrieval_results.content").alias("field_name"), F.col("hit_id").alias("key"), F.col("content").alias("text"))
    return one.unionByName(two)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_pairs(_texts(spark, sf_dir), 0.7)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_groups(_texts(spark, sf_dir), 0.7)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "samples"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("field_name", "defect_type").agg(F.count("*").alias("n_answers"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.broken_conversations(table(spark, sf_dir, "observations"))


def p6_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuilt_conversations(table(spark, sf_dir, "observations"), table(spark, sf_dir, "collectors"))


def _limits(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int]]:
    """The settings table has one row per limit."""
    return {r.limit_name: (r.max_size, r.overlap) for r in table(spark, sf_dir, "size_limits").collect()}


def _items(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, DataFrame]]:
    docs = table(spark, sf_dir, "create_document").select(F.col("document_id").alias("item_key"), "text")
    hits = table(spark, sf_dir, "retrieval_results").where("content is not null").select(F.col("hit_id").cast("string").alias("item_key"), F.col("content").alias("text"))
    return [("create_document.text", "split_document", docs), ("retrieval_results.content", "split_hit", hits)]


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = _limits(spark, sf_dir)
    parts = [splitting.pieces(items, *limits[name]).select(F.lit(field).alias("field_name"), "*") for field, name, items in _items(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pieces(spark, sf_dir).where("piece_no = 1").select("field_name", "item_key")


def p7_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items in pieces within their limit, uncut ones included; sizes and cuts without the texts."""
    limits = _limits(spark, sf_dir)
    parts = [splitting.split_all(items, *limits[name]).select(F.lit(field).alias("field_name"), "item_key", "piece_no", "n_pieces", "start", "size", "cut") for field, name, items in _items(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    capacity = _limits(spark, sf_dir)["pack_documents"][0]
    sizes = materialise(tokens.sized(table(spark, sf_dir, "documents")).select("key", "n_tokens"), "sizes")
    return packing.pack(sizes, capacity), capacity


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, _ = _packed(spark, sf_dir)
    return packed.select(F.col("key").alias("doc_id"), "part", "n_tokens", "token_start", "shard", "container", "n_in")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(*_packed(spark, sf_dir))


def _mix_input(spark: SparkSession, sf_dir: str):
    """(targets, texts, tokens per source); the targets are a settings table."""
    targets = [(r.source, r.target_share, r.max_repeats) for r in table(spark, sf_dir, "mix_targets").collect()]
    texts = materialise(mixing.distinct_texts(tokens.sized(table(spark, sf_dir, "documents"), source="source")), "texts")
    return targets, texts, mixing.source_tokens(texts, targets)


def _mix(spark: SparkSession, sf_dir: str, budget_share: float | None = None):
    targets, texts, held = _mix_input(spark, sf_dir)
    budget = None if budget_share is None else budget_share * sum(held.values())
    total, exponent, plan = mixing.plan_mix(targets, held, budget)
    return mixing.realise(texts, plan), plan, total, exponent


def _natural(spark: SparkSession, sf_dir: str):
    targets, texts, held = _mix_input(spark, sf_dir)
    total, exponent, weights, plan = mixing.plan_natural(targets, held)
    return mixing.realise(texts, plan), plan, total, exponent, weights


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in which every source has its target share."""
    return _mix(spark, sf_dir)[0].withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, plan, total, _ = _mix(spark, sf_dir)
    return mixing.shares_report(mixed, plan, total)


def p9_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix by one exponent over the natural shares, at the entropy of the targets."""
    return _natural(spark, sf_dir)[0].withColumnRenamed("key", "doc_id")


def p9_natural_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, plan, total, exponent, weights = _natural(spark, sf_dir)
    return mixing.shares_report(mixed, plan, total).withColumn("exponent", F.lit(exponent)).withColumn("entropy", F.lit(mixing.entropy(weights)))


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of as many tokens as the documents have: the exponent is bisected until all caps of repeats hold."""
    mixed, plan, total, exponent = _mix(spark, sf_dir, 1.0)
    return mixing.shares_report(mixed, plan, total).withColumn("exponent", F.lit(exponent))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.lookalike_pairs(table(spark, sf_dir, "documents"))


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.visual_forms(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_report, p6_found, p6_conversations, p7_found, p7_pieces, p7_all, p8_containers, p8_report, p9_mix, p9_shares, p9_natural, p9_natural_shares, p9_tempered, p10_found, p10_forms)}


_OBJ = "case when ltrim({c}) like '{{%' and json_valid({c}) then {c} end"
_P6 = f"""
with o as (select *, {_OBJ.format(c='input')} as i, {_OBJ.format(c='output')} as u, {_OBJ.format(c='metadata')} as m from observations where trim(traceid) <> ''),
e as (select traceid, id, obs_key, type,
    coalesce(nullif(sessionid, ''), nullif(m->>'$.conversation_id', ''), nullif(m->>'$.session_id', ''), nullif(m->>'$.sessionId', '')) as s,
    coalesce(nullif(userid, ''), nullif(m->>'$.user_id', ''), nullif(m->>'$.userId', ''), nullif(case when type in ('TRACE', 'GENERATION') then i->>'$."sys.user_id"' end, '')) as w,
    case when type = 'TRACE' then case when i is null then input else coalesce(i->>'$."sys.query"', i->>'$.query') end end as q,
    case when type = 'GENERATION' then case when u is null then output else coalesce(u->>'$.text', u->>'$.answer') end end as a,
    row_number() over (partition by traceid, coalesce(id, 'row-' || obs_key) order by obs_key desc) as rn,
    coalesce(lower(m->>'$.status') = 'deleted', false) as gone from o),
t as (select traceid, arg_min(s, obs_key) filter (s is not null) as s, arg_min(w, obs_key) filter (w is not null) as w,
    coalesce(bool_or(regexp_matches(q, '[^\\s\\x{{3000}}\\x{{a0}}]')), false) as has_q, coalesce(bool_or(regexp_matches(a, '[^\\s\\x{{3000}}\\x{{a0}}]')), false) as has_a
    from e where rn = 1 and not gone group by traceid)
select s as sessionid, w as userid from t where s is not null and w is not null group by s, w having not bool_and(has_q and has_a)"""


def oracle_sql() -> dict[str, str]:
    over = "select 'create_document.text' as field_name, document_id as item_key from create_document where length(text) > (select max_size from size_limits where limit_name = 'split_document') union all select 'retrieval_results.content', cast(hit_id as varchar) from retrieval_results where length(content) > (select max_size from size_limits where limit_name = 'split_hit')"
    return {"p6_found": _P6, "p7_found": over}
