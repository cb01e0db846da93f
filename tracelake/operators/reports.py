"""Reporting over judge results: grouped rates, rank buckets, recall windows, diagnostics, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import non_blank
from .judge import match_form

UNKNOWN = "(unknown)"


def rank_bucket(position: Column, top1: Column, top10: Column) -> Column:
    """Mutually exclusive buckets of the hit's rank."""
    return F.when(top1 == 1, "top1").when(position.between(2, 3), "top2_3").when(position.between(4, 5), "top4_5").when(position.between(6, 10) | (top10 == 1), "top6_10").otherwise("top10_miss")


def return_bucket(n: Column, k: int) -> Column:
    return F.when(n <= 3, "1-3").when(n <= 5, "4-5").when(n < k, f"6-{k - 1}").otherwise(f"{k}+")


def grouped_rates(results: DataFrame, dims: list[str]) -> DataFrame:
    """Retrieval and answer rates per value of each dimension, all dimensions in one pass (grouping sets)."""
    r = results.where("error is null").withColumns({d: F.coalesce(F.nullif(d, F.lit("")), F.lit(UNKNOWN)) for d in dims})
    hit = lambda k: F.avg(F.when((F.col("track") == "retrieval") & F.col("retrieval_evaluable"), F.coalesce(f"top{k}_hit", F.lit(0))))
    answer = lambda t: F.avg(F.when(F.col("track") == t, F.coalesce("answer_correct", F.lit(0))))
    sets = [[F.col(d)] for d in dims]
    out = r.where(F.col("track").isin("retrieval", "strict_qa", "grounded_qa")).groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.count_if((F.col("track") == "retrieval") & F.col("retrieval_evaluable")).alias("n"), *[hit(k).alias(f"top{k}_rate") for k in (1, 3, 5)], answer("strict_qa").alias("strict_rate"), answer("grounded_qa").alias("grounded_rate"), F.grouping_id().alias("gid")
    )
    which = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims])
    return out.select(which.alias("dimension"), F.coalesce(*dims).alias("value"), "n", "top1_rate", "top3_rate", "top5_rate", "strict_rate", "grounded_rate")


def aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two runs with known ranks side by side on question_id, one row per question of either run, the last sample of a question winning."""

    def last(df: DataFrame, tag: str) -> DataFrame:
        return df.where("question_id is not null and question_id != ''").groupBy("question_id").agg(F.max_by(F.struct("rank", "top5_hit"), F.col("sample_id")).alias(tag))

    return last(old, "old").join(last(new, "new"), "question_id", "full")


def evidence_aligned(old: DataFrame, new: DataFrame, hits: DataFrame, max_rank: int = 10) -> DataFrame:
    """Two runs side by side on question_id, one row per question of either run, the last sample of a question winning.

    Both sides have the columns question_id, sample_id, trace_id, gold and top5_hit. ``rank`` is where the gold evidence (the old
    run's, else the new one's) first stands in each run's own results, so a verdict of a model isn't needed.
    """

    def last(df: DataFrame, tag: str) -> DataFrame:
        return df.where("question_id is not null and question_id != ''").groupBy("question_id").agg(F.max_by(F.struct("trace_id", "gold", "top5_hit"), F.col("sample_id")).alias(tag))

    pairs = last(old, "o").join(last(new, "n"), "question_id", "full").withColumn("gold", F.coalesce(F.nullif("o.gold", F.lit("")), F.nullif("n.gold", F.lit(""))))
    sides = F.array(*[F.struct(F.lit(t).alias("side"), F.col(f"{t}.trace_id").alias("trace_id")) for t in ("o", "n")])
    asked = pairs.where("gold is not null").select("question_id", "gold", F.explode(sides).alias("s")).select("question_id", "gold", "s.*").where("trace_id is not null")
    shown = hits.where((F.col("call_order") == 1) & (F.col("rank_position") <= max_rank)).select("trace_id", "rank_position", match_form(non_blank("content")).alias("form")).where("form != ''")
    found = asked.join(shown, "trace_id").where(F.contains("form", "gold")).groupBy("question_id").agg(*[F.min(F.when(F.col("side") == t, F.col("rank_position"))).alias(f"{t}_rank") for t in ("o", "n")])
    side = lambda t: F.when(F.col(t).isNotNull(), F.struct(F.col(f"{t}_rank").alias("rank"), F.col(f"{t}.top5_hit").alias("top5_hit")))
    return pairs.join(found, "question_id", "left").select("question_id", side("o").alias("old"), side("n").alias("new"))


def diff_class() -> Column:
    old, new = F.col("old.rank"), F.col("new.rank")
    judged = F.col("old.top5_hit").isNotNull() & F.col("new.top5_hit").isNotNull() & (F.col("old.top5_hit") != F.col("new.top5_hit"))
    return (
        F.when(F.col("old").isNull() | F.col("new").isNull(), "unpaired")
        .when(old.isNotNull() & new.isNull(), "evidence_lost")
        .when(old.isNotNull() & (new > old), "ranking_regression")
        .when(judged, "judge_disagreement")
        .otherwise("unchanged")
    )


def cutoff_stats(pairs: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per cutoff: hits before and after, gains, losses by kind. Each pair is exploded over the few cutoffs."""
    old, new = F.col("old.rank"), F.col("new.rank")
    k = F.col("k")
    p = pairs.where("old is not null and new is not null").withColumn("k", F.explode(F.array(*[F.lit(x) for x in ks])))
    was, now = F.coalesce(old <= k, F.lit(False)), F.coalesce(new <= k, F.lit(False))
    kind = F.when(was & ~now & new.isNull(), "evidence_lost").when(was & ~now, "ranking_drop").when(~was & now, "gain").otherwise("neutral")
    counts = [F.count_if(kind == x).alias(x) for x in ("evidence_lost", "ranking_drop", "gain", "neutral")]
    out = p.groupBy("k").agg(F.count_if(was).alias("old_hits"), F.count_if(now).alias("new_hits"), *counts)
    return out.withColumns({"loss": F.col("evidence_lost") + F.col("ranking_drop"), "delta": F.col("new_hits") - F.col("old_hits")})


def capped(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows per group: a report's feature. Groups are thinned per salt first, so none is sorted in one task."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(32))
    thin = df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).where(F.col("_rn") <= n)
    return thin.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).withColumnRenamed("_rn", "place").drop("_salt")
