"""Deterministic judging: tracks, rule and exact-match judges, and their metrics.

Gold evidence is compared in a normal form. Hits come as rows (trace, call, rank), so ranks are minima over an
equi-join on the trace; nothing is collected into arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compatible, content_hash, non_blank

KS = (1, 3, 5, 10)
MIN_GOLD = 8

# Inline markup whose text stays (code, emphasis, underline, links), and tags.
INLINE_MARKUP = (r"`([^`]*)`", r"\*{1,2}([^*]*)\*{1,2}", r"__([^_]*)__", r"\[([^\]]*)\]\([^)]*\)")
TAGS = r"<[^>]+>"
# Punctuation of full width and its ASCII form, position by position.
WIDE_PUNCTUATION, ASCII_PUNCTUATION = "，。！？；：（）【】「」、", ",.!?;:()[][],"


def track() -> Column:
    """Which of the five evaluation tracks a sample belongs to."""
    mode = F.coalesce(non_blank("question_mode"), F.lit(""))
    excerpt, reference = non_blank("source_excerpt").isNotNull(), non_blank("reference_answer").isNotNull()
    return (
        F.when(mode == "chunk_exact", "chunk_exact")
        .when((mode == "retrieval") & (excerpt | reference), "retrieval")
        .when(mode == "retrieval", "not_evaluable")
        .when(reference, "strict_qa")
        .otherwise("grounded_qa")
    )


def gold_evidence() -> Column:
    return F.coalesce(non_blank("source_excerpt"), non_blank("reference_answer"), F.lit(""))


def match_form(c: Column | str) -> Column:
    """The text in its compatible form, without inline markup, white space folded, for containment tests."""
    t = compatible(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    for pattern in INLINE_MARKUP:
        t = F.regexp_replace(t, pattern, "$1")
    t = F.regexp_replace(t, TAGS, "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), "^ | $", "")
    return F.translate(t, WIDE_PUNCTUATION, ASCII_PUNCTUATION)


def clean_content(c: Column | str) -> Column:
    """Content without metadata blocks and piles of blank lines."""
    from ..functions.text import strip

    t = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"<metadata>\s*\{[\s\S]*?\}\s*</metadata>\s*", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def exact_ranks(samples: DataFrame, hits: DataFrame, max_rank: int = 10) -> DataFrame:
    """Per sample and call: the first rank whose segment or content is the expected one, and the number of results.

    The disjunction of the two equalities is evaluated after the equi-join on the trace.
    """
    want = samples.select("sample_id", "trace_id", non_blank("expected_segment_id").alias("expected_id"), non_blank("expected_content_hash").alias("expected_hash"))
    got = hits.select("trace_id", "call_order", F.col("rank_position").alias("rank"), non_blank("segment_id").alias("segment_id"), F.nullif(content_hash("content"), F.lit("")).alias("hash"))
    hit = ((F.col("expected_id") == F.col("segment_id")) | (F.col("expected_hash") == F.col("hash"))) & (F.col("rank") <= max_rank)
    return want.join(got, "trace_id").groupBy("sample_id", "call_order").agg(F.min(F.when(hit, F.col("rank"))).alias("hit_position"), F.count("*").cast("int").alias("result_count"))


def exact_judged(samples: DataFrame, hits: DataFrame) -> DataFrame:
    """Exact-match verdicts; what can't be judged has a status and no hits, it is never a miss."""
    calls = exact_ranks(samples, hits).groupBy("sample_id").agg(F.min("hit_position").alias("hit_evidence_position"), F.count("*").cast("int").alias("call_count"), F.count("hit_position").cast("int").alias("subquery_hit_count"))
    base = samples.where(track() == "chunk_exact").join(calls, "sample_id", "left")
    unbound = non_blank("expected_segment_id").isNull() & non_blank("expected_content_hash").isNull()
    untraced = non_blank("trace_id").isNull() | F.col("trace_id").startswith("batch_qa_")
    status = F.when(unbound, "missing_binding").when(untraced, "no_trace").when(F.col("call_count").isNull(), "no_retrieval").otherwise("")
    judged = base.withColumn("chunk_exact_status", status)
    ok = F.col("chunk_exact_status") == ""
    tops = [F.when(ok, F.coalesce((F.col("hit_evidence_position") <= k).cast("int"), F.lit(0))).alias(f"retrieval_top{k}_hit") for k in KS]
    return judged.select("sample_id", "trace_id", "run_id", *tops, F.when(ok, F.col("hit_evidence_position")).alias("hit_evidence_position"), "chunk_exact_status", ok.alias("retrieval_evaluable"), F.when(ok, F.col("call_count")).alias("retrieval_call_count"), F.when(ok, F.col("subquery_hit_count")).alias("subquery_hit_count"))


def evidence_ranks(samples: DataFrame, hits: DataFrame, max_rank: int = 10) -> DataFrame:
    """Per sample: results, results with content among the first five, the first rank that contains the gold evidence, and the first that contains the answer.

    The containment test runs on pairs of an equi-join (trace), never on all pairs.
    """
    want = samples.select("sample_id", "trace_id", match_form(gold_evidence()).alias("gold"), match_form("final_answer").alias("said"))
    got = hits.where(F.col("call_order") == 1).select("trace_id", F.col("rank_position").alias("rank"), non_blank("content").isNotNull().alias("filled"), match_form(non_blank("content")).alias("form"))
    inside = F.when(F.col("filled") & (F.col("rank") <= max_rank) & (F.length("gold") >= MIN_GOLD) & F.contains("form", "gold"), F.col("rank"))
    quoted = F.when(F.col("filled") & (F.col("said") != "") & F.contains("form", "said"), F.col("rank"))
    return want.join(got, "trace_id").groupBy("sample_id").agg(F.count("*").cast("int").alias("n_results"), F.count_if(F.col("filled") & (F.col("rank") <= 5)).cast("int").alias("n_content"), F.min(inside).alias("gold_rank"), F.min(quoted).alias("answer_rank"))


def prescreened(samples: DataFrame, hits: DataFrame) -> DataFrame:
    """The deterministic verdict of every sample; ``needs_model`` where only a model can tell."""
    s = samples.withColumn("track", track()).join(evidence_ranks(samples, hits), "sample_id", "left")
    exact = exact_judged(samples, hits).select("sample_id", F.col("hit_evidence_position").alias("exact_position"), "chunk_exact_status")
    s = s.join(exact, "sample_id", "left")
    none = F.coalesce("n_results", F.lit(0)) == 0
    no_question, no_answer = non_blank("question").isNull(), non_blank("final_answer").isNull()
    rule = (
        F.when(F.col("track") == "not_evaluable", "not_evaluable")
        .when(F.col("track") == "chunk_exact", "chunk_exact")
        .when(no_question, "no_question")
        .when((F.col("track") == "retrieval") & none, "empty_results")
        .when((F.col("track") == "retrieval") & (F.col("n_content") == 0), "no_content")
        .when((F.col("track") == "retrieval") & (F.col("gold_rank") == 1), "exact_contains_top1")
        .when(F.col("track") == "retrieval", "needs_model")
        .when(none & no_answer, "no_retrieval_no_answer")
        .when(none, "needs_model")
        .when(no_answer, "no_answer")
        .otherwise("needs_model")
    )
    s = s.withColumn("rule", rule)
    position = F.when(F.col("rule") == "exact_contains_top1", 1).when(F.col("rule") == "chunk_exact", F.col("exact_position"))
    pending = (F.col("rule") == "needs_model") | ((F.col("rule") == "chunk_exact") & (F.coalesce("chunk_exact_status", F.lit("")) != ""))
    tops = [F.when(pending, None).otherwise(F.coalesce((F.col("position") <= k).cast("int"), F.lit(0))).alias(f"top{k}_hit") for k in KS]
    hint = F.when((F.col("rule") == "needs_model") & (F.col("track") == "retrieval") & F.col("gold_rank").between(2, 5), F.col("gold_rank"))
    return s.withColumn("position", position).select("sample_id", "trace_id", "run_id", "track", "rule", *tops, F.col("position").alias("hit_evidence_position"), "chunk_exact_status", hint.alias("rule_hint"), "answer_rank")


# How a result is shown, as (icon, title, status, description).
TITLES = {
    "strict_qa": (("✅", "回答正确", "correct", "与参考答案一致"), ("❌", "回答错误", "incorrect", "与参考答案不一致或遗漏关键点")),
    "grounded_qa": (("✅", "回答有据", "grounded", "回答被检索内容支持"), ("⚠️", "回答缺乏依据", "not_grounded", "回答未被检索内容充分支持")),
}
PENDING = {
    "missing_binding": ("缺少绑定", "chunk_exact 题缺少 expected_segment_id / expected_content_hash"),
    "no_trace": ("未关联 trace", "chunk_exact 题未关联真实 Langfuse trace"),
    "no_retrieval": ("无检索结果", "trace 已关联但无检索结果，无法判定"),
}
HIT, MISS, BAR = "命中", "未命中", "｜"
NOT_EVALUABLE = ("⚠️", "缺少金标准证据", "not_evaluable", "无法可靠计算检索命中率")
UNKNOWN_TRACK = ("❓", "未知评测类型", "unknown", "")


def status_label() -> Column:
    """struct<icon, title, status, description> of a result."""
    label = lambda icon, title, status, text: F.struct(F.lit(icon).alias("icon"), (F.lit(title) if isinstance(title, str) else title).alias("title"), F.lit(status).alias("status"), F.lit(text).alias("description"))
    tops = F.array_compact(F.array(*[F.when(F.col(f"top{k}_hit").isNotNull(), F.concat(F.lit(f"Top{k} "), F.when(F.col(f"top{k}_hit") == 1, HIT).otherwise(MISS))) for k in (1, 3, 5)]))
    hits = lambda nothing: F.when(F.size(tops) > 0, F.array_join(tops, BAR)).otherwise(nothing)
    out = F.when(F.col("track") == "retrieval", label("🔍", hits("无检索结果"), "retrieval", "检索命中评测"))
    for track_, (good, bad) in TITLES.items():
        out = out.when((F.col("track") == track_) & (F.coalesce("answer_correct", F.lit(0)) == 1), label(*good)).when(F.col("track") == track_, label(*bad))
    out = out.when(F.col("track") == "not_evaluable", label(*NOT_EVALUABLE))
    for status, (title, text) in PENDING.items():
        out = out.when((F.col("track") == "chunk_exact") & (F.col("chunk_exact_status") == status), label("⚠️", title, "chunk_exact_pending", text))
    return out.when(F.col("track") == "chunk_exact", label("🎯", hits("待判定"), "chunk_exact", "精确匹配评测（segment_id / content_hash）")).otherwise(label(*UNKNOWN_TRACK))


def metrics(results: DataFrame, by: list[str]) -> DataFrame:
    """Counts and hit rates per track, each over its own non-NULL denominator; NULL where that is empty."""
    ok = F.col("error").isNull()
    on = lambda t: ok & (F.col("track") == t)
    usable = F.coalesce("retrieval_evaluable", F.lit(True))
    rate = lambda cond, v: F.avg(F.when(cond, v))
    cols = [F.count("*").alias("total"), F.count_if(ok).alias("evaluated"), F.count_if(~ok).alias("errors")]
    cols += [F.count_if(on("retrieval") & usable).alias("retrieval_track_count")]
    cols += [F.count_if(on(t)).alias(f"{t}_track_count") for t in ("strict_qa", "grounded_qa", "chunk_exact")]
    cols += [rate(on("retrieval") & usable, F.coalesce(f"top{k}_hit", F.lit(0))).alias(f"retrieval_top{k}_hit_rate") for k in (1, 3, 5)]
    cols += [rate(on(f"{t}_qa"), F.coalesce("answer_correct", F.lit(0))).alias(f"{t}_qa_answer_rate") for t in ("strict", "grounded")]
    cols += [F.count_if(on("chunk_exact") & usable & F.col("top1_hit").isNotNull()).alias("chunk_exact_evaluable_count")]
    cols += [rate(on("chunk_exact") & usable, F.col(f"top{k}_hit")).alias(f"chunk_exact_top{k}_hit_rate") for k in KS]
    cols += [rate(ok, F.col(f"top{k}_hit")).alias(f"top{k}_hit_rate") for k in (1, 3, 5)]
    return (results.groupBy(*by) if by else results).agg(*cols)
