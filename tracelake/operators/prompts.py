"""Prompts of the judge's stage: one template per track, results listed in rank order, contents cleaned and cut to their place's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .judge import clean_content, gold_evidence

# Characters kept of the content at each place (later places as the last), and what stands for nothing.
CONTENT_LIMITS = (2000, 1200, 1200, 1000, 1000)
NOTHING, NO_RESULTS, NO_CONTENT, NO_GOLD, CUT = "(无)", "(无检索结果)", "(无内容)", "(无金标准证据)", "...(截断)"

TEMPLATES = {
    "retrieval": "Judge which retrieved passage is the first to state the evidence.\n\n[Question]\n{question}\n\n[Evidence]\n{gold_evidence}\n\n[Results]\n{retrieval_results}\n\n[Reply]\nA JSON object with retrieval_top1_hit, retrieval_top3_hit, retrieval_top5_hit (0 or 1) and hit_evidence_position (a rank or null).",
    "strict_qa": "Judge whether the answer agrees with the reference.\n\n[Question]\n{question}\n\n[Query]\n{retrieval_query}\n\n[Results]\n{retrieval_results}\n\n[Answer]\n{final_answer}\n\n[Reference]\n{reference_answer}\n\n[Excerpt]\n{source_excerpt}\n\n[Reply]\nA JSON object with answer_correct (0 or 1).",
    "grounded_qa": "Judge whether the results support the answer.\n\n[Question]\n{question}\n\n[Query]\n{retrieval_query}\n\n[Results]\n{retrieval_results}\n\n[Answer]\n{final_answer}\n\n[Reply]\nA JSON object with answer_correct (0 or 1).",
}
HINT = "\n\n[Hint]\nThe evidence stands word for word at rank {rank}; look for a passage of the same meaning before it."


def listed(hits: DataFrame) -> DataFrame:
    """(trace_id, n_results, listing): the results of a trace's first call as they are shown, in rank order."""
    label = F.concat_ws(" ", F.concat(F.lit("["), F.col("rank_position").cast("string"), F.lit("]")), F.nullif("document_name", F.lit("")), F.concat(F.lit("(score: "), F.format_string("%.4f", F.col("score")), F.lit(")")))
    shown = hits.where("call_order = 1").select("trace_id", "rank_position", "hit_id", F.when(F.col("score").isNull(), F.concat_ws(" ", F.concat(F.lit("["), F.col("rank_position").cast("string"), F.lit("]")), F.nullif("document_name", F.lit("")))).otherwise(label).alias("label"), clean_content(F.coalesce(F.nullif("content", F.lit("")), F.lit(NO_CONTENT))).alias("body"))
    limits = F.array(*[F.lit(n) for n in CONTENT_LIMITS])

    def one(x: Column, i: Column) -> Column:
        limit = F.coalesce(F.get(limits, i), F.lit(CONTENT_LIMITS[-1]))
        body = F.when(F.length(x["body"]) > limit, F.concat(F.substring(x["body"], F.lit(1), limit), F.lit(CUT))).otherwise(x["body"])
        return F.concat(F.lit("--- 检索结果 "), (i + 1).cast("string"), F.lit(" ---\n"), F.when(x["label"] != "", F.concat(x["label"], F.lit("\n"))).otherwise(""), body)

    rows = F.array_sort(F.collect_list(F.struct("rank_position", "hit_id", "label", "body")))  # as many as a call returns
    return shown.groupBy("trace_id").agg(F.count("*").cast("int").alias("n_results"), F.array_join(F.transform(rows, one), "\n\n").alias("listing"))


def prompts(samples: DataFrame, hits: DataFrame) -> DataFrame:
    """(sample_id, track, n_results, prompt) for samples with ``track`` and ``rule_hint``; the other tracks have no prompt."""
    or_else = lambda c, nothing: F.coalesce(F.nullif(c, F.lit("")), F.lit(nothing))
    values = {
        "question": or_else(F.col("question"), NOTHING),
        "retrieval_query": or_else(F.col("retrieval_query"), NOTHING),
        "retrieval_results": F.coalesce("listing", F.lit(NO_RESULTS)),
        "final_answer": or_else(F.col("final_answer"), NOTHING),
        "gold_evidence": or_else(gold_evidence(), NO_GOLD),
        "reference_answer": or_else(F.col("reference_answer"), NOTHING),
        "source_excerpt": or_else(F.col("source_excerpt"), NOTHING),
    }
    text = F.lit(None).cast("string")
    for name, template in TEMPLATES.items():
        filled = F.lit(template)
        for place, value in values.items():
            if "{" + place + "}" in template:
                filled = F.replace(filled, F.lit("{" + place + "}"), value)
        text = F.when(F.col("track") == name, filled).otherwise(text)
    hint = F.when((F.col("track") == "retrieval") & F.col("rule_hint").isNotNull(), F.replace(F.lit(HINT), F.lit("{rank}"), F.col("rule_hint").cast("string"))).otherwise("")
    own = ["sample_id", "trace_id", "track", "rule_hint", "question", "retrieval_query", "final_answer", "source_excerpt", "reference_answer"]
    return samples.select(*own).join(listed(hits), "trace_id", "left").select("sample_id", "track", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.concat(text, hint).alias("prompt"))
