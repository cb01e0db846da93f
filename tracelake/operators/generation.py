"""Question generation around a model: prompts, plans checked against their candidates, queries bound and checked, extra rounds.

What a model returns is a table here (one row per item, in its order); everything a stage decides about it is relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import non_blank
from .candidates import grounded, query_errors
from .reports import capped

# Styles of a query and the one that stands for any other, modifiers kept, rounds and questions asked for at a time.
STYLES, ANY_STYLE = ("lexical", "semantic", "disambiguating"), "semantic"
MODIFIERS, ROUNDS, AT_ONCE = 2, 3, 3
HINT, SECTION, STRUCTURE = "- 主题方向：", "\n当前章节：「{title}」", "\n文档整体结构："

TEMPLATES = {
    "qa": "Write questions with answers for an evaluation.\n{section_context}\n\n[Passage]\n{content}\n\n[Task]\n- number: {num_questions}\n- difficulty: {difficulty}\n{topic_hint_section}\n{coverage_instruction}\n\n[Reply]\nA JSON array of objects with question, reference_answer, source_excerpt, topic and difficulty.",
    "retrieval": "Write short search queries, each with the passage's own words as evidence.\n{section_context}\n\n[Passage]\n{content}\n\n[Task]\n- number: {num_questions}\n{topic_hint_section}\n{coverage_instruction}\n\n[Reply]\nA JSON array of objects with question, reference_answer and topic.",
}
COVERAGE = {"qa": ("- one question about the main point", "- {n} questions, on different points where there are several"), "retrieval": ("- one query about the main point", "- up to {n} queries, fewer where the passage has fewer points")}


def generation_prompt(mode: str, content: Column, n: Column, difficulty: Column, hint: Column, title: Column, structure: Column) -> Column:
    """The prompt for one passage; hint, title and structure may be NULL or empty."""
    given = lambda c: F.nullif(c, F.lit(""))
    context = F.when(given(title).isNotNull(), F.concat(F.replace(F.lit(SECTION), F.lit("{title}"), title), F.coalesce(F.concat(F.lit(STRUCTURE), given(structure)), F.lit("")))).otherwise("")
    one, many = COVERAGE[mode]
    coverage = F.when(n <= 1, one).otherwise(F.replace(F.lit(many), F.lit("{n}"), n.cast("string")))
    out = F.lit(TEMPLATES[mode])
    for place, value in (("content", F.coalesce(content, F.lit(""))), ("num_questions", n.cast("string")), ("difficulty", difficulty), ("topic_hint_section", F.coalesce(F.concat(F.lit(HINT), given(hint)), F.lit(""))), ("section_context", context), ("coverage_instruction", coverage)):
        if "{" + place + "}" in TEMPLATES[mode]:
            out = F.replace(out, F.lit("{" + place + "}"), value)
    return out


def _first_of(rows: DataFrame, on: str) -> DataFrame:
    """Marks the first row (by ``seq``) of every (doc, candidate_id) among those where ``on`` holds."""
    first = rows.where(on).groupBy("doc", "candidate_id").agg(F.min("seq").alias("first_seq"))
    return rows.join(first, ["doc", "candidate_id"], "left").withColumn("is_first", F.col("seq").eqNullSafe(F.col("first_seq"))).drop("first_seq")


def plan_items(items: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """Items of a plan with ``outcome``: planned, or why not; style, fact, intent and modifiers as they will be used.

    ``items`` has doc, seq, candidate_id, style, fact, intent, label and modifiers, ``candidates`` doc and candidate_id. The checks
    run in this order: no_candidate, unknown_candidate, repeated, no_fact (the intent may stand for it), no_label; of the rest
    the first ``n`` of a document are planned, others are beyond_target.
    """
    known = candidates.select("doc", "candidate_id").distinct().withColumn("known", F.lit(True))
    given = items.select("doc", "seq", F.coalesce(non_blank("candidate_id"), F.lit("")).alias("candidate_id"), "style", "fact", "intent", "label", "modifiers")
    i = given.join(known, ["doc", "candidate_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    i = _first_of(i, "known").withColumn("fact", F.coalesce(non_blank("fact"), non_blank("intent")))
    reason = F.when(F.col("candidate_id") == "", "no_candidate").when(~F.col("known"), "unknown_candidate").when(~F.col("is_first"), "repeated").when(F.col("fact").isNull(), "no_fact").when(non_blank("label").isNull(), "no_label")
    i = i.withColumn("reason", reason)
    kept = capped(i.where("reason is null").select("doc", "seq"), ["doc"], [F.col("seq")], n).select("seq", F.lit(True).alias("kept"))
    outcome = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("kept"), "planned").otherwise("beyond_target")
    style = F.when(F.col("style").isin(*STYLES), F.col("style")).otherwise(ANY_STYLE)
    modifiers = F.slice(F.filter(F.transform(F.coalesce("modifiers", F.array().cast("array<string>")), lambda m: non_blank(m)), lambda m: m.isNotNull()), 1, MODIFIERS)
    return i.join(kept, "seq", "left").select("doc", "seq", "candidate_id", outcome.alias("outcome"), style.alias("style"), "fact", "label", modifiers.alias("modifiers"))


def bind_queries(queries: DataFrame, plan: DataFrame, contents: DataFrame) -> DataFrame:
    """Generated queries with ``status`` (passed, rejected, or why they can't be bound) and the names of the rules they break.

    ``queries`` has doc, seq, candidate_id, query and label, ``plan`` the planned items, ``contents`` one content per doc and
    candidate. A modifier of the plan may stand in the content for the word of the query.
    """
    planned = plan.where("outcome = 'planned'").select("doc", "candidate_id", "style", F.lit(True).alias("planned"))
    given = queries.select("doc", "seq", F.coalesce(non_blank("candidate_id"), F.lit("")).alias("candidate_id"), "query", "label")
    q = given.join(planned, ["doc", "candidate_id"], "left").withColumn("planned", F.coalesce("planned", F.lit(False)))
    q = _first_of(q, "planned").join(contents.select("doc", "candidate_id", "content"), ["doc", "candidate_id"], "left")
    errors = F.array_compact(F.concat(query_errors(F.col("query"), F.col("label")), F.array(F.when(~grounded(F.col("query"), F.col("content")), "not_grounded"))))
    unbound = F.when(F.col("candidate_id") == "", "no_candidate").when(~F.col("planned"), "not_planned").when(~F.col("is_first"), "repeated").when(non_blank("query").isNull(), "no_query")
    q = q.withColumn("unbound", unbound).withColumn("errors", F.when(unbound.isNull(), errors))
    status = F.when(F.col("unbound").isNotNull(), F.col("unbound")).when(F.size("errors") == 0, "passed").otherwise("rejected")
    return q.select("doc", "seq", "candidate_id", status.alias("status"), "errors", "style")


def extra_requests(pool: DataFrame, missing: DataFrame, rounds: int = ROUNDS, at_once: int = AT_ONCE) -> DataFrame:
    """(doc, chunk, round, n): what extra rounds ask for until a document has its questions, passages in their order.

    ``pool`` has doc, chunk and place of the passages with unused evidence, ``missing`` the number of questions a document lacks. Each
    passage is asked for at most ``at_once`` a round; what is asked for is taken as got.
    """
    short = missing.where("missing > 0").select("doc", "missing")
    numbered = pool.select("doc", "chunk", "place").join(short, "doc").withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy("place", "chunk")))
    sizes = numbered.groupBy("doc").agg(F.max("i").alias("n_chunks"))
    turns = numbered.join(sizes, "doc").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    slot = (F.col("round") - 1) * F.col("n_chunks") + F.col("i")
    asked = F.least(F.lit(at_once), F.col("missing") - at_once * (slot - 1))
    return turns.withColumn("n", asked.cast("int")).where("n > 0").select("doc", "chunk", "round", "n")
