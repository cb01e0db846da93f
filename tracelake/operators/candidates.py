"""Candidate chunks for question sets: filters, query validation, seeded sampling, apportionment, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import non_blank, squeeze, strip

# What is no content (headings, page numbers, signatures, tables of contents, appendices, short numbered titles).
NO_CONTENT = [r"^\s*#{1,6}\s+\S+\s*$", r"^\s*第?\s*\d+\s*页?\s*$", r"^\s*(?:签字|签名|签章|盖章)\s*[：:]\s*$", r"^\s*(?:目录|目\s*录)\s*$", r"^\s*(?:附录|附件)\s*[A-Z\d]?\s*$", r"^\s*\d+(?:\.\d+)*\s+\S{1,10}\s*$"]
MIN_CONTENT = 20
# Words that make a query a question or link several concepts, and its limits.
LINKS = ("与|和|及|以及|并且|同时|另外|此外|还有", r"\band\b|\bor\b|\bas well as\b|\bin addition\b", "[、，].*[、，]")
QUESTION_WORDS = ["什么", "为何", "为什么", "如何", "是否", "哪些", "请分析", "请说明", "分别", "what", "why", "how", "whether"]
RETRIEVAL_WORDS = ["什么", "为何", "为什么", "如何", "是否", "哪些", "请分析", "请说明", "请解释", "请描述", "请比较", "分别", "哪些方面", "怎么回事"]
ZH_MIN, ZH_MAX, EN_MAX, MIN_EVIDENCE = 3, 30, 15, 15


def reject_reason(duplicated: Column) -> Column:
    """Why a chunk is no candidate, the first reason in order; NULL for candidates."""
    content = F.coalesce(strip("content"), F.lit(""))
    title = content.rlike("|".join(f"(?:{p})" for p in NO_CONTENT))
    return (
        F.when(~F.col("status").eqNullSafe("completed"), "status_not_completed")
        .when(~F.coalesce("enabled", F.lit(True)), "disabled")
        .when(duplicated, "duplicate")
        .when(content == "", "empty")
        .when(F.length(content) < MIN_CONTENT, "too_short")
        .when(title, "title_or_page")
    )


def with_reject_reason(catalog: DataFrame) -> DataFrame:
    """Duplicates are hashes that occur more than once; they are counted by a grouped join, not by a window per hash."""
    repeated = catalog.where("content_hash is not null and content_hash != ''").groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1").select("content_hash", F.lit(True).alias("repeated"))
    return catalog.join(repeated, "content_hash", "left").withColumn("reject_reason", reject_reason(F.coalesce("repeated", F.lit(False)))).drop("repeated")


def mostly_chinese(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[一-鿿]")) >= 0.3 * F.greatest(F.length(c), F.lit(1))


def mostly_english(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]")) >= 0.5 * F.greatest(F.length(c), F.lit(1))


def query_errors(query: Column, label: Column) -> Column:
    """Names of the rules that a retrieval query breaks, in order; empty if it may be used."""
    q = F.coalesce(strip(query), F.lit(""))
    low = F.lower(q)
    word = F.exists(F.array(*[F.lit(w) for w in QUESTION_WORDS]), lambda w: F.contains(low, w))
    items = F.size(F.filter(F.transform(F.split(q, "[、，,]"), strip), lambda x: F.length(x) >= 2))
    linked = q.rlike("|".join(LINKS))
    checks = [
        F.when(non_blank(label).isNull(), "no_label"),
        F.when(word, "question_word"),
        F.when(q.rlike("[?？]"), "question_mark"),
        F.when(mostly_chinese(q) & (F.length(q) < ZH_MIN), "too_short").when(mostly_chinese(q) & (F.length(q) > ZH_MAX), "too_long").when(~mostly_chinese(q) & mostly_english(q) & (F.size(F.split(F.regexp_replace(q, r"(?U)\s+", " "), " ")) > EN_MAX), "too_long"),
        F.when(linked & (items >= 3), "several_concepts"),
    ]
    return F.when(q == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*checks)))


def grounded(query: Column, content: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """A query is grounded unless none of its terms occurs in the content and a term of three or more characters is missing.

    Chinese runs count by their two-character pieces: a longer piece only occurs where its pairs do. ``synonyms`` names other words
    that are allowed to stand for a word of the query.
    """
    q, c = F.coalesce(strip(query), F.lit("")), F.lower(F.coalesce(strip(content), F.lit("")))
    runs = F.regexp_extract_all(q, F.lit("([一-鿿]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    terms = F.concat(F.regexp_extract_all(q, F.lit("([A-Za-z][A-Za-z0-9_-]+)"), F.lit(1)), F.regexp_extract_all(q, F.lit(r"(\d+(?:\.\d+)*(?:\s*[条款项号])?)"), F.lit(1)))
    found = F.exists(F.concat(pairs, terms), lambda t: F.contains(c, F.lower(t)))
    for word, others in (synonyms or {}).items():
        found = found | (F.contains(F.lower(q), F.lit(word.lower())) & F.exists(F.array(*[F.lit(o.lower()) for o in others]), lambda o: F.contains(c, o)))
    long_term = F.exists(F.concat(runs, terms), lambda t: F.length(t) > 2)
    return (q != "") & (c != "") & (found | ~long_term)


def retrieval_question_error(question: Column, reference: Column, excerpt: Column, chunk: Column) -> Column:
    """Why a retrieval question can't be used; NULL if it can."""
    plain = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    bare = lambda c: strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s*\d+[.\-]\d+[.\d]*\s*", ""), r"[（(][^）)]*[）)]", ""), "[《》「」\"“”]", ""))
    q, r, e = [F.coalesce(strip(c), F.lit("")) for c in (question, reference, excerpt)]
    word = F.exists(F.array(*[F.lit(w) for w in RETRIEVAL_WORDS]), lambda w: F.contains(q, w))
    return (
        F.when(q == "", "empty").when(q.rlike("[?？]"), "question_mark").when(word, "question_word")
        .when((r != "") & (F.length(r) < MIN_EVIDENCE), "short_evidence")
        .when((r != "") & ~F.contains(plain(F.coalesce(chunk, F.lit(""))), plain(r)), "not_in_chunk")
        .when((r != "") & (bare(q) != "") & F.contains(bare(r), bare(q)), "copied")
        .when((e != "") & (r != "") & (e != r), "excerpt_differs")
    )


def draw(key: Column, seed: str) -> Column:
    """The order in which a seeded sample draws: a hash of seed and key, the same on any cluster."""
    return F.sha2(F.concat(F.lit(seed + ":"), key), 256)


def sample_per_group(rows: DataFrame, group: str, key: str, seed: str, n: int, factor: float = 1.5) -> DataFrame:
    """The candidate pool of every group: least(available, max(n, ceil(factor * n))) rows in draw order.

    Groups are thinned per salt before the final cut, so a hot group isn't sorted in one task.
    """
    size = max(n, -(-int(n * factor * 10) // 10))
    d = rows.withColumn("_draw", draw(F.concat_ws(":", group, key), seed))
    thin = d.withColumn("_salt", F.substring("_draw", 1, 1)).withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_salt").orderBy("_draw", key))).where(F.col("_rn") <= size)
    return thin.withColumn("pool_no", F.row_number().over(Window.partitionBy(group).orderBy("_draw", key))).where(F.col("pool_no") <= size).drop("_draw", "_salt", "_rn")


def first_by(rows: DataFrame, key: Column, seq: str) -> DataFrame:
    """The first row of every key by ``seq``; rows without a key are dropped. One grouped aggregate, no window."""
    cols = rows.columns
    kept = rows.withColumn("_key", key).where("_key is not null and _key != ''").groupBy("_key").agg(F.min_by(F.struct(*cols), F.col(seq)).alias("r"))
    return kept.select("r.*")


def repeated_questions(rows: DataFrame, seq: str) -> DataFrame:
    return first_by(rows, squeeze("question"), seq)


def apportion(rows: DataFrame, by: list[str], order: str, weight: str, total: int) -> DataFrame:
    """Largest-remainder shares of ``total`` per group, at least one each; the first ``total`` get one if there are more.

    Shares that the minimum of one has raised are taken back from the smallest remainders that can give.
    """
    w, o = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    d = rows.withColumns({"_n": F.count("*").over(w), "_sum": F.sum(weight).over(w), "_i": F.row_number().over(o)})
    raw = F.col(weight) * total / F.col("_sum")
    d = d.withColumn("_raw", raw).withColumn("_base", F.greatest(F.lit(1), F.floor("_raw"))).withColumn("_rest", F.col("_raw") - F.floor("_raw"))
    d = d.withColumn("_diff", F.lit(total) - F.sum("_base").over(w))
    up = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_rest"), "_i"))
    giving = F.when(F.col("_base") > 1, F.col("_base") - 1).otherwise(0)
    down = F.row_number().over(Window.partitionBy(*by).orderBy((giving == 0).cast("int"), "_rest", "_i"))
    d = d.withColumns({"_up": up, "_down": down})
    share = F.when(F.col("_n") >= total, (F.col("_i") <= total).cast("bigint")).when(F.col("_diff") > 0, F.col("_base") + (F.col("_up") <= F.col("_diff")).cast("bigint")).otherwise(F.col("_base") - ((giving > 0) & (F.col("_down") <= -F.col("_diff"))).cast("bigint"))
    return d.withColumn("share", share.cast("bigint")).drop("_n", "_sum", "_i", "_raw", "_base", "_rest", "_diff", "_up", "_down")


def round_robin(rows: DataFrame, section: str, seq: str, n: int) -> DataFrame:
    """n rows taken in turns from the sections: the r-th of each before the (r+1)-th of any.

    A section holds no more than ``n`` of the result, so the global cut sorts at most n rows per section.
    """
    r = F.row_number().over(Window.partitionBy(section).orderBy(seq))
    turn = rows.withColumn("_r", r).withColumn("_first", F.min(seq).over(Window.partitionBy(section))).where(F.col("_r") <= n)
    return turn.orderBy("_r", "_first").limit(n).drop("_r", "_first")
