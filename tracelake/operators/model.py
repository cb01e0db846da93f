"""Model calls as an operator: an injected client over distinct prompts, replies parsed and checked, failures kept in their row."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[str], str]
# Tries after the first, the first pause in seconds, the greatest rank a reply may name.
RETRIES, BASE_DELAY, LAST_RANK = 3, 1.0, 5
CALLED = "judge_key string, reply string, tries int, error string"


class ServiceError(RuntimeError):
    """A refusal of the service with its HTTP status, and the pause it asks for."""

    def __init__(self, message: str, status: int | None = None, retry_after: str | float | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


def is_passing(e: Exception) -> bool:
    """Whether trying again may help: too many requests, a failing server, a timeout or a lost connection."""
    if isinstance(e, ServiceError) and e.status is not None:
        return e.status == 429 or 500 <= e.status < 600
    return isinstance(e, (TimeoutError, ConnectionError))


def pause_before(e: Exception, n: int, base: float = BASE_DELAY) -> float:
    """Seconds before try n + 2: doubled each time, and no less than the service asks for."""
    try:
        asked = float(getattr(e, "retry_after", None) or 0)
    except (TypeError, ValueError):
        asked = 0.0
    return max(base * 2**n, asked)


def ask(client: Client, prompt: str, retries: int = RETRIES, pause: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None]:
    """(reply, tries, error) of one call."""
    for n in range(retries + 1):
        try:
            return client(prompt), n + 1, None
        except Exception as e:
            if n == retries or not is_passing(e):
                return None, n + 1, str(e)[:200] or type(e).__name__
            pause(pause_before(e, n))
    raise AssertionError


def call_model(prompts: DataFrame, client: Client, retries: int = RETRIES, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """(judge_key, prompt) -> ``CALLED``. Calls at a time are as many as partitions; an exception stays in its row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, *ask(client, p or "", retries, pause)) for k, p in zip(part["judge_key"], part["prompt"])]
            yield pd.DataFrame(rows, columns=["judge_key", "reply", "tries", "error"])

    return prompts.select("judge_key", "prompt").mapInPandas(run, CALLED)


def verdict(reply: Column, track: Column, n_results: Column) -> Column:
    """struct<top1, top3, top5, position, answer_correct, problem>: a reply read and checked.

    The JSON object is what stands between the first and the last brace. A retrieval verdict needs hits of 0 or 1 and a
    position that is absent or a rank that was shown and agrees with the hits; a verdict on an answer needs 0 or 1. What doesn't
    hold is named in ``problem``, and no value of such a reply is used.
    """
    whole = F.regexp_extract(reply, r"\{[\s\S]*\}", 0)
    doc = F.try_parse_json(F.nullif(whole, F.lit("")))
    number = lambda key: F.when(F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant")) == "BIGINT", F.try_variant_get(doc, f"$.{key}", "int"))
    t1, t3, t5, position, correct = (number(k) for k in ("retrieval_top1_hit", "retrieval_top3_hit", "retrieval_top5_hit", "hit_evidence_position", "answer_correct"))
    named = F.schema_of_variant(F.try_variant_get(doc, "$.hit_evidence_position", "variant"))
    absent = F.coalesce(named, F.lit("VOID")) == "VOID"
    flags = lambda *cs: F.coalesce(F.forall(F.array(*cs), lambda c: F.coalesce(c.isin(0, 1), F.lit(False))), F.lit(False))
    fits = F.when(absent, (t1 == 0) & (t3 == 0) & (t5 == 0)).otherwise((t1 == (position <= 1).cast("int")) & (t3 == (position <= 3).cast("int")) & (t5 == 1))
    problem = (
        F.when(doc.isNull(), "no_json")
        .when((track == "retrieval") & ~flags(t1, t3, t5), "bad_hits")
        .when((track == "retrieval") & ~absent & (position.isNull() | ~position.between(1, F.least(F.lit(LAST_RANK), n_results))), "bad_position")
        .when((track == "retrieval") & ~F.coalesce(fits, F.lit(False)), "position_against_hits")
        .when((track != "retrieval") & ~flags(correct), "bad_answer")
    )
    kept = lambda c, on: F.when(problem.isNull() & on, c)
    hit = track == "retrieval"
    return F.struct(kept(t1, hit).alias("top1"), kept(t3, hit).alias("top3"), kept(t5, hit).alias("top5"), kept(position, hit).alias("position"), kept(correct, ~hit).alias("answer_correct"), problem.alias("problem"))


def judge_with(rows: DataFrame, client: Client, retries: int = RETRIES, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """(judge_key, question, final_answer) -> (judge_key, answer_correct, error): answers judged by a plain prompt of the two."""
    prompt = F.concat(F.coalesce("question", F.lit("")), F.lit("\n"), F.coalesce("final_answer", F.lit("")))
    called = call_model(rows.select("judge_key", prompt.alias("prompt")), client, retries, pause)
    v = verdict(F.col("reply"), F.lit("grounded_qa"), F.lit(0))
    return called.withColumn("v", v).select("judge_key", F.col("v.answer_correct").alias("answer_correct"), F.when(F.col("error").isNotNull(), F.col("error")).otherwise(F.col("v.problem")).alias("error"))


def exact_reader(prompt: str) -> str:
    """A stand-in for a model: it looks for the evidence, or the answer, word for word in what the prompt shows."""
    part = lambda name: (re.search(rf"^\[{name}\]\n(.*?)(?=^\[[A-Z][a-z]+\]\n|\Z)", prompt, re.S | re.M) or ["", ""])[1].strip()
    shown = re.split(r"^--- 检索结果 \d+ ---\n", part("Results"), flags=re.M)[1:]
    if "[Evidence]\n" in prompt:
        rank = next((n for n, text in enumerate(shown[:LAST_RANK], 1) if part("Evidence") in text), None)
        hits = {f"retrieval_top{k}_hit": int(rank is not None and rank <= k) for k in (1, 3, 5)}
        return "Verdict:\n" + json.dumps({**hits, "hit_evidence_position": rank})
    answer, reference = part("Answer"), part("Reference")
    good = (reference in answer or answer in reference) if reference else any(answer in text for text in shown)
    return json.dumps({"answer_correct": int(bool(answer) and good)})


PLAN_MODES = ("quick_test", "incremental", "retry_failed", "force_all")


def run_plan(samples: DataFrame, existing: DataFrame, mode: str) -> DataFrame:
    """The samples a judge run takes up: (sample_id, trace_id, judge_key, needs_model, state).

    ``samples`` has sample_id (their order), trace_id, judge_key and needs_model; ``existing`` one result per trace_id with its
    error. ``state`` is new, retry (a result with an error) or success. quick_test takes the first new sample that needs the model,
    else the first to be tried again; incremental what is new or failed; retry_failed what failed; force_all everything.
    """
    state = F.when(F.col("judged").isNull(), "new").when(F.col("failed"), "retry").otherwise("success")
    past = existing.groupBy("trace_id").agg(F.lit(True).alias("judged"), F.bool_and(F.col("error").isNotNull()).alias("failed"))
    all_ = samples.select("sample_id", "trace_id", "judge_key", "needs_model").join(past, "trace_id", "left").select("sample_id", "trace_id", "judge_key", "needs_model", state.alias("state"))
    if mode == "incremental":
        return all_.where("state != 'success'")
    if mode == "retry_failed":
        return all_.where("state = 'retry'")
    if mode == "force_all":
        return all_
    if mode == "quick_test":
        return all_.where("needs_model and state != 'success'").orderBy((F.col("state") == "retry").cast("int"), "sample_id").limit(1)
    raise ValueError(f"no such mode: {mode}")


def plan_counts(plan: DataFrame) -> DataFrame:
    """One row: what the plan holds, and the calls it costs, one per distinct content."""
    n = lambda s: F.count_if(F.col("state") == s)
    return plan.agg(F.count("*").alias("n_samples"), n("new").alias("n_new"), n("retry").alias("n_retry"), n("success").alias("n_again"), F.countDistinct(F.when(F.col("needs_model"), F.col("judge_key"))).alias("n_calls"))
