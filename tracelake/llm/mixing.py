"""Mixing sources to target weights under a cap of repeats.

Method. Tempered weights, exponents found by bisection, realised as budgeted block permutations.

``plan_natural`` is the plain tempering: the natural token shares of the sources, raised to one exponent and normalised. The
exponent is bisected until the weights have the entropy of the target shares; with a ``budget`` it goes on until no
source needs more repeats than its cap. One exponent has one degree of freedom, so it can meet an entropy or a limit but not
a given share for each of many sources.
``plan_mix`` gives each source its own share: the tempering runs from the target shares (exponent 0) towards the shares that
all repeats allow (exponent 1), w ~ target * (capacity / target) ** exponent. Without a ``budget`` every source has exactly
its target share and the total is the largest that no source's cap of repeats forbids; with a larger one the smallest
exponent is bisected at which the caps hold.

A source with weight w gets w * budget / tokens passes over its texts: whole passes are full permutations, the last
one is the beginning of a permutation up to its token budget.

Scale. Texts are counted and hashed row by row and never shuffled. Copies of a text, wherever they stand, are one text (that of
the least id), so repeats are capped per text. The beginning of a permutation is found by 4096 hash buckets per source,
whose sums are accumulated, and an exact running sum within the one bucket that the budget cuts: no task ever sorts
a whole source. What is collected is one row per target.

Defined results. NULL and empty texts and sources without a target are left out. A target without any text gets share 0 and
the others are scaled up; the report shows it. Targets of no or negative share give nothing. Repeated ids are
counted by their text. Empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
SEED = 20240301


@dataclass(frozen=True)
class Plan:
    source: str
    target: float
    repeats: int
    tokens: int
    weight: float
    budget: float

    @property
    def passes(self) -> float:
        return min(self.budget / self.tokens, self.repeats) if self.tokens else 0.0


def temper(shares: list[float], exponent: float) -> list[float]:
    powered = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(powered)
    return [p / total if total else 0.0 for p in powered]


def entropy(shares: list[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def bisect(low: float, high: float, too_low, steps: int = 80) -> float:
    """The least x of [low, high] at which ``too_low`` no longer holds; it must be monotonous."""
    if not too_low(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if too_low(mid) else (low, mid)
    return high


def temper_to_entropy(shares: list[float], goal: float) -> float:
    """The exponent at which the tempered shares have the entropy (0: uniform, 1: natural, beyond: sharper)."""
    return bisect(0.0, 64.0, lambda x: entropy(temper(shares, x)) > goal)


def plan_mix(targets: list[tuple[str, float, int]], tokens: dict[str, int], budget: float | None = None) -> tuple[float, float, list[Plan]]:
    """(total, exponent, plan per target)."""
    live = [(s, t, r) for s, t, r in targets if t and t > 0 and (r or 0) > 0 and tokens.get(s, 0) > 0]
    scale = sum(t for _, t, _ in live)
    goal = {s: t / scale for s, t, _ in live}
    room = {s: r * tokens[s] for s, _, r in live}
    if not live:
        return 0.0, 0.0, [Plan(s, t or 0.0, r or 0, tokens.get(s, 0), 0.0, 0.0) for s, t, r in targets]
    exact = min(room[s] / goal[s] for s in goal)
    total = exact if budget is None else min(budget, sum(room.values()))

    def weights(x: float) -> dict[str, float]:
        raw = {s: goal[s] * (room[s] / goal[s]) ** x for s in goal}
        n = sum(raw.values())
        return {s: v / n for s, v in raw.items()}

    over = lambda x: max(w * total / room[s] for s, w in weights(x).items()) > 1 + 1e-9
    exponent = bisect(0.0, 1.0, over)
    w = weights(exponent)
    return total, exponent, [Plan(s, t or 0.0, r or 0, tokens.get(s, 0), w.get(s, 0.0), w.get(s, 0.0) * total) for s, t, r in targets]


def plan_natural(targets: list[tuple[str, float, int]], tokens: dict[str, int], budget: float | None = None) -> tuple[float, float, list[float], list[Plan]]:
    """(total, exponent, weights of the sources that have both a target and texts, plan per target).

    Without a ``budget`` the total is the largest that the caps allow at the exponent of the targets' entropy; with one, the
    exponent is the least at or above that at which the caps hold for it (natural shares at the end of the range).
    """
    live = [(s, t, r) for s, t, r in targets if t and t > 0 and (r or 0) > 0 and tokens.get(s, 0) > 0]
    empty = [Plan(s, t or 0.0, r or 0, tokens.get(s, 0), 0.0, 0.0) for s, t, r in targets]
    if not live:
        return 0.0, 0.0, [], empty
    held = sum(tokens[s] for s, _, _ in live)
    natural = [tokens[s] / held for s, _, _ in live]
    asked = sum(t for _, t, _ in live)
    room = [r * tokens[s] for s, _, r in live]
    exponent = temper_to_entropy(natural, entropy([t / asked for _, t, _ in live]))
    if budget is not None:
        budget = min(budget, sum(room))
        over = lambda x: max(w * budget / c for w, c in zip(temper(natural, x), room)) > 1 + 1e-9
        exponent = bisect(exponent, max(1.0, exponent), over)
    w = temper(natural, exponent)
    most = min(c / x for c, x in zip(room, w) if x > 0)
    total = most if budget is None else min(budget, most)
    by_source = {s: x for (s, _, _), x in zip(live, w)}
    return total, exponent, w, [Plan(s, t or 0.0, r or 0, tokens.get(s, 0), by_source.get(s, 0.0), by_source.get(s, 0.0) * total) for s, t, r in targets]


def distinct_texts(sized: DataFrame) -> DataFrame:
    """(key, source, text_hash, n_tokens): one row per text, the row of the least key."""
    first = F.min(F.struct("key", "source", "n_tokens")).alias("first")
    return sized.where("n_tokens > 0").groupBy("text_hash").agg(first).select("first.*", "text_hash").select("key", "source", "text_hash", "n_tokens")


def source_tokens(texts: DataFrame, targets: list[tuple[str, float, int]]) -> dict[str, int]:
    named = texts.where(F.col("source").isin([s for s, _, _ in targets])).groupBy("source").agg(F.sum("n_tokens").alias("n"))
    return {r.source: r.n for r in named.collect()}  # one row per target


def realise(texts: DataFrame, plan: list[Plan], seed: int = SEED) -> DataFrame:
    """(key, source, block, position, n_tokens): every use of a text; ``position`` orders the texts of a block."""
    spark = texts.sparkSession
    rows = [(p.source, int(p.passes + 1e-12), float((p.passes - int(p.passes + 1e-12)) * p.tokens), p.repeats) for p in plan if p.weight > 0]
    steps = spark.createDataFrame(rows, "source string, full int, rest double, repeats int")
    drawn = texts.join(steps, "source")
    place = lambda block: F.xxhash64(F.lit(seed), block, "text_hash")
    full = drawn.where("full > 0").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("full")))).select("key", "source", "block", place(F.col("block")).alias("position"), "n_tokens")
    last = drawn.where("rest >= 1 and full < repeats").withColumn("block", F.col("full") + 1).withColumn("position", place(F.col("block")))
    last = last.withColumn("bucket", F.shiftrightunsigned("position", 52))
    sums = last.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("held"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    marked = last.join(sums, ["source", "bucket"])
    whole = marked.where(F.col("before") + F.col("held") <= F.col("rest"))
    running = Window.partitionBy("source", "bucket").orderBy("position", "key").rowsBetween(Window.unboundedPreceding, 0)
    cut = marked.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("held") > F.col("rest")))
    cut = cut.withColumn("upto", F.col("before") + F.sum("n_tokens").over(running)).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest"))  # the text that the budget cuts counts if most of it fits
    cols = ["key", "source", "block", "position", "n_tokens"]
    return full.unionByName(whole.select(cols)).unionByName(cut.select(cols))


def shares_report(mixed: DataFrame, plan: list[Plan], total: float) -> DataFrame:
    """Per target: the share asked for, the weight planned, and what was reached."""
    spark = mixed.sparkSession
    rows = [(p.source, float(p.target), p.repeats, p.tokens, float(p.weight), float(p.passes)) for p in plan]
    asked = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, source_tokens bigint, weight double, passes double")
    used = mixed.groupBy("source").agg(F.count("*").alias("n_uses"), F.countDistinct("key").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.max("block").alias("most_repeats"))
    out = asked.join(used, "source", "left").fillna({"n_uses": 0, "n_texts": 0, "n_tokens": 0, "most_repeats": 0})
    return out.withColumn("reached_share", F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(Window.partitionBy())))
