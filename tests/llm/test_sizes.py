"""Splitting, packing and mixing."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import mixing as M
from tracelake.llm import packing as K
from tracelake.llm import splitting as S
from tracelake.llm import tokens as T


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 。，.\n\r测😀", max_size=400), st.integers(2, 60), st.data())
def test_pieces_give_the_text_back(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    parts = S.split_text(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(e - s <= limit for s, e, _ in parts)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(parts, parts[1:]))


# The boundaries as patterns, best kind last.
PATTERNS = [
    (5, re.compile(r"[^\S\r\n]+")),
    (4, re.compile(r"[，、；：,;:][”’」』）】)\]]*[^\S\r\n]*")),
    (3, re.compile(r"(?:[。！？…]|[.!?](?=\s|$))[”’」』）】\"')\]]*[^\S\r\n]*")),
    (2, re.compile(r"\r\n|\n|\r")),
    (1, re.compile(r"(?:\r\n|\n|\r(?!\n))(?:[^\S\r\n]*(?:\r\n|\n|\r(?!\n)))+")),
]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab \t\u3000。，.!\n\r)”\"测😀", max_size=60))
def test_boundaries_are_those_of_the_patterns(text):
    want = {}
    for kind, pattern in PATTERNS:
        want.update({m.end(): kind for m in pattern.finditer(text)})
    want = {p: k for p, k in want.items() if 0 < p < len(text)}
    pos, kind = S.boundaries(text)
    assert dict(zip(pos.tolist(), kind.tolist())) == want


def test_cuts_are_natural_and_best():
    text = "aaaa. bbbb. cccc. dddd. "
    assert [text[s:e] for s, e, _ in S.split_text(text, 12, 0)] == ["aaaa. bbbb. ", "cccc. dddd. "]
    for seed in range(20):
        rng = random.Random(seed)
        t = "".join(rng.choice("ab .\n") for _ in range(60))
        ends, kinds = S.cuts(t, 25, 3)
        pos, kind = S.boundaries(t)
        if 6 in kinds:
            continue
        ideal = (60 + (-(-57 // 22) - 1) * 3) / -(-57 // 22)
        cost = lambda es: sum(S.IMBALANCE * ((e - (p - 3 if p else 0) - ideal) / 25) ** 2 for p, e in zip([0, *es], es)) + sum(S.PENALTY[dict(zip(pos.tolist(), kind.tolist())).get(e, 0)] for e in es[:-1])
        fits = lambda es: all(e - (p - 3 if p else 0) <= 25 and (not p or p > 3) for p, e in zip([0, *es], es))
        best = min(cost([*c, 60]) for n in (2, 3, 4) for c in itertools.combinations(pos.tolist(), n) if fits([*c, 60]))
        assert cost(ends) == pytest.approx(best)


def test_split_frames(spark):
    df = spark.createDataFrame([("a", "x" * 30, 1), ("a", "x" * 30, 1), ("b", "", 1), ("c", None, 1), ("d", "y" * 10, 1)], "item_key string, text string, size int")
    out = S.split_all(df, 10, 2).collect()
    assert sum(r.item_key == "a" for r in out) == 2 * out[0].n_pieces and {r.item_key for r in out} == set("abcd")
    assert S.pieces(df.where("1 = 0"), 10, 2).collect() == []
    with pytest.raises(ValueError):
        S.pieces(df, 10, 10)


def test_packing(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([0, 1, 7, 90, 100, 100, 250, 1000])) for k in range(3000)] + [(5000, 7), (9999, None)]
    df = spark.createDataFrame(rows, "key long, n_tokens long")
    for shard in (20_000, 500):
        out = K.pack(df, 100, shard=shard).toPandas()
        assert out.groupby(["shard", "container"])["n_tokens"].sum().max() <= 100
        assert out["n_tokens"].sum() == sum(n or 0 for _, n in rows)
        assert (out[out["part"] == 0].shape[0]) == sum(1 for _, n in rows if n)
        whole = {k: n for k, n in rows if n and n <= 100}
        assert not out[out["key"].isin(whole)]["part"].any()
        report = [r for r in K.fill_report(K.pack(df, 100, shard=shard), 100).collect() if r.shard is None][0]
        assert 0 <= report.unused_share < 0.08
        assert report.least_containers <= report.n_containers
    assert K.pack(df.where("1 = 0"), 100).collect() == []
    assert len(set(K.assign(np.array([60, 50, 50, 40]), 100).tolist())) == 2


def test_packing_of_repeated_keys(spark):
    """Copies of one key, whole ones and one over the capacity, are items of their own and spread over the shards."""
    df = spark.createDataFrame([(5, 60)] * 4000 + [(5, 250), (5, 250), (6, 0)], "key long, n_tokens long")
    out = K.pack(df, 100, shard=500).toPandas()
    assert len(out) == 4006 and out["n_tokens"].sum() == 4000 * 60 + 500
    assert sorted(out[out["part"] > 0]["n_tokens"]) == [50, 50, 100, 100] and out["shard"].nunique() > 1
    assert out.groupby(["shard", "container"])["n_tokens"].sum().max() <= 100


def test_plan_of_a_mix():
    total, x, plan = M.plan_mix([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("gone", 0.4, 1), ("none", 0.0, 1)], {"a": 1000, "b": 100, "c": 500})
    assert x == 0 and total == pytest.approx(200 / 0.3)
    assert [round(p.weight, 6) for p in plan] == [0.5, 0.3, 0.2, 0, 0]
    total, x, plan = M.plan_mix([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 1000, "b": 100}, budget=900)
    assert 0 < x <= 1 and total == 900 and all(p.passes <= p.repeats + 1e-6 for p in plan) and plan[1].passes == pytest.approx(2, abs=1e-6)
    assert M.plan_mix([("a", 1.0, 1)], {})[0] == 0
    total, x, w, plan = M.plan_natural([("a", 0.4, 1), ("b", 0.35, 4), ("c", 0.25, 9), ("gone", 0.1, 2)], {"a": 7000, "b": 2000, "c": 1000})
    assert 0 < x < 1 and M.entropy(w) == pytest.approx(M.entropy([0.4, 0.35, 0.25])) and all(p.passes <= p.repeats for p in plan)
    assert any(p.passes == pytest.approx(p.repeats) for p in plan) and total == pytest.approx(sum(p.budget for p in plan))
    _, x, _, plan = M.plan_natural([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 1000, "b": 100}, budget=900)
    assert x > 0 and max(p.passes / p.repeats for p in plan) == pytest.approx(1, abs=1e-6)
    assert M.plan_natural([("a", 1.0, 1)], {})[0] == 0
    shares = [0.7, 0.2, 0.1]
    assert M.entropy(M.temper(shares, M.temper_to_entropy(shares, 0.9))) == pytest.approx(0.9)


def test_mix(spark):
    rng = random.Random(4)
    rows = [(k, "big" if k % 3 else "small" if k % 2 else "hot", f"t{k}".encode(), rng.randrange(1, 50)) for k in range(3000)]
    rows += [(9000 + k, "big", b"t1", 20) for k in range(500)] + [(1, "none", b"z", 5), (2, None, b"y", 5), (3, "big", b"e", 0)]
    texts = M.distinct_texts(spark.createDataFrame(rows, "key long, source string, text_hash binary, n_tokens long")).cache()
    assert texts.where("source = 'big'").count() == 2000
    targets = [("big", 0.5, 1), ("small", 0.3, 4), ("hot", 0.2, 2), ("gone", 0.1, 3)]
    total, _, plan = M.plan_mix(targets, M.source_tokens(texts, targets))
    mixed = M.realise(texts, plan)
    out = mixed.toPandas()
    for p in plan[:3]:
        assert out[out["source"] == p.source]["n_tokens"].sum() == pytest.approx(p.budget, abs=30)
        uses = out[out["source"] == p.source].groupby("key").size()
        assert uses.max() <= p.repeats and uses.max() - uses.min() <= 1
    assert not out.duplicated(["key", "block"]).any()
    report = {r.source: r for r in M.shares_report(mixed, plan, total).collect()}
    assert report["gone"].n_uses == 0 and report["big"].reached_share == pytest.approx(0.5 / 1.0, abs=0.01)
    empty = M.distinct_texts(texts.select("key", "source", "text_hash", "n_tokens").where("1 = 0"))
    total, _, plan = M.plan_mix(targets, M.source_tokens(empty, targets))
    assert M.realise(empty, plan).collect() == [] and len(M.shares_report(M.realise(empty, plan), plan, total).collect()) == 4


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, None, "s"), (3, "", None), (4, "测试" * 1000, "s")], "doc_id long, text string, source string")
    out = {r.key: r.n_tokens for r in T.sized(df, source="source").collect()}
    assert out[2] == out[3] == 0 and out[1] == T.count_tokens("hello world") > 0 and out[4] > 500
