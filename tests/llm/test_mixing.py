from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexifold.llm import mixing

from .fixtures import ROWS, edge, empty


def entropy(w):
    return 1.0 if len(w) < 2 else -sum(x * math.log(x) for x in w.values()) / math.log(len(w))


def tempered(tokens, alpha):
    raised = {s: n**alpha for s, n in tokens.items()}
    return {s: x / sum(raised.values()) for s, x in raised.items()}


def brute_temper(tokens, target, repeat, budget=None):
    """Weights and copies by plain halving over a dict."""

    def copies(alpha):
        w = tempered(tokens, alpha)
        whole = budget if budget is not None else max(n / w[s] for s, n in tokens.items())
        return {s: w[s] * whole / n for s, n in tokens.items()}

    def halve(ok, low, high):  # ok holds at low
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if ok(middle) else (low, middle)
        return low

    flat = lambda a: entropy(tempered(tokens, a)) >= target
    alpha = 1.0 if flat(1.0) else halve(flat, 0.0, 1.0) if flat(0.0) else 0.0
    if max(copies(alpha).values()) > repeat:
        alpha = 1.0 if max(copies(1.0).values()) > repeat else halve(lambda a: max(copies(a).values()) <= repeat, 1.0, alpha)
    least = min(1.0, repeat) if budget is None else 0.0
    return tempered(tokens, alpha), {s: max(min(c, repeat), least) for s, c in copies(alpha).items()}


def temper(spark, tokens, *args):
    rows = mixing.temper(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), *args).collect()
    return {r.source: r.weight for r in rows}, {r.source: r.passes + r.rest / r.tokens for r in rows}


@pytest.mark.parametrize(
    ("tokens", "target", "repeat", "budget"),
    [
        ({"a": 900, "b": 90, "c": 10}, 0.8, 1e9, None),
        ({"a": 900, "b": 90, "c": 10}, 0.99, 2.0, None),
        ({"a": 900, "b": 90, "c": 10}, 0.99, 2.0, 500),
        ({"a": 900, "b": 90, "c": 10}, 0.0, 0.5, 800),
        ({"a": 5, "b": 5}, 0.9, 2.0, None),
        ({"a": 7}, 0.9, 2.0, None),
        ({f"s{i}": 3 * i * i + 1 for i in range(40)}, 0.97, 3.0, None),
    ],
)
def test_like_plain_halving(spark, tokens, target, repeat, budget):
    weight, copies = temper(spark, tokens, target, repeat, budget)
    expected = brute_temper(tokens, target, repeat, budget)
    assert weight == pytest.approx(expected[0], rel=1e-6) and copies == pytest.approx(expected[1], rel=1e-5, abs=1e-6)


def test_alpha_meets_the_entropy(spark):
    weight, _ = temper(spark, {"a": 900, "b": 90, "c": 10}, 0.8, 1e9)
    assert abs(entropy(weight) - 0.8) < 1e-6


def test_repetition_limit_comes_first(spark):
    _, copies = temper(spark, {"a": 900, "b": 90, "c": 10}, 0.99, 2.0)
    assert max(copies.values()) == pytest.approx(2.0, abs=1e-6) and min(copies.values()) == pytest.approx(1.0)
    assert mixing.temper(spark.createDataFrame([], "source string, tokens long"), 0.9, 2.0).collect() == []


def test_a_smaller_budget_leaves_out(spark):
    rows = [(i, "one two three", "s") for i in range(500)]
    got = mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"), budget=600).collect()
    assert sum(r.copies for r in got) == 200


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_each_document_has_the_copies_of_the_permutation(spark, monkeypatch, broadcast):
    """Whole passes, and the rest in the order (block, small block, place) as far as the tokens go."""
    for name, n in (("BLOCKS", 8), ("BLOCK_ROWS", 4), ("BROADCAST_SOURCES", broadcast)):
        monkeypatch.setattr(mixing, name, n)
    rng = random.Random(1)
    rows = [(i, "word " * rng.randrange(1, 30), None if i % 11 == 0 else "big" if i % 10 else f"small{i % 3}") for i in range(1_200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.source: r for r in mixing.plan(df.select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("tokens")), 0.99, 1.6).collect()}
    got = {r.doc_id: r for r in mixing.with_copies(df, 0.99, 1.6).collect()}
    sized = df.withColumn("tokens", mixing.n_tokens(F.col("text")))
    tokens, docs = defaultdict(int), defaultdict(list)
    for source, p in plan.items():
        own = sized.where(F.col("source").eqNullSafe(F.lit(source))).withColumns({"b": F.lit(p.blocks), "s": F.lit(p.small)})
        for r in mixing._with_places(own, "b", "s", 17).collect():
            tokens[source] += r.tokens
            docs[source].append((r._order, r._small, r._place, r.doc_id, r.tokens))
    assert sum(map(len, docs.values())) == len(rows) and max(p.small for p in plan.values()) > 1
    _, copies = brute_temper(tokens, 0.99, 1.6)
    for source, own in docs.items():
        passes = int(copies[source] + 1e-9)
        left = (copies[source] - passes) * tokens[source] + 1e-3
        for *_, doc_id, n in sorted(own):
            left -= n
            assert got[doc_id].copies == passes + (left >= 0), (source, doc_id)
    assert all(r.copies >= 1 for r in got.values())


def test_documents_are_not_shuffled_to_learn_of_few_sources(spark, monkeypatch):
    plans, kept = [], mixing.checkpointed

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(mixing, "checkpointed", told)
    rows = [(i, "a b c", f"s{i % 7 % 4}") for i in range(300)]
    assert mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() == 300
    assert len(plans) > 4 and not any("Exchange hashpartitioning(coalesce(source" in p for p in plans)


def test_same_whatever_the_partitions(spark):
    rows = [(i, "a b c", f"s{i % 7 % 4}") for i in range(1_500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    deal = lambda d: {r.doc_id: r.copies for r in mixing.with_copies(d, entropy=0.999, repeat=3.0).collect()}
    assert deal(df) == deal(df.repartition(9))


def test_edge_rows_and_empty(spark):
    out = mixing.mix(edge(spark))
    assert out.columns == edge(spark).columns and out.count() >= len(ROWS)
    assert {r.doc_id for r in out.collect()} == {r[0] for r in ROWS}
    assert mixing.mix(empty(spark)).collect() == [] and mixing.with_copies(empty(spark)).collect() == []


def test_no_source_is_left_out_by_rounding(spark):
    rng = random.Random(1)
    for target in (0.0, 0.8, 0.95):
        tables = [(f"{t}/{i}", rng.randrange(1, 40)) for t in range(3) for i in range(20)]
        for t in range(3):
            docs = spark.createDataFrame([(i, "word " * n, s) for i, (s, n) in enumerate(tables) if s.startswith(f"{t}/")], "doc_id long, text string, source string")
            copies = [r.copies for r in mixing.with_copies(docs, entropy=target).collect()]
            assert min(copies) >= 1 and max(copies) <= 2 and (target or copies == [1] * 20)
