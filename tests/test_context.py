from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexifold.operators import analytics, context, suggest

SECTION = r"^## state (\d+)$"


def brute_slice(text, terms, anchors, radius, most):
    lines = (text or "").split("\n")
    names, now = [], None
    for x in lines:
        m = re.match(SECTION, x)
        now = m[1] if m else now
        names.append(now)
    anchored = {i for i, n in enumerate(names) if n is not None and n in (anchors or ())}
    hits = [i for i, x in enumerate(lines) if any(t.lower() in x.lower() for t in terms or () if t)]
    near = {j for i in hits for j in range(max(0, i - radius), min(len(lines), i + radius + 1))}
    if not anchored and not near:
        return "\n".join(lines[: 2 * radius])[:most]
    size, keep, full = 0, set(), False
    for group in (sorted(anchored), sorted(near - anchored)):
        for i in group:
            size += len(lines[i]) + 1
            full = full or size > most
            if not full:
                keep.add(i)
    out, before = [], -2
    for i in sorted(keep):
        out += ["[...]"] * (i != before + 1) + [lines[i]]
        before = i
    return "\n".join(out)


def test_slices(spark):
    rng = random.Random(0)
    text = lambda n: "\n".join(rng.choice(["## state 1", "## state 2", "plain words", "a Needle here", "", "x" * 30, "état", "😀 needle"]) for _ in range(n))
    files = [("b", f"f{i}", text(rng.randint(0, 60))) for i in range(40)] + [("b", "null", None), ("b", "empty", "")]
    asked = [(q, b, r, rng.choice([["needle"], ["ÉTAT", ""], ["nowhere"], [], None]), rng.choice([["1"], ["2", "9"], [], None])) for q in range(3) for b, r, _ in files]
    known = {r: t for _, r, t in files}
    served = spark.createDataFrame(asked, "qid int, base string, rel string, terms array<string>, anchors array<string>")
    table = spark.createDataFrame(files, "base string, rel string, text string")
    for radius, most in ((2, 80), (1, 5), (40, 60_000)):
        got = {(r.qid, r.rel): r.slice for r in context.slices(served, table, SECTION, radius, most).collect()}
        assert got == {(q, r): brute_slice(known[r], terms, anchors, radius, most) for q, _, r, terms, anchors in asked}


def brute_merge(first, second):
    first, second = first.strip(), second.strip()
    if second in first:
        return first
    if first in second:
        return second
    for n in range(min(len(first), len(second)), 0, -1):
        if first.endswith(second[:n]) and len(second[:n].encode()) >= 10:
            return first + "\n" + second[n:].lstrip()
    return first + "\n\n" + second


def brute_cap(text, most):
    if len(text) <= most:
        return text
    head = text[:most]
    for mark, tail in (("\n\n", ""), (". ", ".")):
        at = head.rfind(mark)
        if at > most // 2:
            return head[:at].strip() + tail
    return head.strip()


def test_passages(spark):
    rng = random.Random(1)
    whole = "".join(rng.choice(["palavra ", "é ", "fim. ", "\n\n", "a longer run of words "]) for _ in range(120))
    cut = lambda: whole[(a := rng.randint(0, len(whole) - 10)) : a + rng.randint(5, 400)]
    rows = [(q, "b", f"f{rng.randint(0, 2)}", k, f"h{rng.randint(0, 1)}", rng.choice([None, "o"]), rng.choice([cut(), cut(), cut(), "", None, "same", " same "])) for q in range(3) for k in range(1, 40)]
    got = {tuple(r) for r in context.assembled(spark.createDataFrame(rows, "qid int, base string, rel string, rank int, heading string, captured_from string, text string"), 6, 300).select("qid", "rel", "heading", "at", "text").collect()}
    want, taken = {}, Counter()
    for q, _, rel, k, heading, origin, text in sorted(rows, key=lambda r: (r[0], r[3])):
        taken[q, rel] += 1
        if taken[q, rel] <= 6:
            at, held = want.get((q, rel, heading, origin), (k, None))
            want[q, rel, heading, origin] = at, (text or "") if held is None else brute_merge(held, text or "")
    assert got == {(q, rel, heading, at, brute_cap(text, 300)) for (q, rel, heading, _), (at, text) in want.items()}


def test_excerpts(spark):
    words = [f"w{i}" for i in range(40)]
    words[20:23] = ["Célula", "tronco,", "célula"]
    show = lambda text, terms: spark.createDataFrame([(text, terms)], "t string, q array<string>").select(context.excerpt(F.col("t"), F.col("q"), 5)).first()[0]
    assert show(" ".join(words), ["celula", "tronco"]) == " ... w18 w19 Célula tronco, célula ... "
    assert show(" ".join(words), ["nothing"]) == "w0 w1 w2 w3 w4 ... "
    assert show("(one) two", ["two"]) == "one) two"
    assert show("... !", ["x"]) == "" == show(None, ["x"]) == show("", ["x"])


def dice(a, b):
    grams = lambda w: Counter([w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w])
    x, y = grams(a), grams(b)
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


@pytest.mark.parametrize("floor", [0.3, 0.65, 1.0])
def test_similarity_join_loses_no_pair(spark, floor):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(120)} | {"aaaaaaa", "aaaaaaaa", "aaa", "a", "papapapa"})
    table = lambda name: spark.createDataFrame([(w,) for w in words], f"{name} string")
    got = {(r.word, r.part): r.likeness for r in suggest.look_alike(table("word"), table("part"), floor).collect()}
    want = {(a, b): dice(a, b) for a in words for b in words if dice(a, b) >= floor}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_many_patterns_in_many_texts(spark):
    rng = random.Random(3)
    texts = [("b", str(i), " ".join(rng.choices(["Alpha", "beta", "gâma", "delta.", "x-y"], k=rng.randint(0, 30)))) for i in range(60)] + [("b", "null", None)]
    patterns = [(i, rng.choices(["alpha", "beta", "gama", "delta", "never"], [9, 9, 9, 9, 1], k=rng.randint(1, 4))) for i in range(50)] + [(99, [])]
    got = {(r.pattern, r.rel) for r in analytics.holders(spark.createDataFrame(patterns, "pattern int, tokens array<string>"), spark.createDataFrame(texts, "base string, rel string, text string")).collect()}
    flat = {r: " " + " ".join(re.findall(r"\w+", (t or "").lower().replace("â", "a"))) + " " for _, r, t in texts}
    assert got == {(p, r) for p, tokens in patterns for r, t in flat.items() if tokens and " " + " ".join(tokens) + " " in t}


def test_where_evidence_is_lost(spark):
    texts = [("b", "both", "one two three. four five six"), ("b", "part", "one two three only"), ("b", "far", "seven eight nine ten")]
    golds = [(1, "one two three"), (1, "Four FIVE six"), (2, "one two"), (2, "four five"), (3, "seven eight"), (4, "not here"), (5, "one two"), (5, "seven eight"), (6, "...")]
    served = [(1, "says one two three, then four five six"), (2, "one two"), (5, "nothing")]
    ranked = [(1, "b", "far"), (2, "b", "both"), (3, "b", "both"), (4, "b", "both")]
    got = analytics.evidence_taxonomy(
        spark.createDataFrame(golds, "qid int, gold string"), spark.createDataFrame(served, "qid int, text string"), spark.createDataFrame(ranked, "qid int, base string, rel string"), spark.createDataFrame(texts, "base string, rel string, text string")
    )
    assert {tuple(r) for r in got.collect()} == {(1, 2, 2, "full", ""), (2, 2, 1, "partial", "slice"), (3, 1, 0, "none", "route"), (4, 1, 0, "none", "not-verbatim"), (5, 2, 0, "none", "not-verbatim")}
