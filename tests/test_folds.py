from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexifold.operators import analytics, dense, index, logs, quality

EVENTS = "session string, seq long, ts long, kind string, agent string, question string"


def session(spark, *rows):
    return spark.createDataFrame([(s, i, i, k, a, q) for i, (s, k, a, q) in enumerate(rows)], EVENTS)


def test_owner_is_the_last_route_before_else_the_first_after(spark):
    rows = [("s", "refused", None, "a"), ("s", "routed", "x", None), ("s", "refused", None, "b"), ("s", "routed", "y", None), ("s", "conclusion", None, None), ("t", "refused", None, "c")]
    got = {r.seq: r.owner for r in logs.owners(session(spark, *rows)).collect()}
    assert got == {0: "x", 1: "x", 2: "x", 3: "x", 4: "y", 5: None}


def test_routes_in_a_row_are_one(spark):
    rows = [("s", "routed", a, None) for a in "xxyx"] + [("t", "routed", "x", None)]
    assert [r.agent for r in logs.routes(session(spark, *rows)).orderBy("seq").collect()] == ["x", "y", "x", "x"]


def test_deposits(spark):
    rows = [("s", "refused", None, "b"), ("s", "routed", "x", None), ("s", "refused", None, "a"), ("s", "conclusion", None, None), ("t", "refused", None, "c")]
    assert [tuple(r) for r in logs.deposits(session(spark, *rows)).collect()] == [("s", "x", 2, 1, "a|b")]


def test_counted_keeps_the_newest_payload(spark):
    df = spark.createDataFrame([("k", 2, 1, "new"), ("k", 1, 2, "old"), ("j", 5, 3, "x")], "key string, ts long, seq long, p string")
    got = {r.key: tuple(r)[1:] for r in logs.counted(df, ["key"], "ts", "p", "seq").collect()}
    assert got == {"k": (2, 1, 2, "new"), "j": (1, 5, 5, "x")}


def test_ledger(spark):
    rows = [("a", "r1", 1, "pending", False), ("a", "r1", 2, "objected", True), ("a", "r2", 1, "approved", False), ("b", "r1", 1, "objected", True), ("b", "r1", 2, "resolved", True)]
    got = {r.artifact: tuple(r)[1:] for r in logs.ledger(spark.createDataFrame(rows, "artifact string, reviewer string, seq int, state string, blocking boolean")).collect()}
    assert got == {"a": (2, 0, 1, False), "b": (1, 0, 0, True)}


def test_handoffs(spark):
    rows = [("s", 1, 1, "save", "a"), ("s", 2, 2, "claim", "b"), ("s", 3, 3, "claim", "c"), ("t", 1, 1, "complete", "a"), ("u", 1, 1, "save", "a")]
    got = {r.session: (r.status, r.claimed_by) for r in logs.handoffs(spark.createDataFrame(rows, "session string, ts long, seq long, action string, agent string")).collect()}
    assert got == {"s": ("claimed", "b"), "t": ("completed", None), "u": ("pending", None)}


OBJECTIONS = [
    ("too short", "brief"),
    ("   nine ch   ", "brief"),
    ("This feels wrong to me somehow", "vague"),
    ("I am NOT A FAN of the second part", "vague"),
    ("not a fan because it repeats itself", "advisory"),
    ("this looks ugly and violates the layout", "constitutional"),
    ("badly timed write to the log file", "advisory"),
    ("the second section is a race condition in waiting", "constitutional"),
    ("bad in every way I can think of", "advisory"),
    ("it talks past the reader, Keep It Short please", "constitutional"),
    (None, "brief"),
]


@pytest.mark.parametrize(("text", "verdict"), OBJECTIONS)
def test_objections(spark, text, verdict):
    said = F.lit(text).cast("string")
    constitution = F.array(F.lit("  "), F.lit(" keep it short "))
    got = spark.range(1).select(logs.admissibility(said, constitution), logs.admissible(said)).first()
    assert tuple(got) == (verdict, verdict not in ("brief", "vague"))
    assert spark.range(1).select(logs.admissibility(F.lit("it talks past the reader, keep it short"), F.lit(None).cast("array<string>"))).first()[0] == "advisory"


def test_kappa(spark):
    pairs = [(True, True)] * 21 + [(True, False)] * 4 + [(False, True)] * 9 + [(False, False)] * 16
    r = analytics.judge_agreement(spark.createDataFrame(pairs, "first boolean, second boolean")).first()
    assert (r.n, r.agreement, r.kappa, r.strength) == (50, 0.74, 0.48, "moderate")
    r = analytics.judge_agreement(spark.createDataFrame([(True, True)] * 3, "first boolean, second boolean")).first()
    assert r.kappa is None and r.strength is None


@pytest.mark.parametrize("n", [1, 2, 19, 20, 101])
def test_percentiles_are_lower_nearest_ranks(spark, n):
    values = sorted((i * 37 % 101) / 3 for i in range(n))
    r = analytics.latency_percentiles(spark.createDataFrame([("a", v) for v in values], "k string, v double"), "v", "k").first()
    assert (r.n, r.p50, r.p95, r.max) == (n, values[int((n - 1) * 0.5)], values[int((n - 1) * 0.95)], values[-1])


def test_triad(spark):
    rows = [(0, "where is the red house", ["The red house is on the hill. Nothing else matters"], "The house stands on the hill"), (1, "where", [], "Not found."), (2, "where", ["some context here"], "not found"), (3, "", [], "")]
    got = {r.qid: tuple(r)[1:] for r in analytics.triad(spark.createDataFrame(rows, "qid long, question string, context array<string>, answer string")).collect()}
    assert got == {0: (0.67, 0.33, 0.5), 1: (1.0, 1.0, 1.0), 2: (1.0, 0.0, 0.5), 3: (1.0, 1.0, 0.0)}


def test_gold_by_passage(spark):
    questions = spark.createDataFrame([(0, "one two three four five six seven eight nine"), (1, "too short")], "qid long, question string")
    texts = spark.createDataFrame([("b", "x", "zero One two, three four five six seven eight"), ("b", "y", "one two three four five six seven ate")], "base string, rel string, text string")
    assert [tuple(r) for r in analytics.gold_by_passage(questions, texts).collect()] == [(0, "b", "x")]


def test_every_note_is_one_of_three(spark):
    paths = ["README.md", "a/readme.md", "inbox/x.md", "records/x.md", "tools/calculation-log/x.md", "knowledge/x.md"]
    df = spark.createDataFrame([(p,) for p in paths], "rel string").select("rel", quality.classify(F.col("rel"), F.col("rel") != "knowledge/x.md").alias("c"))
    assert {r.rel: r.c for r in df.collect()} == {p: "exempt" for p in paths[:5]} | {"knowledge/x.md": "unreachable"}


def test_facets(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "base string, kind string")
    assert quality.list_notes(df, base="a", kind=None).count() == 1
    with pytest.raises(ValueError):
        quality.list_notes(df, nope=1)


def test_references(spark):
    refs = spark.createDataFrame([("a",), ("b",), (None,)], "r string")
    assert {r[0] for r in quality.broken(refs, spark.createDataFrame([("a",)], "t string"), "r", "t").collect()} == {"b", None}
    records = spark.createDataFrame([("k1", None), ("k2", "k1"), ("k3", "k1")], "key string, replaces string")
    cited = spark.createDataFrame([("k1",), ("k1",), ("k2",)], "key string")
    assert [tuple(r) for r in quality.superseded(cited, records).collect()] == [("k1", "k2", 2)]
    lines = spark.createDataFrame([("b", 1, "k", "old"), ("b", 2, "k", "new"), ("b", 3, "j", "same")], "base string, pos int, key string, written string")
    rendered = spark.createDataFrame([("b", "k", "old"), ("b", "j", "same")], "base string, key string, rendered string")
    assert [tuple(r) for r in quality.bibliography_drift(lines, rendered).collect()] == [("b", "k", "new", "old")]


def test_link_graph(spark):
    notes = spark.createDataFrame([("b", "x", "[[y]] [[y]] [[z]]"), ("b", "y", "[[z]] `[[x]]`")], "base string, stem string, text string")
    got = {r.node: (r.cites, r.cited_by) for r in quality.degrees(quality.note_links(notes)).collect()}
    assert got == {"x": (2, 0), "y": (1, 1), "z": (0, 2)}


def test_sync(spark, tmp_path):
    files = lambda rows: index.hashed(spark.createDataFrame(rows, "base string, rel string, text string"))
    changed = index.changes(files([("b", "x", "1"), ("b", "y", "1"), ("b", "z", "1")]), files([("b", "x", "1"), ("b", "y", "2"), ("b", "n", "1")]))
    assert tuple(index.report(changed).first()) == ("b", 2, 1, 1)
    old = spark.createDataFrame([("b", r, "old") for r in "xyz"], "base string, rel string, c string")
    new = spark.createDataFrame([("b", r, "new") for r in "xyn"], "base string, rel string, c string")
    assert {(r.rel, r.c) for r in index.refreshed(old, changed, new).collect()} == {("x", "old"), ("y", "new"), ("n", "new")}
    index.write(old, str(tmp_path / "i"))
    index.write(spark.createDataFrame([("c", "q", "new")], "base string, rel string, c string"), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 4


def test_best_owners(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.5], 2), (3, None, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [(r.qid, r.owner, round(r.score, 6)) for r in dense.best_owners(df.where("vec_id = 0"), df).orderBy("rank").collect()]
    assert got == [(0, 1, 0.9), (0, 2, 0.5)]


def test_best_owners_of_several_passes(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERIES", 7)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 5) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r.qid, r.owner): round(r.score, 4) for r in dense.best_owners(df.where("vec_id % 3 = 0"), df).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    right = {(q, o): round(max(dot(x, y) for v, y, w in rows if w == o and v != q), 4) for q, x, _ in rows if q % 3 == 0 for o in range(5)}
    assert got.keys() == right.keys() and all(abs(got[k] - right[k]) < 1e-3 for k in right)
