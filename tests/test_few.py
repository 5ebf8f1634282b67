"""The same rows, whether what is small is broadcast or, being too large for that, shuffled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexifold.functions.text import counted
from lexifold.operators import analytics, fulltext, store
from lexifold.sources import stages

from .test_store import FIRST, answers, direct, frame, note, report

CHUNKS = [("b", "r1", 1, "one two", "one two two three"), ("b", "r2", 2, "", "two four"), ("c", "r3", 3, "five", ""), ("b", "r4", 4, "six", "one one one"), (None, "r5", 5, "one", "two")]
SCHEMA = "base string, rel string, chunk_id long, heading string, text string"


def rows(df):
    return sorted(map(str, df.collect()))


def found(spark, chunks):
    asked = spark.createDataFrame([(1, ["one", "two"]), (2, ["five", "none"])], "qid int, terms array<string>")
    return rows(fulltext.search(asked, spark.createDataFrame(chunks, SCHEMA)))


def test_counted(spark):
    got = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],)], "t array<string>").select(counted(F.col("t")).alias("c")).collect()
    assert [[tuple(x) for x in r.c] for r in got] == [[("a", 1), ("b", 2)], [], [("x", 1)]]


def test_postings_stay_where_they_are(spark):
    posts = fulltext.postings(spark.createDataFrame(CHUNKS, SCHEMA), unique=True)
    assert {(r.chunk_id, r.term): r.tf for r in posts.collect() if r.chunk_id == 1} == {(1, "one"): 3.0, (1, "two"): 4.0, (1, "three"): 1.0}
    assert "Exchange" not in posts._jdf.queryExecution().toString()


def test_repeated_chunks_count_as_one(spark):
    posts = fulltext.postings(spark.createDataFrame([CHUNKS[1], *CHUNKS], SCHEMA))
    assert {r.tf for r in posts.where("chunk_id = 2 and term = 'four'").collect()} == {2.0}
    df = fulltext.document_frequency(posts).where("base = 'b' and term = 'two'").collect()
    assert [r.df for r in df] == [2]


@pytest.mark.parametrize("chunks", [CHUNKS, [CHUNKS[0], *CHUNKS]])
def test_search(spark, monkeypatch, chunks):
    right = found(spark, chunks)
    assert len(right) == 4
    monkeypatch.setattr(stages, "FEW", 0)
    assert found(spark, chunks) == right


def test_holders(spark, monkeypatch):
    texts = spark.createDataFrame([("b", "r1", "A one two three"), ("b", "r2", "two one"), (None, "r3", "one two"), ("c", "r4", None)], "base string, rel string, text string")
    sought = spark.createDataFrame([(1, ["one", "two"]), (2, ["nowhere"]), (3, []), (4, ["two", "three"])], "pattern int, tokens array<string>")
    right = [(1, None, "r3"), (1, "b", "r1"), (4, "b", "r1")]
    for most in (stages.FEW, 0):
        monkeypatch.setattr(stages, "FEW", most)
        assert sorted(map(tuple, analytics.holders(sought, texts).collect()), key=str) == sorted(right, key=str)


def test_sync(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(stages, "FEW", 0)
    root = str(tmp_path / "index")
    twice = [*FIRST, FIRST[0], note(1, "older or newer text")]  # one path with two texts, one row twice
    assert report(store.sync(frame(spark, twice), root, 0)) == {"b": (8, 0, 0), "c": (1, 0, 0)}  # most are fresh
    live = store.open_index(spark, root)
    assert live.files().count() == 9 and live.table("entries").count() == 9
    second = [note(0, "# Title 0\nzeta zeta omega"), *FIRST[1:]]
    assert report(store.sync(frame(spark, second), root, 1))["b"][0] in (1, 2)  # few are
    assert answers(store.open_index(spark, root), spark) == direct(spark, second)
