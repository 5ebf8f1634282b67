from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexifold.operators import ask, store
from lexifold.streaming import library

NOTES = "base string, rel string, stem string, text string, private boolean"


def note(i: int, text: str, base: str = "b", private: bool = False) -> tuple:
    return base, f"knowledge/{i}.md", str(i), text, private


FIRST = [note(i, f"# Title {i}\nalpha beta\n\nwords of note{i} gamma gamma gamma delta") for i in range(8)] + [note(9, "# Other\nbeta only here", "c", True)]
QUESTIONS = [(1, "gamma note3 title"), (2, "beta only"), (3, "zeta"), (4, "omega")]


def frame(spark, rows):
    return spark.createDataFrame(rows, NOTES)


def answers(index, spark):
    return {tuple(sorted(r.asDict().items(), key=str)) for r in index.answers(spark.createDataFrame(QUESTIONS, "qid long, question string")).collect()}


def direct(spark, rows):
    """The same answers from the notes themselves, without an index."""
    notes = frame(spark, rows)
    questions = spark.createDataFrame(QUESTIONS, "qid long, question string")
    parts = ask.ask(questions, store.note_entries(notes), store.note_chunks(notes))
    return {tuple(sorted(r.asDict().items(), key=str)) for r in ask.answers(questions, parts).collect()}


def report(df):
    return {r.base: (r.reindexed, r.unchanged, r.removed) for r in df.collect()}


def rows(index, name):
    return sorted(map(str, index.table(name).collect()))


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "index")


def test_no_index(spark, root):
    assert store.open_index(spark, root) is None


def test_sync_change_remove_and_replay(spark, root):
    assert report(store.sync(frame(spark, FIRST), root, 0)) == {"b": (8, 0, 0), "c": (1, 0, 0)}
    first = store.open_index(spark, root)
    assert answers(first, spark) == direct(spark, FIRST)
    second = [note(0, "# Title 0\nzeta zeta omega"), *FIRST[1:7], FIRST[8], note(10, "omega omega", "c")]
    assert report(store.sync(frame(spark, second), root, 1)) == {"b": (1, 6, 1), "c": (1, 1, 0)}
    live = store.open_index(spark, root)
    assert (live.version, live.segments) == (1, [0, 1])
    assert answers(live, spark) == direct(spark, second) != answers(first, spark)
    # A replayed number changes nothing, also with other rows.
    before = {t: rows(live, t) for t in store.TABLES}
    assert report(store.sync(frame(spark, FIRST), root, 1)) == {} == report(store.sync(frame(spark, FIRST[:1]), root, 0))
    again = store.open_index(spark, root)
    assert {t: rows(again, t) for t in store.TABLES} == before
    # An older number than the live one cannot be written any more.
    with pytest.raises(ValueError, match="older"):
        store.sync(frame(spark, FIRST), root, -5)
    # Who has the first version open still reads it.
    assert answers(first, spark) == direct(spark, FIRST)
    # What was removed may come back.
    assert report(store.sync(frame(spark, [*second, FIRST[7]]), root, 2))["b"] == (1, 7, 0)
    assert answers(store.open_index(spark, root), spark) == direct(spark, [*second, FIRST[7]])


def test_a_half_written_segment_is_written_again(spark, root):
    store.sync(frame(spark, FIRST), root, 0)
    frame(spark, FIRST[:1]).write.parquet(f"{root}/postings/segment=1")  # a batch that died before it published
    store.sync(frame(spark, FIRST[:5]), root, 1)
    assert answers(store.open_index(spark, root), spark) == direct(spark, FIRST[:5])


def test_compaction_keeps_every_row(spark, root, monkeypatch):
    monkeypatch.setattr(store, "MANY_SEGMENTS", 2)
    states = [FIRST[:4], FIRST[:6], FIRST[2:]]
    for number, state in enumerate(states):
        store.sync(frame(spark, state), root, number)
    live = store.open_index(spark, root)
    assert live.version == 2 and len(live.segments) == 1
    assert answers(live, spark) == direct(spark, FIRST[2:])
    assert live.table("files").count() == live.files().count() == 7
    store.sync(frame(spark, FIRST), root, 3)
    assert answers(store.open_index(spark, root), spark) == direct(spark, FIRST)
    assert report(store.sync(frame(spark, FIRST), root, 2 + 1)) == {}


def test_another_schema_is_built_anew(spark, root, monkeypatch):
    store.sync(frame(spark, FIRST), root, 0)
    monkeypatch.setattr(store, "SCHEMA_VERSION", 99)
    assert store.open_index(spark, root) is None
    assert report(store.sync(frame(spark, FIRST), root, 1)) == {"b": (8, 0, 0), "c": (1, 0, 0)}
    assert store.open_index(spark, root).segments == [1]


def test_repeated_paths_nulls_and_empty_tables(spark, root):
    store.sync(frame(spark, []), root, 0)
    assert store.open_index(spark, root).files().count() == 0 and direct(spark, []) == answers(store.open_index(spark, root), spark)
    twice = [note(1, "one text"), note(1, "one text"), note(1, "another text"), note(2, None)]
    store.sync(frame(spark, twice), root, 1)
    live = store.open_index(spark, root)
    assert live.files().count() == 2 and live.table("chunks").count() == 1


def test_streams_keep_and_ask(spark, root, tmp_path):
    inbox, asked = str(tmp_path / "in"), str(tmp_path / "asked")
    state = iter((FIRST[:3], FIRST[3:6], [note(0, "# Changed\nomega omega"), *FIRST[6:]]))
    for batch, number in zip(state, range(3), strict=True):
        frame(spark, batch).coalesce(1).write.mode("append").parquet(inbox)
        library.keep(spark.readStream.schema(NOTES).option("maxFilesPerTrigger", 1).parquet(inbox), root, f"{root}/state")
        spark.createDataFrame([(number, "omega title")], "qid long, question string").coalesce(1).write.mode("append").parquet(asked)
        library.answer(spark.readStream.schema("qid long, question string").parquet(asked), root, f"{root}/asked", f"{root}/answers")
    live = store.open_index(spark, root)
    whole = [note(0, "# Changed\nomega omega"), *FIRST[1:]]
    assert answers(live, spark) == direct(spark, whole)
    got = {r.qid: r.version for r in spark.read.parquet(f"{root}/answers").collect()}
    assert len(set(got.values())) == 3 and got[2] == live.version  # each question saw the version of its time
    # The last batch once more, as after a failure: nothing changes.
    before = {t: rows(live, t) for t in store.TABLES}
    store.upsert(root)(frame(spark, FIRST[:2]), live.version)
    assert {t: rows(store.open_index(spark, root), t) for t in store.TABLES} == before
    assert live.table("postings").where(F.col("term") == "omega").count() == 1
