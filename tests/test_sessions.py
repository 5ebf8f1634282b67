from __future__ import annotations

import datetime

import pytest

from lexifold.operators import logs
from lexifold.streaming import sessions

EVENT = "session string, seq long, ts timestamp, kind string, agent string"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """Feeds micro-batches of (session, seq, minute, kind, agent); each call starts the stream again from its checkpoint."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(*batches, gap=3600):
        for batch in batches:
            rows = [(s, q, START + datetime.timedelta(minutes=m), k, a) for s, q, m, k, a in batch]
            spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = sessions.owned(events, "10 minutes", gap).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((tuple(r) for r in spark.read.schema(sessions.OWNED).parquet(str(tmp_path / "out")).collect()), key=lambda r: (r[0], r[1]))

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


END = [(None, 0, 10_000, "heartbeat", None)]


def test_batches_late_events_and_restarts(spark, stream):
    got = stream(
        [("a", 1, 0, "refused", None), ("a", 2, 5, "routed", "x"), ("b", 3, 6, "refused", None)],
        [("a", 4, 8, "refused", None), ("a", 5, 7, "routed", "y")],  # out of order, yet before the watermark
        [("a", 6, 30, "routed", "y"), ("c", 7, 31, "routed", "z")],
        [("a", 8, 2, "refused", None), ("a", 9, 3, "routed", "w")],  # what came after was decided before
        [("a", 10, 32, "refused", None)],
        END,
        [("a", 11, 33, "conclusion", None)],  # its session was closed long ago
        [(None, 0, 30_000, "heartbeat", None)],
    )
    assert got == [
        ("a", 1, "refused", None, "x", None, False),
        ("a", 2, "routed", "x", "x", True, False),
        ("a", 4, "refused", None, "y", None, False),
        ("a", 5, "routed", "y", "x", True, False),
        ("a", 6, "routed", "y", "y", False, False),
        ("a", 8, "refused", None, "y", None, True),
        ("a", 9, "routed", "w", "y", True, True),
        ("a", 10, "refused", None, "y", None, False),
        ("a", 11, "conclusion", None, None, None, False),
        ("b", 3, "refused", None, None, None, False),
        ("c", 7, "routed", "z", "z", True, False),
    ]


def test_a_session_ends_after_its_rest(stream):
    got = stream([("a", 1, 0, "routed", "x"), ("a", 2, 61, "refused", None), ("a", 3, 62, "routed", "y"), ("a", 4, 200, "refused", None)], END)
    assert [r[4] for r in got] == ["x", "y", "y", None]


def test_one_batch_is_the_batch_fold(spark, stream):
    rows = [(f"s{i % 4}", i, (i * 37) % 500, "routed" if i % 5 == 1 else "refused", f"agent{i % 3}" if i % 5 == 1 else None) for i in range(80)]
    got = stream(rows, END, gap=10**9)
    events = spark.createDataFrame([(s, q, START + datetime.timedelta(minutes=m), k, a) for s, q, m, k, a in rows], EVENT)
    assert {(s, q): o for s, q, _, _, o, *_ in got} == {(r.session, r.seq): r.owner for r in logs.owners(events).collect()}
    assert {(s, q): x for s, q, k, _, _, x, _ in got if k == "routed"} == {(r.session, r.seq): r.switched for r in logs.sticky(events).collect()}
    assert not any(late for *_, late in got)
