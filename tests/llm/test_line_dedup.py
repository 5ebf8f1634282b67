from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexifold.llm import line_dedup

from .fixtures import ROWS, SHARED, edge, empty, plain

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(BLANKS).translate({i: i + 32 for i in range(65, 91)})
    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    held[key(line)].add(i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return plain(line_dedup.with_kept_text(df).withColumn("h", F.sha2("kept_text", 256)), "doc_id", "n_lines", "n_dropped", "h")


def test_edge_rows(spark):
    assert got(edge(spark)) == brute([(i, t) for i, t, *_ in ROWS])


def test_empty(spark):
    assert got(empty(spark)) == []


def test_shared_line_stays_in_the_largest_id_only(spark):
    kept = {r.doc_id: r.text for r in line_dedup.without_shared_lines(edge(spark)).collect()}
    assert [i for i, t in kept.items() if i and t and SHARED.lower() in t.lower()] == [6]


def test_columns_stay(spark):
    assert line_dedup.without_shared_lines(edge(spark)).columns == edge(spark).columns


@pytest.mark.parametrize("hot_lines", [1, 5, 1_000])
def test_hot_and_cold_paths_agree(spark, monkeypatch, hot_lines):
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot_lines)
    rows = [(i, "\n".join(f"line number {(i * k) % 7} with enough letters" for k in range(130))) for i in range(40)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_texts_under_one_id_lose_their_own_lines_only(spark):
    shared, own = "a line that many documents have", "PRECIOUS line that nobody else has here"
    rows = [(1, f"{shared}\nfirst"), (1, f"{own}\nsecond"), (1, f"x\n{shared}"), (1, f"{shared}\nfirst"), (2, shared), (3, f"{own[:5]}\n{shared}"), (3, f"third\n{shared}"), (None, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)
    kept = [r.text for r in line_dedup.without_shared_lines(docs).collect()]
    assert f"{own}\nsecond" in kept and kept.count("first") == 2 and "x" in kept
