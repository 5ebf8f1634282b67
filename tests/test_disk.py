"""What queries over many questions and texts leave on disk: bytes shuffled and kept, as a multiple of the documents' own."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

import __spark_entry__
from lexifold.sources.stages import ensure_folder

DATA = Path("/root/testdata/sf0.01")
#: Of 1.4 MB of documents, where what does not grow with them still counts for much.
MOST = {
    "rrf_fuse": 3,
    "evidence_recall": 4,
    "near_misses": 3,
    "score_separation": 4,
    "fused_agents": 3,
    "snippets": 6,
    "evidence_taxonomy": 5,
    "index_postings": 8,
    "index_sync": 8,
    "index_ask": 10,
    "stream_index_upsert": 8,
    "stream_ask": 12,
}


def size(path: str) -> int:
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(path.removeprefix("file:")) for f in files)


def taken(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite() + size(ensure_folder(spark))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The tables with documents in several files, as large ones are: nothing is dealt out anew for the cores."""
    folder = str(tmp_path_factory.mktemp("tables"))
    for p in DATA.glob("*.parquet"):
        spark.read.parquet(str(p)).repartition(8 if p.stem == "documents" else 1).write.parquet(f"{folder}/{p.name}")
    return folder


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", MOST)
def test_disk(spark, tables, name):
    before = taken(spark)
    assert __spark_entry__.queries()[name](spark, tables).collect()
    times = (taken(spark) - before) / size(f"{tables}/documents.parquet")
    print(f"{name}: {times:.2f} x the documents")
    assert times < MOST[name]
