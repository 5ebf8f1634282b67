from __future__ import annotations

import random

import corpus_pipeline

from .fixtures import SCHEMA

NAMES = ["language", "lines", "near_duplicates", "mixture", "encode"]


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["tion", "the", "ing", "er", "sh", "an"]) for _ in range(rng.randrange(1, 4)))
    shared = "one line that many of the documents have"
    rows = []
    for i in range(120):
        text = " ".join(word() for _ in range(80)) + ("\n" + shared if i % 4 == 0 else "")
        rows.append((i, text, "en", "a" if i % 5 else "b", len(text), "", "", "", ""))
    rows += [(200, rows[1][1], "en", "a", 0, "", "", "", ""), (201, "12 34", "en", "a", 0, "", "", "", ""), (202, None, None, None, None, "", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "encode":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    ids = lambda name: {r.doc_id for r in seen[name].collect()}
    assert ids("language") == set(range(120)) | {200}
    kept = [r for r in seen["lines"].collect() if shared in r.text]
    assert [r.doc_id for r in kept] == [116] and all(r.n_chars == len(r.text) for r in seen["lines"].collect())
    assert ids("near_duplicates") == set(range(120)) == ids("mixture") == ids("encode")
    assert seen["mixture"].count() == seen["encode"].count() >= 120


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
