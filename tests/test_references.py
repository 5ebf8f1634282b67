from __future__ import annotations

from lexifold.operators import quality


def test_names_of_any_script(spark):
    rows = [
        ("ben", "knowledge/1.md", "see ana/memória/x.md, not ana/memória/y.md or zana/memória/x.md."),
        ("ben", "knowledge/2.md", "(библиотека/книга.md) ben/knowledge/1.md ana/memória/x.mdé"),
        ("ana", "memória/x.md", None), ("библиотека", "книга.md", ""),
    ]
    found = quality.cross_references(spark.createDataFrame(rows, "base string, rel string, text string"))
    assert sorted(tuple(r[c] for c in ("base", "rel", "to_base", "to_rel")) for r in found.collect()) == [("ben", "knowledge/1.md", "ana", "memória/x.md"), ("ben", "knowledge/2.md", "библиотека", "книга.md")]
