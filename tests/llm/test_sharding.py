from __future__ import annotations

import zlib

import pytest

from lexifold.llm import sharding

from .fixtures import ROWS, edge, empty


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 100, 1_000, 4_097])
def test_permutation_is_a_bijection(n):
    p = sharding.Permutation(n, seed=3)
    assert sorted(map(p, range(n))) == list(range(n))


def test_expression_is_the_function(spark):
    p = sharding.Permutation(1_003, seed=5)
    rows = p.apply(spark.range(1_003), "id", "p").collect()
    assert all(r.p == p(r.id) for r in rows)


def test_edge_rows(spark):
    rows = sharding.shard_documents(edge(spark), shards=4).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS if i is not None)
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1 and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_reproducible(spark):
    one = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in sharding.shard_documents(edge(spark).where("doc_id <> 8")).collect()}
    two = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in sharding.shard_documents(edge(spark).where("doc_id <> 8").repartition(7)).collect()}
    assert one == two


def test_empty_and_bad_arguments(spark):
    assert sharding.shard_documents(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_rows(edge(spark), ["doc_id"], 0)
