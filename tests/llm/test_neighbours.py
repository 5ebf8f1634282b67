from __future__ import annotations

import numpy as np
import pytest

from lexifold.llm import neighbours


def exact(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            near = sorted(((-float(x @ y), i) for i, y in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def found(spark, rows, k, every):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    out = {}
    for r in sorted(neighbours.nearest(df, k, every).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("scale", [1.0, 3.0])
def test_recall(spark, scale):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2_500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rng.uniform(1, scale, (2_500, 1))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    right, got = exact(rows, 10, 50), found(spark, rows, 10, 50)
    assert right.keys() == got.keys()
    assert np.mean([len({i for i, _ in right[q]} & {i for i, _ in got[q]}) / 10 for q in right]) >= 0.9
    vectors = dict(rows)
    assert all(abs(s - np.dot(vectors[q], vectors[i])) < 1e-9 for q in got for i, s in got[q])


def test_bad_vectors_ties_and_copies(spark):
    unit = [1.0] + [0.0] * 7
    rows = [(0, unit), (20, unit), (1, None), (2, [0.0] * 8), (3, [float("nan")] + [1.0] * 7), (4, [float("inf")] + [0.0] * 7), (5, [None] + [1.0] * 7), (None, unit), (6, [1.0, 2.0])]
    rows += [(100 + i, unit) for i in range(60)] + [(40, [0.5] * 8), (41, [-0.5] * 8)]
    right, got = exact(rows, 20, 20), found(spark, rows, 20, 20)
    assert {q: [i for i, _ in v] for q, v in right.items()} == {q: [i for i, _ in v] for q, v in got.items()}


def test_few_and_none(spark):
    assert found(spark, [], 20, 20) == {}
    assert found(spark, [(0, [1.0, 2.0])], 20, 20) == {}
    assert [i for i, _ in found(spark, [(0, [1.0, 2.0]), (7, [3.0, 1.0])], 20, 20)[0]] == [7]


def _vectors(n: int, clusters: int = 0, dims: int = 64, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    if clusters:
        x = rng.normal(size=(clusters, dims))[rng.integers(0, clusters, n)] + 0.15 * x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _recall(index: neighbours.Index, x: np.ndarray, k: int, queries: int = 60) -> tuple[float, float]:
    """Recall of an index over a whole table, and the share of it that is looked at."""
    q = x[:queries]
    near = q @ x.T
    near[np.arange(queries), np.arange(queries)] = -np.inf
    truth = np.argsort(-near, axis=1)[:, :k]
    hit = np.zeros(near.shape, bool)
    for t in range(len(index.signs)):
        codes, probed = index.buckets(index.lift(x, False), t), index.probed(index.lift(q, True), t, index.probes)
        asked = np.zeros((queries, index.most_probes), bool)
        np.put_along_axis(asked, probed, True, 1)
        hit |= asked[:, codes]
    return float(np.take_along_axis(hit, truth, 1).mean()), float(hit.mean())


@pytest.mark.parametrize("clusters", [0, 200])
def test_the_fit_holds_for_tables_of_any_size(clusters):
    """What is fitted on the sample is all there is: more rows, as many as fit a test, keep the recall."""
    x = _vectors(40_000, clusters)
    index = neighbours.fit(x[20_000 : 20_000 + neighbours.SAMPLE], None, 20)
    for n in (4_000, 12_000, 40_000):
        recall, looked = _recall(index, x[:n], 20)
        assert recall >= 0.9, (n, recall)
        assert looked < (0.2 if clusters else 0.8)


def test_the_target_can_always_be_met():
    """All buckets together hold everything, whatever the number of hashes."""
    x = _vectors(600)
    for hashes in (1, 2):
        index = neighbours.Index(np.random.default_rng(0).choice([-1.0, 1.0], (8, hashes, 3, 64)), None, 128**hashes)
        assert index.most_probes == 128**hashes and sorted(index.probed(x[:1], 0, index.probes)[0].tolist()) == list(range(128**hashes))
        assert _recall(index, x, 20, 5) == (1.0, 1.0)


def test_recall_on_64_dimensions(spark):
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(_vectors(2_000))]
    x = np.array([v for _, v in rows])
    got = found(spark, rows, 20, 20)
    near = x[::20] @ x.T
    near[np.arange(100), np.arange(0, 2_000, 20)] = -np.inf
    truth = np.argsort(-near, axis=1)[:, :20]
    shares = [len({i for i, _ in got[q * 20]} & set(truth[q].tolist())) / 20 for q in range(100)]
    assert np.mean(shares) >= 0.9
    assert all(abs(s - x[q] @ x[i]) < 1e-12 for q in got for i, s in got[q])


def test_two_hashes_in_a_key(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "WORTH", np.inf)
    x = _vectors(1_500, 40, 8, 3)
    assert neighbours.fit(x, None, 5).signs.shape[1] == 2
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    right, got = exact(rows, 5, 60), found(spark, rows, 5, 60)
    assert np.mean([len({i for i, _ in right[q]} & {i for i, _ in got[q]}) / 5 for q in right]) >= 0.9
