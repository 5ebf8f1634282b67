from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexifold.llm import simhash
from lexifold.llm.common import checkpointed
from lexifold.llm.components import components

from .fixtures import ROWS, edge, empty, plain


def brute_fingerprint(text):
    blank = set(" \t\n\x0b\x0c\r")
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = [w for w in "".join(" " if c in blank else c for c in low).split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_fingerprints_of_edge_texts():
    for _, t, *_ in ROWS:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@given(st.sets(st.integers(0, 63), max_size=2), st.integers(0, 2**64 - 1))
@settings(max_examples=300, deadline=None)
def test_masks_cover_every_pair_within_two(bits, value):
    other = value
    for b in bits:
        other ^= 1 << b
    assert any(value & m == other & m for m in (m % 2**64 for m in simhash.covering_masks(2)))


@given(st.sets(st.integers(0, 63), max_size=4))
@settings(max_examples=200, deadline=None)
def test_masks_cover_every_pair_within_four(bits):
    changed = sum(1 << b for b in bits)
    masks = [m % 2**64 for m in simhash.covering_masks(4)]
    assert len(set(masks)) == 31 and any(changed & m == 0 for m in masks)


def test_links_within_two_join_what_brute_force_joins(spark):
    rng = random.Random(7)
    values = set()
    for _ in range(30):
        v = rng.getrandbits(64)
        for _ in range(12):
            values.add(v)
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
    signed = sorted(v - 2**64 if v >> 63 else v for v in values)
    edges = simhash.links_within_two(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = {v: v for v in signed} | {r.node: r.root for r in components(edges).collect()}
    assert got == brute_components(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in edges.collect())


def test_edge_rows(spark):
    out = plain(simhash.query_components(edge(spark)), "doc_id", "fingerprint", "component_id")
    fps = {f"{brute_fingerprint(t):016x}" for _, t, *_ in ROWS}
    roots = brute_components(sorted(fps), lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count() <= 2)
    least = defaultdict(list)
    for i, t, *_ in ROWS:
        if i is not None:
            least[roots[f"{brute_fingerprint(t):016x}"]].append(i)
    expected = [(i, fp := f"{brute_fingerprint(t):016x}", min(least[roots[fp]], default=None)) for i, t, *_ in ROWS]
    assert out == sorted(expected, key=repr)


def test_empty(spark):
    assert simhash.query_components(empty(spark)).collect() == []
    assert simhash.near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr("lexifold.llm.components.FEW", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_rounds_over_few_edges_shuffle_and_broadcast_nothing(spark, monkeypatch):
    """What the driver holds grows with its queries' exchanges: each is a job, a thread and a broadcast of its own."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpointed(df)

    monkeypatch.setattr("lexifold.llm.components.checkpointed", kept)
    got = {r.node: r.root for r in components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)}
    assert len(plans) > 2 and not any("Exchange" in p for p in plans[1:])


def test_near_duplicates_are_what_brute_force_links(spark):
    """Links are pairs of similarity 0.8 or more."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(25):
        words = [word() for _ in range(150)]
        for c in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(min(c, 2)):
                copy[rng.randrange(150)] = word()
            texts.append(" ".join(copy))
    sets = [set(simhash.shingles(simhash.words_of(t), 5)) for t in texts]

    def linked(a, b):
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    right = brute_components(range(len(texts)), linked)
    assert got == right and len(set(right.values())) < 0.6 * len(texts)


def test_prints_of_sets_of_words(monkeypatch):
    monkeypatch.setattr(simhash, "CACHE", 5)
    prints = simhash._WordPrints()
    for text in (b"a b c a", b"a b c d e f g h i j", b"c d", b"", b"x y z a b"):
        hashes = [xxhash.xxh64_intdigest(w, simhash.SEED) for w in set(text.split())]
        assert prints.of(text.split()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert len(prints.known) <= 5


def test_stage_keeps_clean_and_odd_rows(spark):
    kept = simhash.one_of_each_group(edge(spark))
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    # 2, 3 and 4 have no words, 8 is a copy of 7; the row without an id stays.
    assert ids == sorted([1, 2, 5, 6, 7, None, 10, 11, 12, 13, 9_000_000_000], key=repr) and kept.columns == edge(spark).columns


def words_like(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def exact_groups(texts):
    sets = [set(simhash.shingles(simhash.words_of(t), 5)) for t in texts]
    return sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])


def groups_of(spark, texts, **options):
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options)
    return {r.doc_id: r.group_id for r in found.collect()}


def test_crowded_buckets_are_settled(spark, monkeypatch):
    """Texts of one frame share their prints' buckets; all near pairs are linked."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(11)
    frame, texts = words_like(rng, 120), []
    for _ in range(200):  # each pair near, the pairs apart from each other by their order only
        words = list(frame)
        rng.shuffle(words)
        copy = [*words[:60], *words_like(rng, 2), *words[62:]]
        texts += [" ".join(words), " ".join(copy)]
    _, near = exact_groups(texts)
    right = brute_components(range(len(texts)), near)
    assert groups_of(spark, texts) == right and len(set(right.values())) < 260


def test_stage_drops_all_copies_by_true_similarity(spark):
    """Appended, truncated, block-edited and short copies, whatever their prints; pairs under 0.8 stay."""
    rng = random.Random(5)
    texts = []
    for n in (5, 9, 24, 60, 150, 400):
        for part in (0.05, 0.1, 0.15, 0.2, 0.3):
            k = max(1, int(n * part))
            words, new = words_like(rng, n), words_like(rng, k)
            at = rng.randrange(n - k + 1)
            texts += [" ".join(t) for t in (words, [*words, *new], words[: n - k], [*words[:at], *new[: k // 2 + 1], *words[at + k // 2 + 1 :]])]
    sets, near = exact_groups(texts)
    right = brute_components(range(len(texts)), near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each_group(docs).collect()}
    assert kept == set(right.values()) and 40 < len(kept) < len(texts) - 40
