from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from lexifold.llm import collocations


def counted(rows) -> dict[str, Counter]:
    out: dict[str, Counter] = {}
    for lang, text in rows:
        f = out.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            f.update(tuple(words[i : i + k]) for k in range(6) for i in range(len(words) - k + 1) if k or i < len(words))
    return out


def brute(rows, least: int, top: int = 2_000) -> list[tuple]:
    out = []
    for lang, f in counted(rows).items():
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        hidden = {p[i : i + k] for p, a in own.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= own[p[i : i + k]]}
        found = []
        for p, a in own.items():
            if p not in hidden:
                score, k = min((1000 * a * f[()] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, f[()], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def some_rows(n: int = 300) -> list[tuple]:
    rng = random.Random(1)
    words = ["the", "of", "Straße", "été", "naïve", "\x01odd", "a", "b", "c", "😀", "x-y", "ÀB"]
    rows = []
    for i in range(n):
        text = "".join(rng.choices(words, range(len(words), 0, -1))[0] + rng.choices([" ", "  ", "\t", ". ", "\n", ","], [12, 1, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 60)))
        rows.append(([None, "en", "en", "en", "und", "fr"][i % 6], text + ("one hot phrase of many words " * (i % 7))))
    return [*rows, rows[3], rows[3], ("en", None), (None, None), ("zz", ""), ("yy", "...,,,")]


@pytest.mark.parametrize(("shard", "each"), [(12_000_000, 2_000_000), (300, 40), (60, 5)])
def test_brute_force(spark, monkeypatch, shard, each):
    """Small shards and ranges part the subtrees of phrases and the texts themselves."""
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "RANGE", each)
    rows = some_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert sorted(map(tuple, collocations.collocations(docs, least=4).collect())) == brute(rows, 4)
    assert sorted(map(tuple, collocations.collocations(docs, least=9, top=5).collect())) == brute(rows, 9, 5)


def test_counts_of_all_lengths(spark):
    rows = some_rows(60)
    got = {(r.lang, tuple(r.phrase.split(" ")) if r.phrase else ()): r.f for r in collocations.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), 2).collect()}
    want = {(lang, p): a for lang, f in counted(rows).items() for p, a in f.items() if a >= 2 or not p}
    assert got == want


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([("en", "a b. a b", 1, "x", 2)], "lang string, text string, f long, phrase string, words int")
    assert [(r.phrase, r.a, r.score) for r in collocations.collocations(docs, least=2).collect()] == [("a b", 2, 2000)]
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_exact_beyond_64_bits(spark, monkeypatch):
    """Counts of a corpus of 10^13 words: the products are far beyond a long, and one more would change the quotient."""
    big = [("en", "", 0, 10**13), ("en", "a", 1, 3 * 10**9 + 1), ("en", "b", 1, 7 * 10**9 + 3), ("en", "a b", 2, 2_999_999_999)]
    monkeypatch.setattr(collocations, "phrase_counts", lambda docs, least: spark.createDataFrame(big, "lang string, phrase string, words int, f long"))
    row = collocations.collocations(spark.createDataFrame([], "lang string, text string")).first()
    assert row.score == 1000 * 2_999_999_999 * 10**13 // ((3 * 10**9 + 1) * (7 * 10**9 + 3))


def _random(rng, n: int) -> collocations.Transducer:
    texts = [" ".join(rng.choice(["a", "b", "cc", "d"]) for _ in range(rng.randint(0, 7))).encode() for _ in range(n)]
    return collocations.shard(pa.array(texts, pa.large_binary()))


def _paths(t: collocations.Transducer) -> dict:
    return {tuple(t.words[int(w) - 1].as_py() for w in row if w): int(f) for row, f in zip(t.windows, t.weights, strict=True)}


def test_transducers():
    rng = random.Random(0)
    one, two = _random(rng, 30), _random(rng, 20)
    again = collocations.Transducer.from_bytes(one.to_bytes())
    assert _paths(again) == _paths(one) and again.words.to_pylist() == one.words.to_pylist()
    assert _paths(collocations.Transducer.union([one, two])) == dict(Counter(_paths(one)) + Counter(_paths(two)))
    parts = [one.part(a, b) for a, b in ((0, 5), (5, 5), (5, len(one.windows)))]
    assert dict(Counter(_paths(parts[0])) + Counter(_paths(parts[2]))) == _paths(one) and not len(parts[1].windows)
    other = _paths(two) | {(b"never", b"seen"): 1}
    asked, place = collocations._paths([list(p) for p in other])
    assert one.compose(asked)[place].tolist() == [_paths(one).get(p, 0) for p in other]


def test_a_long_text_is_cut_at_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 10)
    text = b"aa bb cc. dd ee! a_long_piece_without_any_end ff, gg"
    parts = [p[0].as_py() for p in collocations._bounded(pa.array([b"x", b"", text, b"y z"], pa.large_binary()))]
    assert parts[0] == b"x" and parts[-1] == b"y z" and b"".join(parts[1:-1]) == text
    assert all(p[-1:] in b".!," for p in parts[1:-2]) and max(map(len, parts)) == len(b" a_long_piece_without_any_end ff,")
