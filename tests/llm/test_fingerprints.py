from __future__ import annotations

import hashlib
import random
import unicodedata

from lexifold.llm import fingerprints

from .fixtures import ROWS, edge, empty, plain


def form(t):
    return " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", t or "").casefold()).split())


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for at, (i, t) in enumerate(rows):
        nxt = rows[(at + 1) % len(rows)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(form(edited) == form(t)), float(form(nxt) == form(t))))
    return sorted(out, key=repr)


COLUMNS = "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"


def test_edge_rows(spark):
    out = fingerprints.document_fingerprints(edge(spark))
    assert plain(out, *COLUMNS) == brute([(i, t) for i, t, *_ in ROWS])


def test_many_ranges(spark):
    rng = random.Random(4)
    rows = [(i * rng.randrange(1, 9), "".join(rng.choice("ab é") for _ in range(rng.randrange(0, 12)))) for i in range(400)]
    rows = list({i: (i, t) for i, t in rows}.values())
    assert plain(fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")), *COLUMNS) == brute(rows)


def test_single_and_empty(spark):
    one = spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")
    assert plain(fingerprints.document_fingerprints(one), *COLUMNS) == brute([(3, "abcdefgh")])
    assert fingerprints.document_fingerprints(empty(spark)).collect() == []


def test_groups_by_canonical_text(spark):
    rows = [(1, "Été  ICI"), (2, "été ici "), (3, "ete ici"), (4, "x"), (5, "ÉTÉ ici")]
    groups = fingerprints.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert plain(groups, "doc_id", "group_id") == [(1, 1), (2, 1), (5, 1)]


def test_bytes_decide_inside_a_bucket(spark, monkeypatch):
    """Texts that differ are parted even when all digests collide; the digest is patched where tasks find it."""
    rows = [(1, "same"), (2, "same"), (3, "other"), (4, "other"), (5, "third")]
    found = spark.createDataFrame([(i, "0" * 32) for i, _ in rows], "doc_id long, digest string")
    monkeypatch.setattr(fingerprints, "digests", lambda docs: found)
    monkeypatch.setattr(fingerprints, "digest", lambda form: "0" * 32)
    source = spark.createDataFrame(rows, "doc_id long, text string")
    forms = [(fingerprints.canonical(t), fingerprints.digest(t)) for _, t in rows]
    assert len(set(forms)) == 3 and len({d for _, d in forms}) == 1
    kept = fingerprints.exact_groups(source)
    assert kept.columns == ["doc_id", "digest", "group_id"]
