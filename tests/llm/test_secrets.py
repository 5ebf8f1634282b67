from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexifold.llm import secrets

PLAIN = [
    ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]


def brute(text: str | None) -> list[tuple]:
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, pattern, group, least) in enumerate(PLAIN) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(found)


TEXTS = [
    None,
    "",
    "nothing here",
    "token: ab secret: token: abcdef12",  # the short match uses up the second keyword
    "😀 Password='abc123/+' token==abcd PASSWD = x_y_z.1",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIAAKIA",
    "deadbeef" * 4000 + "\n" + "0123456789abcdef" * 2,
    " ".join(["0123456789abcdef01234567"] * 700),
    "ſecret=abcdefg toKen=abcdefg secret=abcdefg",  # letters that only Unicode folds are no match
    "api_key = 'AKIA" + "Z" * 16 + "' apikey:0123456789abcdef0123456789abcdef",
]


def scanned(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, word int")
    return secrets.with_spans(docs, **more)


def test_brute_force(spark):
    rows = [(i if i % 4 else None, t, "own", 7) for i, t in enumerate(TEXTS)]
    rows += [(5, "another text under one id, password=hunter22", "own", 7), (1 << 50, "secret=far_away", "own", 7), (-9, "token=negative", "own", 7), (5, TEXTS[5], "own", 7)]
    got = scanned(spark, rows).where(F.col("word") == 7).collect()
    assert len(got) == len(rows)
    for row in got:
        assert [tuple(s) for s in row.spans if s["rank"] < 3] == brute(row.text), row.text
    assert sum(len(brute(t)) for _, t, *_ in rows) > 700


def test_added_rules(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "gZ" * 18 + " xoxb-1234567890-abc AIza" + "x" * 35 + " eyJhbGci.eyJzdWIi.sig-1"
    got = scanned(spark, [(1, text, None, 0)]).select(secrets.named(F.col("spans"))).first()[0]
    assert [s.split(":")[0] for s in got.split(",")] == ["pem", "github", "slack", "google", "jwt"]


def test_queries_of_trigrams():
    grams = lambda p: {"&".join(sorted(c)) for c in secrets.trigram_query(p)}
    assert grams("AKIA[A-Z0-9]+") == {"aki&kia"}
    assert grams("[0-9a-f]+") == {""}  # nothing is mandatory
    assert grams("(abcd|xyz)*q") == {""}
    assert grams("(abcd|xyz)+q") == {"abc&bcd", "xyz"}
    assert grams("ab(c|d)?ef") == {"abc&bce&cef", "abd&bde&def", "abe&bef"}
    assert grams("foo.*bar") == {"bar&foo"}
    assert grams("x{3}y") == {"xxx&xxy"}


def test_every_match_meets_its_query():
    for rule, texts in ((secrets.BASE[0], ["aPi_KeY:abcdef", "passwd=\"qwerty1"]), (secrets.MORE[1], ["ghr_" + "Z" * 36])):
        for text in texts:
            assert re.search(rule.pattern, text)
            assert any(all(g in text.lower() for g in clause) for clause in secrets.trigram_query(rule.pattern))


def test_postings_and_both_joins(spark, monkeypatch):
    rows = [(i, f"token=abcdef{i}" if i % 3 == 0 else "token only" if i % 3 == 1 else "none", None, 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, word int")
    lists = {r.word: r.bits & (1 << 64) - 1 for r in secrets.postings(docs, ["tok"]).collect()}
    assert {64 * w + b for w, bits in lists.items() for b in range(64) if bits >> b & 1} == {i for i in range(300) if i % 3 != 2}
    few = sorted((r.doc_id, len(r.spans)) for r in scanned(spark, rows).collect())
    monkeypatch.setattr(secrets, "FEW_WORDS", 0)
    assert few == sorted((r.doc_id, len(r.spans)) for r in scanned(spark, rows).collect()) == [(i, int(i % 3 == 0)) for i in range(300)]


def test_empty_table_and_no_index(spark):
    assert scanned(spark, []).collect() == []
    only = scanned(spark, [(1, "f" * 30, None, 0)], rules=secrets.BASE[2:]).first()
    assert [(s["start"], s["end"]) for s in only.spans] == [(0, 30)]


def test_native(spark):
    plan = secrets.query(spark.createDataFrame([(1, "token=abcdef")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
