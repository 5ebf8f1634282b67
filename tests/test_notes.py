from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexifold.functions import parsers, records, sections
from lexifold.functions.text import STOPWORDS
from lexifold.operators import keyword, logs, quality


def note(spark, *texts):
    return spark.createDataFrame([("b", f"{i}.md", t) for i, t in enumerate(texts)], "base string, rel string, text string")


def chunks(spark, text):
    return [(r.heading, r.text) for r in sections.chunks(note(spark, text)).orderBy("section", "seq").collect()]


@pytest.mark.parametrize(("text", "expected"), [
    ("# T\n\na\n\n## A\n\nb\n\n### A1\n\nc\n\n## B\n\nd", [("T", "a"), ("T > A", "b"), ("T > A > A1", "c"), ("T > B", "d")]),
    ("# Title\n\n```bash\n# a comment\necho hi\n```\n\ntail", [("Title", "```bash\n# a comment\necho hi\n```\n\ntail")]),
    ("---\nprovenance: human\n# no\n---\n# T\nx", [("T", "x")]),
    ("---\nnever: ends\n# T\nx", []),
    ("x\n---\ny", [("", "x\n---\ny")]),
    ("# T\nreal\nSearch for: `a`, `b`\n## Search for me\nkeys\n## After\nz", [("T", "real"), ("T > After", "z")]),
    ("### deep\na\n# top\nb\n#not\n####### seven", [("deep", "a"), ("top", "b\n#not\n####### seven")]),
    ("# T\r\n\r\na\r\n## T\r\nb", [("T", "a"), ("T > T", "b")]),
    ("", []), (None, []), ("# only\n\n  \n", []),
])
def test_sections(spark, text, expected):
    assert chunks(spark, text) == expected


def test_parent_heading_and_many_notes(spark):
    rows = sections.sections(note(spark, "# A\nx\n## B\ny", "z")).orderBy("rel", "section").collect()
    assert [(r.rel, r.heading, r.parent_heading) for r in rows] == [("0.md", "A", None), ("0.md", "A > B", "A"), ("1.md", "", None)]
    assert sections.chunks(note(spark).where("false")).count() == 0


def cut(body):
    """Windows of a trimmed text one by one."""
    if len(body) <= 1800:
        return [body]
    out, at = [], 0
    while True:
        stop = min(at + 1800, len(body))
        blank = body.rfind("\n\n", at, stop)
        if stop < len(body) and blank - at > 600:
            stop = blank
        out.append(body[at:stop].strip())
        if stop == len(body):
            return [w for w in out if w]
        at = max(stop - 300, at + 1)


@pytest.mark.parametrize("body", [
    "x" * 1800, "x" * 1801, "x" * 5000, "é" * 601 + "\n\n" + "y" * 1300 + "\n\n" + "z" * 4000, "x" * 600 + "\n\n" + "y" * 2000,
    ("word " * 200).strip() + "\n\n" + ("word " * 200).strip() + "\n\n" + ("word " * 200).strip(), "a" * 1799 + "\n\n\n" + "b" * 1700, "p\n\n" * 3000 + "q", "x" * 601 + "\n\n" + "y" * 300 + "\n\n" + "z" * 200_000,
])
def test_windows(spark, body):
    assert spark.createDataFrame([(body,)], "b string").select(sections.windows(F.col("b"))).first()[0] == cut(body)


GOOD = "type = book\n# said\nTitle = T\nauthor = Last, First\nauthor = Guild\ntitle = second\nretrieval_status = full\nretrieved_on = 2024-01-02\nyear = 1999-x\npages = 3-4"


@pytest.mark.parametrize(("key", "text", "error"), [
    ("ABCDEFGH23", GOOD, None), ("ABCDEFGH2", GOOD, "no key"), ("ABCDEFGHO2", GOOD, "no key"), ("ABCDEFGH23", GOOD.replace("book", "blog"), "unknown type"),
    ("ABCDEFGH23", GOOD.replace("= full", "="), "no retrieval_status"), ("ABCDEFGH23", GOOD + "\nreplaces = ABCDEFGH23", "replaces itself"), ("ABCDEFGH23", GOOD + "\nreplaces = x", "replaces no key"),
    ("ABCDEFGH23", "", "no type"), ("ABCDEFGH23", None, "no type"), (None, GOOD, None), ("ABCDEFGH23", GOOD.replace("2024-01-02", ""), "no retrieved_on"),
])
def test_sources(spark, key, text, error):
    got = records.sources(spark.createDataFrame([("b", key, text)], "base string, key string, text string")).first()
    assert got.error == error
    if text == GOOD:
        assert got.title == "T" and got.authors == ["Last, First", "Guild"]


def test_rendered_record(spark):
    found = records.sources(spark.createDataFrame([("b", "ABCDEFGH23", GOOD), ("b", "ABCDEFGH24", GOOD.replace("Guild", "Maslow, A."))], "base string, key string, text string"))
    lines = [r[0] for r in found.orderBy("key").select(records.bibliography_entry()).collect()]
    assert lines == ['Last, First; Guild. "T". 3-4. 1999-x. read in full, 2024-01-02.', 'Last, First; Maslow, A. "T". 3-4. 1999-x. read in full, 2024-01-02.']
    item = records.csl(found).orderBy("key").first().item
    assert '"family":"Last","given":"First"' in item and '"literal":"Guild"' in item and '"issued":{"date-parts":[[1999.0]]}' in item and '"page":"3-4"' in item
    assert [r.position for r in quality.listing(found).orderBy("key").collect()] == [1, 2]


def test_settings(spark):
    rows = [("ann", "name = A\nname = B # c\nrole =\nprivate = x/, y"), ("person", None), ("eve", "private ="), ("bob", "private = ."), ("dan", "nothing")]
    got = {r.base: (r.name, r.role, r.whole, r.private) for r in records.bases(spark.createDataFrame(rows, "base string, text string")).collect()}
    default = ["profile", "projects", "records"]
    assert got == {"ann": ("B", None, False, ["x", "y"]), "person": ("Person", None, True, []), "eve": ("Eve", None, False, []), "bob": ("Bob", None, True, []), "dan": ("Dan", None, False, default)}
    fleet = records.fleets(spark.createDataFrame([("r", "attach = a\nattach = b\ndisable =\nclassifier = x\n# classifier = y")], "root string, text string")).first()
    assert (fleet.attach, fleet.disable, fleet.classifier) == (["a", "b"], [], "x")
    table = records.aliases(spark.createDataFrame([("b", "git hub = github\nx =\n= y\n# a = b\nq = r = s")], "base string, text string"))
    assert [(r.alias, r.canonical) for r in table.orderBy("pos").collect()] == [("git hub", "github"), ("q", "r = s")]


def test_gold(spark):
    lines = spark.createDataFrame([(x,) for x in ("# c\tx", "", "q\t-", " q2\ta | b|", "none", None)], "value string")
    assert {(r.question, tuple(r.answers), r.error) for r in records.gold(lines).collect()} == {("q", (), None), ("q2", ("a", "b"), None), ("none", (), "no tab")}


def test_lines(spark):
    rows = ["- [src:K] Title – x", "* [src:K]", "a – b — c", "Sources, read: x", "the sources: x", "-[src:K] x", None]
    key, rest = records.bibliography_line(F.col("s"))
    got = spark.createDataFrame([(r,) for r in rows], "s string").select(key, rest, records.prose_sources(F.col("s")), records.first_dash(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("K", "Title – x", False, None), ("K", "", False, None), (None, None, False, "–"), (None, None, True, None), (None, None, False, None), (None, None, False, None), (None, None, None, None)]
    said = parsers.without_blocks(F.lit("a<system-reminder>x\n</system-reminder>b<task-notification>c"))
    assert spark.range(1).select(said).first()[0] == "ab"


def test_panels_and_sessions(spark):
    seats = spark.createDataFrame([("a", 5, 2), ("a", 7, 2)], "artifact string, boot long, reading long")
    assert logs.panel_cost(seats).first().total == 16
    cited = spark.createDataFrame([(1, "s1"), (1, " s2 "), (2, "s1"), (2, "s1"), (3, "s1"), (3, "s9"), (4, ""), (4, None)], "proposal int, source string")
    known = spark.createDataFrame([("s1",), ("s2",)], "session string")
    assert {r.proposal: (r.distinct_sources, r.accepted) for r in logs.unsupported(cited, known).collect()} == {1: (2, True), 2: (1, False), 3: (2, False), 4: (0, False)}
    raised = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("a", "x", 2), ("b", "x", 9)], "artifact string, reviewer string, at int")
    assert {(r.artifact, r.at): (r.number, r.seq) for r in logs.numbered(raised).collect()} == {("a", 1): (1, 1), ("a", 2): (2, 1), ("a", 3): (3, 2), ("b", 9): (1, 1)}


def test_stopwords_are_data(spark):
    asked = spark.createDataFrame([(1, "qual o calculo da proteina")], "qid int, question string")
    assert keyword.question_terms(asked).first().terms == ["qual", "calculo", "da", "proteina"]
    assert keyword.question_terms(asked, stopwords=(*STOPWORDS, "da", "qual")).first().terms == ["calculo", "proteina"]
    entries = spark.createDataFrame([("b", "1.md", "1", "da vinci", "", ["da"])], "base string, rel string, stem string, title string, purpose string, keywords array<string>")
    assert {r.term for r in keyword.entry_terms(entries, (*STOPWORDS, "da")).collect()} == {"vinci"}
