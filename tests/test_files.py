from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexifold.operators import blocks
from lexifold.sources import logfiles

MISSES = """# header
looked like: lost
3 2024-01-01 2024-02-01  How do I?
  looked like: first , , list
  looked like: a, b ,
x 2024 2024 bad count
one two
4294967296 a b too large
 +2\t2024\t2025 what else
\tlooked like: c
1 a b HOW DO I?

7 a b tail kept \t"""


def texts(spark, *rows):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "file string, text string")


def test_misses(spark):
    rows = logfiles.misses(texts(spark, MISSES, None, "", MISSES.replace("\n", "\r\n")))
    good = [(r.file, r.line, r["count"], r.first, r.last, r.question.rstrip(), list(r.looked_like)) for r in rows.where("bad is null").orderBy("file", "line").collect()]
    own = [(9, 2, "2024", "2025", "what else", ["c"]), (11, 1, "a", "b", "HOW DO I?", []), (13, 7, "a", "b", "tail kept", [])]
    assert good == [("0", *r) for r in own] + [("3", *r) for r in own]
    bad = {(r.line, r.bad) for r in rows.where("file = '0' and bad is not null").collect()}
    assert bad == {(2, "no record above"), (6, "count"), (7, "fields"), (8, "count")}
    assert [(r.position, r.question.rstrip()) for r in logfiles.report(rows.where("file = '0'"), "question").orderBy("position").collect()] == [(1, "tail kept"), (2, "what else"), (3, "HOW DO I?")]


def test_layouts(spark):
    of = lambda kind, text: logfiles.tabbed(texts(spark, text), logfiles.LAYOUTS[kind]).orderBy("line").collect()
    rows = of("misroutes", "#\n\n2\ta\tb\tc\td\tq\nx\ta\tb\tc\td\tr\twhy\tmore\n1\ta\tb\tc\td")
    assert [(r["count"], r.question, r.why, r.bad) for r in rows] == [(2, "q", "", None), (1, "r", "why", None), (1, "", "", "columns")]
    rows = of("abstentions", "2\ta\tb\tc\td\ts\tm\nx\ta\tb\tc\td\ts\tm\treason\tz")
    assert [(r["count"], r.subject, r.reason, r.contenders, r.bad) for r in rows] == [(2, "s", "", "", None), (None, "s", "reason", "z", "count")] or rows[1].bad == "count"
    rows = of("rejections", "  3\t a\tb\tc \td\te\tthe\treason \n1\ta\tb\tc\td\te")
    assert [(r["count"], r.first, r.agent, r.reason, r.bad) for r in rows] == [(3, "a", "c", "the\treason", None), (1, "a", "c", "", "columns")]
    rows = of("rounds", "art\town\trev\t2\tobjected\to\tu\t blocking\ttext\nart\town\trev\tz\tapproved\to\tu\tno\nart\town\trev\t1\tstrange\to\tu\tblocking")
    assert [(r.seq, r.state, r.blocking, r.text, r.bad) for r in rows] == [(2, "objected", True, "text", None), (0, "approved", False, "", None), (1, "strange", True, "", "state")]


def test_reports_keep_ties_in_order(spark):
    text = "2\ta\tb\tc\td\tsecond\n5\ta\tb\tc\td\tmost\n2\ta\tb\tc\td\tearlier"
    rows = logfiles.tabbed(texts(spark, text), logfiles.LAYOUTS["misroutes"])
    assert [r.question for r in logfiles.report(rows, None).orderBy("position").collect()] == ["most", "second", "earlier"]
    assert [r.question for r in logfiles.report(rows, "question").orderBy("position").collect()] == ["most", "earlier", "second"]


def test_session_events(spark):
    rows = logfiles.session_events(texts(spark, "routed\t x \nrefused\tq\ta, ,b\nrefused\t \nconclusion\tdone\nother\tx\nrouted")).orderBy("seq").collect()
    assert [(r.seq, r.kind, r.agent, r.question, r.looked_like, r.summary) for r in rows] == [(1, "routed", "x", None, None, None), (2, "refused", None, "q", ["a", "b"], None), (4, "conclusion", None, None, None, "done")]


def fence(line):
    bare = line.lstrip(" ")
    run = len(bare) - len(bare.lstrip(bare[:1])) if bare[:1] in ("`", "~") else 0
    return (bare[0], run) if run >= 3 and len(line) - len(bare) <= 3 and not (bare[0] == "`" and "`" in bare[run:]) else None


def brute_code(text):
    code, held = 0, None
    for line in text.split("\n") if text else []:
        now = fence(line)
        if held or now:
            code += len(line.encode()) + 1
        if held and now and now[0] == held[0] and now[1] >= held[1]:
            held = None
        elif not held:
            held = now
        last = bool(held) or now
    return code - bool(text and last)


def test_code_bytes(spark):
    rng = random.Random(0)
    parts = ["```", "````", "~~~", "~~~~ x", "``` a`b", "   ```py", "    ```", "text é", "", "``", "  ~~~"]
    cases = ["\n".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(300)] + ["", "```"]
    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", blocks.code_bytes(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: brute_code(t) for i, t in enumerate(cases)}
    assert spark.range(1).select(blocks.code_bytes(F.lit(None).cast("string"))).first()[0] == 0


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("a\n**Search for:** x\nb", "a\nb"),
        ("search for: a,\n  `b`,\n`c`\n`d`\n", "`d`\n"),
        ("Buscar por: a,\nplain", "plain"),
        ("say `Search for:` in prose", "say `Search for:` in prose"),
        ("Search for: last", ""),
    ],
)
def test_key_lines(spark, text, kept):
    assert spark.range(1).select(blocks.without_key_lines(F.lit(text))).first()[0] == kept


def test_blocks(spark):
    manifest = "early.md\n[core] # note\na.md\n gone.md # x\n\n[broken\n[ later ]  ON-DEMAND\nb.md\n[ end ]\na.md\n[empty]"
    listed = blocks.manifest(spark.createDataFrame([("r", "b", manifest), ("s", "b", None)], "root string, base string, text string"))
    files = spark.createDataFrame([("b", "a.md", "Search for: x\n```\ncode\n```\n" + "p" * 399), ("b", "b.md", "q" * 40), ("c", "gone.md", "other base")], "base string, rel string, text string")
    got = [tuple(r)[2:] for r in blocks.report(listed, files).orderBy("pos").collect()]
    size, code = 13 + 399, 13
    tokens = int((size - code) / 3.99 + code / 2.96 + 0.5)
    assert got == [("core", True, 1, 1, size + 14, size, code, tokens, 2 * tokens), ("later", False, 1, 0, 40, 40, 0, 10, None), ("end", True, 1, 0, size + 14, size, code, tokens, tokens), ("empty", True, 0, 0, 0, 0, 0, 0, 0)]
