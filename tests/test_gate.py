from __future__ import annotations

from lexifold.operators import ask, gate, keyword
from lexifold.sources.stages import written

ENTRIES = [
    ("ana", "knowledge/1.md", "1", "Storage of ledgers", "", ["ledger", "archive"]),
    ("ana", "knowledge/2.md", "2", "Vault rules", "", ["vault", "double entry"]),
    ("ben", "skills/3.md", "3", "Design system", "", ["colour", "spacing"]),
    ("ben", "knowledge/4.md", "4", "Interface", "", ["button"]),
    ("cid", "tools/5.md", "5", "", "", []),
]
QUESTIONS = [(1, "where is the ledger kept"), (2, "interface button"), (3, "panel of the vault"), (4, "weather panel"), (5, ""), (6, "panel double entry")]
GOLD = [(1, "ana", "knowledge/1.md"), (2, "ben", "knowledge/4.md"), (3, "ana", "knowledge/2.md"), (3, "ana", "knowledge/2.md")]
CANDIDATES = [
    (1, "mainbook", "ledger", "mainbook"),  # mends its own, touches nothing else
    (2, "panel", "colour spacing design system", "panel"),  # mends its own, takes questions 3 and 6 away
    (3, "mainbook", "unheard", "mainbook"),
    (4, "ledger", "vault", "ledger"),
    (5, "other", "ledger", "mainbook"),
    (6, "weather panel", "button", "weather panel here"),  # answers question 4, which has to be declined
    (7, " ", "x", "y"), (8, None, "x", "y"), (9, "Word", "wORD", "y"), (10, "a", "b", None), (11, "a=b", "c", "y"),
    (12, "mainbook", "ledger", "mainbook"),  # another candidate that is the same
    (13, "!!", "ledger", "mainbook"),  # no token: matches nothing
    (14, "mainbook ledger", "vault", "mainbook"),
]


def frames(spark, entries=ENTRIES, questions=QUESTIONS, gold=GOLD, candidates=CANDIDATES):
    e = spark.createDataFrame(entries, "base string, rel string, stem string, title string, purpose string, keywords array<string>")
    q = spark.createDataFrame(questions, "qid long, question string")
    g = spark.createDataFrame(gold, "qid long, base string, rel string")
    c = spark.createDataFrame(candidates, "cid long, alias string, canonical string, because string")
    return e, q, g, c


def judged(spark, aliases=None, **changed):
    e, q, g, c = frames(spark, **changed)
    return {r.cid: r for r in gate.judge(c, q, g, keyword.entry_terms(e), keyword.entry_phrases(e), e.count(), aliases).collect()}


def full_run(spark, extra):
    """The counts of all questions, and which own questions find something, with the aliases ``extra`` in force."""
    e, q, g, c = frames(spark)
    n = e.count()
    asked = q.unionByName(c.selectExpr("cid + 100 as qid", "because as question"))
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(extra)], "pos int, alias string, canonical string") if extra else None
    hits = written(keyword.route(keyword.question_terms(asked, table), e, n))
    top = {r.qid: r for r in hits.where("rank = 1").collect()}
    owner = {r.qid: r.agent for r in ask.choose_agents(hits).collect()}
    gold = {(r.qid, r.base, r.rel) for r in g.collect()}
    known = {x[0] for x in gold}
    counts = [0, 0, 0]
    for qid, _ in QUESTIONS:
        t = top.get(qid)
        counts[0] += t is not None and (qid, t.base, t.rel) in gold
        counts[1] += any(x[0] == qid and x[1] == owner.get(qid) for x in gold)
        counts[2] += t is not None and qid not in known and t.score >= ask.floor_for(n)
    return counts, {q - 100 for q in top if q > 100}


def test_each_candidate_as_if_all_were_scored_again(spark):
    inforce = [("kept", "vault"), ("weather", "colour")]
    aliases = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(inforce)], "pos int, alias string, canonical string")
    got = judged(spark, aliases)
    before, found = full_run(spark, inforce)
    assert len(got) == len(CANDIDATES)
    for cid in (7, 8, 9, 10, 11):
        assert not got[cid].admitted and got[cid].file_before is None and got[cid].touched is None
    for cid, alias, canonical, _ in (CANDIDATES[i - 1] for i in (1, 2, 6, 14)):
        r = got[cid]
        after, then = full_run(spark, [*inforce, (alias, canonical)])
        assert [r.file_before, r.agent_before, r.answered_before] == before
        assert [r.file_after, r.agent_after, r.answered_after] == after, cid
        assert r.missing == (cid not in found) and r.fixes == (cid not in found and cid in then)
        assert r.admitted == (r.fixes and after[0] >= before[0] and after[1] >= before[1] and after[2] <= before[2])


def test_reasons(spark):
    got = judged(spark)
    assert {c: got[c].reason for c in got} == {
        1: "", 2: "costs elsewhere", 3: "still finds nothing", 4: "does not miss", 5: "still finds nothing", 6: "costs elsewhere", 7: "empty side", 8: "empty side",
        9: "same word", 10: "no question", 11: "equals sign", 12: "", 13: "still finds nothing", 14: "still finds nothing",
    }
    assert got[6].file_after == got[6].file_before and got[6].answered_after == got[6].answered_before + 1
    assert got[1].touched == 0 and got[2].touched == 3 and got[2].file_after < got[2].file_before


def test_empty_tables(spark):
    assert judged(spark, candidates=[]) == {}
    lone = judged(spark, questions=[], gold=[], candidates=CANDIDATES[:1])[1]
    assert lone.admitted and lone.file_before == lone.file_after == 0
    nothing = judged(spark, entries=[], candidates=CANDIDATES[:1])[1]
    assert nothing.missing and not nothing.fixes and nothing.reason == "still finds nothing"
