from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lexifold.operators import ask, fulltext, keyword, suggest
from lexifold.sources import corpus

ENTRIES = "base string, rel string, stem string, title string, purpose string, keywords array<string>"


def entries(spark, *rows):
    return spark.createDataFrame([(b, r, s, t, p, list(k)) for b, r, s, t, p, k in rows], ENTRIES)


def asked(spark, *questions, aliases=None):
    table = None if aliases is None else spark.createDataFrame(aliases, "pos int, alias string, canonical string")
    return keyword.question_terms(spark.createDataFrame(list(enumerate(questions)), "qid long, question string"), table)


def hits(spark, question, *rows, aliases=None):
    found = keyword.route(asked(spark, question, aliases=aliases), entries(spark, *rows), len(rows))
    return {r.rel: (r.score, r.matched) for r in found.collect()}


def test_weights_and_idf(spark):
    rows = [("b", "x.md", "pear", "pear", "about pear", ["pear"]), ("b", "y.md", "y1", "plum", "", [])]
    score, matched = hits(spark, "pear", *rows)["x.md"]
    assert score == pytest.approx((6 + 3 + 3 + 1) * math.log(1 + 2 / 2)) and matched == ["pear"]


def test_a_repeated_question_term_scores_again(spark):
    rows = [("b", "x.md", "x1", "pear", "", [])]
    assert hits(spark, "pear pear", *rows)["x.md"][0] == pytest.approx(2 * hits(spark, "pear", *rows)["x.md"][0])


def test_phrase_keys_match_whole_and_by_characters(spark):
    rows = [("b", "x.md", "x1", "", "", ["git push"]), ("b", "y.md", "y1", "", "", ["three word phrase"])]
    assert hits(spark, "git pull", *rows) == {}
    assert hits(spark, "digit pushing", *rows)["x.md"][1] == ["git push"]
    assert hits(spark, "a three word phrase here", *rows).keys() == {"y.md"}


def test_phrase_join_is_containment(spark):
    rng = random.Random(0)
    text = lambda n: ["".join(rng.choice("ab") for _ in range(rng.randrange(2, 4))) for _ in range(n)]
    questions = [(i, text(rng.randrange(2, 7))) for i in range(60)]
    phrases = sorted({" ".join(text(rng.randrange(2, 5))) for _ in range(80)})
    df = spark.createDataFrame(questions, "qid long, terms array<string>")
    got = {(r.qid, r.norm) for r in keyword.phrase_matches(df, spark.createDataFrame([(p,) for p in phrases], "norm string")).collect()}
    assert got == {(q, p) for (q, t), p in itertools.product(questions, phrases) if p in " ".join(t)}


def test_dead_keys_score_nothing(spark):
    assert hits(spark, "funciona", ("b", "x.md", "x1", "", "", ["not funciona", "text-to-speech"])) == {}


def test_aliases_add_and_never_take_away(spark):
    got = asked(spark, "calorie floor of that", aliases=[(1, "calorie floor", "minimum floor intake"), (0, "of", "x1"), (2, "minimum", "never")]).first().terms
    assert got == ["calorie", "floor", "minimum", "intake"]


def test_ties_go_by_path(spark):
    found = keyword.route(asked(spark, "pear"), entries(spark, ("b", "z.md", "z1", "pear", "", []), ("a", "a.md", "a1", "pear", "", [])), 2)
    assert [r.rel for r in found.orderBy("rank").collect()] == ["a.md", "z.md"]


CHUNKS = "base string, rel string, private boolean, chunk_id long, seq int, heading string, text string"


def bm25(chunks, terms):
    """The closed form, chunk by chunk, with the statistics of each base."""
    out = {}
    tok = lambda s: s.lower().split()
    for base in {c[0] for c in chunks}:
        own = [c for c in chunks if c[0] == base]
        lengths = {c[3]: len(tok(c[5])) + len(tok(c[6])) for c in own}
        mean = sum(lengths.values()) / len(own)
        for c in own:
            score = 0.0
            for t in set(terms):
                n = sum(t in tok(x[5]) + tok(x[6]) for x in own)
                tf = 2 * tok(c[5]).count(t) + tok(c[6]).count(t)
                if tf:
                    w = math.log((len(own) - n + 0.5) / (n + 0.5))
                    score += (w if w > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[c[3]] / mean))
            if score:
                out[c[3]] = score
    return out


def chunk_rows():
    rng = random.Random(2)
    word = lambda: rng.choice("ab cd ef gh ij kl mn".split())
    return [(f"b{i % 3}", f"{i}.md", i % 7 == 0, i, 0, word(), " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(60)]


def test_bm25_is_the_closed_form(spark):
    rows = chunk_rows()
    found = fulltext.search(asked(spark, "ab ef zz"), spark.createDataFrame(rows, CHUNKS), public=False).collect()
    right = bm25(rows, ["ab", "ef", "zz"])
    assert {r.chunk_id: r.bm25 for r in found} == pytest.approx(right, abs=1e-8)


def test_private_chunks_stay_out_but_count(spark):
    rows = chunk_rows()
    found = fulltext.search(asked(spark, "ab"), spark.createDataFrame(rows, CHUNKS)).collect()
    right = bm25(rows, ["ab"])
    assert {r.chunk_id: r.bm25 for r in found} == pytest.approx({c: s for c, s in right.items() if c % 7}, abs=1e-8)


def test_pruning_keeps_all_when_nothing_would_be_left(spark):
    rows = [("b", f"{i}.md", False, i, 0, "", "ab" + (" cd" if i == 0 else "")) for i in range(20)]
    df = spark.createDataFrame(rows, CHUNKS)
    terms = lambda q: {r.term for r in fulltext.pruned(asked(spark, q), fulltext.document_frequency(fulltext.postings(df)), fulltext.base_statistics(df)[1], least=10).collect()}
    assert terms("ab cd") == {"cd"} and terms("ab") == {"ab"}


def test_round_robin(spark):
    rows = [(0, b, f"{b}{i}", 10 * i + ord(b), 1.0, i) for b, n in (("a", 3), ("b", 1), ("c", 2)) for i in range(1, n + 1)]
    got = fulltext.round_robin(spark.createDataFrame(rows, "qid long, base string, rel string, chunk_id long, bm25 double, base_rank int"), 5)
    assert [r.rel for r in got.orderBy("rank").collect()] == ["a1", "b1", "c1", "a2", "c2"]


def test_a_file_counts_once_and_agreement_wins(spark):
    kw = spark.createDataFrame([(0, "b", "x", 1), (0, "b", "y", 2)], "qid long, base string, rel string, rank int")
    tx = spark.createDataFrame([(0, "b", "z", 1), (0, "b", "y", 2), (0, "b", "z", 3)], "qid long, base string, rel string, rank int")
    got = ask.fuse(kw, tx).orderBy("rank").collect()
    assert [(r.rel, r.passages) for r in got] == [("y", 1), ("x", 0), ("z", 2)]
    assert got[2].rrf == pytest.approx(1 / 61)


def test_floor():
    assert ask.floor_for(226) == pytest.approx(17.5) and ask.floor_for(11) == pytest.approx(0.61582 * 6 * math.log(1 + 11 / 2), rel=1e-4)


@pytest.mark.parametrize(("score", "n", "verdict"), [(17.5, 226, "hit"), (17.4, 226, "guess"), (100.0, 1, "guess"), (None, 226, "nothing")])
def test_verdict(spark, score, n, verdict):
    kw = spark.createDataFrame([] if score is None else [(0, "b", "x", score, 1)], "qid long, base string, rel string, score double, rank int")
    tx = spark.createDataFrame([(0, "b", "x")], "qid long, base string, rel string")
    r = ask.verdicts(spark.createDataFrame([(0,)], "qid long"), kw, tx, n).first()
    assert r.verdict == verdict and r.agreement == (0 if score is None else 2)


def test_the_best_of_a_species_counts_once(spark):
    rows = [(0, "deep", f"knowledge/{i}", 5.0, i) for i in range(1, 6)] + [(0, "wide", "skills/a", 4.0, 6), (0, "wide", "knowledge/b", 3.0, 7)]
    r = ask.choose_agents(spark.createDataFrame(rows, "qid long, base string, rel string, score double, rank int")).first()
    assert (r.agent, r.agent_score, r.files, r.contenders) == ("wide", 7.0, 2, 2) and r.agent_margin == pytest.approx(7 / 5)


def test_suggestions(spark):
    rows = [("b", "x.md", "x", "", "", ["public", "repository", "weather"])]
    q = spark.createDataFrame([(0, "publico repositorio")], "qid long, question string")
    got = suggest.suggest(q, entries(spark, *rows)).orderBy("rank").collect()
    assert [r.keyword for r in got] == ["public", "repository"]


@pytest.mark.parametrize(("claim", "outcome"), [("ab cd ef", "NOOP"), ("ab cd ef gh", "UPDATE"), ("ab xx yy", "ADD"), ("zz", "ADD")])
def test_remember(spark, claim, outcome):
    chunks = spark.createDataFrame([("b", "x.md", False, 1, 0, "", "ab cd ef"), ("b", "y.md", False, 2, 0, "", "mn"), ("b", "z.md", False, 3, 0, "", "op")], CHUNKS)
    q = asked(spark, claim)
    ranked = fulltext.round_robin(fulltext.search(q, chunks, 25), 25)
    assert suggest.remember(q, ranked, chunks).first().outcome == outcome


def test_mechanical_keys(spark):
    text = "Alpha beta alpha beta gamma. Alphabet! the beta's gamma gamma xyz"
    got = corpus.mechanical_keys(spark.createDataFrame([(0, text), (1, "")], "doc_id long, text string"), cap=6).collect()
    assert [(r.doc_id, r.keywords) for r in got] == [(0, ["alpha beta", "gamma", "alphabet"])]


def test_windows_cover_and_overlap(spark):
    text = "".join(chr(97 + i % 26) for i in range(5_000))
    got = [r.w.text for r in spark.createDataFrame([(text,)], "t string").select(F.explode(corpus.windows(F.col("t"))).alias("w")).collect()]
    assert got[0] == text[:1800] and got[1] == text[1500:3300] and got[-1] == text[4500:] or text.endswith(got[-1])
    assert [r.w.text for r in spark.createDataFrame([("x",)], "t string").select(F.explode(corpus.windows(F.col("t"))).alias("w")).collect()] == ["x"]


def test_notes(spark, tmp_path):
    for path in ("fleet/ann/knowledge/a.md", "fleet/ann/projects/p.MD", "fleet/ann/.git/x.md", "fleet/bob/target/y.md", "fleet/bob/n.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("# t\n")
    got = {(r.base, r.rel, r.stem, r.private) for r in corpus.notes(spark, str(tmp_path / "fleet")).collect()}
    assert got == {("ann", "knowledge/a.md", "a", False), ("ann", "projects/p.MD", "p", True)}
