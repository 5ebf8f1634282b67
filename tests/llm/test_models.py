"""Language identification and toxicity: held-out accuracy, edge rows, gradients."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lexifold.llm import language_id, toxicity

from .fixtures import ROWS, edge, empty

SYLLABLES = {"aa": ["tion", "the", "ing", "er", "sh"], "bb": ["ung", "der", "ich", "sch", "ein"], "cc": ["que", "eau", "oux", "ment", "é"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(i, sentence(rng, lang, rng.randrange(1, 40)), lang) for i in range(360) for lang in [rng.choice(sorted(SYLLABLES))]]


def test_language_accuracy_on_held_out_rows(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    right = {i: lang for i, _, lang in corpus}
    held = [r for r in language_id.query(docs).collect() if r.held_out]
    assert len(held) > 60 and np.mean([r.lang_pred == right[r.doc_id] for r in held]) > 0.95
    assert not any(r.rejected for r in held)


def test_language_edge_rows(spark):
    rows = {(r.doc_id, r.text): r for r in language_id.predict(edge(spark), language_id.train(edge(spark))).collect()}
    assert len(rows) == len({(i, t) for i, t, *_ in ROWS})
    for (_, text), r in rows.items():
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und" and r.score == 0.0 and r.rejected
        else:
            assert r.lang_pred in {"en", "fr", "de"} and 0 <= r.score <= 1
    assert language_id.query(empty(spark)).collect() == []


def test_nothing_to_learn_from(spark):
    docs = edge(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language_id.query(docs).collect()} == {"und"}


def test_word_shares_add_up_to_the_network():
    model = language_id.fit(["aa bb", "cc dd"] * 10, ["x", "y"] * 10)
    words = language_id.words_of("aa bb zz")
    hidden = np.mean([model.embeddings[language_id.subwords([w], len(model.embeddings))[0]].mean(axis=0) for w in words], axis=0)
    found = language_id.Scorer(model).logits([words, []])
    assert np.allclose(found[:, :3], [hidden @ model.weights, np.zeros(3)])
    seen = np.mean([model.seen[language_id.subwords([w], len(model.embeddings))[0]].mean(axis=0) for w in words], axis=0)
    assert np.allclose(found[:, 3:], [seen, np.zeros(2)]) and seen[0] > seen[1]


def test_subwords_of_many_words_are_those_of_each():
    words = ["a", "été", "straße", "x" * 300, "😀b"]
    ids, counts = language_id.subwords(words, 1 << 15)
    assert counts.tolist() == [3 * (len(w) + 2) - 3 for w in words]
    assert ids.tolist() == [i for w in words for i in language_id.subwords([w], 1 << 15)[0]]


def test_few_texts_still_reject_and_an_id_teaches_once(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, lang, 40), lang) for i, lang in enumerate(sorted(SYLLABLES) * 12)]
    rows += [(0, "x" * 50, rows[0][2])] * 20  # one id with many other texts
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.thresholds and model.coverages and min(t for _, t in model.coverages) > 0
    judged = language_id.Scorer(model).judge_all([" ".join("".join(rng.choices("qwxzvjkñ", k=6)) for _ in range(30)) for _ in range(20)])
    assert sum(r for *_, r in judged) >= 18


def test_what_is_kept_moves_no_score(monkeypatch):
    rng = random.Random(3)
    model = language_id.fit([sentence(rng, lang, 30) for lang in SYLLABLES for _ in range(30)], [lang for lang in SYLLABLES for _ in range(30)])
    texts = [sentence(rng, "aa", n) for n in (1, 50, 400)] + [None, "12"]
    whole = language_id.Scorer(model).judge_all(texts)
    monkeypatch.setattr(language_id, "CACHE", 20)
    monkeypatch.setattr(language_id, "AT_ONCE", 15)
    parts = language_id.Scorer(model).judge_all(texts)
    assert [x[::2] for x in whole] == [x[::2] for x in parts] and np.allclose([x[1] for x in whole], [x[1] for x in parts])


def test_long_texts_teach_by_pieces_of_the_whole():
    words = [f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(5_000)]
    kept = language_id._pieces(" ".join(words)).split()
    assert len(kept) == language_id.PIECES * language_id.PIECE and kept[0] == words[0] and kept[-1] == words[-1]
    assert language_id._pieces("un texte court") == "un texte court"


def test_gradients_match_differences():
    model = toxicity.ToxicityModel(np.random.default_rng(1))
    for p in (model.p, model.words.p, model.chars.p):
        for k in p:
            p[k] = p[k].astype(np.float64)
    rows, labels = [["you", "mean", "averyveryverylongword", "x"], ["a", "b"]], np.array([1.0, 0.0])

    def loss():
        total = 0.0
        for r, y in zip(rows, labels, strict=True):
            gates, mask = np.zeros((1, toxicity.WINDOW, 6 * model.hidden)), np.zeros((1, toxicity.WINDOW))
            for i, w in enumerate(r):
                gates[0, i], mask[0, i] = model.words.project(model.inputs([w]))[0], 1
            p = 1 / (1 + np.exp(-(model.words.run(gates, mask) @ model.p["out"] + model.p["bias"])[0]))
            total -= (y * np.log(p) + (1 - y) * np.log(1 - p)) / len(rows)
        return total

    for (group, name), g in toxicity._gradients(model, rows, labels).items():
        weights = {"own": model.p, "words": model.words.p, "chars": model.chars.p}[group][name]
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = weights[at]
        weights[at] = old + 1e-2
        up = loss()
        weights[at] = old - 1e-2
        down = loss()
        weights[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 1e-3 + 0.01 * abs(g[at])


def test_windows_cover_the_text():
    for n in (0, 1, 23, 24, 25, 36, 37, 100):
        starts = toxicity.windows(n)
        assert set(range(n)) <= {s + i for s in starts for i in range(toxicity.WINDOW)} and (n <= toxicity.WINDOW or starts[-1] + toxicity.WINDOW == n)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(420):
        words = sentence(rng, "aa", rng.randrange(5, 120)).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum", "idiot"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model_docs, model_labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [r for r in toxicity.query(model_docs, model_labels).collect() if r.held_out]
    right = dict(labels)
    assert np.mean([r.predicted == right[r.doc_id] for r in held]) > 0.95


def test_toxicity_edge_rows(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (5, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.query(edge(spark), labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.query(empty(spark), labels).collect() == [] and len(toxicity.query(edge(spark), labels.limit(0)).collect()) == len(ROWS)


def test_unlearned_languages_and_random_letters_are_rejected(spark, corpus):
    rng = random.Random(8)
    model = language_id.train(spark.createDataFrame(corpus, "doc_id long, text string, lang string"))
    scorer = language_id.Scorer(model)
    cyrillic = lambda: "".join(rng.choice(["ко", "ла", "ми", "ста", "ро", "ни"]) for _ in range(3))
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    other = lambda: "".join(rng.choice(["ska", "lj", "och", "att", "för"]) for _ in range(rng.randrange(1, 4)))
    for word in (cyrillic, letters, other):
        assert np.mean([scorer.judge(" ".join(word() for _ in range(60)))[2] for _ in range(100)]) > 0.9
    clean = [sentence(rng, lang, n) for lang in SYLLABLES for n in (1, 3, 10, 40, 200) for _ in range(40)]
    assert np.mean([scorer.judge(t)[2] for t in clean]) < 0.02
