"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word is the mean of the embeddings of its hashed character n-grams (with word ends marked), a text
the mean of its words, and a linear layer with softmax gives the languages and one class more, for
text of none of them.  The model is trained by stochastic gradient descent in numpy on segments of a
bounded sample of labelled documents; examples of the last class are made of the same segments, with
words reversed, letters shuffled or letters drawn at random.  Beside it the model knows which buckets
each language's texts have: a text's coverage is the mean share of its words' n-grams that its language
has.  A part of the sample is held back to set the temperature of the probabilities and, for texts of
each length, the probability and the coverage under which a prediction is rejected: the order
statistic at ``REJECTED``, which is the lowest value held back where there are few, so that no table is
too small to reject.  Every word's share in the scores is computed once by each worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_of_each, slices

_WORDS = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[A-Za-z]")

#: Rows of each language that the model learns from at most; of a long text, so many pieces of so
#: many words each, spread evenly over the whole of it.
SAMPLE, PIECES, PIECE = 640, 16, 64
#: Rejected share of the calibration segments whose language was found.
REJECTED = 0.001
#: A text may be so many times less probable, and have so many times the share of n-grams that its language lacks, as the worst that was held back.
SLACK = 1.5
#: Words from which on a text has a threshold of its own, segments that are drawn of each held-back
#: text for it, and segments that a threshold needs.
BANDS, SEGMENTS, ENOUGH = (1, 2, 4, 8, 16, 32, 64, 128), 8, 50
#: Texts that are held back for calibration: a tenth, but this many where that leaves two thirds.
HELD_BACK = 40
#: Examples that training goes through at least, the same ones again where the sample is small and has no more than so many letters.
EXAMPLES, LETTERS = 12_000, 4_000_000
#: Examples of no language for each segment.
FOREIGN = 1.0
#: Words that a worker keeps, and words that it reads at once.
CACHE, AT_ONCE = 100_000, 30_000


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


def subwords(words: list[str], buckets: int, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every ``<word>``, word after word, and how many each word has.

    A hash is taken over code points, for all words at once.
    """
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    h, found, owners = np.zeros(len(points), np.uint64), [], []
    for k in range(1, longest + 1):
        h = h[: len(points) - k + 1] * np.uint64(1_000_003) + points[k - 1 :]
        inside = owner[: len(h)] == owner[k - 1 :]
        mixed = (h[inside] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        found.append(((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    owner = np.concatenate(owners)
    return np.concatenate(found)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


@dataclass
class LanguageModel:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: (words from which on it holds, probability under which a prediction is rejected), ascending.
    thresholds: tuple[tuple[int, float], ...] = ()
    #: Whether a language (column) has a bucket, and the least coverages, as ``thresholds``.
    seen: np.ndarray | None = None
    coverages: tuple[tuple[int, float], ...] = ()

    def rejects(self, n_words: int, probability: float, coverage: float) -> bool:
        of = lambda bands: max((t for t in bands if t[0] <= n_words), default=(0, 0.0))[1]
        return bool(probability < of(self.thresholds) or coverage < of(self.coverages))

    def word_scores(self) -> np.ndarray:
        """Each bucket's share in the scores, as the layers are linear up to the softmax, and in each language's coverage."""
        return np.hstack([self.embeddings @ self.weights, self.seen if self.seen is not None else np.ones((len(self.embeddings), len(self.languages)))])

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = (logits[:, : len(self.bias)] + self.bias) / self.temperature
        x = np.exp(x - x.max(axis=-1, keepdims=True))
        return x / x.sum(axis=-1, keepdims=True)


class Scorer:
    """Scores texts with a model; keeps what it knows about words, up to ``CACHE`` of them."""

    def __init__(self, model: LanguageModel):
        self.model, self.shares = model, model.word_scores()
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, self.shares.shape[1]))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(words)
        if not new:
            return
        start = len(self.known)
        if start + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(new)), self.table.shape[1]))])
        ids, counts = subwords(new, len(self.shares))
        self.table[start : start + len(new)] = np.add.reduceat(self.shares[ids], np.cumsum(counts) - counts, axis=0) / counts[:, None]
        self.known |= {w: start + i for i, w in enumerate(new)}

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """The mean share of the words of each text (rows), scores first, then coverages; a text without words has zeros."""
        out, sizes = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        held: list[tuple[int, list[str]]] = []
        size = 0

        def read() -> None:
            self._learn(set().union(*(words for _, words in held)))
            for i, words in held:
                out[i] += self.table[[self.known[w] for w in words]].sum(axis=0)
                sizes[i] += len(words)

        for i, words in enumerate(texts):
            for at in range(0, len(words), AT_ONCE):  # no more words than that are read at once, also of one text
                held.append((i, words[at : at + AT_ONCE]))
                size += len(held[-1][1])
                if size >= AT_ONCE:
                    read()
                    held, size = [], 0
        if held:
            read()
        return out / np.maximum(sizes, 1)[:, None]

    def judge_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Of each text the language, its probability and whether it is rejected; ``und``, 0 and rejected for texts without a letter or with no model."""
        languages = self.model.languages
        if not languages:
            return [("und", 0.0, True)] * len(texts)
        words = [words_of(t) if has_letter(t) else None for t in texts]
        found = self.logits([w or [] for w in words])
        p, covered = self.model.probabilities(found), found[:, len(languages) + 1 :]
        out = []
        for w, own, has in zip(words, p, covered, strict=True):
            if w is None:
                out.append(("und", 0.0, True))
            else:
                best = int(own[: len(languages)].argmax())
                out.append((languages[best], float(own[best]), self.model.rejects(len(w), own[best], has[best])))
        return out

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        return self.judge_all([text])[0]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def foreign(words: list[str], rng: np.random.Generator) -> list[str]:
    """Words as long as ``words`` of no language: reversed, of their letters shuffled, or of random letters."""
    kind = rng.integers(0, 3)
    if kind == 0:
        return [w[::-1] for w in words]
    letters = "".join(words) if kind == 1 else "".join(map(chr, rng.integers(97, 123, sum(map(len, words)))))
    letters = "".join(letters[i] for i in rng.permutation(len(letters)))
    ends = np.cumsum([len(w) for w in words])
    return [letters[e - len(w) : e] for w, e in zip(words, ends, strict=True)]


def fit(texts: list[str], languages: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 3, rate: float = 2.0, seed: int = 0) -> LanguageModel:
    """A model of ``texts`` and their ``languages``; some of the texts are held back for calibration.  ``epochs`` are the fewest."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    model = LanguageModel(names, rng.normal(0, 0.1, (buckets, dim)), np.zeros((dim, len(names) + 1)), np.zeros(len(names) + 1))
    order = rng.permutation(len(texts))
    back = max(len(texts) // 10, min(HELD_BACK, len(texts) // 3))
    kept, learnt = order[:back], order[back:]
    model.seen = np.zeros((buckets, len(names)))
    segments, targets = [], []
    for i in learnt:
        words = words_of(texts[i])
        if words:
            model.seen[subwords(words, buckets)[0], names.index(languages[i])] = 1.0
        for size in (2, 6, 20, 60):  # short texts must work as well
            if words:
                start = rng.integers(0, max(1, len(words) - size + 1))
                segments.append(words[start : start + size])
                targets.append(names.index(languages[i]))
                if rng.random() < FOREIGN:
                    segments.append(foreign(segments[-1], rng))
                    targets.append(len(names))
    targets = np.array(targets, np.int64)
    letters = sum(len(w) for words in segments for w in words)
    again = min(-(-EXAMPLES // (32 * -(-max(1, len(segments)) // 32))), LETTERS // max(1, letters))  # in batches of 32
    epochs = max(epochs, again)
    for epoch in range(epochs if segments else 0):
        step = rate * (1 - epoch / epochs)
        shuffled = rng.permutation(len(segments))
        for at in range(0, len(shuffled), 32):
            batch = shuffled[at : at + 32]
            words = [w for i in batch for w in segments[i]]
            sizes = np.array([len(segments[i]) for i in batch])
            ids, counts = subwords(words, buckets)
            owner = np.repeat(np.repeat(np.arange(len(batch)), sizes), counts)
            weight = np.repeat(1 / (np.repeat(sizes, sizes) * counts), counts)
            hidden = np.zeros((len(batch), dim))
            np.add.at(hidden, owner, model.embeddings[ids] * weight[:, None])
            p = model.probabilities(hidden @ model.weights)
            p[np.arange(len(batch)), targets[batch]] -= 1
            p /= len(batch)
            back = p @ model.weights.T
            model.weights -= step * hidden.T @ p
            model.bias -= step * p.sum(axis=0)
            np.add.at(model.embeddings, ids, -step * dim * back[owner] * weight[:, None])
    _calibrate(model, [texts[i] for i in kept], [languages[i] for i in kept])
    return model


def _calibrate(model: LanguageModel, texts: list[str], languages: list[str]) -> None:
    """Temperature of least log loss; least probability and coverage of each length by the order statistic at ``REJECTED`` of what was rightly found."""
    scorer = Scorer(model)
    split = [(words, model.languages.index(lang)) for t, lang in zip(texts, languages, strict=True) if (words := words_of(t))]
    if not split:
        return
    logits, right = scorer.logits([words for words, _ in split]), np.array([y for _, y in split])
    losses = {}
    for t in np.geomspace(0.2, 20, 50):
        model.temperature = float(t)
        losses[float(t)] = -np.log(np.maximum(model.probabilities(logits)[np.arange(len(right)), right], 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    rng, thresholds, coverages = np.random.default_rng(1), [], []
    for size in BANDS:
        drawn = [(words[(at := int(rng.integers(0, len(words) - size + 1))) : at + size], y) for words, y in split if len(words) >= size for _ in range(SEGMENTS)]
        if not drawn:
            continue
        found, y = scorer.logits([words for words, _ in drawn]), np.array([y for _, y in drawn])
        p = model.probabilities(found)
        ok = p[:, :-1].argmax(axis=1) == y
        if ok.sum() >= ENOUGH:  # longer texts are held to the band before
            least = lambda x: float(np.quantile(x, REJECTED, method="lower"))
            thresholds.append((size, least(p[ok, y[ok]]) / SLACK))
            coverages.append((size, 1 - SLACK * (1 - least(found[ok, len(model.bias) + y[ok]]))))
    model.thresholds, model.coverages = tuple(thresholds), tuple(coverages)


def _pieces(text: str) -> str:
    """The words of a text, of a long one those of ``PIECES`` pieces over the whole of it."""
    words = words_of(text)
    if len(words) <= PIECES * PIECE:
        return " ".join(words)
    starts = [i * (len(words) - PIECE) // (PIECES - 1) for i in range(PIECES)]
    return " ".join(w for at in starts for w in words[at : at + PIECE])


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fits on about ``sample`` rows of each language (doc_id, text, lang) at most, drawn by hashes of doc_id.

    ``docs`` are the rows that may be learned from; those with a null text, lang or doc_id teach nothing.
    Only pieces of the sample's texts come to the driver: ``PIECES * PIECE`` words a row at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pieces = [_pieces(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(pieces, pa.string())], ["doc_id", "lang", "text"])

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("string"), F.col("lang").cast("string"), "text")
    picked = sample_of_each(rows.select("doc_id", "lang"), "lang", sample)
    some = rows.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")
    some = some.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # an id that occurs often teaches once
    taught = sorted(some.mapInArrow(run, "doc_id string, lang string, text string").collect())  # sample rows a language
    return fit([r.text for r in taught], [r.lang for r in taught]) if taught else LanguageModel([], np.zeros((1, 1)), np.zeros((1, 0)), np.zeros(0))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; columns of these names are replaced.

    Texts that are null or have no letter are ``und`` with score 0 and rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            found = scorer.judge_all(batch.column(names.index("text")).to_pylist())
            out = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have none."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def query(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
