"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

The network has two levels of one kind.  The lower one reads a word's characters; its pooled output,
beside an embedding of the hashed word, is the input for that word in the upper one, which reads a
window of words.  A text is scored over all its windows of ``WINDOW`` words, each overlapping the
next by half; its score is that of its worst window, put on a scale of probability.

Only whole texts have labels, so windows are learnt as many instances of one label: of a toxic text,
the window that the network finds worst (at first: the one with the most telling word) is an example
of label 1; of a clean one, its worst window and a random one are examples of label 0.  The sample
to learn from is bounded.  Scoring is a map over the documents; a worker computes a word's input
once and keeps it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_of_each, slices
from .language_id import fold

_WORDS = re.compile(r"\w+")

WINDOW = 24
STRIDE = 12
#: Rows of each label that are learnt from at most, whole texts.
SAMPLE = 2_048
#: A text is called toxic from this score on.
THRESHOLD = 0.3
CHARS, BUCKETS = 512, 1 << 13
#: Characters that are read of a word at once; longer words are read in parts that overlap by half.
WORD_CHARS = 16
CACHE = 250_000
F32 = np.float32


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiGru:
    """Gated recurrent units in both directions, pooled by attention; weights live in ``p``."""

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int):
        self.hidden = hidden
        scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(F32)
        self.p = {"query": np.zeros(2 * hidden, F32)}
        for d in "fb":
            self.p |= {f"{d}x": scale(inputs, 3 * hidden), f"{d}h": scale(hidden, 3 * hidden), f"{d}0": np.zeros(3 * hidden, F32)}

    def project(self, x: np.ndarray) -> np.ndarray:
        """The inputs' share in the gates of both directions."""
        return np.concatenate([x @ self.p[f"{d}x"] + self.p[f"{d}0"] for d in "fb"], axis=-1)

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Pooled states (rows, 2 * hidden) of projected inputs (rows, steps, 6 * hidden)."""
        n, steps, _ = gates.shape
        k = self.hidden
        states = np.zeros((n, steps, 2 * k), F32)
        tape: dict = {}
        for d, part, order in (("f", gates[:, :, : 3 * k], range(steps)), ("b", gates[:, :, 3 * k :], range(steps - 1, -1, -1))):
            u, h, side = self.p[f"{d}h"], np.zeros((n, k), F32), slice(0, k) if d == "f" else slice(k, 2 * k)
            for t in order:
                own, back = part[:, t], h @ u
                zr = _sigmoid(own[:, : 2 * k] + back[:, : 2 * k])
                z, r = zr[:, :k], zr[:, k:]
                new = np.tanh(own[:, 2 * k :] + r * back[:, 2 * k :])
                live = mask[:, t, None]
                if keep:
                    tape[d, t] = h, z, r, new, back[:, 2 * k :]
                h = h + live * (1 - z) * (new - h)
                states[:, t, side] = h
        weight = states @ self.p["query"] - 1e9 * (1 - mask)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True)) * mask
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", weight, states)
        return (pooled, (states, weight, tape)) if keep else pooled

    def back(self, x: np.ndarray, mask: np.ndarray, kept: tuple, grad: np.ndarray) -> tuple[np.ndarray, dict]:
        """Gradients of the inputs and of the weights."""
        states, weight, tape = kept
        n, steps, _ = x.shape
        k = self.hidden
        of_weight = np.einsum("nh,nth->nt", grad, states)
        of_score = weight * (of_weight - (weight * of_weight).sum(axis=1, keepdims=True))
        of_states = weight[:, :, None] * grad[:, None] + of_score[:, :, None] * self.p["query"]
        out = {"query": np.einsum("nt,nth->h", of_score, states)}
        of_x = np.zeros_like(x)
        for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            u, side = self.p[f"{d}h"], slice(0, k) if d == "f" else slice(k, 2 * k)
            du, dgates, dh = np.zeros_like(u), np.zeros((n, steps, 3 * k), F32), np.zeros((n, k), F32)
            for t in order:
                h, z, r, new, back = tape[d, t]
                dh = dh + of_states[:, t, side]
                live = mask[:, t, None]
                dnew = dh * live * (1 - z) * (1 - new * new)
                dz = -dh * live * (new - h) * z * (1 - z)
                dr = dnew * back * r * (1 - r)
                dgates[:, t] = np.concatenate([dz, dr, dnew], axis=1)
                dback = np.concatenate([dz, dr, dnew * r], axis=1)
                du += h.T @ dback
                dh = dh * (1 - live * (1 - z)) + dback @ u.T
            flat = dgates.reshape(-1, 3 * k)
            out |= {f"{d}h": du, f"{d}x": x.reshape(n * steps, -1).T @ flat, f"{d}0": flat.sum(axis=0)}
            of_x += dgates @ self.p[f"{d}x"].T
        return of_x, out


@dataclass
class ToxicityModel:
    rng: np.random.Generator
    dim: int = 8
    hidden: int = 8
    scale: tuple[float, float] = (1.0, 0.0)
    p: dict = field(default_factory=dict)

    def __post_init__(self):
        self.chars, self.words = BiGru(self.rng, self.dim, self.hidden), BiGru(self.rng, 2 * self.hidden + self.dim, self.hidden)
        self.p = {"char": self.rng.normal(0, 0.5, (CHARS, self.dim)).astype(F32), "word": self.rng.normal(0, 0.1, (BUCKETS, self.dim)).astype(F32), "out": self.rng.normal(0, 0.3, 2 * self.hidden).astype(F32), "bias": np.full(1, -1.0, F32)}

    @staticmethod
    def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters (rows, longest part), mask, and the word each row is of."""
        half = WORD_CHARS // 2
        parts = [[w] if len(w) <= WORD_CHARS else [w[i : i + WORD_CHARS] for i in range(0, len(w) - half, half)] for w in words]
        owner = np.repeat(np.arange(len(words)), [len(p) for p in parts])
        flat = [x for p in parts for x in p]
        lengths = np.array([len(x) for x in flat], np.int64)
        mask = np.arange(max(1, lengths.max(initial=1))) < lengths[:, None]
        ids = np.zeros(mask.shape, np.int64)
        ids[mask] = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), "<u4") % (CHARS - 1) + 1
        return ids, mask.astype(F32), owner

    def inputs(self, words: list[str]) -> np.ndarray:
        """The upper level's inputs for words: what the lower level reads, and the hashed word."""
        ids, mask, owner = self.spell(words)
        read = self.chars.run(self.chars.project(self.p["char"])[ids], mask)
        # The part of a long word with the largest state stands for it.
        first = np.searchsorted(owner, np.arange(len(words)))
        spelt = np.maximum.reduceat(read, first) if len(words) else np.zeros((0, 2 * self.hidden), F32)
        return np.concatenate([spelt, self.p["word"][[_bucket(w) for w in words]]], axis=1)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -60, 60)))


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def windows(n: int) -> np.ndarray:
    """First places of the windows over ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


class Scorer:
    """Scores texts; keeps the projected inputs of the words it met, up to ``CACHE`` of them."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.known: dict[str, int] = {}
        self.table = np.zeros((1, 6 * model.hidden), F32)  # row 0 is no word

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            self.table = self.table[:1]
            new = list(words)
        new.sort(key=len)  # words of like length are read together
        for at in range(0, len(new), 4_000):
            part = new[at : at + 4_000]
            start = len(self.known) + 1
            if start + len(part) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), start + len(part)), self.table.shape[1]), F32)
                grown[: len(self.table)] = self.table
                self.table = grown
            self.table[start : start + len(part)] = self.model.words.project(self.model.inputs(part))
            self.known |= {w: start + i for i, w in enumerate(part)}

    def logits(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The logit of every window of every text."""
        self._learn(set().union(*texts) if texts else set())
        known = self.known
        flat = np.concatenate([np.array([known[w] for w in t] + [0] * max(0, WINDOW - len(t)), np.int64) for t in texts])
        lengths = np.array([max(len(t), WINDOW) for t in texts])
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        starts = [windows(len(t)) for t in texts]
        at = np.concatenate([f + s for f, s in zip(firsts, starts, strict=True)])
        out = np.empty(len(at), F32)
        steps = np.arange(WINDOW)
        for i in range(0, len(at), 2048):
            ids = flat[at[i : i + 2048, None] + steps]
            pooled = self.model.words.run(self.table[ids], (ids > 0).astype(F32))
            out[i : i + 2048] = pooled @ self.model.p["out"] + self.model.p["bias"]
        return np.split(out, np.cumsum([len(s) for s in starts])[:-1])

    def scores(self, texts: list[str | None], at_once: int = 60_000) -> list[float]:
        """A probability for each text; a text without words gets that of an empty window."""
        out: list[float] = []
        held: list[list[str]] = []
        size = 0
        for i, t in enumerate(texts):
            held.append(words_of(t))
            size += len(held[-1])
            if size >= at_once or i == len(texts) - 1:
                out += [float(self.model.probability(x.max())) for x in self.logits(held)]
                held, size = [], 0
        return out


def fit(texts: list[str], labels: list[int], epochs: int | None = None, rate: float = 0.01, seed: int = 0) -> ToxicityModel:
    """A model of ``texts`` and their ``labels``; a fifth of them is kept back to scale the scores."""
    rng = np.random.default_rng(seed)
    model = ToxicityModel(rng)
    split = [words_of(t) for t in texts]
    order = rng.permutation(len(texts))
    kept, learnt = order[: len(order) // 5], order[len(order) // 5 :]
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for i in learnt:
        seen[labels[i]].update(set(split[i]))
    total = {y: sum(labels[i] == y for i in learnt) + 1 for y in (0, 1)}
    telling = {w: np.log((n + 0.1) / total[1]) - np.log((seen[0][w] + 1.0) / total[0]) for w, n in seen[1].items() if n >= 3}
    adam = _Adam(model, rate)
    epochs = epochs or int(np.clip(20_000 // max(1, len(learnt)), 6, 40))  # small samples are read more often
    for epoch in range(epochs):
        worst: dict[int, int] = {}
        if epoch:
            scorer = Scorer(model)
            worst = {int(i): int(windows(len(split[i]))[x.argmax()]) for part in np.array_split(learnt, max(1, len(learnt) // 100)) for i, x in zip(part, scorer.logits([split[j] for j in part]), strict=True)}
        examples = []
        for i in map(int, learnt):
            starts = windows(len(split[i]))
            if labels[i] and not epoch:
                best = max(range(len(split[i])), key=lambda j: telling.get(split[i][j], -9.0), default=0)
                examples.append((i, max(0, min(best - int(rng.integers(0, WINDOW)), len(split[i]) - WINDOW)), 1))
            elif labels[i]:
                examples.append((i, worst[i], 1))
            else:
                examples += [(i, int(rng.choice(starts)), 0), *([(i, worst[i], 0)] if epoch else [])]
        for at in np.array_split(rng.permutation(len(examples)), max(1, len(examples) // 64)):
            batch = [examples[j] for j in at]
            if batch:
                adam.step(_gradients(model, [split[i][s : s + WINDOW] for i, s, _ in batch], np.array([y for *_, y in batch], F32)))
    _scale(model, [split[i] for i in kept], np.array([labels[i] for i in kept]))
    return model


def _gradients(model: ToxicityModel, rows: list[list[str]], labels: np.ndarray) -> dict:
    words = sorted(set().union(*rows)) or [""]
    number = {w: i for i, w in enumerate(words)}
    ids, mask, owner = model.spell(words)
    letters = model.p["char"][ids]
    read, lower = model.chars.run(model.chars.project(letters), mask, keep=True)
    first = np.searchsorted(owner, np.arange(len(words)))
    spelt = np.maximum.reduceat(read, first)
    buckets = np.array([_bucket(w) for w in words])
    table = np.concatenate([spelt, model.p["word"][buckets]], axis=1)
    at = np.zeros((len(rows), WINDOW), np.int64)
    live = np.zeros((len(rows), WINDOW), F32)
    for i, r in enumerate(rows):
        at[i, : len(r)] = [number[w] for w in r]
        live[i, : len(r)] = 1
    x = table[at]
    pooled, upper = model.words.run(model.words.project(x), live, keep=True)
    logit = pooled @ model.p["out"] + model.p["bias"]
    error = ((_sigmoid(logit) - labels) / len(rows)).astype(F32)
    of_x, of_words = model.words.back(x, live, upper, error[:, None] * model.p["out"])
    of_table = np.zeros_like(table)
    np.add.at(of_table, at, of_x * live[:, :, None])
    k = 2 * model.hidden
    of_read = of_table[owner, :k] * (read == spelt[owner])
    of_letters, of_chars = model.chars.back(letters, mask, lower, of_read)
    of_char, of_word = np.zeros_like(model.p["char"]), np.zeros_like(model.p["word"])
    np.add.at(of_char, ids, of_letters * mask[:, :, None])
    np.add.at(of_word, buckets, of_table[:, k:])
    own = {"out": pooled.T @ error, "bias": error.sum(keepdims=True), "char": of_char, "word": of_word}
    return {("own", n): g for n, g in own.items()} | {("words", n): g for n, g in of_words.items()} | {("chars", n): g for n, g in of_chars.items()}


class _Adam:
    def __init__(self, model: ToxicityModel, rate: float):
        self.at = {("own", n): model.p for n in model.p} | {("words", n): model.words.p for n in model.words.p} | {("chars", n): model.chars.p for n in model.chars.p}
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(p[k[1]]) for k, p in self.at.items()}
        self.v = {k: np.zeros_like(p[k[1]]) for k, p in self.at.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(size, 1e-9))
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            p = self.at[k]
            p[k[1]] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-6)).astype(F32)


def _scale(model: ToxicityModel, texts: list[list[str]], labels: np.ndarray) -> None:
    """Fits the worst window's logit to the labels of whole texts, by Newton's method with a weak prior."""
    if len(texts) == 0:
        return
    scorer = Scorer(model)
    x = np.concatenate([[v.max() for v in scorer.logits(texts[i : i + 100])] for i in range(0, len(texts), 100)]).astype(float)
    design, w = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -60, 60)))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        w -= np.linalg.solve(hess, design.T @ (p - labels) + 0.1 * (w - [1.0, 0.0]))
    model.scale = (float(max(w[0], 0.05)), float(w[1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fits on about ``sample`` documents of each label at most, drawn by hashes of doc_id.

    ``docs`` are the rows that may be learned from.  Null texts, ids and labels teach nothing; an id
    with several labels counts as toxic if one of them does.  With no rows the model is untrained.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    usable = rows.select("doc_id").distinct().join(marked, "doc_id")
    picked = sample_of_each(usable, "toxic", sample)
    taught = sorted(rows.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").collect())  # sample rows a label
    return fit([r.text for r in taught], [r.toxic for r in taught]) if taught else ToxicityModel(np.random.default_rng(0))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches):
            found = np.array(scorer.scores(part.column(names.index("text")).to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held_out), labels.where(~held_out))
    return score(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text").select("doc_id", "held_out", "score", "predicted")
