"""Phrase collocation mining with weighted acyclic automata.

A text is lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words
``[^\\x20\\x09]+``.  Every word begins one window: itself and up to ``LONGEST - 1`` words of its piece
behind it.  A phrase occurs once for each window that it begins, so one automaton over windows counts
phrases of all lengths: the weight of the state that a phrase leads to is its number of occurrences,
and the weight of the initial state is the number of all words.

1. Each task sorts the windows of its shard and builds from them, in order, a deterministic acyclic
   count transducer (``Transducer``): arcs level by level, each with its word and its number of
   following arcs, weights at the last.  It is cut at prefixes (``_cuts``) into ranges.
2. The transducers of a range are united: words are renumbered, equal paths summed, and the states
   that may have ``least`` occurrences in all give (lang, phrase, f).  A cut may lie inside a phrase's
   subtree; such phrases (prefixes of the cut) are given whatever their count, and summed afterwards.
3. The parts of candidates are looked up by composition: parts and counted phrases are dealt by the
   same hash, and in each cell the parts are read along the transducer of that cell's phrases.

Cuts are drawn from a bounded sample of documents; they move work between tasks and no result.  A
phrase is one path in each shard's transducer however often it occurs there, so a phrase that is a
third of the corpus is no hot key, and cuts run through the whole window, so neither is a word or pair
with very many continuations.  Every part of a candidate occurs at least as often as the candidate,
so phrases below ``least`` are never needed and are not kept.

A null language is ``und``, a null text is empty.  Documents are counted row by row: repeated rows and
ids count as often as they occur.  An empty table gives an empty result.  A text is cut at pieces into
shards of ``SHARD`` bytes; a longer piece is one shard.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions

LONGEST = 5
LEAST = 100
#: Bytes of text of a shard, and windows of a range, on average.
SHARD, RANGE = 4_000_000, 700_000
#: Documents, about, and windows of each of them from which the cuts are drawn.
SAMPLE, DRAWN = 4_096, 16

_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _packed(a: np.ndarray) -> bytes:
    """A numpy array in the narrowest type that holds it, its width first."""
    a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
    return bytes([a.itemsize]) + a.tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.int64)


def _order(windows: np.ndarray, words: int) -> np.ndarray:
    """The order of windows (rows, LONGEST), by columns."""
    bits = max(1, int(words).bit_length())
    if bits * 3 <= 63:
        packed = lambda *levels: sum(windows[:, k].astype(np.int64) << bits * (len(levels) - 1 - i) for i, k in enumerate(levels))
        return np.lexsort((packed(3, 4), packed(0, 1, 2)))
    return np.lexsort(windows.T[::-1])


class Transducer:
    """Counts of word sequences: ``words`` (sorted bytes), ``windows`` (distinct rows of word numbers from 1, in order, 0 behind the last word) and their ``weights``."""

    def __init__(self, words: pa.Array, windows: np.ndarray, weights: np.ndarray):
        self.words, self.windows, self.weights = words, windows, weights

    @classmethod
    def counted(cls, words: pa.Array, windows: np.ndarray, weights: np.ndarray) -> Transducer:
        """Sorts windows and sums the weights of equal ones."""
        order = _order(windows, len(words))
        windows, weights = windows[order], weights[order]
        first = np.flatnonzero(np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)]) if len(windows) else np.zeros(0, np.int64)
        return cls(words, windows[first], np.add.reduceat(weights, first) if len(first) else weights)

    def begins(self) -> Iterator[np.ndarray]:
        """For each level, the first window of each state: states are told by the words that lead to them."""
        new = np.zeros(len(self.windows), bool)
        new[:1] = True
        for level in range(self.windows.shape[1]):
            new[1:] |= self.windows[1:, level] != self.windows[:-1, level]
            yield np.flatnonzero(new)

    def part(self, low: int, high: int) -> Transducer:
        """The paths from the ``low``-th to before the ``high``-th, with the words that they have."""
        windows = self.windows[low:high]
        used = np.zeros(len(self.words) + 1, bool)
        used[windows.ravel()] = True
        used[0] = True
        number = (np.cumsum(used) - 1).astype(np.int32)
        return Transducer(self.words.filter(pa.array(used[1:])), number[windows], self.weights[low:high])

    def to_bytes(self) -> list[bytes]:
        """[words, lengths of words, weights, arcs and numbers of following arcs of each level]."""
        lengths = np.asarray(pc.binary_length(self.words)).astype(np.int64)
        out = [b"".join(self.words.to_pylist()), _packed(lengths), _packed(self.weights)]
        last = np.arange(0)
        states = [*self.begins()]
        for level, at in enumerate(states):
            below = states[level + 1] if level + 1 < len(states) else last
            out.append(_packed(self.windows[at, level]))
            out.append(_packed(np.diff(np.r_[np.searchsorted(below, at), len(below)])) if level + 1 < len(states) else b"")
        return out

    @classmethod
    def from_bytes(cls, parts: list[bytes]) -> Transducer:
        lengths, weights = _unpacked(parts[1]), _unpacked(parts[2])
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int64)), pa.py_buffer(parts[0])])
        windows = np.zeros((len(weights), LONGEST), np.int32)
        follow = np.ones(len(weights), np.int64)  # windows behind each arc, from the last level up
        for level in range(LONGEST - 1, -1, -1):
            arcs = _unpacked(parts[3 + 2 * level])
            if level < LONGEST - 1:
                children = _unpacked(parts[4 + 2 * level])
                follow = np.add.reduceat(follow, np.r_[0, np.cumsum(children)[:-1]]) if len(children) else follow
            windows[:, level] = np.repeat(arcs, follow)
        return cls(words, windows, weights)

    @classmethod
    def union(cls, parts: list[Transducer]) -> Transducer:
        """The sum of several: a path's weight is the sum of its weights in them."""
        every = pa.concat_arrays([t.words for t in parts])
        coded = every.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int32) + np.int32(1)
        at, moved = 0, []
        for t in parts:
            moved.append(np.concatenate([np.zeros(1, np.int32), codes[at : at + len(t.words)]])[t.windows])
            at += len(t.words)
        return cls.counted(coded.dictionary, np.vstack(moved), np.concatenate([t.weights for t in parts]))

    def compose(self, other: Transducer) -> np.ndarray:
        """The weight with which this transducer accepts each path of ``other``, 0 if it does not."""
        numbers = pc.index_in(other.words, value_set=self.words).to_numpy(zero_copy_only=False)
        paths = np.r_[0, np.nan_to_num(numbers, nan=-2).astype(np.int64) + 1][other.windows]
        state, alive = np.zeros(len(paths), np.int64), (paths >= 0).all(axis=1)
        size = len(self.words) + 1
        parent = np.zeros(len(self.windows), np.int64)
        for level, at in enumerate(self.begins()):
            keys = parent[at] * size + self.windows[at, level]  # rising, as windows are in order of their numbers
            wanted = state * size + np.maximum(paths[:, level], 0)
            found = np.searchsorted(keys, wanted)
            alive &= np.r_[keys, -1][found] == wanted
            state = np.where(alive, found, 0)
            new = np.zeros(len(self.windows), np.int64)
            new[at] = 1
            parent = np.cumsum(new) - 1
        return np.where(alive, self.weights[state] if len(self.weights) else 0, 0)


def shard(texts: pa.Array) -> Transducer:
    """The windows of some texts (large_binary, no nulls)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    bounds = (offsets - offsets[0])[:-1]
    bounds = bounds[bounds < len(data)]
    kind = _KIND[data]
    word = kind == 0
    opens, breaks = np.zeros(len(data), bool), (kind == 2).astype(np.int32)
    opens[bounds] = True
    breaks[bounds] += 1
    starts = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | opens))
    ends = np.flatnonzero(word & np.r_[~word[1:] | opens[1:], True]) + 1
    piece = np.cumsum(breaks, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    lengths = ends - starts
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int64)), pa.py_buffer(data[word].tobytes())])
    coded = every.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    ids = rank[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.int32)
    windows = np.zeros((len(ids), LONGEST), np.int32)
    for k in range(LONGEST):
        m = max(0, len(ids) - k)
        windows[:m, k] = np.where(piece[len(ids) - m :] == piece[:m], ids[len(ids) - m :], 0)
    return Transducer.counted(coded.dictionary.take(pa.array(order)), windows, np.ones(len(ids), np.int64))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Transducer]]:
    """A transducer for each language and each ``SHARD`` bytes or so of the rows (lang, text)."""
    held: dict[str, tuple[list[pa.Array], int]] = {}
    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            texts = batch.column(1).filter(pc.equal(langs, lang)).cast(pa.large_binary())
            for text in _bounded(texts):
                parts, size = held.pop(lang, ([], 0))
                parts, size = [*parts, text], size + text.nbytes
                if size >= SHARD:
                    yield lang, shard(pa.concat_arrays(parts))
                else:
                    held[lang] = parts, size
        while sum(size for _, size in held.values()) >= 2 * SHARD:  # many languages: the largest goes
            lang = max(held, key=lambda x: held[x][1])
            yield lang, shard(pa.concat_arrays(held.pop(lang)[0]))
    for lang, (parts, _) in held.items():
        yield lang, shard(pa.concat_arrays(parts))


def _bounded(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in groups of less than ``SHARD`` bytes; a longer text in parts that end with a piece."""
    sizes = np.asarray(pc.binary_length(texts))
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SHARD)))
        if sizes[at] < SHARD:
            yield pa.concat_arrays([texts.slice(at, n)])
            at += n
            continue
        long = texts[at].as_py()
        ends = np.flatnonzero(_KIND[np.frombuffer(long, np.uint8)] == 2) + 1
        low = 0
        while low < len(long):
            fit = ends[(ends > low) & (ends <= low + SHARD)]
            after = ends[ends > low + SHARD]
            high = int(fit[-1]) if len(fit) else int(after[0]) if len(after) else len(long)
            high = len(long) if len(long) - low <= SHARD else high
            yield pa.array([long[low:high]], pa.large_binary())
            low = high
        at += 1


Cut = tuple[str, tuple[bytes, ...]]


def _cuts(rows: DataFrame) -> list[Cut]:
    """Windows at which ranges begin, in order, from about ``SAMPLE`` documents: enough for ``RANGE`` windows a range, and for all tasks."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    ranges = max(shuffle_partitions(rows.sparkSession), int((size or 0) / 6) // RANGE + 1)
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(0)
        for batch in batches:
            for i in range(batch.num_rows):
                part = next(iter(_bounded(batch.column(1).slice(i, 1).cast(pa.large_binary()))))
                t = shard(part)
                if len(t.windows):
                    for row in rng.choice(len(t.windows), min(DRAWN, len(t.windows)), replace=False):
                        path = [t.words[int(w) - 1].as_py() for w in t.windows[row] if w]
                        yield pa.RecordBatch.from_pydict({"lang": [batch.column(0)[i].as_py()], "size": pa.array([len(t.windows)], pa.int64()), "path": pa.array([path], pa.list_(pa.binary()))})

    found = some.mapInArrow(drawn, "lang string, size long, path array<binary>").orderBy(F.xxhash64("path", "lang")).limit(SAMPLE * DRAWN).collect()
    sample = sorted((r.lang, tuple(bytes(w) for w in r.path), r.size / DRAWN) for r in found)
    if not sample:
        return []
    place = np.cumsum([weight for *_, weight in sample])
    at = np.searchsorted(place, place[-1] * np.arange(1, ranges) / ranges)
    return sorted({sample[min(i, len(sample) - 1)][:2] for i in at})


def _places(t: Transducer, cuts: list[tuple[bytes, ...]]) -> list[int]:
    """For each cut, how many paths of a shard lie before it."""
    out, known = [], t.words.to_pylist()
    for cut in cuts:
        low, high = 0, len(t.windows)
        for level, word in enumerate(cut):
            i = bisect.bisect_left(known, word)
            column = t.windows[low:high, level]
            if i < len(known) and known[i] == word:
                low, high = low + int(np.searchsorted(column, i + 1)), low + int(np.searchsorted(column, i + 1, "right"))
            else:
                low = high = low + int(np.searchsorted(column, i + 1))
            if low == high:
                break
        out.append(low)
    return out


_PIECES = [f"p{i}" for i in range(3 + 2 * LONGEST)]


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f) of every phrase of up to ``LONGEST`` words with ``least`` occurrences or more.

    The empty phrase (``words`` 0) is counted as often as there are words, whatever their number.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.sparkSession.sparkContext.broadcast(_cuts(rows))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = [lang for lang, _ in cuts.value]
        for lang, t in _shards(batches):
            own = [i for i, x in enumerate(langs) if x == lang]
            first = sum(x < lang for x in langs)
            edges = [0, *_places(t, [cuts.value[i][1] for i in own]), len(t.windows)]
            for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if low < high:
                    parts = t.part(low, high).to_bytes()
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "r": pa.array([first + i], pa.int32())} | {c: pa.array([p], pa.binary()) for c, p in zip(_PIECES, parts, strict=True)})

    def united(key: tuple, table: pa.Table) -> pa.Table:
        lang, at = key[0].as_py(), key[1].as_py()
        t = Transducer.union([Transducer.from_bytes([row[c] for c in _PIECES]) for batch in table.to_batches() for row in batch.to_pylist()])
        edge = {p for i in (at - 1, at) if 0 <= i < len(cuts.value) for p in [cuts.value[i][1]]}
        edge = {p[:n] for p in edge for n in range(1, LONGEST + 1)}
        phrases, sizes, counts = [b""], [0], [int(t.weights.sum())]
        known = t.words
        for level, begin in enumerate(t.begins()):
            f = np.add.reduceat(t.weights, begin)
            keep = t.windows[begin, level] > 0
            may = keep & (f >= least)
            rest = {p for p in edge if len(p) == level + 1}
            for i in np.flatnonzero(may):
                phrases.append(b" ".join(known[int(w) - 1].as_py() for w in t.windows[begin[i], : level + 1]))
                sizes.append(level + 1)
                counts.append(int(f[i]))
            for p in rest:  # a cut may part these
                numbers = pc.index_in(pa.array(p, pa.large_binary()), value_set=known).to_pylist()
                if None not in numbers:
                    hit = np.flatnonzero((t.windows[begin, : level + 1] == np.array(numbers) + 1).all(axis=1))
                    if len(hit) and f[hit[0]] < least:
                        phrases.append(b" ".join(p))
                        sizes.append(level + 1)
                        counts.append(int(f[hit[0]]))
        return pa.table({"lang": [lang] * len(phrases), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "words": pa.array(sizes, pa.int32()), "f": pa.array(counts, pa.int64())})

    pieces = ", ".join(f"{c} binary" for c in _PIECES)
    parts = rows.mapInArrow(built, f"lang string, r int, {pieces}")
    found = parts.groupBy("lang", "r").applyInArrow(united, "lang string, phrase string, words int, f long")
    summed = found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return checkpointed(summed.where((F.col("f") >= least) | (F.col("words") == 0)))


def _paths(words: list[list[bytes]], weights: np.ndarray | None = None) -> tuple[Transducer, np.ndarray]:
    """A transducer of distinct paths, and the place of each among its windows."""
    sizes = np.array([len(w) for w in words], np.int64)
    coded = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    windows = np.zeros((len(words), LONGEST), np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    windows[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = rank[coded.indices.to_numpy()] if len(row) else 0
    at = _order(windows, len(order))
    weights = np.ones(len(words), np.int64) if weights is None else weights
    place = np.empty(len(at), np.int64)
    place[at] = np.arange(len(at))
    return Transducer(coded.dictionary.take(pa.array(order)), windows[at], weights[at]), place


def part_counts(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, part, f) of distinct ``parts`` (lang, part) that ``counts`` has, by composition cell by cell."""
    cells = shuffle_partitions(parts.sparkSession)
    cell = lambda c: F.pmod(F.xxhash64("lang", c), F.lit(4 * cells)).cast("int").alias("cell")

    def composed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        asked = left.column("part").to_pylist()
        if not asked or not right.num_rows:
            asked, f = [], np.zeros(0, np.int64)
        else:
            split = lambda column: [p.encode().split(b" ") for p in column]
            counted, _ = _paths(split(right.column("phrase").to_pylist()), right.column("f").to_numpy().astype(np.int64))
            wanted, place = _paths(split(asked))
            f = counted.compose(wanted)[place]
        return pa.table({"lang": pa.array([lang] * len(asked), pa.string()), "part": pa.array(asked, pa.string()), "f": pa.array(f, pa.int64())})

    own = counts.where("words > 0").select("lang", cell("phrase"), "phrase", "f")
    return parts.select("lang", cell("part"), "part").groupBy("lang", "cell").cogroup(own.groupBy("lang", "cell")).applyInArrow(composed, "lang string, part string, f long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = 2_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two words or more.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of its worst cut, ``n`` the number
    of words, ``score`` floor(1000 a n / (l r)).  Phrases inside a longer candidate that occurs as often
    are left out.  Ties go to the larger count, then to the smaller phrase in byte order.
    """
    counts = phrase_counts(docs, least)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    phrases = counts.where("words >= 2").withColumn("_w", F.split("phrase", " "))
    piece = lambda start, length: F.array_join(F.slice("_w", start, length), " ")
    # A phrase of one word more that occurs as often hides both of its own ends; longer ones hide through those between.
    inside = phrases.where("words > 2").select("lang", "f", F.explode(F.array(piece(F.lit(1), F.col("words") - 1), piece(F.lit(2), F.col("words") - 1))).alias("phrase"))
    hidden = inside.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    left = phrases.join(hidden, ["lang", "phrase"], "left").where("_longer is null or _longer < f").drop("_longer")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = checkpointed(cuts.select("lang", "phrase", F.col("f").alias("a"), "k", piece(F.lit(1), F.col("k")).alias("_first"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("_rest")))
    asked = cuts.select("lang", F.col("_first").alias("part")).unionByName(cuts.select("lang", F.col("_rest").alias("part"))).distinct()
    found = checkpointed(part_counts(asked, counts))
    of = lambda part, name: found.select("lang", F.col("part").alias(part), F.col("f").alias(name))
    known = cuts.join(of("_first", "l"), ["lang", "_first"]).join(of("_rest", "r"), ["lang", "_rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    known = known.withColumns({"_up": (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)")) * wide("n"), "_down": wide("l") * wide("r")})
    known = known.withColumn("score", F.expr("_up div _down"))
    worst = known.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w")).select("lang", "phrase", "a", "n", "w.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return worst.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
