"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints within ``radius`` differing bits are found through ``2 ** (radius + 1) - 1`` masks.
Bit ``i`` has a vector ``m(i)`` of ``radius + 1`` bits; the mask for a vector ``v`` keeps the bits
whose ``m(i)`` has an odd overlap with ``v``.  Any ``radius`` differing bits leave some ``v`` that
overlaps all of theirs evenly, so in that table the two fingerprints have the same key: no pair
within the radius is missed, by construction and not by chance.

Work is on distinct fingerprints (a group of copies is one), and no bucket's pairs are written out.
For radius 2 a bucket is settled through midpoints: two fingerprints within two bits share a value
that is within one bit of both, and all that share one are linked to the smallest of them.  A value
has 65 such neighbours at most, so these groups are small however large the bucket is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, slices
from .components import components

SEED = 42


def words_of(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All runs of ``size`` words, repeats included; of fewer words, the whole sequence."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(run) for run in zip(*(words[i:] for i in range(size)), strict=False)]


def majority(hashes: np.ndarray) -> int:
    """The 64-bit value whose bits are those set in over half of the hashes."""
    counts = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, size: int = 3, seed: int = SEED) -> int:
    runs = shingles(words_of(text), size)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, seed) for s in runs], np.uint64)) if runs else 0


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; a text without words has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [fingerprint(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _signed(values)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The masks, as signed 64-bit values; every one keeps a little over half of the bits."""
    width = radius + 1
    kinds = (1 << width) - 1
    # Neighbouring bits get vectors far apart; all vectors are used about equally often.
    step = next(s for s in range(max(1, kinds * 3 // 5), 2 * kinds + 2) if np.gcd(s, kinds) == 1)
    vectors = [(i * step) % kinds + 1 for i in range(bits)]
    masks = []
    for v in range(1, 1 << width):
        kept = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        masks.append(kept - (1 << 64) if kept >> 63 else kept)
    return masks


def keyed(fps: DataFrame, column: str, masks: list[int]) -> DataFrame:
    """A row for each fingerprint and table: ``mask`` and ``key`` = the kept bits."""
    return fps.withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))).withColumn("key", F.col(column).bitwiseAND(F.col("mask")))


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows whose (mask, key) another row has too."""
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("mask", "key"))).where("_n > 1").drop("_n")


def links_within_two(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join all distinct ``fp`` linked by two or fewer differing bits."""
    rows = _crowded(keyed(fps.select("fp"), "fp", covering_masks(2)))
    singles: Column = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)))
    free = F.filter(singles, lambda one: one.bitwiseAND(F.col("mask")) == 0)
    middles = rows.withColumn("_one", F.explode(free)).select("mask", "key", "fp", F.col("fp").bitwiseXOR(F.col("_one")).alias("middle"))
    lowest = F.min("fp").over(Window.partitionBy("mask", "key", "middle"))
    return middles.withColumn("low", lowest).where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def near_components(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row: fingerprints of ``size``-word shingles, linked within two bits.

    ``component_id`` is the smallest doc_id that can be reached.  Texts without words (null and empty
    ones too) have fingerprint zero and are linked like any other.  Rows without an id take part but
    never name a component, unless it has no other rows.
    """
    prints = checkpointed(fingerprints(docs, size))
    held = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = checkpointed(links_within_two(held))
    roots = components(edges)
    firsts = held.join(roots, held.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named = firsts.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def query_components(docs: DataFrame) -> DataFrame:
    found = near_components(docs, 3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For near duplicates by text: bits in which the prints of sets of words may differ to be candidates for certain.
RADIUS = 2
#: Texts whose shingles are counted to put rare ones first, texts of these that make a shingle
#: frequent, and frequent shingles that are told apart.  They move the work, never the result.
COUNTED, FREQUENT, TOLD_APART = 16_384, 3, 200_000
#: Rows of a crowded bucket that one task holds against those of other groups.
BLOCK = 1_024
#: Up to so many ids (8 MB) are broadcast to find their texts; more are joined by a shuffle.
FEW_IDS = 1_000_000
#: Words whose hashes a worker keeps.
CACHE = 60_000


class _WordPrints:
    """SimHash prints of sets of words; keeps hashes of words, ``CACHE`` of them at most."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> int:
        own = set(words)
        if len(self.known) + len(own) > CACHE:
            self.known.clear()
        new = {w: xxhash.xxh64_intdigest(w, SEED) for w in own if w not in self.known}
        hashes = np.array([new[w] if w in new else self.known[w] for w in own], np.uint64)
        if len(new) <= CACHE:
            self.known |= new
        return majority(hashes) if own else 0


def _runs(words: list[bytes], size: int) -> np.ndarray:
    """The set of 32-bit hashes of the shingles, in order."""
    return np.unique(np.array([xxhash.xxh32_intdigest(s) for s in shingles(words, size)], np.uint32).view(np.int32))


def _digests(docs: DataFrame) -> DataFrame:
    """(doc_id, exact): a digest of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [xxhash.xxh3_128_hexdigest(b" ".join(words_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "exact"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, exact string")


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, runs array<int>): the set of 32-bit hashes of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [_runs(words_of(t), size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int32()))], ["doc_id", "runs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, runs array<int>")


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of about ``COUNTED`` texts, in order, and the number of these texts that have them."""
    every = max(1, docs.count() // COUNTED)
    some = _shingle_sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0), size)
    counts = some.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    table = counts.orderBy(F.desc("n"), "run").limit(TOLD_APART).toArrow()
    runs, n = table.column("run").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(runs)
    return runs[order], n[order]


def _prefixes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(doc_id, exact, fp, n, marks, prefix): a digest of the word sequence, the SimHash print of the set of
    words, the number of shingles, their parities by 256 cells, and the first shingles in an order that
    all texts share, rare ones first.

    Two sets of which the larger has ``n`` shingles have ``similarity * n`` or more in common if they
    are near, so they share one of the first ``n - ceil(similarity * n) + 1`` of each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        prints = _WordPrints()
        for batch in slices(batches):
            exact, fps, n, marks, prefix = [], [], [], [], []
            for t in batch.column("text").to_pylist():
                words = words_of(t)
                exact.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                fps.append(prints.of(words))
                runs = _runs(words, size)
                n.append(len(runs))
                marks.append(np.packbits(np.bincount(runs & 255, minlength=256) % 2 == 1).view(np.int64))
                often = np.zeros(len(runs), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
                    often = np.where(frequent[at] == runs, counts[at], 0)
                first = len(runs) - math.ceil(similarity * len(runs) - 1e-9) + 1 if len(runs) else 0
                prefix.append(runs[np.lexsort((runs, often))[:first]])
            columns = [pa.array(exact, pa.string()), _signed(fps), pa.array(n, pa.int32()), pa.array(marks, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "exact", "fp", "n", "marks", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, exact string, fp long, n int, marks array<long>, prefix array<int>")


def _may_be_near(similarity: float, a: str, b: str) -> Column:
    """Never false for near sets: neither their sizes nor the cells of odd count can differ by more."""
    apart = sum((F.bit_count(F.col(f"{a}.marks")[i].bitwiseXOR(F.col(f"{b}.marks")[i])) for i in range(4)), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) + 1e-6 >= similarity * F.greatest(n, m)) & (apart * (1 + similarity) <= (n + m) * (1 - similarity) + 1e-6)


def _share_enough(similarity: float, a: str, b: str) -> Column:
    """Never false for near sets: what they share lies in both prefixes or behind one of them.

    ``shared`` are the shingles of a prefix that other texts' prefixes have, ``behind`` is the number of shingles after it.
    """
    none = F.array().cast("array<int>")
    both = F.size(F.array_intersect(F.coalesce(F.col(f"{a}.shared"), none), F.coalesce(F.col(f"{b}.shared"), none)))
    most = both + F.greatest(F.col(f"{a}.behind"), F.col(f"{b}.behind"))
    return most * (1 + similarity) + 1e-6 >= similarity * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, group_id) of all rows with an id; group_id is the smallest id of a group of near duplicates.

    Texts are near duplicates if the sets of their ``size``-word shingles have a Jaccard similarity of
    ``similarity`` or more; groups are connected.  Copies (the same sequence of words, none included)
    are one text.

    Candidates come from two kinds of buckets: the covering tables of the SimHash prints of the sets of
    words, which hold all pairs within ``RADIUS`` bits, and the shingles of the prefixes (see
    ``_prefixes``), which hold every near pair, as prints alone do not.  First each text is compared with two others of each of its
    buckets; what the prints find is connected then.  After that, where a prefix's bucket has texts of
    several groups, every text outside its largest group is compared with all of other groups, so that
    each near pair has been compared or was connected already.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    one = _prefixes(known, size, similarity).groupBy("exact").agg(F.min(F.struct("doc_id", "fp", "n", "marks", "prefix")).alias("t"))
    texts = checkpointed(one.select("exact", F.col("t.doc_id").alias("text_id"), "t.fp", "t.n", "t.marks", "t.prefix"))

    def links(pairs: DataFrame) -> DataFrame:
        """The near ones of ``pairs`` (a, b)."""
        facts = texts.join(shared, "text_id", "left").select("text_id", F.struct("n", "marks", "shared", (F.col("n") - F.size("prefix")).alias("behind")).alias("f"))
        left, right = facts.select(F.col("text_id").alias("a"), F.col("f").alias("fa")), facts.select(F.col("text_id").alias("b"), F.col("f").alias("fb"))
        likely = checkpointed(pairs.distinct().join(left, "a").join(right, "b").where(_may_be_near(similarity, "fa", "fb") & _share_enough(similarity, "fa", "fb")).select("a", "b"))
        wanted = checkpointed(likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct())
        if wanted.count() <= FEW_IDS:
            wanted = F.broadcast(wanted)
        sets = checkpointed(_shingle_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), size))
        left, right = sets.select(F.col("doc_id").alias("a"), F.col("runs").alias("a_runs")), sets.select(F.col("doc_id").alias("b"), F.col("runs").alias("b_runs"))
        compared = likely.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("a_runs", "b_runs")))
        return checkpointed(compared.where(F.col("both") >= similarity * (F.size("a_runs") + F.size("b_runs") - F.col("both"))).where("both > 0").select("a", "b"))

    def some_pairs(rows: DataFrame, *bucket: str) -> DataFrame:
        """Each row of a bucket of two or more with the bucket's first one and the one before it."""
        order = Window.partitionBy(*bucket).orderBy(F.xxhash64("text_id"), "text_id")
        return rows.withColumns({"_first": F.first("text_id").over(order), "_before": F.lag("text_id").over(order), "_after": F.lead("text_id").over(order)}).where("_before is not null or _after is not null").drop("_after")

    tables = keyed(texts.where("n > 0").select("text_id", "fp"), "fp", covering_masks(RADIUS)).drop("fp")
    by_print = some_pairs(tables, "mask", "key")
    rows = checkpointed(some_pairs(texts.select("text_id", F.posexplode("prefix").alias("at", "run")), "run"))
    shared = checkpointed(rows.groupBy("text_id").agg(F.collect_list("run").alias("shared")))
    both = by_print.select("text_id", "_first", "_before").unionByName(rows.select("text_id", "_first", "_before")).where("_before is not null")
    pairs = both.select("text_id", F.explode(F.array("_first", "_before")).alias("o")).where("text_id <> o")
    found = links(pairs.select(F.greatest("text_id", "o").alias("a"), F.least("text_id", "o").alias("b")))

    # Buckets of several groups; their largest group is settled in itself.
    roots = components(found)
    facts = texts.join(roots, texts.text_id == roots.node, "left").select("text_id", F.coalesce("root", "text_id").alias("root"))
    rows = checkpointed(rows.select("run", "text_id", "at").join(facts, "text_id"))
    groups = rows.groupBy("run", "root").agg(F.count(F.lit(1)).alias("rows"))
    mixed = groups.groupBy("run").agg(F.max_by("root", F.struct("rows", "root")).alias("largest"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    held = rows.join(mixed.select("run", "largest", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "run").join(texts.select("text_id", "n", "marks"), "text_id")
    left = held.where("root <> largest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = held.withColumn("block", F.pmod(F.xxhash64(F.lit(1), F.col("text_id")), F.col("blocks")).cast("int"))
    x, y = left.alias("x"), right.alias("y")
    common = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))  # at most, from the first shared shingle on
    enough = common * (1 + similarity) + 1e-6 >= similarity * (F.col("x.n") + F.col("y.n"))
    same = (F.col("x.run") == F.col("y.run")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.root") != F.col("y.root"))
    pairs = x.join(y, same & enough & _may_be_near(similarity, "x", "y")).select(F.greatest("x.text_id", "y.text_id").alias("a"), F.least("x.text_id", "y.text_id").alias("b"))
    roots = components(found.unionByName(links(pairs)))
    groups = texts.join(roots, texts.text_id == roots.node, "left").select("exact", F.coalesce("root", "text_id").alias("group_id"))
    return _digests(known).join(groups, "exact").select("doc_id", "group_id")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near duplicates: of each group the row with the smallest id stays.

    Rows without an id stay; rows that share an id stay or go together.
    """
    gone = checkpointed(near_duplicates(docs, **options).where("doc_id <> group_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
