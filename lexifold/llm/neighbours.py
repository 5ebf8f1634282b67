"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A unit vector goes through three rounds of random sign flips and fast Hadamard transforms; the
nearest signed axis is its hash.  A query looks into the buckets of its nearest axes in each table.
Candidates are reranked by their inner product in double precision on the vectors as they are.

Hashes in a key (one or two) and probes are fitted together on a bounded sample, and on nothing else: for
each number of hashes the fewest probes with which ``TARGET`` of the sample's true neighbours are
found, all buckets being probes if it takes that, then the number with which less is looked at.  The
neighbours of a denser table lie nearer than those of the sample, so the recall holds at every size;
how much is looked at depends on the vectors.  Near-orthogonal ones have a large share looked at
(README has figures), clustered ones a small one.  Every vector is indexed.  Equal vectors are indexed
once, with their smallest ids, so a vector that a third of the rows share is one entry.  A bucket is
cut into blocks of ``BLOCK`` vectors, and of as many queries, so that no group grows with the data; each
block gives its best for each of its queries, and the best of these are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

TABLES = 8
BLOCK = 4_096
SAMPLE, SAMPLE_QUERIES, TARGET = 4_096, 128, 0.95
#: Keys of two hashes are tried if there are no more of them than this, and taken if they look at no more than this share of what keys of one do.
MOST_KEYS, WORTH = 1 << 16, 0.5


@dataclass
class Index:
    """What it takes to hash: signs of the rotations, the hashes in a key, and the fitted probes."""

    signs: np.ndarray  # tables, hashes, 3, width
    largest: float | None  # the largest norm, where norms differ: vectors are then lifted onto a sphere
    probes: int

    def _axes(self, x: np.ndarray, table: int, i: int) -> np.ndarray:
        """Signed coordinates (rows, 2 * width) of a pseudo-rotation."""
        n, width = x.shape
        for s in self.signs[table, i]:
            x, h = x * s, 1
            while h < width:
                x = x.reshape(n, width // (2 * h), 2, h)
                x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
                h *= 2
        return np.concatenate([x, -x], axis=1) / width**1.5

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors of the tables' width, on which a larger inner product is a smaller angle."""
        out = np.zeros((len(x), self.signs.shape[-1]))
        norms = np.linalg.norm(x, axis=1)
        if self.largest is None or query:
            out[:, : x.shape[1]] = x / norms[:, None]
        else:
            out[:, : x.shape[1]] = x / self.largest
            out[:, -1] = np.sqrt(np.maximum(0, 1 - (norms / self.largest) ** 2))
        return out

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for i in range(self.signs.shape[1]):
            code = code * (2 * x.shape[1]) + self._axes(x, table, i).argmax(axis=1)
        return code

    def probed(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """Buckets (rows, probes) of the nearest axes, nearest first."""
        sides = [self._axes(x, table, i) for i in range(self.signs.shape[1])]
        total = sides[0]
        for side in sides[1:]:  # every pair of axes is a bucket
            total = (total[:, :, None] + side[:, None, :]).reshape(len(x), -1)
        if probes < total.shape[1]:
            some = np.argpartition(-total, probes - 1, axis=1)[:, :probes]
            return np.take_along_axis(some, np.argsort(-np.take_along_axis(total, some, 1), axis=1, kind="stable"), 1)
        return np.argsort(-total, axis=1, kind="stable")

    @property
    def most_probes(self) -> int:
        return (2 * self.signs.shape[-1]) ** self.signs.shape[1]


def fit(sample: np.ndarray, largest: float | None, k: int, tables: int = TABLES, seed: int = 0) -> Index:
    """The hashes and probes that find ``TARGET`` of the sample's ``k`` nearest and look at least at."""
    rng = np.random.default_rng(seed)
    width = 1 << max(1, int(np.ceil(np.log2(max(2, sample.shape[1] + (largest is not None))))))
    asked = rng.permutation(len(sample))[:SAMPLE_QUERIES]
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    truth = np.argsort(-near, axis=1)[:, :k]
    chosen, least = None, np.inf
    for hashes in (1, 2):
        index = Index(rng.choice([-1.0, 1.0], (tables, hashes, 3, width)), largest, 1)
        if hashes > 1 and index.most_probes > MOST_KEYS:
            break
        if len(sample) <= k + 1:  # everything is a neighbour
            index.probes = index.most_probes
            return index
        stored, asking = index.lift(sample, False), index.lift(sample[asked], True)
        first = np.full(truth.shape, index.most_probes)  # the place in the order of probes that first finds each neighbour
        counts = []
        for t in range(tables):
            codes = index.buckets(stored, t)
            order = index.probed(asking, t, index.most_probes)
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(order.shape[1])[None].repeat(len(order), 0), 1)
            first = np.minimum(first, np.take_along_axis(place, codes[truth], 1))
            counts.append(np.bincount(codes, minlength=index.most_probes).astype(np.uint16)[order])
        index.probes = min(index.most_probes, int(np.quantile(first, TARGET, method="higher")) + 1)
        looked = sum(int(c[:, : index.probes].sum()) for c in counts) / (len(asked) * len(sample))
        if looked < least * (1.0 if chosen is None else WORTH):
            chosen, least = index, looked
    return chosen


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vector) of rows that take part, all of the most frequent length; floats stay floats, others are doubles."""
    kind = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    parts = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    parts = parts.where(F.col("vec_id").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    sizes = parts.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return parts.where(F.size("vector") == (sizes[0] if sizes else 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each row whose id ``every`` divides.

    Ties go to the smaller id; a row is not its own neighbour.  Rows with a null id, and vectors that
    are null, zero, of an odd length or hold null or non-finite components, take no part.  An id that
    occurs with several vectors counts once for each as a candidate.
    """
    rows = _usable(vectors, vec_id, embedding)
    # Equal vectors are one entry with its k + 1 smallest ids (the query's own may be among them).
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    entries = rows.withColumn("_n", nth).where(F.col("_n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    entries = checkpointed(entries.select(F.element_at("members", 1).alias("entry"), F.xxhash64("vector").alias("mark"), "vector", "members"))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector")
    asked = checkpointed(asked.join(entries.select("vector", "entry", "mark"), "vector").select("query_id", "entry", "mark"))

    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, low, high = entries.agg(F.count(F.lit(1)), F.min(norm), F.max(norm)).first()
    sample = entries.orderBy(F.xxhash64("entry", "mark")).limit(SAMPLE).select("vector").collect()
    points = np.array([r[0] for r in sample], np.float64) if sample else np.zeros((0, 1))
    index = entries.sparkSession.sparkContext.broadcast(fit(points, high if n and high - low > 1e-6 * high else None, k))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = index.value.lift(_matrix(batch.column(2)), False)
            for t in range(len(index.value.signs)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(index.value.buckets(x, t)), *batch.columns], ["t", "bucket", "entry", "mark", "vector"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = index.value.lift(_matrix(part.column(2)), True)
                for t in range(len(index.value.signs)):
                    code = index.value.probed(x, t, index.value.probes)
                    repeated = part.take(pa.array(np.repeat(np.arange(len(x)), code.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(code.size, t, np.int32)), pa.array(code.ravel()), *repeated.columns], ["t", "bucket", "entry", "mark", "vector"])

    def counting(of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in of(iter([batch])):
                    yield part.select(["t", "bucket"])

        return run

    schema = f"t int, bucket long, entry long, mark long, vector {entries.schema['vector'].dataType.simpleString()}"
    source = entries.select("entry", "mark", "vector")
    wanted = checkpointed(source.join(asked.select("entry", "mark").distinct(), ["entry", "mark"], "left_semi"))
    kept, asking = source.mapInArrow(stored, schema), wanted.mapInArrow(probing, schema)

    # Blocks: a bucket's vectors and its queries are dealt by a hash, each into as many as it takes.
    blocks = lambda df, name: df.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    codes = lambda df, of: df.mapInArrow(counting(of), "t int, bucket long")  # noqa: E731  no vector leaves the task
    deal = blocks(codes(source, stored), "stored_in").join(blocks(codes(wanted, probing), "asked_in"), ["t", "bucket"])
    deal = checkpointed(deal)
    share = lambda n: F.pmod(F.xxhash64("entry", "mark"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = kept.join(deal, ["t", "bucket"]).withColumn("i", share("stored_in")).withColumn("j", each("asked_in")).drop("stored_in", "asked_in")
    asking = asking.join(deal, ["t", "bucket"]).withColumn("j", share("asked_in")).withColumn("i", each("stored_in")).drop("stored_in", "asked_in")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, found = left.combine_chunks(), right.combine_chunks()
        names = ["q_entry", "q_mark", "entry", "mark", "score"]
        if not len(queries) or not len(found):
            return pa.table({x: pa.array([], pa.float64() if x == "score" else pa.int64()) for x in names})
        q, x = (_matrix(t.column("vector").combine_chunks() if isinstance(t.column("vector"), pa.ChunkedArray) else t.column("vector")) for t in (queries, found))
        entry, mark = found.column("entry").to_numpy(), found.column("mark").to_numpy()
        rows, places, values = [], [], []
        for at in range(0, len(q), 256):
            score = q[at : at + 256] @ x.T
            order = np.lexsort((mark[None].repeat(len(score), 0), entry[None].repeat(len(score), 0), -score), axis=1)[:, : k + 1] if len(x) <= 4 * k else _top(score, entry, k + 1)
            rows.append(np.repeat(np.arange(at, at + len(score)), order.shape[1]))
            places.append(order.ravel())
            values.append(np.take_along_axis(score, order, 1).ravel())
        row, place = np.concatenate(rows), np.concatenate(places)
        return pa.table({"q_entry": queries.column("entry").to_numpy()[row], "q_mark": queries.column("mark").to_numpy()[row], "entry": entry[place], "mark": mark[place], "score": np.concatenate(values)})

    keys = ["t", "bucket", "i", "j"]
    found = asking.groupBy(*keys).cogroup(kept.groupBy(*keys)).applyInArrow(best, "q_entry long, q_mark long, entry long, mark long, score double")
    found = found.groupBy("q_entry", "q_mark", "entry", "mark").agg(F.max("score").alias("score"))
    top = Window.partitionBy("q_entry", "q_mark").orderBy(F.desc("score"), "vec_id")
    ids = found.withColumn("_n", F.row_number().over(Window.partitionBy("q_entry", "q_mark").orderBy(F.desc("score"), "entry"))).where(F.col("_n") <= k + 1)
    ids = ids.join(entries.select("entry", "mark", "members"), ["entry", "mark"]).select("q_entry", "q_mark", "score", F.explode("members").alias("vec_id"))
    ids = ids.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k + 1).drop("_n")
    answers = asked.join(ids, (asked.entry == ids.q_entry) & (asked.mark == ids.q_mark)).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_mark").orderBy(F.desc("score"), "vec_id"))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _top(score: np.ndarray, entry: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of each row, ties to the smaller entry."""
    k = min(k, score.shape[1])
    edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    out = np.empty((len(score), k), np.int64)
    for i, (row, least) in enumerate(zip(score, edge, strict=True)):
        at = np.flatnonzero(row >= least)
        out[i] = at[np.lexsort((entry[at], -row[at]))][:k]
    return out
