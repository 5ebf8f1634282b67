"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Row ``g`` of ``n`` goes to place ``p = permute(g)``; its shard is ``p % shards`` and its slot
``p div shards``.  Anyone who knows ``(n, seed, shards)`` can compute both from ``g`` alone, and
shard sizes differ by one at most whatever the data look like.  The plan has no Python and one
narrow shuffle (id, size, checksum); the text itself never moves.
"""

from __future__ import annotations

import random
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions

_PRIME = 2_147_483_647  # products of two residues stay inside 63 bits
_ROUNDS = 6


class Permutation:
    """A keyed bijection of ``[0, n)``: an unbalanced Feistel network on ``[0, a) x [0, b)``.

    ``a * b`` exceeds ``n`` by less than ``a``, about the square root of ``n``.  A value that lands
    at ``n`` or above is permuted again (cycle walking).  ``depth`` is the longest such walk that
    starts inside ``[0, n)``; it is found by following the fewer than ``a`` outside points, so the
    unrolled expression is exact and not merely likely to be.
    """

    def __init__(self, n: int, seed: int = 0):
        self.n, self.a = n, isqrt(max(n - 1, 0)) + 1
        self.b = max(1, -(-n // self.a))
        rng = random.Random(f"{seed}/{n}")
        self.keys = [tuple(rng.randrange(1, _PRIME) for _ in range(3)) for _ in range(_ROUNDS)]
        self.depth = self._longest_walk()

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i, (m, c, d) in enumerate(self.keys):
            t = ((right if i % 2 == 0 else left) * m + c) % _PRIME
            t = (t * t + d) % _PRIME
            if i % 2 == 0:
                left = (left + t) % self.a
            else:
                right = (right + t) % self.b
        return left * self.b + right

    def _longest_walk(self) -> int:
        outside = range(self.n, self.a * self.b)
        after = {x: self._once(x) for x in outside}
        starts = set(outside) - set(after.values())
        longest = 0
        for x in starts:  # reached from inside, so the walk leaves again
            steps = 0
            while x >= self.n:
                x, steps = after[x], steps + 1
            longest = max(longest, steps)
        return longest

    def __call__(self, x: int) -> int:
        x = self._once(x)
        while x >= self.n:
            x = self._once(x)
        return x

    def _step(self, df: DataFrame, col: str, walking: bool) -> DataFrame:
        """One application of the network to ``col``; when walking, only to values outside."""
        df = df.withColumns({"_left": F.expr(f"{col} div {self.b}"), "_right": F.col(col) % self.b})
        for i, (m, c, d) in enumerate(self.keys):
            source, target, size = ("_right", "_left", self.a) if i % 2 == 0 else ("_left", "_right", self.b)
            df = df.withColumn("_t", (F.col(source) * m + c) % _PRIME)
            df = df.withColumn(target, (F.col(target) + (F.col("_t") * F.col("_t") + d) % _PRIME) % size)
        out: Column = F.col("_left") * self.b + F.col("_right")
        if walking:
            out = F.when(F.col(col) >= self.n, out).otherwise(F.col(col))
        return df.withColumn(col, out).drop("_left", "_right", "_t")

    def apply(self, df: DataFrame, source: str, target: str) -> DataFrame:
        df = df.withColumn(target, F.col(source).cast("long"))
        for k in range(self.depth + 1):
            df = self._step(df, target, walking=k > 0)
        return df


def with_row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with gapless numbers from 0 in the order of ``order``, and the number of rows.

    The rows are range-partitioned on all of ``order`` (a key that holds a third of the rows is
    split by the later columns), sorted inside partitions and written to the checkpoint folder;
    a number is the offset of the partition plus the place in it.  Only one count for each
    partition is gathered.  Rows that agree in all of ``order`` take neighbouring numbers.
    """
    spark = df.sparkSession
    n_parts = shuffle_partitions(spark)
    ranged = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))  # a row for each partition
    total = counts.agg(F.sum("_n")).first()[0] or 0
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.drop("_at", "_part", "_offset"), total


def shard_rows(df: DataFrame, order: list[str], shards: int = 16, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` and ``slot``; shard sizes differ by one at most, slots are gapless from 0.

    An empty table gives an empty result.  Nulls in ``order`` sort first; repeated rows get places
    of their own.  Extra columns pass through (put wide ones back by a join on the row's key).
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    numbered, total = with_row_numbers(df, order, "_g")
    placed = Permutation(total, seed).apply(numbered, "_g", "_p")
    return placed.withColumns({"shard": (F.col("_p") % shards).cast("int"), "slot": F.expr(f"_p div {shards}")}).drop("_g", "_p")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Shard and slot of every document under the law ``rows``; a null text has size 1 and checksum 0."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard_rows(narrow, ["doc_id", "size", "text_crc32"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
