"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


#: Up to so many edges (3 MB) a round is one task without a shuffle; with more its steps are shuffled.
FEW = 200_000


def _pairs(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A row (a, b) for each of ``pairs`` of columns of each row."""
    each = F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs)))
    return rows.select(each.alias("_p")).select("_p.a", "_p.b")


def _with_low(rows: DataFrame, few: bool) -> DataFrame:
    """``rows`` with ``low``, the smallest b of each a: by a join, as one a may have very many rows, or by a window where they are ``few``.

    Spark shuffles both sides of a join also where each is one partition; a window over one partition stays in it.
    """
    low: Column = F.min("b")
    return rows.withColumn("low", low.over(Window.partitionBy("a"))) if few else rows.join(rows.groupBy("a").agg(low.alias("low")), "a")


def _large_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Every neighbour above a node is linked to the smallest node around it."""
    both = _with_low(_pairs(edges, ("a", "b"), ("b", "a")), few)
    return both.where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b"))


def _small_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """A node and its neighbours below are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    return _pairs(_with_low(down, few), ("b", "low"), ("a", "low")).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node reachable.

    Each round is a few shuffles (none with ``FEW`` edges or less) and one written checkpoint; it ends when the edges are stars, as seen
    from a count and a sum over them.  The number of rounds grows with the logarithm of the longest
    path.  Self-loops are allowed, an empty table gives an empty result.
    """
    edges = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    few, before = edges.count() <= FEW, None
    for _ in range(most_rounds):
        if few:
            edges = edges.coalesce(1)  # no round adds edges
        edges = checkpointed(_small_star(_large_star(edges, few), few))
        now = (edges.coalesce(1) if few else edges).agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no stars after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
