"""Mixing sources to target weights by temperature.

Source shares of the tokens are exponentiated and normalised: ``w ~ p ** alpha``.  A smaller exponent
makes the mixture flatter, and repeats small sources more often.  ``alpha`` is found by bisection: the
largest that reaches the target entropy, or, if that would repeat some source more often than the
limit, the smallest that keeps the limit.

Sources are never gathered: a pass of the bisection sums over the table of their totals, for several
exponents at once, and what is known of a source is a row of a table.

The weights are realised as budgeted block permutations.  A source's budget is a number of tokens:
whole passes over the source, and for the rest a permutation of its blocks (documents by a hash of
their ids) up to the budget; the block that crosses it is permuted in the same way by smaller
blocks, and in the small one that crosses, documents go in the order of another hash.  A source's
decision is thus five numbers - passes, the block and the small block where the last pass ends, and
the last document in it - so documents are dealt where they are read and their texts are never
shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Blocks of a source, and small blocks of a block, at most; those of one source are put in order in one task.
BLOCKS = 4_096
BLOCK_ROWS = 256
#: Up to so many sources (some 20 MB) their decisions are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 200_000
#: Exponents that one pass of the bisection looks at (four halvings), and passes.
AT_ONCE, PASSES = 15, 10


def n_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a text without words counts as one."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


#: For each exponent ``a`` the sums over all sources of ``p ** a`` and of ``p ** a * log p``.
Sums = Callable[[list[float]], list[tuple[float, float]]]


def _sums(totals: DataFrame, total: int) -> Sums:
    share = totals.select((F.col("tokens") / total).alias("p"))

    def at(alphas: list[float]) -> list[tuple[float, float]]:
        each = share.withColumn("a", F.explode(F.array(*map(F.lit, sorted(set(alphas)))))).withColumn("x", F.pow("p", "a"))
        found = {r.a: (r.z, r.s) for r in each.groupBy("a").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.log("p")).alias("s")).collect()}  # a row for each exponent
        return [found[a] for a in alphas]

    return at


def _bisect(ok: Callable[[list[float]], list[bool]], low: float = 0.0, high: float = 1.0) -> float:
    """The point between ``low`` (where ``ok`` holds) and ``high`` up to which it holds."""
    for _ in range(PASSES):
        points = [low + (high - low) * i / (AT_ONCE + 1) for i in range(1, AT_ONCE + 1)]
        held = ok(points)
        last = next((i for i, x in enumerate(held) if not x), AT_ONCE)
        low, high = ([low, *points][last], [*points, high][last])
    return low


def exponent(at: Sums, n: int, least: float, most: float, entropy: float, repeat: float, passes: float | None = None) -> float:
    """The exponent for ``n`` sources whose shares lie between ``least`` and ``most``.

    ``entropy`` is a part of the largest possible, ``repeat`` how often a source may be passed over,
    ``passes`` the budget in passes over everything.
    """

    def flat_enough(alphas: list[float]) -> list[bool]:
        return [n < 2 or (math.log(z) - a * s / z) / math.log(n) >= entropy for a, (z, s) in zip(alphas, at(alphas), strict=True)]

    def seldom(alphas: list[float]) -> list[bool]:
        if passes is None:  # the largest source is passed over once
            return [(most / least) ** (1 - a) <= repeat for a in alphas]
        return [least ** (a - 1) / z * passes <= repeat for a, (z, _) in zip(alphas, at(alphas), strict=True)]

    alpha = 1.0 if flat_enough([1.0])[0] else _bisect(flat_enough) if flat_enough([0.0])[0] else 0.0
    if not seldom([alpha])[0]:
        alpha = 1.0 if not seldom([1.0])[0] else 1.0 - _bisect(lambda points: seldom([1.0 - x for x in points]), 0.0, 1.0 - alpha)
    return alpha


def temper(totals: DataFrame, entropy: float, repeat: float, budget: int | None = None) -> DataFrame:
    """``totals`` (source, tokens, ...) with ``weight``, ``passes`` (whole ones) and ``rest`` (tokens of one more).

    With no ``budget`` the whole mixture is as large as it takes for every source to be passed over at
    least once; a smaller budget leaves out parts of the largest sources.
    """
    n, total, low, high = totals.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return totals.withColumns({"weight": F.lit(0.0), "passes": F.lit(0), "rest": F.lit(0.0)})
    at, most = _sums(totals, total), high / total
    alpha = exponent(at, n, low / total, most, entropy, repeat, None if budget is None else budget / total)
    ((z, _),) = at([alpha])
    share = F.col("tokens") / total
    copies = F.pow(share, F.lit(alpha - 1)) * ((budget / total / z) if budget is not None else most ** (1 - alpha))
    copies = F.least(copies, F.lit(float(repeat)))
    copies = F.when(F.abs(copies - F.round(copies)) < 1e-9, F.round(copies)).otherwise(copies)  # whole passes are not lost to rounding
    copies = F.greatest(copies, F.lit(min(1.0, repeat) if budget is None else 0.0))
    out = totals.withColumns({"weight": F.pow(share, F.lit(alpha)) / z, "_copies": copies}).withColumn("passes", F.floor("_copies").cast("int"))
    out = out.withColumn("rest", F.round((F.col("_copies") - F.col("passes")) * F.col("tokens"), 6)).drop("_copies")
    full = F.col("rest") >= F.col("tokens")
    return out.withColumns({"passes": F.col("passes") + full.cast("int"), "rest": F.when(full, 0.0).otherwise(F.col("rest"))})


def _with_places(rows: DataFrame, blocks: str, small: str, seed: int) -> DataFrame:
    """``rows`` with ``_order`` and ``_small``, where a document's block and small block come in the permutation, and ``_place``."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    number = lambda i, n: F.pmod(F.xxhash64(F.lit(seed + i), key), F.col(n)).cast("int")
    own = F.coalesce(F.col("source"), F.lit(""))
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed + 2), own, number(0, blocks)))
    return rows.withColumns({"_small": F.xxhash64(F.lit(seed + 4), "_order", number(3, small)), "_place": F.xxhash64(F.lit(seed + 1), key)})


def _crossing(rows: DataFrame, key: str) -> DataFrame:
    """For each source the block (by ``key``) in which the sum of tokens crosses ``_left``: (source, key, left), left being what may be taken of it."""
    blocks = rows.groupBy("source", key).agg(F.sum("tokens").alias("tokens"), F.first("_left").alias("_left"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy(key))  # BLOCKS rows of a source at most
    over = blocks.withColumn("_upto", upto).where(F.col("_upto") > F.col("_left"))
    cut = F.struct(F.col(key), (F.col("_left") - F.col("_upto") + F.col("tokens")).alias("left"))
    return checkpointed(over.groupBy("source").agg(F.min_by(cut, "_upto").alias("c")).select("source", F.col(f"c.{key}").alias("at"), "c.left"))


def plan(docs: DataFrame, entropy: float = 0.95, repeat: float = 2.0, budget: int | None = None, seed: int = 17) -> DataFrame:
    """A row for each source of ``docs`` (doc_id, source, tokens): blocks, small, weight, passes, and where the last pass ends."""
    narrow = checkpointed(docs.select("doc_id", "source", "tokens"))
    totals = checkpointed(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    bounded = lambda rows: F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.floor(F.col("rows") / rows))).cast("int")
    sources = temper(totals, entropy, repeat, budget).withColumns({"blocks": bounded(BLOCK_ROWS), "small": bounded(BLOCK_ROWS * BLOCKS)})
    sources = checkpointed(sources.drop("tokens", "rows"))
    few = sources.count() <= BROADCAST_SOURCES

    placed = _with_places(_by_source(narrow, sources.select("source", "blocks", "small", F.col("rest").alias("_left")), few), "blocks", "small", seed)
    first = _crossing(placed, "_order")
    inside = _by_source(placed.drop("_left"), first.withColumnRenamed("left", "_left"), few).where(F.col("_order") == F.col("at")).drop("at")
    second = _crossing(inside, "_small")
    inside = _by_source(inside.drop("_left"), second, few).where(F.col("_small") == F.col("at"))
    filled = inside.withColumn("_upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("_place")))  # some BLOCK_ROWS rows of a source
    last = filled.where(F.col("_upto") <= F.col("left")).groupBy("source").agg(F.max("_place").alias("cut_place"))
    out = _by_source(sources.drop("rest"), first.select("source", F.col("at").alias("cut_order")), few)
    return _by_source(_by_source(out, second.select("source", F.col("at").alias("cut_small")), few), last, few)


def _by_source(rows: DataFrame, facts: DataFrame, few: bool = False) -> DataFrame:
    """Left join on the source, where null is a source too; ``few`` facts are broadcast, so that the rows are not shuffled by their sources."""
    facts = facts.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(facts) if few else facts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def with_copies(docs: DataFrame, entropy: float = 0.95, repeat: float = 2.0, budget: int | None = None, seed: int = 17, tokens: Column | None = None) -> DataFrame:
    """``docs`` with ``copies``, how often each document is in the mixture, and its source's ``weight``.

    ``tokens`` is a document's size, by default the words of its ``text``.  A null source is a source of
    its own; rows without an id are dealt by their source alone, rows that share an id have the same
    number of copies.  An empty table gives an empty result.
    """
    sized = docs.select("doc_id", "source", (n_tokens(F.col("text")) if tokens is None else tokens).alias("tokens"))
    cuts = checkpointed(plan(sized, entropy, repeat, budget, seed))
    facts = cuts.select("source", *(F.col(c).alias(f"_mix_{c}") for c in cuts.columns if c != "source"))
    placed = _with_places(_by_source(docs.drop("copies", "weight"), facts, cuts.count() <= BROADCAST_SOURCES), "_mix_blocks", "_mix_small", seed)
    order, small, place = (F.col(c) for c in ("_order", "_small", "_place"))
    cut, cut_small = F.col("_mix_cut_order"), F.col("_mix_cut_small")
    before = (order < cut) | ((order == cut) & ((small < cut_small) | ((small == cut_small) & F.coalesce(place <= F.col("_mix_cut_place"), F.lit(False)))))
    dealt = placed.withColumns({"weight": F.col("_mix_weight"), "copies": F.col("_mix_passes") + F.coalesce(before, F.lit(False)).cast("int")})
    return dealt.drop("_order", "_small", "_place", *(c for c in facts.columns if c != "source"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: every row of ``docs`` as often as it has copies, with the columns of ``docs``."""
    columns = docs.columns
    count = with_copies(docs.select("*", F.struct(*columns).alias("_row")), **options).where("copies > 0")
    return count.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
