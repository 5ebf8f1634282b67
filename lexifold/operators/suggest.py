"""Spelling suggestions, claims, near misses and shortfalls (Q5-Q8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, normalise, trigrams
from ..sources.stages import few, written

#: Least likeness of a suggestion, suggestions of a question; containment of a claim that is there
#: already, and of one that brings something new: fixed values.
SUGGEST_FLOOR, SUGGESTIONS = 0.65, 8
NOOP_AT, UPDATE_AT, EVIDENCE, EVIDENCE_WIDTH = 0.90, 0.55, 5, 25


def _sets(words: DataFrame, name: str) -> DataFrame:
    """(name, grams): the trigrams of distinct words as sets, an occurrence's number told apart from the others' (gram, times)."""
    own = trigrams(F.col(name))
    numbered = F.transform(F.sequence(F.lit(1), F.size("_g")), lambda i: F.struct(F.element_at("_g", i).alias("gram"), F.size(F.filter(F.slice("_g", 1, i), lambda g: g == F.element_at("_g", i))).alias("nth")))
    return words.withColumn("_g", own).where(F.size("_g") > 0).select(name, numbered.alias("grams"))


def _prefixes(sets: DataFrame, name: str, rare: DataFrame, floor: float) -> DataFrame:
    """(name, n, gram, at): of each set the rarest grams, as many as a partner must share one of, with their places."""
    each = sets.select(name, F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(rare, "gram", "left")
    place = F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("df", F.lit(0)), "gram"))
    # A partner of m grams shares floor * (n + m) / 2 of them, and has no fewer than it shares.
    least = F.ceil(F.round(floor * F.col("n") / (2 - floor), 9))
    return each.withColumn("at", place).where(F.col("at") <= F.col("n") - least + 1).select(name, "n", "gram", "at")


def look_alike(asked: DataFrame, offered: DataFrame, floor: float = SUGGEST_FLOOR) -> DataFrame:
    """(word, part, likeness) of all pairs at or above ``floor`` by Dice over trigrams as multisets.

    ``asked`` has distinct ``word``, ``offered`` distinct ``part``.  Pairs meet on their rarest trigrams
    only: with grams in one order for all words, two sets that share enough share one of the first few of
    each.  Sizes, and what can still follow behind the places of a shared gram, rule pairs out before
    whole sets are compared.
    """
    left, right = written(_sets(asked.select("word").distinct(), "word")), written(_sets(offered.select("part").distinct(), "part"))
    rare = right.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    a = _prefixes(left, "word", rare, floor)
    b = _prefixes(right, "part", rare, floor).withColumnsRenamed({"n": "m", "at": "place"})
    needed = F.round(floor * (F.col("n") + F.col("m")) / 2, 9)
    reach = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place")) + F.least("at", "place") >= needed
    met = a.join(b, "gram").where((F.least("n", "m") >= needed) & reach).select("word", "part").distinct()
    both = met.join(left.withColumnRenamed("grams", "_a"), "word").join(right.withColumnRenamed("grams", "_b"), "part")
    likeness = 2.0 * F.size(F.array_intersect("_a", "_b")) / (F.size("_a") + F.size("_b"))
    return both.select("word", "part", likeness.alias("likeness")).where(F.col("likeness") >= floor)


def suggest(questions: DataFrame, entries: DataFrame, limit: int = SUGGESTIONS, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(qid, keyword, likeness, rank): the keys that look most like a word of the question (Q5)."""
    asked = questions.select("qid", F.explode(F.array_distinct(normalise(F.col("question"), stopwords))).alias("word"))
    keys = entries.select(F.explode("keywords").alias("keyword")).distinct().select("keyword", F.explode(F.array_distinct(normalise(F.col("keyword"), stopwords))).alias("part"))
    alike = look_alike(asked.select("word").distinct(), keys.select("part").distinct())
    best = asked.join(alike, "word").join(keys, "part").groupBy("qid", "keyword").agg(F.round(F.max("likeness"), 9).alias("likeness"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("likeness"), "keyword"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit)


def remember(claims: DataFrame, text_hits: DataFrame, chunks: DataFrame, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(qid, outcome, containment, shared, missing, chunk_id): what the base already says of a claim (Q8).

    ``claims`` is (qid, terms), ``text_hits`` the chunks ranked for it; the chunk that holds most of
    its distinct words decides, ties go to the better rank.
    """
    words = claims.select("qid", F.array_distinct("terms").alias("words"))
    read = text_hits.where(F.col("rank") <= EVIDENCE_WIDTH).join(chunks.select("base", "chunk_id", "text"), ["base", "chunk_id"])
    held = read.join(words, "qid").withColumn("own", normalise(F.col("text"), stopwords))
    held = held.withColumns({"shared": F.sort_array(F.array_intersect("words", "own")), "missing": F.sort_array(F.array_except("words", "own"))})
    held = held.withColumn("containment", F.size("shared") / F.size("words"))
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("containment"), "rank"))
    best = held.withColumn("_n", first).where("_n = 1").select("qid", "containment", "shared", "missing", "chunk_id")
    outcome = F.when(F.col("containment") >= NOOP_AT, "NOOP").when(F.col("containment") >= UPDATE_AT, "UPDATE").otherwise("ADD")
    return claims.select("qid").join(best, "qid", "left").withColumn("outcome", outcome)


def near_misses(fused: DataFrame, keyword_hits: DataFrame, entries: DataFrame, floor: float) -> DataFrame:
    """(qid, base, rel, keyword_score, keys, rank): fused files that no verdict vouches for (Q7)."""
    scores = keyword_hits.select("qid", "base", "rel", F.col("score").alias("keyword_score"))
    joined = fused.join(scores, ["qid", "base", "rel"], "left").withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))
    missed = written(joined.where(F.col("keyword_score") < floor))
    keys = entries.select("base", "rel", F.col("keywords").alias("keys")).join(few(missed.select("base", "rel").distinct()), ["base", "rel"], "left_semi")
    return missed.join(keys, ["base", "rel"], "left").select("qid", "base", "rel", "keyword_score", "keys", "rank")


def shortfalls(answers: DataFrame, n_entries: int, unreachable: int) -> DataFrame:
    """(qid, causes): why a question has no answer, at most four causes (Q6, T17); hits have none."""
    scored = F.col("keyword_score") > 0
    causes = F.array_compact(F.array(
        F.when(F.lit(n_entries < 2), F.lit("too few entries")),
        F.when(F.lit(unreachable > 0), F.lit(f"{unreachable} files have no keys")),
        F.when(scored & (F.col("keyword_score") < F.col("floor")), F.format_string("scored %.1f against a floor of %.1f", "keyword_score", "floor")),
        F.when(~scored, F.lit("no term matched a key")),
    ))
    return answers.where("verdict <> 'hit'").select("qid", causes.alias("causes"))
