"""Fusion, verdict and the agent's choice: the whole answer to a batch of questions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..sources.corpus import kind
from . import fulltext, keyword

RRF_K = 60.0
#: A score that is an answer, and the size of the corpus for which it was found: fixed values.
SCORE_FLOOR, CALIBRATED_AT, LEAST_ENTRIES = 17.5, 226, 2


def floor_for(n_entries: int) -> float:
    """The least score of an answer in a corpus of this size: a fixed share of one unique key."""
    unique = lambda n: math.log(1 + n / 2)
    return SCORE_FLOOR / unique(CALIBRATED_AT) * unique(n_entries)


def fuse(keyword_hits: DataFrame, text_hits: DataFrame, top: int = 10) -> DataFrame:
    """(qid, base, rel, rrf, keyword_rank, text_rank, passages, rank): reciprocal rank fusion by file (A4).

    A file counts once for each scorer, at its best chunk; ``passages`` counts all its chunks.
    """
    k = keyword_hits.select("qid", "base", "rel", F.col("rank").alias("kr"), F.lit(None).cast("int").alias("tr"))
    t = text_hits.select("qid", "base", "rel", F.lit(None).cast("int").alias("kr"), F.col("rank").alias("tr"))
    ranks = k.unionByName(t).groupBy("qid", "base", "rel").agg(F.min("kr").alias("keyword_rank"), F.min("tr").alias("text_rank"), F.count("tr").alias("passages"))
    share = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    fused = ranks.withColumn("rrf", F.round(share("keyword_rank") + share("text_rank"), 12))
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), "rel", "base"))
    return fused.withColumn("rank", order).where(F.col("rank") <= top)


def verdicts(questions: DataFrame, keyword_hits: DataFrame, text_hits: DataFrame, n_entries: int) -> DataFrame:
    """(qid, verdict, agreement, keyword_score, margin, floor, keyword_top): hit, guess or nothing.

    Only the keyword score is held against the floor.  Agreement is 2 if the text scorer ranked the
    first file as well.
    """
    floor = floor_for(n_entries)
    first = keyword_hits.where("rank <= 2").groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("keyword_score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.max(F.when(F.col("rank") == 1, F.struct("base", "rel"))).alias("top"),
    )
    seen = text_hits.select("qid", F.struct("base", "rel").alias("top"), F.lit(True).alias("seen")).distinct()
    joined = questions.select("qid").join(first, "qid", "left").join(seen, ["qid", "top"], "left")
    hit = (F.col("keyword_score") >= floor) & F.lit(n_entries >= LEAST_ENTRIES)
    margin = F.when(F.col("second") > 0, F.col("keyword_score") / F.col("second")).otherwise(1.0)
    return joined.select(
        "qid",
        F.when(F.col("top").isNull(), "nothing").when(hit, "hit").otherwise("guess").alias("verdict"),
        F.when(F.col("top").isNull(), 0).when(F.col("seen"), 2).otherwise(1).alias("agreement"),
        F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"),
        F.when(F.col("top").isNull(), 0.0).otherwise(margin).alias("margin"),
        F.lit(floor).alias("floor"),
        F.concat("top.base", F.lit("/"), "top.rel").alias("keyword_top"),
    )


def species_bests(keyword_hits: DataFrame) -> DataFrame:
    """(qid, base, kind, best, at): the best score of a base in each of memory, skills and tools."""
    return keyword_hits.withColumn("kind", kind(F.col("rel"))).groupBy("qid", "base", "kind").agg(F.max("score").alias("best"), F.min("rank").alias("at"))


def choose_agents(keyword_hits: DataFrame, routable: Column | None = None) -> DataFrame:
    """(qid, agent, agent_score, files, contenders, agent_margin): the base that owns the subject (A5).

    The bests of a base's species are summed; ties go to the base that was ranked first.  ``files`` is
    the number of species that scored.  A lone base has a null margin (no runner-up).
    """
    hits = keyword_hits if routable is None else keyword_hits.where(routable)
    totals = species_bests(hits).groupBy("qid", "base").agg(F.round(F.sum("best"), 9).alias("agent_score"), F.count(F.lit(1)).alias("files"), F.min("at").alias("at"))
    order = Window.partitionBy("qid").orderBy(F.desc("agent_score"), "at")
    ranked = totals.withColumns({"nth": F.row_number().over(order), "runner_up": F.lead("agent_score").over(order), "contenders": F.count(F.lit(1)).over(Window.partitionBy("qid"))})
    return ranked.where("nth = 1").select("qid", F.col("base").alias("agent"), "agent_score", "files", "contenders", F.when(F.col("runner_up") > 0, F.col("agent_score") / F.col("runner_up")).alias("agent_margin"))


def fused_agents(fused: DataFrame) -> DataFrame:
    """(qid, agent, agent_score): the base whose fused files sum highest, ties to the one ranked first."""
    totals = fused.groupBy("qid", "base").agg(F.round(F.sum("rrf"), 9).alias("agent_score"), F.min("rank").alias("_at"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("agent_score"), "_at"))
    return totals.withColumn("_n", nth).where("_n = 1").select("qid", F.col("base").alias("agent"), "agent_score")


def ask(questions: DataFrame, entries: DataFrame, chunks: DataFrame, aliases: DataFrame | None = None, top: int = 10, n_entries: int | None = None, stopwords: Sequence[str] = STOPWORDS) -> dict[str, DataFrame]:
    """Both scorers over a batch of questions, and all that follows; the plans share their scans."""
    n = entries.count() if n_entries is None else n_entries
    asked = keyword.question_terms(questions, aliases, stopwords)
    ranked = keyword.route(asked, entries, n, top * keyword.OVERSAMPLE, stopwords)
    found = fulltext.round_robin(fulltext.search(asked, chunks, top * fulltext.OVERSAMPLE), top * fulltext.OVERSAMPLE)
    return {"asked": asked, "keyword": ranked, "text": found, "n": n}


def answers(questions: DataFrame, parts: dict) -> DataFrame:
    """One row for each question: verdict, agent and how many files were fused."""
    judged = verdicts(questions, parts["keyword"], parts["text"], parts["n"])
    agents = choose_agents(parts["keyword"])
    files = fuse(parts["keyword"], parts["text"]).groupBy("qid").agg(F.count(F.lit(1)).alias("found"))
    return judged.join(agents, "qid", "left").join(files, "qid", "left").withColumn("found", F.coalesce("found", F.lit(0)))
