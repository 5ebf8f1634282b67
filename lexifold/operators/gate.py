"""The gate of new aliases: what each candidate would change, over all candidates at once (Q13, U4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, normalise
from ..sources.stages import written
from . import ask, keyword

#: What is counted over a set of questions: the right file on top, the right owner, and hits where none should be.
COLUMNS = ("file", "agent", "answered")


def problem() -> Column:
    """Why a candidate (alias, canonical, because) needs no measuring: null if it has to be measured."""
    bare = lambda c: F.trim(F.coalesce(c, F.lit("")))
    alias, canonical = bare("alias"), bare("canonical")
    return (
        F.when((alias == "") | (canonical == ""), "empty side")
        .when(F.lower(alias) == F.lower(canonical), "same word")
        .when(bare("because") == "", "no question")
        .when(F.contains(alias, F.lit("=")) | F.contains(canonical, F.lit("=")), "equals sign")
    )


def judge(candidates: DataFrame, questions: DataFrame, gold: DataFrame, terms: DataFrame, phrases: DataFrame, n_entries: int, aliases: DataFrame | None = None, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """A row for each candidate (cid, alias, canonical, because), ``cid`` unique: whether it may be let in.

    A candidate is admitted if the question it was proposed for finds nothing now and something with it
    (``fixes``), and over all ``questions`` (qid, question) no count gets worse: ``file`` and ``agent`` may not
    fall, ``answered`` (hits on questions without ``gold`` (qid, base, rel)) may not rise.  ``reason`` says what
    kept it out; candidates that ``problem`` refuses have null counts.  ``terms`` and ``phrases`` are those of the
    entries (``keyword.entry_terms``, ``entry_phrases``), or what an index has of them.

    A candidate can only change questions that hold its alias.  So every question is scored once as it is, and
    again only for the candidates that would add a word to it; counts of the rest are taken over.
    A candidate is judged alone, behind the ``aliases`` in force.
    """
    judged = written(candidates.select("cid", "alias", "canonical", "because", problem().alias("problem")))
    live = judged.where("problem is null")
    rows = questions.select(F.struct(F.lit(False).alias("own"), F.col("qid").cast("long").alias("id")).alias("row"), "question")
    rows = rows.unionByName(live.select(F.struct(F.lit(True).alias("own"), F.col("cid").cast("long").alias("id")).alias("row"), F.col("because").alias("question")))
    rows = rows.select(F.struct("row", F.lit(None).cast("long").alias("cid")).alias("qid"), "question")

    asked = written(keyword.question_terms(rows, aliases, stopwords))
    own_words = rows.select("qid", normalise(F.col("question"), stopwords).alias("terms"))
    touched = keyword.alias_matches(own_words, live.select(F.col("cid").cast("long").alias("pos"), "alias", "canonical"), stopwords)
    touched = touched.where(~F.col("qid.row.own") | (F.col("qid.row.id") == F.col("pos"))).distinct()
    more = F.filter(F.array_distinct("c"), lambda w: ~F.array_contains("terms", w))
    again = touched.join(asked, "qid").select("qid", "pos", "terms", more.alias("more")).where(F.size("more") > 0)
    again = again.select(F.struct("qid.row", F.col("pos").alias("cid")).alias("qid"), F.concat("terms", "more").alias("terms"))

    every = written(asked.unionByName(again))
    hits = written(keyword.route_terms(every, terms, phrases, n_entries))
    scored = written(_outcomes(every, hits, gold, n_entries))

    plain, changed = scored.where("cid is null").drop("cid"), scored.where("cid is not null")
    total = plain.where("not row.own").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COLUMNS)).first()
    old = plain.select("row", *(F.col(c).alias(f"_{c}") for c in COLUMNS))
    moved = changed.where("not row.own").join(old, "row").groupBy("cid").agg(F.count(F.lit(1)).alias("touched"), *(F.sum(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in COLUMNS))

    now = plain.where("row.own").select(F.col("row.id").alias("cid"), F.col("found").alias("_now"))
    then = changed.where("row.own").select("cid", F.col("found").alias("_then"))
    out = judged.join(now, "cid", "left").join(then, "cid", "left").join(moved, "cid", "left")
    measured = F.col("problem").isNull()
    before = {f"{c}_before": F.when(measured, F.lit(total[c])).cast("long") for c in COLUMNS}
    after = {f"{c}_after": F.when(measured, F.lit(total[c]) + F.coalesce(f"d_{c}", F.lit(0))).cast("long") for c in COLUMNS}
    missing = ~F.col("_now")
    out = out.withColumns({"touched": F.when(measured, F.coalesce("touched", F.lit(0))), "missing": F.when(measured, missing), "fixes": F.when(measured, missing & F.coalesce("_then", "_now"))} | before | after)
    harmless = (F.col("file_after") >= F.col("file_before")) & (F.col("agent_after") >= F.col("agent_before")) & (F.col("answered_after") <= F.col("answered_before"))
    reason = F.when(~measured, F.col("problem")).when(~F.col("missing"), "does not miss").when(~F.col("fixes"), "still finds nothing").when(~harmless, "costs elsewhere").otherwise("")
    return out.withColumn("reason", reason).select("cid", "alias", "canonical", (F.col("reason") == "").alias("admitted"), "reason", "missing", "fixes", "touched", *before, *after)


def _outcomes(asked: DataFrame, hits: DataFrame, gold: DataFrame, n_entries: int) -> DataFrame:
    """(row, cid, found, file, agent, answered) of every asked (qid: row and cid) by its keyword hits."""
    top = hits.where("rank = 1").select("qid", "base", "rel", "score")
    agents = ask.choose_agents(hits).select("qid", F.col("agent").alias("_owner"))
    files = gold.select(F.col("qid").cast("long").alias("id"), "base", "rel", F.lit(1).alias("_file")).distinct()
    owners = gold.select(F.col("qid").cast("long").alias("id"), F.col("base").alias("_owner"), F.lit(1).alias("_agent")).distinct()
    known = gold.select(F.col("qid").cast("long").alias("id"), F.lit(True).alias("_known")).distinct()
    joined = asked.select("qid").join(top, "qid", "left").join(agents, "qid", "left").withColumn("id", F.when(~F.col("qid.row.own"), F.col("qid.row.id")))
    joined = joined.join(files, ["id", "base", "rel"], "left").join(owners, ["id", "_owner"], "left").join(known, "id", "left")
    hit = (F.col("score") >= ask.floor_for(n_entries)) & F.lit(n_entries >= ask.LEAST_ENTRIES)
    answered = F.coalesce(F.col("_known").isNull() & hit, F.lit(False)).cast("int")
    return joined.select("qid.row", "qid.cid", F.col("score").isNotNull().alias("found"), F.coalesce("_file", F.lit(0)).alias("file"), F.coalesce("_agent", F.lit(0)).alias("agent"), answered.alias("answered"))
