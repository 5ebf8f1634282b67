"""The keyword scorer: questions against entries, in batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, idf, normalise
from ..sources.stages import few, stored

#: Weights of a term by where an entry has it: fixed values.
W_KEYWORD, W_PHRASE, W_TITLE, W_STEM, W_SUMMARY = 6.0, 10.0, 3.0, 3.0, 1.0
#: Ranked entries of a question for each wanted result.
OVERSAMPLE = 4


def question_terms(questions: DataFrame, aliases: DataFrame | None = None, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(qid, terms): a question's tokens, repeats kept, then what its aliases add.

    ``aliases`` (pos, alias, canonical) are matched against the question's own tokens, an alias of
    several words as a substring; words that are there already are not added.
    """
    asked = questions.select("qid", normalise(F.col("question"), stopwords).alias("terms"))
    if aliases is None:
        return asked
    matched = alias_matches(asked, aliases, stopwords)
    added = matched.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("more"))
    more = F.array_distinct(F.flatten(F.transform("more", lambda m: m["c"])))
    joined = asked.join(added, "qid", "left")
    return joined.select("qid", F.when(F.col("more").isNull(), F.col("terms")).otherwise(F.concat("terms", F.filter(more, lambda w: ~F.array_contains("terms", w)))).alias("terms"))


def alias_matches(asked: DataFrame, aliases: DataFrame, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(qid, pos, c): the aliases (pos, alias, canonical) that own tokens (qid, terms) call for, with the tokens they stand for.

    An alias of one token matches that token, one of several a substring of the joined tokens; one without tokens nothing.
    """
    table = aliases.select("pos", normalise(F.col("alias"), stopwords).alias("a"), normalise(F.col("canonical"), stopwords).alias("c")).where(F.size("a") > 0)
    table = table.select("pos", F.array_join("a", " ").alias("norm"), F.size("a").alias("n"), "c")
    single = asked.select("qid", F.explode("terms").alias("norm")).distinct().join(table.where("n = 1"), "norm").select("qid", "pos", "c")
    several = phrase_matches(asked, table.where("n > 1").select("pos", "norm", "c")).select("qid", "pos", "c")
    return single.unionByName(several)


def phrase_matches(asked: DataFrame, phrases: DataFrame) -> DataFrame:
    """Joins questions (qid, terms) and phrases (norm, ...) wherever the joined terms contain the phrase.

    Containment is by characters, not by tokens, but both sides have single spaces: the first word
    of a phrase ends a term, the last begins one, and those between are terms.  Two words are found by
    an equi-join on the ends and beginnings of adjacent terms, more by an equi-join on the second.
    """
    asked = asked.select("qid", "terms", F.array_join("terms", " ").alias("_norm"))
    parts = F.split("norm", " ")
    two, more = phrases.where(F.size(parts) == 2), phrases.where(F.size(parts) > 2).withColumn("_second", F.element_at(parts, 2))
    n = F.size("terms")
    at = asked.where(n > 1).select("qid", F.explode(F.zip_with(F.slice("terms", F.lit(1), n - 1), F.slice("terms", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    ends = F.transform(F.sequence(F.lit(1), F.char_length("p.a")), lambda i: F.substring(F.col("p.a"), i, F.char_length("p.a")))
    starts = F.transform(F.sequence(F.lit(1), F.char_length("p.b")), lambda i: F.substring(F.col("p.b"), F.lit(1), i))
    spans = at.distinct().withColumn("e", F.explode(ends)).withColumn("s", F.explode(starts)).select("qid", F.concat_ws(" ", "e", "s").alias("norm")).distinct()
    inner = asked.select("qid", "_norm", F.explode(F.array_distinct("terms")).alias("_second"))
    longer = few(inner).join(more, "_second").where(F.contains("_norm", F.col("norm"))).drop("_second", "_norm")
    return few(spans).join(two, "norm").select("qid", *phrases.columns).unionByName(longer.select("qid", *phrases.columns))


def entry_terms(entries: DataFrame, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(base, rel, term, weight): what an entry is found by, a row for each field and distinct term.

    A key is a keyword only if it is one written word and one token.
    """
    single = F.filter("keywords", lambda k: F.size(F.filter(F.split(F.trim(k), r"\s+"), lambda w: w != "")) == 1)
    tokens = F.filter(F.transform(single, lambda k: normalise(k, stopwords)), lambda t: F.size(t) == 1)
    field = lambda terms, weight: F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))
    every = F.concat(field(F.flatten(tokens), W_KEYWORD), field(normalise(F.col("title"), stopwords), W_TITLE), field(normalise(F.col("stem"), stopwords), W_STEM), field(normalise(F.col("purpose"), stopwords), W_SUMMARY))
    return entries.select("base", "rel", F.explode(every).alias("t")).select("base", "rel", "t.*")


def entry_phrases(entries: DataFrame, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(base, rel, pos, original, norm): keys of several tokens."""
    keys = entries.select("base", "rel", F.posexplode("keywords").alias("pos", "original"))
    return keys.withColumn("norm", normalise(F.col("original"), stopwords)).where(F.size("norm") > 1).withColumn("norm", F.array_join("norm", " "))


def document_frequency(terms: DataFrame) -> DataFrame:
    """(term, df): entries that can be found by a term (A1)."""
    return terms.select("base", "rel", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def route(asked: DataFrame, entries: DataFrame, n_entries: int, top: int = 10 * OVERSAMPLE, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(qid, base, rel, score, matched, rank): the best entries of each question (Q1).

    ``asked`` is (qid, terms).  Each occurrence of a term counts; a phrase counts ten times the mean
    idf of its words.  ``matched`` lists phrases, then terms in the order of the question.
    """
    return route_terms(asked, entry_terms(entries, stopwords), entry_phrases(entries, stopwords), n_entries, top)


def route_terms(asked: DataFrame, every: DataFrame, phrases: DataFrame, n_entries: int, top: int = 10 * OVERSAMPLE) -> DataFrame:
    """As ``route``, from what ``entry_terms`` and ``entry_phrases`` give."""
    occurrences = asked.select("qid", F.posexplode("terms").alias("pos", "term"))
    wanted = occurrences.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"), F.min("pos").alias("pos"))
    found = stored(phrase_matches(asked, phrases))
    # Only terms of the questions, and of the phrases in them, are counted.
    needed = wanted.select("term").unionByName(found.select(F.explode(F.split("norm", " ")).alias("term"))).distinct()
    terms = stored(every.join(few(needed), "term", "left_semi"))
    df = few(document_frequency(terms))
    wanted = wanted.join(df, "term").withColumn("idf", idf(F.col("df"), n_entries))
    by_term = few(wanted).join(terms, "term").select("qid", "base", "rel", (F.col("times") * F.col("idf") * F.col("weight")).alias("part"), F.struct(F.lit(1).alias("g"), "pos", F.col("term").alias("name")).alias("m"))

    words = found.select("qid", "base", "rel", "pos", "original", F.explode(F.split("norm", " ")).alias("term")).join(df, "term", "left")
    by_phrase = words.groupBy("qid", "base", "rel", "pos", "original").agg((W_PHRASE * F.avg(idf(F.col("df"), n_entries))).alias("part"))
    by_phrase = by_phrase.select("qid", "base", "rel", "part", F.struct(F.lit(0).alias("g"), "pos", F.col("original").alias("name")).alias("m"))

    scored = by_term.unionByName(by_phrase).groupBy("qid", "base", "rel").agg(F.round(F.sum("part"), 9).alias("score"), F.transform(F.array_sort(F.collect_set("m")), lambda m: m["name"]).alias("matched"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rel", "base"))
    return scored.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= top)
