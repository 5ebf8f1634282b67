"""Grading, agreement and latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ALNUM, STOPWORDS, fulltext_tokens
from ..sources.stages import few, is_few, stored, written

#: Words that say that an answer was refused: fixed values.
REFUSALS = ("library does not hold this", "the library does not", "nao possui", "não possui", "not found")


def judge_pairs(first: DataFrame, second: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, agreed, disagreed, only_first, only_second): two judges (id, *by, yes) side by side, the unpaired of both counted."""
    a, b = first.withColumnRenamed("yes", "_a"), second.withColumnRenamed("yes", "_b")
    both = a.join(b, ["id", *by], "full")
    count = lambda x, name: F.count_if(x).alias(name)
    x, y = F.col("_a"), F.col("_b")
    return both.groupBy(*by).agg(count(x == y, "agreed"), count(x != y, "disagreed"), count(y.isNull(), "only_first"), count(x.isNull(), "only_second"))


def accuracy(answers: DataFrame, by: str) -> DataFrame:
    """(``by``, n, accuracy): the share of right answers of each type, and overall where the type is null."""
    known = answers.where(F.col(by).isNotNull() & F.col("right").isNotNull())
    return known.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("right").cast("double")).alias("accuracy"))


def sampled(items: DataFrame, every: int, partitions: Sequence[str]) -> DataFrame:
    """Every ``every``-th item (id, *partitions) of each partition by id, and all whose id ends in ``_abs``."""
    nth = F.row_number().over(Window.partitionBy(*partitions).orderBy("id"))
    return items.withColumn("_n", nth).where(((F.col("_n") - 1) % every == 0) | F.endswith("id", F.lit("_abs"))).drop("_n")


def holders(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, base, rel): which texts (base, rel, text) hold which patterns (pattern, tokens) as runs of full-text tokens.

    Many patterns are sought in many texts at once: a text that holds a pattern holds its rarest token,
    so patterns and texts meet on that one, and only texts that may hold something are compared.  No runs
    of texts are made.  A pattern without tokens is held by none.  Few patterns come to the texts, and
    no text is shuffled; of many, the texts that may hold one are.
    """
    asked = patterns.where(F.size("tokens") > 0).select("pattern", "tokens").distinct()
    wanted = asked.select(F.explode("tokens").alias("token")).distinct()
    own = texts.select("base", "rel", F.explode(F.array_distinct(fulltext_tokens(F.col("text")))).alias("token")).join(few(wanted), "token", "left_semi")
    own = stored(own)
    df = own.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    each = asked.select("pattern", "tokens", F.explode(F.array_distinct("tokens")).alias("token")).join(df, "token", "left")
    # A token that no text has leaves its pattern without candidates.
    rarest = each.groupBy("pattern", "tokens").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("r")).where("r.df > 0")
    sought = written(rarest.select("pattern", F.array_join("tokens", " ").alias("_run"), F.col("r.token").alias("token")))
    tokens = fulltext_tokens(F.col("text"))
    said = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).alias("_text")
    if is_few(sought):
        read = texts.select("base", "rel", said, F.array_distinct(tokens).alias("_own")).select("base", "rel", "_text", F.explode("_own").alias("token"))
        both = read.join(F.broadcast(sought), "token")
    else:
        may = stored(sought.join(own, "token").select("pattern", "_run", F.col("base").alias("_base"), F.col("rel").alias("_rel")).distinct())
        same = F.col("base").eqNullSafe(F.col("_base")) & F.col("rel").eqNullSafe(F.col("_rel"))
        both = may.join(texts.join(may.select("_base", "_rel").distinct(), same, "left_semi").select("base", "rel", said), same)
    return both.where(F.contains("_text", F.concat(F.lit(" "), "_run", F.lit(" ")))).select("pattern", "base", "rel").distinct()


def gold_by_passage(questions: DataFrame, texts: DataFrame, words: int = 8) -> DataFrame:
    """(qid, base, rel): files that hold the first ``words`` tokens of a question in a row; a question with fewer has none."""
    tokens = fulltext_tokens(F.col("question"))
    asked = questions.where(F.size(tokens) >= words).select(F.col("qid").alias("pattern"), F.slice(tokens, 1, words).alias("tokens"))
    return holders(asked, texts).withColumnRenamed("pattern", "qid")


def evidence_taxonomy(golds: DataFrame, served: DataFrame, ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, golds, found, outcome, miss): how much of the evidence was served, and where what is missing was lost.

    ``golds`` are (qid, gold) texts, ``served`` is (qid, text), ``ranked`` (qid, base, rel) the files that were
    ranked.  The outcome is full, partial or none.  If something is missing, the miss is ``slice`` where a
    ranked file holds all golds of the question, ``route`` where another file does, else ``not-verbatim``.
    All is compared by full-text tokens; golds without one do not count.
    """
    known = golds.select("qid", fulltext_tokens(F.col("gold")).alias("tokens")).where(F.size("tokens") > 0).distinct()
    known = written(known.withColumn("pattern", F.array_join("tokens", " ")))
    shown = served.groupBy("qid").agg(F.concat(F.lit(" "), F.array_join(F.transform(F.collect_list("text"), lambda t: F.array_join(fulltext_tokens(t), " ")), " | "), F.lit(" ")).alias("_shown"))
    there = F.contains(F.coalesce("_shown", F.lit("")), F.concat(F.lit(" "), "pattern", F.lit(" ")))
    counts = known.join(shown, "qid", "left").groupBy("qid").agg(F.count(F.lit(1)).alias("golds"), F.count_if(there).alias("found"))
    held = known.select("qid", "pattern").join(holders(known.select("pattern", "tokens"), texts), "pattern").groupBy("qid", "base", "rel").agg(F.count(F.lit(1)).alias("_held"))
    whole = held.join(counts.select("qid", "golds"), "qid").where("_held = golds").select("qid", "base", "rel")
    near = whole.join(ranked.select("qid", "base", "rel").distinct().withColumn("_ranked", F.lit(True)), ["qid", "base", "rel"], "left")
    where = near.groupBy("qid").agg(F.coalesce(F.bool_or("_ranked"), F.lit(False)).alias("_ranked"))
    outcome = F.when(F.col("found") == F.col("golds"), "full").when(F.col("found") > 0, "partial").otherwise("none")
    miss = F.when(F.col("found") == F.col("golds"), "").when(F.col("_ranked"), "slice").when(F.col("_ranked").isNotNull(), "route").otherwise("not-verbatim")
    return counts.join(where, "qid", "left").select("qid", "golds", "found", outcome.alias("outcome"), miss.alias("miss"))


def graded(answers: DataFrame, fused: DataFrame, gold: DataFrame) -> DataFrame:
    """A row for each answered question with what was right about it (Q12)."""
    top = fused.where("rank = 1").select("qid", F.concat_ws("/", "base", "rel").alias("file_top"))
    keys = gold.groupBy("qid").agg(F.collect_set(F.concat_ws("/", "base", "rel")).alias("answers"), F.collect_set("base").alias("owners"))
    joined = answers.join(top, "qid", "left").join(keys, "qid", "left")
    among = lambda array, x: F.coalesce(F.array_contains(array, F.col(x)), F.lit(False))
    return joined.select("qid", "verdict", "keyword_score", "agent", F.col("answers").isNull().alias("must_abstain"), among("answers", "file_top").alias("file_hit"), among("answers", "keyword_top").alias("keyword_hit"), among("owners", "agent").alias("agent_hit"), "owners")


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts over graded questions."""
    can = ~F.col("must_abstain")
    count = lambda cond, name: F.count_if(cond).alias(name)
    return rows.agg(
        count(can, "answerable"),
        count(can & F.col("file_hit"), "file_hits"),
        count(can & F.col("keyword_hit"), "keyword_hits"),
        count(can & F.col("agent_hit"), "agent_hits"),
        count(can & ~F.col("keyword_hit") & (F.col("verdict") != "hit"), "misses_flagged"),
        count(can & ~F.col("keyword_hit"), "misses_total"),
        count(can & F.col("keyword_hit") & (F.col("verdict") != "hit"), "hits_demoted"),
        count(~can & (F.col("verdict") == "nothing"), "abstention_refused"),
        count(~can & (F.col("verdict") == "guess"), "abstention_hedged"),
        count(~can & (F.col("verdict") == "hit"), "abstention_answered"),
        count(~can, "abstention_expected"),
    )


def best_fixed_agent(rows: DataFrame) -> DataFrame:
    """(agent, hits): the agent that owns most answerable questions; ties to the smallest name (A10)."""
    return rows.select(F.explode("owners").alias("agent")).groupBy("agent").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "agent").limit(1)


def separation(rows: DataFrame) -> DataFrame:
    """Lowest score of a keyword hit, highest of a miss, and whether a floor can part them."""
    can = ~F.col("must_abstain")
    low, high = F.min(F.when(can & F.col("keyword_hit"), F.col("keyword_score"))), F.max(F.when(can & ~F.col("keyword_hit"), F.col("keyword_score")))
    return rows.agg(low.alias("lowest_hit"), high.alias("highest_miss"), (low > high).alias("separable"))


def triad(rows: DataFrame, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(qid, faithfulness, answer_relevance, context_relevancy) of question, context (array) and answer."""
    content = lambda x: F.filter(F.transform(F.regexp_extract_all(x, F.lit(ALNUM), 1), F.lower), lambda t: (F.octet_length(t) > 2) & ~t.isin(*stopwords))
    ratio = lambda xs, ok, empty: F.when(F.size(xs) == 0, F.lit(empty)).otherwise(F.size(F.filter(xs, ok)) / F.greatest(F.size(xs), F.lit(1)))
    rows = rows.withColumns({"_a": F.lower(F.trim("answer")), "_c": F.lower(F.array_join("context", " ")), "_at": content(F.trim("answer")), "_qt": content(F.trim("question"))})
    sentences = F.filter(F.transform(F.flatten(F.transform("context", lambda c: F.split(c, r"[.\n;]"))), lambda s: F.trim(s)), lambda s: F.octet_length(s) >= 10)
    relevant = lambda s: F.exists("_qt", lambda t: F.contains(F.lower(s), t))
    refused = F.lit(False)
    for words in REFUSALS:
        refused = refused | F.contains("_a", F.lit(words))
    empty = F.size("context") == 0
    two = lambda x: F.floor(x * 100 + 0.5) / 100  # noqa: E731  rounds halves up, as the contract has it
    return rows.select(
        "qid",
        two(F.when(refused, 1.0).otherwise(ratio(F.col("_at"), lambda t: F.contains("_c", t), 1.0))).alias("faithfulness"),
        two(F.when(refused, F.when(empty, 1.0).otherwise(0.0)).otherwise(ratio(F.col("_qt"), lambda t: F.contains("_a", t), 1.0))).alias("answer_relevance"),
        two(F.when(refused, F.when(empty, 1.0).otherwise(0.5)).when(empty, 0.0).otherwise(ratio(sentences, relevant, 1.0))).alias("context_relevancy"),
    )


def abstention_matrix(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, confident, guess, nothing, total) over labelled questions."""
    joined = labels.join(answers.select("qid", "verdict"), "qid")
    count = lambda v, name: F.count_if(F.col("verdict") == v).alias(name)
    return joined.groupBy("label").agg(count("hit", "confident"), count("guess", "guess"), count("nothing", "nothing"), F.count(F.lit(1)).alias("total"))


def strength(kappa: Column) -> Column:
    """The name of a kappa's band (Landis and Koch)."""
    bands = F.when(kappa < 0, "worse than chance").when(kappa < 0.2, "slight").when(kappa < 0.4, "fair").when(kappa < 0.6, "moderate").when(kappa < 0.8, "substantial")
    return F.when(kappa.isNotNull(), bands.otherwise("almost perfect"))


def judge_agreement(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Agreement and Cohen's kappa of two judges (first, second booleans); null where undefined."""
    n = F.count(F.lit(1))
    counts = pairs.groupBy(*by).agg(
        n.alias("n"),
        F.count_if(F.col("first") & F.col("second")).alias("both_yes"),
        F.count_if(F.col("first") & ~F.col("second")).alias("first_only"),
        F.count_if(~F.col("first") & F.col("second")).alias("second_only"),
        F.count_if(~F.col("first") & ~F.col("second")).alias("neither"),
    )
    p0 = (F.col("both_yes") + F.col("neither")) / F.col("n")
    a, b = (F.col("both_yes") + F.col("first_only")) / F.col("n"), (F.col("both_yes") + F.col("second_only")) / F.col("n")
    pe = a * b + (1.0 - a) * (1.0 - b)
    kappa = F.when(F.abs(1.0 - pe) < 2.220446049250313e-16, F.lit(None)).otherwise((p0 - pe) / (1.0 - pe))
    rated = counts.withColumns({"agreement": p0, "kappa": kappa})
    return rated.withColumns({"strength": strength(F.col("kappa")), "agreement": F.round("agreement", 6), "kappa": F.round("kappa", 6)})


def latency_percentiles(samples: DataFrame, value: str, by: str, at: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Lower nearest-rank percentiles of ``value`` for each ``by``, and the maximum.

    Ranks are numbered inside narrow ranges of the value, so no group is sorted in one task: a range
    keeps its count, and only the range that holds the wanted rank is looked into.
    """
    spread = samples.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).cast("double").alias("v"))
    bounds = spread.groupBy("_by").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    cell = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * 1000)).otherwise(0)
    celled = spread.join(bounds, "_by").withColumn("cell", cell)
    counts = celled.groupBy("_by", "cell").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("_by").orderBy("cell")) - F.col("c"))
    names = {q: f"p{round(q * 100)}" for q in at}
    asked = F.array(*(F.struct(F.lit(name).alias("name"), F.floor((F.col("n") - 1) * q).alias("k")) for q, name in names.items()))
    wanted = bounds.select("_by", "high", "n", F.explode(asked).alias("w")).select("_by", "high", "n", "w.*")
    cells = wanted.join(before, "_by").where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("c")))
    inside = celled.select("_by", "cell", "v").join(cells.select("_by", "cell", "before").distinct(), ["_by", "cell"])
    ranked = inside.select("_by", "v", (F.row_number().over(Window.partitionBy("_by", "cell").orderBy("v")) - 1 + F.col("before")).alias("k"))
    found = cells.join(ranked, ["_by", "k"])
    picked = (F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in names.values())
    return found.groupBy(F.col("_by").alias(by), "n", F.col("high").alias("max")).agg(*picked)


def evidence(questions: DataFrame, served: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, golds, found, outcome): how many gold files were served - full, partial or none."""
    hits = gold.join(served.select("qid", "base", "rel").distinct().withColumn("there", F.lit(1)), ["qid", "base", "rel"], "left")
    counts = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("golds"), F.count("there").alias("found"))
    outcome = F.when(F.col("golds").isNull(), "no gold").when(F.col("found") == F.col("golds"), "full").when(F.col("found") > 0, "partial").otherwise("none")
    return questions.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("golds", F.lit(0)).alias("golds"), F.coalesce("found", F.lit(0)).alias("found"), outcome.alias("outcome"))
