"""What of a file is shown to a reader: slices by line, assembled passages, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sections import trimmed
from ..functions.text import ACCENTED, PLAIN, once

#: Lines around a hit, characters of a slice, the mark of a gap: fixed values.
RADIUS, SLICE_CHARS, GAP = 40, 60_000, "[...]"
#: Passages of a file, characters of an assembled passage, least bytes of an overlap: fixed values.
PASSAGES, PASSAGE_CHARS, OVERLAP_BYTES = 8, 1_800, 10
#: Tokens of an excerpt and what stands for the text left out: fixed values.
EXCERPT_TOKENS, ELLIPSIS = 14, " ... "


def slices(served: DataFrame, files: DataFrame, section: str, radius: int = RADIUS, most: int = SLICE_CHARS) -> DataFrame:
    """(qid, base, rel, slice): of each served file (qid, base, rel, terms, anchors) the lines worth reading (P25).

    Sections that ``anchors`` name come first: ``section`` is a pattern whose group 1 names the section
    that a line opens, and a section lasts to the next.  Then come the lines within ``radius`` of one that
    holds a term, whatever its case.  Lines are taken in this order while they and their line ends fit
    into ``most`` characters, and shown in the file's order with a mark before each run.  A file without
    either shows its head.  Null texts are empty; null terms and anchors name nothing.

    Runs of lines come from running frames over the lines of one file for one question, in linear time.
    """
    place = ["qid", "base", "rel"]
    lines = files.select("base", "rel", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "text"))
    asked = served.select(*place, F.filter(F.transform("terms", F.lower), lambda t: t != "").alias("_terms"), "anchors")
    rows = asked.join(lines, ["base", "rel"])
    by = Window.partitionBy(*place).orderBy("line")
    hit = F.coalesce(F.exists("_terms", lambda t: F.contains(F.lower("text"), t)), F.lit(False))
    opened = F.nullif(F.regexp_extract("text", section, 1), F.lit(""))
    rows = rows.withColumns({"_hit": F.when(hit, F.col("line")), "_opened": opened}).drop("_terms")
    after = Window.partitionBy(*place).orderBy(F.desc("line"))
    rows = rows.withColumns({"_before": F.last("_hit", True).over(by), "_after": F.last("_hit", True).over(after), "_section": F.last("_opened", True).over(by)})
    anchored = F.coalesce(F.array_contains("anchors", F.col("_section")), F.lit(False))
    near = (F.col("line") - F.col("_before") <= radius) | (F.col("_after") - F.col("line") <= radius)
    whole = Window.partitionBy(*place)
    group = F.when(anchored, 0).when(F.coalesce(near, F.lit(False)), 1)
    rows = rows.withColumn("_group", group).withColumn("_any", F.count("_group").over(whole) > 0)
    order = Window.partitionBy(*place).orderBy("_group", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.where("_any and _group is not null").withColumn("_size", F.sum(F.char_length("text") + 1).over(order)).where(F.col("_size") <= most)
    first = F.coalesce(F.col("line") != F.lag("line").over(by) + 1, F.lit(True))
    marked = kept.withColumn("_shown", F.when(first, F.concat(F.lit(GAP + "\n"), "text")).otherwise(F.col("text")))
    joined = lambda column: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.col(column).alias("s")))), lambda x: x["s"]), "\n")
    found = marked.groupBy(*place).agg(joined("_shown").alias("slice"))
    heads = rows.where(~F.col("_any") & (F.col("line") < 2 * radius)).groupBy(*place).agg(F.substring(joined("text"), 1, most).alias("slice"))
    nothing = rows.groupBy(*place).agg(F.max("_any").alias("_any")).where("_any")  # anchored or near, though not a line fits
    return found.unionByName(heads).unionByName(nothing.join(found, place, "left_anti").select(*place, F.lit("").alias("slice")))


def merged(first: Column, second: Column) -> Column:
    """Two texts as one: the longer if it holds the other, else joined where the end of one begins the other."""
    sizes = F.sequence(F.least(F.char_length(first), F.char_length(second)), F.lit(1), F.lit(-1))
    same = F.filter(sizes, lambda n: (F.right(first, n) == F.left(second, n)) & (F.octet_length(F.left(second, n)) >= OVERLAP_BYTES))
    n = F.try_element_at(same, F.lit(1))
    rest = trimmed_start(F.substring(second, n + 1, F.char_length(second)))
    apart = F.concat(first, F.lit("\n\n"), second)
    return F.when(F.contains(first, second), first).when(F.contains(second, first), second).when(n.isNotNull(), F.concat(first, F.lit("\n"), rest)).otherwise(apart)


def trimmed_start(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+", "")


def capped(text: Column, most: int = PASSAGE_CHARS) -> Column:
    """A text cut to ``most`` characters: at its last blank line past the half, else behind its last sentence there, else anywhere."""
    head = F.left(text, F.lit(most))
    paragraph = F.char_length(F.regexp_extract(head, r"(?s)^(.*)\n\n", 1))
    sentence = F.char_length(F.regexp_extract(head, r"(?s)^(.*)\. ", 1))
    cut = F.when(paragraph > most // 2, trimmed(F.left(head, paragraph))).when(sentence > most // 2, F.concat(trimmed(F.left(head, sentence)), F.lit("."))).otherwise(trimmed(head))
    return F.when(F.char_length(text) <= most, text).otherwise(cut)


def assembled(hits: DataFrame, passages: int = PASSAGES, most: int = PASSAGE_CHARS) -> DataFrame:
    """(qid, base, rel, heading, at, text): the passages of each file, those of one heading merged into one.

    ``hits`` has qid, base, rel, rank, heading, captured_from, text.  The first ``passages`` of a file by
    rank take part.  Those with the same heading and origin are folded in the order of rank; ``at`` is the
    rank of the first of them.
    """
    nth = F.row_number().over(Window.partitionBy("qid", "base", "rel").orderBy("rank"))
    taken = hits.withColumn("_n", nth).where(F.col("_n") <= passages)
    parts = taken.groupBy("qid", "base", "rel", "heading", "captured_from").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))).alias("_parts"))
    texts = F.transform("_parts", lambda p: trimmed(p["text"]))
    lone = F.element_at("_parts", 1)["text"]
    fold = F.aggregate(F.slice(texts, F.lit(2), F.size(texts)), F.element_at(texts, 1), merged)
    return parts.select("qid", "base", "rel", "heading", F.element_at("_parts", 1)["rank"].alias("at"), capped(F.when(F.size("_parts") == 1, lone).otherwise(fold), most).alias("text"))


def excerpt(text: Column, terms: Column, tokens: int = EXCERPT_TOKENS) -> Column:
    """The ``tokens`` tokens of a text that hold most of the terms.

    The most distinct terms win, then the most tokens that are terms, then the earliest place.  What is
    left out before or behind is marked; what separates tokens stays as it is.
    """
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\p{IsAlphabetic}\p{N}]*[\p{IsAlphabetic}\p{N}]+)"), 1)

    def best(found: Column) -> Column:
        """Where the best window of found terms (null for other tokens) begins."""

        def rated(i: Column) -> Column:
            inside = F.array_compact(F.slice(found, i, F.lit(tokens)))
            return F.struct(F.size(F.array_distinct(inside)).alias("distinct"), F.size(inside).alias("hits"), (-i).alias("at"))

        last = F.greatest(F.size(found) - tokens + 1, F.lit(1))
        return -F.array_max(F.transform(F.sequence(F.lit(1), last), rated))["at"]

    def shown(ps: Column) -> Column:
        words = F.transform(ps, lambda p: F.lower(F.translate(F.regexp_replace(p, r"^[^\p{IsAlphabetic}\p{N}]+", ""), ACCENTED, PLAIN)))
        return once(once(F.transform(words, lambda w: F.when(F.array_contains(terms, w), w)), best), lambda at: cut(ps, at))

    def cut(ps: Column, at: Column) -> Column:
        middle = F.regexp_replace(F.array_join(F.slice(ps, at, F.lit(tokens)), ""), r"^[^\p{IsAlphabetic}\p{N}]+", "")
        before, behind = F.when(at > 1, F.lit(ELLIPSIS)).otherwise(""), F.when(at + tokens - 1 < F.size(ps), F.lit(ELLIPSIS)).otherwise("")
        return F.when(F.size(ps) == 0, F.lit("")).otherwise(F.concat(before, middle, behind))

    return once(pieces, shown)
