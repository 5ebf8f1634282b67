"""Log files of one record a line to tables, rows that are no records set apart (S12), and the order of a report (O3).

Texts are (file, text).  Lines that begin with ``#`` and blank ones are no rows.  Every other row comes
out: ``bad`` says why it is no record and is null for records, so readers filter on it and count it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MOST = 4_294_967_295


def log_lines(texts: DataFrame) -> DataFrame:
    """(file, line, text): lines by their number from 1."""
    lines = texts.select("file", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)).alias("_n", "text"))
    return lines.select("file", (F.col("_n") + 1).alias("line"), "text")


def _rows(lines: DataFrame) -> DataFrame:
    return lines.where(~F.startswith("text", F.lit("#")) & (_bare("text") != ""))


def _bare(x) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _number(text: Column) -> Column:
    """A count as the logs write it, null for anything else."""
    value = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("decimal(38,0)"))
    return F.when(value <= _MOST, value.cast("long"))


def misses(texts: DataFrame) -> DataFrame:
    """(file, line, count, first, last, question, looked_like, bad) of logs with three fields, then the question.

    A line ``looked like: a, b`` goes on with the record above it, whatever bad lines stand between; the
    last one counts.  One without a record above is bad.  Of several records of a question, whatever their
    case, the last one holds.
    """
    lines = log_lines(texts)
    more = F.col("text").rlike(r"^\s*looked like:")
    rows = lines.withColumn("_more", more).where(F.col("_more") | (~F.startswith("text", F.lit("#")) & (_bare("text") != "")))
    part = lambda i: F.regexp_extract("text", r"(?s)^\s*(\S+)\s+(\S+)\s+(\S+)\s+(\S.*)$", i)
    count = _number(part(1))
    bad = F.when(F.col("_more"), None).when(part(4) == "", "fields").when(count.isNull(), "count")
    rows = rows.withColumns({"bad": bad, "count": count, "first": part(2), "last": part(3), "question": part(4)})
    record = F.when(~F.col("_more") & F.col("bad").isNull(), F.col("line"))
    above = F.last(record, True).over(Window.partitionBy("file").orderBy("line"))
    rows = rows.withColumn("_of", above)
    words = F.filter(F.transform(F.split(F.regexp_replace("text", r"^\s*(looked like:)+", ""), ","), _bare), lambda w: w != "")
    said = rows.where("_more and _of is not null").groupBy("file", F.col("_of").alias("line")).agg(F.max_by(words, "line").alias("looked_like"))
    lost = rows.where("_more and _of is null").withColumns({"bad": F.lit("no record above"), "count": F.lit(None).cast("long"), "question": F.col("text"), "first": F.lit(""), "last": F.lit("")})
    told = rows.where("not _more")
    newest = F.row_number().over(Window.partitionBy("file", F.lower("question")).orderBy(F.desc("line")))
    good = told.where("bad is null").withColumn("_n", newest).where("_n = 1").drop("_n").join(said, ["file", "line"], "left")
    none = F.array().cast("array<string>")
    shown = ["file", "line", "count", "first", "last", "question", F.coalesce("looked_like", none).alias("looked_like"), "bad"]
    rest = told.where("bad is not null").withColumn("question", F.col("text")).unionByName(lost).withColumn("looked_like", none)
    return good.select(*shown).unionByName(rest.select(*shown))


@dataclass(frozen=True)
class Layout:
    """Columns of a log parted by tabs; rows with fewer than ``least`` are bad, later columns may be missing."""

    columns: tuple[str, ...]
    least: int
    #: What a count that is none becomes; None makes the row bad.
    count: int | None = 1
    #: Whether the last column takes what is left of the line, and all are trimmed.
    tail: bool = False
    #: Values that the named column may have.
    known: tuple[str, tuple[str, ...]] | None = None
    #: Column that breaks ties of the count in a report; None keeps the order of the file.
    ties: str | None = None


#: The logs that are parted by tabs: fixed formats.
LAYOUTS = {
    "misroutes": Layout(("count", "first", "last", "chose", "owner", "question", "why"), 6),
    "abstentions": Layout(("count", "first", "last", "coverage", "nearest", "subject", "message", "reason", "contenders"), 7, count=None, ties="subject"),
    "rejections": Layout(("count", "first", "last", "agent", "slug", "lens", "reason"), 7, tail=True),
    "refusals": Layout(("count", "first", "last", "alias", "why"), 5),
    "rounds": Layout(("artifact", "owner", "reviewer", "seq", "state", "opened", "updated", "blocking", "text", "why"), 8, known=("state", ("pending", "objected", "approved", "resolved", "refused", "not-returned"))),
}


def tabbed(texts: DataFrame, layout: Layout) -> DataFrame:
    """(file, line, *columns, bad) of logs in a layout; ``count`` and ``seq`` are longs, ``blocking`` a boolean."""
    rows = _rows(log_lines(texts).withColumn("text", _bare("text") if layout.tail else F.col("text")))
    rows = rows.withColumn("_p", F.split("text", "\t", -1))
    names = layout.columns
    value = lambda i: F.coalesce(F.try_element_at("_p", F.lit(i + 1)), F.lit(""))
    columns = {c: value(i) for i, c in enumerate(names)}
    if layout.tail:
        columns = {c: _bare(v) for c, v in columns.items()}
        columns[names[-1]] = _bare(F.array_join(F.slice("_p", len(names), F.greatest(F.size("_p") - len(names) + 1, F.lit(0))), "\t"))
    bad = F.when(F.size("_p") < layout.least, "columns")
    if "count" in names:
        count = _number(_bare(columns["count"]))
        bad = bad.when(count.isNull(), "count") if layout.count is None else bad
        columns["count"] = F.coalesce(count, F.lit(layout.count).cast("long"))
    if "seq" in names:
        columns["seq"] = F.coalesce(_number(_bare(columns["seq"])), F.lit(0).cast("long"))
    if "blocking" in names:
        columns["blocking"] = _bare(columns["blocking"]) == "blocking"
    if layout.known is not None:
        bad = bad.when(~columns[layout.known[0]].isin(*layout.known[1]), layout.known[0])
    return rows.select("file", "line", *(v.alias(c) for c, v in columns.items()), bad.alias("bad"))


def report(records: DataFrame, ties: str | None) -> DataFrame:
    """Records without the bad ones, with ``position`` in their file: the most frequent first, then by ``ties`` or as they stand (O3)."""
    order = Window.partitionBy("file").orderBy(F.desc("count"), *([ties] if ties else []), "line")
    return records.where("bad is null").withColumn("position", F.row_number().over(order))


def session_events(texts: DataFrame) -> DataFrame:
    """(session, seq, kind, agent, question, looked_like, summary) of event logs, one file a session.

    Lines are ``refused``, ``routed`` or ``conclusion``, a tab, what it is about, and for a refusal another
    tab and what it looked like.  Other lines, and those that are about nothing, are none.
    """
    rows = log_lines(texts).withColumn("_p", F.split("text", "\t", -1))
    about = _bare(F.coalesce(F.try_element_at("_p", F.lit(2)), F.lit("")))
    like = F.filter(F.transform(F.split(F.coalesce(F.try_element_at("_p", F.lit(3)), F.lit("")), ","), _bare), lambda w: w != "")
    kind = F.element_at("_p", 1)
    found = rows.where(kind.isin("refused", "routed", "conclusion") & (about != ""))
    of = lambda name: F.when(kind == name, about)
    return found.select(F.col("file").alias("session"), F.col("line").alias("seq"), kind.alias("kind"), of("routed").alias("agent"), of("refused").alias("question"), F.when(kind == "refused", like).alias("looked_like"), of("conclusion").alias("summary"))
