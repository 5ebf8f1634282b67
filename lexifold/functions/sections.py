"""Notes to sections under their headings, and long sections to windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest window and overlap of two windows of one section, in characters: fixed values.
WINDOW, OVERLAP = 1_800, 300
#: How lines and sections that only list keys are told: fixed values.
KEY_LINES, KEY_SECTIONS = ("Search for:", "Buscar por:"), ("search for", "buscar por")
LEVELS = range(1, 7)


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def windows(body: Column) -> Column:
    """Windows of at most ``WINDOW`` characters, each overlapping the one before.

    A window ends before its last blank line, if that lies past a third of it; the last one ends with
    the text.  Windows are trimmed; blank ones go.
    """
    n = F.char_length(body)

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        blank = F.char_length(F.regexp_extract(F.substring(body, at, F.lit(WINDOW)), r"(?s)^(.*)\n\n", 1))
        size = F.when((at - 1 + WINDOW < n) & (blank > WINDOW // 3), blank).otherwise(WINDOW)
        stop = F.least(at - 1 + size, n)
        after = F.when(stop < n, F.greatest(stop - OVERLAP, at) + 1)
        # A null start says that the text is used up.
        return F.struct(after.alias("at"), F.when(at.isNull(), acc["w"]).otherwise(F.concat(acc["w"], F.array(F.struct(at.alias("at"), stop.alias("stop"))))).alias("w"))

    empty = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,stop:int>>").alias("w"))
    most = (n / (WINDOW // 3 + 1 - OVERLAP)).cast("int")
    cuts = F.aggregate(F.sequence(F.lit(0), most), empty, step, lambda acc: acc["w"])
    texts = F.transform(cuts, lambda c: trimmed(F.substring(body, c["at"], c["stop"] - c["at"] + 1)))
    return F.when(n <= WINDOW, F.array(body)).otherwise(F.filter(texts, lambda w: w != ""))


def sections(notes: DataFrame) -> DataFrame:
    """(base, rel, section, heading, parent_heading, title, body): what stands under each heading of notes (base, rel, text).

    Front matter goes, also one that never ends; ``#`` inside a fenced block opens no section; lines
    and sections of keys go.  ``heading`` is the path of headings, joined by `` > ``: a heading ends all
    of its own level or deeper.  Text above the first heading is section 0 with an empty path.  Blank
    sections go, so a null or empty text gives no row.  Lines are shuffled once, by note.
    """
    note = ["base", "rel"]
    lines = notes.select(*note, F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)).alias("line", "text"))
    by = Window.partitionBy(*note).orderBy("line")
    dashes = trimmed(F.col("text")) == "---"
    opened = F.first(dashes).over(by)
    ended = F.coalesce(F.count_if(dashes).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) >= 2
    lines = lines.withColumn("_matter", opened & ~ended).where("not _matter")
    fences = F.count_if(F.col("text").rlike(r"^\s*(```|~~~)")).over(by)
    level = F.when(fences % 2 == 0, F.nullif(F.char_length(F.regexp_extract("text", "^(#{1,6}) ", 1)), F.lit(0)))
    lines = lines.withColumn("level", level).withColumn("section", F.count("level").over(by))
    kept = F.col("level").isNull() & ~F.contains("text", F.lit(KEY_LINES[0])) & ~F.contains("text", F.lit(KEY_LINES[1]))
    # All of this keeps the partitioning by note.
    found = lines.groupBy(*note, "section").agg(
        F.max("level").alias("level"),
        F.max(F.when(F.col("level").isNotNull(), trimmed(F.expr("substr(text, level + 1)")))).alias("title"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("line", "text")))).alias("_lines"),
    )
    so_far = Window.partitionBy(*note).orderBy("section")
    last = {n: F.last(F.when(F.col("level") == n, F.struct("section", "title")), True).over(so_far) for n in LEVELS}
    found = found.withColumns({f"_h{n}": c for n, c in last.items()})
    above = lambda n: F.coalesce(F.greatest(F.lit(-1), *(F.col(f"_h{m}.section") for m in range(1, n))), F.lit(-1)) if n > 1 else F.lit(-1)
    path = F.array_compact(F.array(*(F.when(F.col(f"_h{n}.section") > above(n), F.col(f"_h{n}.title")) for n in LEVELS)))
    found = found.select(*note, "section", path.alias("_path"), "title", trimmed(F.array_join(F.transform("_lines", lambda x: x["text"]), "\n")).alias("body"))
    keys = F.lower(F.coalesce("title", F.lit("")))
    found = found.where((F.col("body") != "") & ~keys.startswith(KEY_SECTIONS[0]) & ~keys.startswith(KEY_SECTIONS[1]))
    return found.select(*note, "section", F.array_join("_path", " > ").alias("heading"), F.when(F.size("_path") > 1, F.try_element_at("_path", F.lit(-2))).alias("parent_heading"), "title", "body")


def chunks(notes: DataFrame) -> DataFrame:
    """(base, rel, section, seq, heading, parent_heading, text): the windows of each section."""
    split = sections(notes).select("base", "rel", "section", "heading", "parent_heading", F.posexplode(windows(F.col("body"))).alias("seq", "text"))
    return split.select("base", "rel", "section", "seq", "heading", "parent_heading", "text")
