"""Blocks of a base: what a manifest lists, how large it is, how much of it is code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsers import token_estimate
from ..functions.sections import trimmed

#: Lines that list keys, with lines of keys that a comma at the end announces.
KEY_LINES = r"(?im)^[^\S\n]*[*_]*(?:search for|buscar por)[*_]*:(?:[^\n]*,[^\S\n]*\n[^\S\n]*(?=`))*[^\n]*(?:\n|\z)"


def without_key_lines(text: Column) -> Column:
    """A text without its lines of keys; a line that ends with a comma takes those that begin with a backtick along."""
    return F.regexp_replace(text, KEY_LINES, "")


def code_bytes(text: Column) -> Column:
    """Bytes of the lines in fenced blocks, fences and line ends included.

    A fence is three or more backticks or tildes with at most three blanks before; a fence of backticks
    has no backtick behind it.  A block ends with a fence of the same character that is no shorter, else
    with the text.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    said = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^ {0,3}(`{3,})[^`]*$", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"(?s)^ {0,3}(~{3,})", 1), F.lit("")))
    told = F.transform(lines, lambda x, i: F.struct((F.octet_length(x) + F.when(i < F.size(lines) - 1, 1).otherwise(0)).alias("size"), said(x).alias("fence")))

    def step(state: Column, line: Column) -> Column:
        ends = (F.left(line["fence"], F.lit(1)) == F.left(state["open"], F.lit(1))) & (F.char_length(line["fence"]) >= F.char_length(state["open"]))
        inside = state["open"].isNotNull()
        now = F.when(inside & F.coalesce(ends, F.lit(False)), F.lit(None).cast("string")).when(inside, state["open"]).otherwise(line["fence"])
        code = state["code"] + F.when(inside | line["fence"].isNotNull(), line["size"]).otherwise(0)
        return F.struct(now.alias("open"), code.cast("long").alias("code"))

    return F.aggregate(told, F.struct(F.lit(None).cast("string").alias("open"), F.lit(0).cast("long").alias("code")), step, lambda s: s["code"])


def manifest(texts: DataFrame) -> DataFrame:
    """(root, base, pos, name, resident, line, rel): the blocks of manifests (root, base, text) and the files they list.

    ``[name]`` opens a block and ``[name] on-demand`` one that is not resident; what follows ``#`` is no
    part of a line.  Files above the first block, and openings that do not end, are left out.  A block
    without files has one row with a null ``rel``.
    """
    lines = texts.select("root", "base", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)).alias("line", "said"))
    lines = lines.withColumn("said", trimmed(F.regexp_extract("said", r"^([^#]*)", 1))).where("said <> ''")
    opens = F.col("said").startswith("[")
    name = F.when(opens & F.contains("said", F.lit("]")), F.struct(F.col("line").alias("pos"), trimmed(F.regexp_extract("said", r"^\[([^\]]*)\]", 1)).alias("name"), (F.lower(trimmed(F.regexp_extract("said", r"^\[[^\]]*\](.*)$", 1))) != "on-demand").alias("resident")))
    running = F.last(name, True).over(Window.partitionBy("root").orderBy("line"))
    rows = lines.withColumns({"_b": running, "_opens": opens}).where("_b is not null")
    listed = rows.where("not _opens").select("root", "base", "_b.*", "line", F.col("said").alias("rel"))
    bare = rows.where("_opens and line = _b.pos").select("root", "base", "_b.*", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("rel"))
    return listed.unionByName(bare)


def report(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(root, pos, name, resident, files, missing, file_bytes, bytes, code_bytes, tokens, cost): a row for each block (Q15).

    ``files`` has base, rel, text.  ``bytes`` and what follows are without the lines of keys; ``cost`` is the
    tokens to be sent again when a resident block changes: its own and those of the resident ones behind it.
    """
    kept = without_key_lines(F.coalesce("text", F.lit("")))
    wanted = files.join(listed.select("base", "rel").distinct(), ["base", "rel"], "left_semi")
    sized = wanted.select("base", "rel", F.octet_length(F.coalesce("text", F.lit(""))).alias("_all"), kept.alias("_kept")).select("base", "rel", "_all", F.octet_length("_kept").alias("_sent"), code_bytes(F.col("_kept")).alias("_code"))
    joined = listed.join(sized, ["base", "rel"], "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    blocks = joined.groupBy("root", "pos", "name", "resident").agg(
        F.count("_all").alias("files"), F.count_if(F.col("rel").isNotNull() & F.col("_all").isNull()).alias("missing"), total("_all", "file_bytes"), total("_sent", "bytes"), total("_code", "code_bytes")
    )
    blocks = blocks.withColumn("tokens", token_estimate(F.col("bytes"), F.col("code_bytes")))
    behind = Window.partitionBy("root").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("cost", F.when(F.col("resident"), F.sum(F.when(F.col("resident"), F.col("tokens")).otherwise(0)).over(behind)))
