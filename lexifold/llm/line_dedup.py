"""Line dedup: lines that many documents share stay only in the document with the largest id.

A text is split at ``\\n``.  A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends,
A-Z lower-cased.  Only keys of ``min_chars`` code points or more that ``min_docs`` documents or
more hold lose lines.

What is shuffled is 128-bit hashes with document and position: they are range-partitioned by hash
and sorted by (hash, document descending, position), so that the first rows of a run are the lines
that stay and the rest are marked.  Marks come back as a compressed bitmap for each document - a
map from the index of a 64-line word to that word's dropped bits, without the words that drop
nothing - and only then meet the text.  A document is told by its id when documents are counted, but a
bitmap belongs to an id and a hash of the text, so rows that share an id and not a text lose only
lines of their own.  Keys with very many lines would fill one range; they are
found by a count that is summed before it is shuffled and decided by a broadcast table whose
length is bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, checkpointed, shuffle_partitions

#: No more than this many keys can be hot: a hot key holds more than 1/HOT_KEYS of all keyed lines.
HOT_KEYS = 500_000
#: A key with fewer lines is never hot.
HOT_LINES = 1_000


def line_key(line):
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, own, pos, hi, lo) of every line whose key is long enough; (hi, lo) is the key's 128-bit hash, own that of the text."""
    lines = docs.select("doc_id", text_hash().alias("own"), F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "own", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return lines.select("doc_id", "own", "pos", F.xxhash64("key").alias("hi"), F.xxhash64(F.lit(7), F.col("key")).alias("lo"))


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, own, dropped): ``dropped`` maps a word's index to the bits of its dropped lines.

    ``own`` is the hash of the text.  Texts that drop nothing have no row.  Rows that share an id count
    as one document; lines that the largest id holds stay in all its rows.  Rows without an id hold no
    lines that count.
    """
    spark = docs.sparkSession
    lines = checkpointed(_keyed_lines(docs.where(F.col("doc_id").isNotNull()), min_chars))  # read three times below

    totals = lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    # Most keys have one line: keep what can be hot, and the overall count, in one pass.
    sized = checkpointed(totals.groupBy(F.when(F.col("n") >= HOT_LINES, F.col("hi")).alias("hi"), F.when(F.col("n") >= HOT_LINES, F.col("lo")).alias("lo")).agg(F.sum("n").alias("n")))
    threshold = max(HOT_LINES, (sized.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = sized.where(F.col("hi").isNotNull() & (F.col("n") >= threshold)).select("hi", "lo")

    marked = lines.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), ["hi", "lo"], "left")
    of_hot = marked.where(F.col("is_hot"))
    # One row for each hot key and document first, so that a count of documents is a plain sum.
    held = of_hot.select("hi", "lo", "doc_id").distinct().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
    shared = checkpointed(held.where(F.col("docs") >= min_docs).select("hi", "lo", "keeper"))
    hot_drops = of_hot.join(F.broadcast(shared), ["hi", "lo"]).where(F.col("doc_id") != F.col("keeper")).select("doc_id", "own", "pos")

    cold = marked.where(F.col("is_hot").isNull()).select("hi", "lo", "doc_id", "own", "pos")
    cold = cold.repartitionByRange(shuffle_partitions(spark), "hi", "lo").sortWithinPartitions("hi", "lo", F.desc("doc_id"), "pos")
    run = Window.partitionBy("hi", "lo").orderBy(F.desc("doc_id"))
    ranked = cold.withColumn("nth", F.dense_rank().over(run)).withColumn("docs", F.max("nth").over(Window.partitionBy("hi", "lo")))
    cold_drops = ranked.where((F.col("docs") >= min_docs) & (F.col("nth") > 1)).select("doc_id", "own", "pos")

    drops = cold_drops.unionByName(hot_drops)
    words = drops.groupBy("doc_id", "own", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc_id", "own").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def _with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    bitmaps = drop_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).select(F.col("doc_id").alias("_doc"), F.col("own").alias("_own"), F.col("dropped").alias("_dropped"))
    return docs.join(bitmaps, (F.col("doc_id") == F.col("_doc")) & (text_hash() == F.col("_own")), "left").drop("_doc", "_own")


def _kept():
    """The text without the lines that ``_dropped`` marks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = lambda i: F.coalesce(F.try_element_at("_dropped", F.shiftright(i, 6)), F.lit(0).cast("long"))
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: F.getbit(bits(i), i % 64) == 0)
    return F.when(F.col("_dropped").isNull(), text).otherwise(F.array_join(kept, "\n"))


def with_kept_text(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``; columns of these names are replaced.

    Null and empty texts are one empty line; an empty table gives an empty result.
    """
    joined = _with_bitmaps(docs, min_chars, min_docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    n_dropped = F.aggregate(F.map_values("_dropped"), F.lit(0).cast("long"), lambda acc, w: acc + F.bit_count(w))
    return joined.withColumns({
        "kept_text": _kept(),
        "n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_dropped": F.when(F.col("_dropped").isNull(), F.lit(0).cast("long")).otherwise(n_dropped),
    }).drop("_dropped")


def without_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the same columns, ``text`` (and ``n_chars``, where it is there) being what is left; no row goes."""
    out = _with_bitmaps(docs, min_chars, min_docs).withColumn("text", _kept())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
