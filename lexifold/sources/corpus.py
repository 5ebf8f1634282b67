"""Notes, entries, chunks and questions.

``notes`` reads markdown files; ``from_documents`` makes the same tables from the ``documents`` and
``benchmark`` tables (base = source, title = first line, purpose = second line, keywords = mechanical
keys of the text).
"""

from __future__ import annotations

from collections import Counter
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ALNUM, KEY_STOPWORDS

#: Longest chunk and overlap of two windows of one section, in characters.
CHUNK, OVERLAP = 1_800, 300
#: Words of a benchmark passage that make a question.
QUESTION_WORDS = 12
KEYS = 24


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def notes(spark: SparkSession, root: str) -> DataFrame:
    """(base, rel, stem, text, private) of all ``.md`` files below ``root/<base>/``.

    Files below a folder that starts with a dot, or below build folders, are left out.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").text(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    found = files.select(F.col("value").alias("text"), path.alias("path"))
    found = found.where(~F.col("path").rlike(r"(^|/)(\.[^/]+|target|node_modules|dist|build)/"))
    rel = F.regexp_replace("path", r"^[^/]+/", "")
    return found.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("base"), rel.alias("rel"), F.regexp_extract("path", r"([^/]+)\.[mM][dD]$", 1).alias("stem"), "text", in_private_layer(rel).alias("private"))


def in_private_layer(rel) -> Column:
    """Whether a path is a private folder or lies below one (F4), with the default folders."""
    return rel.rlike(r"^(profile|projects|records)(/|$)")


def kind(rel) -> Column:
    """Memory, skills or tools, from the first folder."""
    first = F.split_part(rel, F.lit("/"), F.lit(1))
    return F.when(first.isin("skills", "tools"), first).otherwise("memory")


def layer(rel) -> Column:
    """Short below an ``inbox`` folder, else long."""
    return F.when(F.array_contains(F.split(rel, "/"), "inbox"), "short").otherwise("long")


def document_notes(docs: DataFrame) -> DataFrame:
    """Documents as notes: one in five is a skill, one a tool, one in the inbox; one in eleven is private."""
    folder = F.when(F.col("doc_id") % 5 == 3, "skills/").when(F.col("doc_id") % 5 == 4, "tools/").when(F.col("doc_id") % 5 == 2, "inbox/").otherwise("knowledge/")
    return docs.select(
        "doc_id",
        F.col("source").alias("base"),
        F.concat(folder, F.col("doc_id").cast("string"), F.lit(".md")).alias("rel"),
        F.col("doc_id").cast("string").alias("stem"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.col("doc_id") % 11 == 0).alias("private"),
    )


def ranked_keys(words: list[str | None], cap: int) -> list[str]:
    """The keys of one text: words are null where they are left out, so that what is adjacent stays adjacent."""
    order = lambda counts: sorted(counts, key=lambda k: (-counts[k], k))
    pairs = Counter(f"{a} {b}" for a, b in pairwise(words) if a and b)
    kept = order({k: c for k, c in pairs.items() if c > 1})[: cap // 3]
    for word in order(Counter(w for w in words if w)):
        if len(kept) >= cap:
            break
        if not any(word in k for k in kept):
            kept.append(word)
    return kept


def key_column(text: Column, cap: int = KEYS) -> Column:
    """Frequent adjacent pairs, then words that no kept key contains (T14); none for a null or empty text.

    Ordered by count, then alphabetically; pairs must occur twice and take a third of the places.  A text's
    counts need no other text, so nothing is shuffled: words are cut by Spark and counted in Arrow batches.
    """
    stop = lambda w: (F.octet_length(w) < 4) | w.isin(*KEY_STOPWORDS)
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM), 1), lambda w: F.when(~stop(w), w))

    @F.arrow_udf("array<string>")
    def keys(batch: pa.Array) -> pa.Array:
        return pa.array([ranked_keys(row, cap) for row in batch.to_pylist()], pa.list_(pa.string()))

    return keys(words)


def mechanical_keys(texts: DataFrame, key: str = "doc_id", cap: int = KEYS) -> DataFrame:
    """(key, keywords) of the texts that have any."""
    return texts.select(key, key_column(F.col("text"), cap).alias("keywords")).where(F.size("keywords") > 0)


def document_entries(docs: DataFrame) -> DataFrame:
    """(doc_id, base, rel, stem, title, purpose, keywords) of every document."""
    lines = F.split(F.col("text"), "\n", -1)
    found = document_notes(docs)
    named = {"title": F.element_at(lines, 1), "purpose": F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")), "keywords": key_column(F.col("text"))}
    return found.withColumns(named).drop("text")


def windows(text) -> Column:
    """Windows of ``CHUNK`` characters that overlap by ``OVERLAP`` (P6), with their number."""
    step = CHUNK - OVERLAP
    last = F.when(F.char_length(text) <= CHUNK, 0).otherwise(F.ceil((F.char_length(text) - CHUNK) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("seq"), F.substring(text, i * step + 1, F.lit(CHUNK)).alias("text")))


def document_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, base, rel, private, chunk_id, seq, heading, text): windows of each document under its title."""
    split = document_notes(docs).withColumn("w", F.explode(windows(F.col("text"))))
    heading = F.element_at(F.split(F.col("text"), "\n", -1), 1)
    return split.select("doc_id", "base", "rel", "private", (F.col("doc_id") * 1_000_000 + F.col("w.seq")).alias("chunk_id"), "w.seq", heading.alias("heading"), F.col("w.text").alias("text"))


def questions(benchmark: DataFrame, words: int = QUESTION_WORDS) -> DataFrame:
    """(qid, question): the first words of each benchmark passage."""
    return benchmark.select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.filter(F.split("text", r"[ \n]+"), lambda w: w != ""), 1, words), " ").alias("question"))
