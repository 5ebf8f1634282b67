"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, odd characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, copies string, blocks string"

SHARED = "A line that several of the documents share."
ROWS = [
    (1, f"First words of a text.\n{SHARED}\nIts end is here.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "a"),
    (4, "   \t \n ", "fr", None),
    (5, f"Other words.\n  {SHARED.upper()}\t\n\nEnd.", "en", "a"),
    (6, f"{SHARED}\n{SHARED}", "en", "b"),
    (7, "Le texte français avec des mots comme été, où et ça.", "fr", "b"),
    (8, "Le texte français avec des mots comme été, où et ça.", "fr", "b"),
    (8, "Le texte français avec des mots comme été, où et ça.", "fr", "b"),
    (None, f"No id at all.\n{SHARED}", "en", "b"),
    (10, "word " * 40_000 + "end", "en", "c"),
    (11, "x" * 70_000, "en", "c"),
    (12, "Straße İstanbul é é 😀 　 中文 <|endoftext|> don't", "de", "c"),
    (13, "123 456 !!! ---", "de", "c"),
    (9_000_000_000, "\x00\x0b\x0c odd \x1c marks   here", "en", "d"),
]


def edge(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", "z", "w") for i, t, lang, s in ROWS], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def plain(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
