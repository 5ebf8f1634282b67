"""String functions of the scorers, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Accented letters and what they fold to: fixed values.
ACCENTED = "áàãâäÁÀÃÂÄéèêëÉÈÊËíìîïÍÌÎÏóòõôöÓÒÕÔÖúùûüÚÙÛÜçÇñÑ"
PLAIN = "aaaaaaaaaaeeeeeeeeiiiiiiiioooooooooouuuuuuuuccnn"

#: Words that say nothing about a subject.  A corpus brings its own list; this one is for English.
STOPWORDS = ("the", "an", "is", "are", "was", "were", "be", "been", "of", "to", "in", "on", "for", "with", "as", "at", "by", "from", "and", "or", "but", "if", "not", "that", "this", "it", "its", "he", "she", "you", "we", "they")

#: Function words that mechanical keys leave out: fixed values.
KEY_STOPWORDS = (
    "the", "and", "for", "that", "with", "this", "you", "your", "have", "has", "had",
    "was", "were", "are", "not", "but", "they", "their", "them", "from", "what",
    "when", "where", "which", "will", "would", "could", "should", "about", "there",
    "been", "being", "into", "over", "also", "just", "like", "some", "more", "can",
    "than", "then", "out", "get", "got", "how", "who", "why", "his", "her", "she",
    "him", "its", "our", "ours", "any", "all", "one", "two", "did", "does", "doing",
    "assistant", "user", "yes", "okay", "sure", "thanks", "thank", "help", "know",
    "want", "need", "make", "made", "really", "very", "much", "many", "here",
)

ALNUM = r"([\p{IsAlphabetic}\p{N}]+)"


def normalise(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Keyword tokens (T1): accents fold, only A-Z lower-cased, one-byte words and stopwords go; order and repeats stay."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ACCENTED, PLAIN), F.lit(ALNUM), 1)
    words = F.transform(words, lambda w: F.translate(w, UPPER, LOWER))
    return F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(*stopwords))


def fulltext_tokens(text: Column) -> Column:
    """Full-text tokens (T2): accents fold, all letters lower-cased, nothing is left out."""
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(text, F.lit("")), ACCENTED, PLAIN)), F.lit(ALNUM), 1)


def counted(tokens: Column) -> Column:
    """The distinct tokens of an array as (term, n), by the runs of the sorted array."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        each = lambda starts: F.transform(starts, lambda at, k: F.struct(F.element_at(s, at).alias("term"), (F.coalesce(F.try_element_at(starts, k + 2), F.size(s) + 1) - at).alias("n")))
        return once(starts, each)

    return once(F.sort_array(tokens), lambda s: F.when(F.size(s) == 0, F.array().cast("array<struct<term:string,n:int>>")).otherwise(runs(s)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it for every element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trigrams(word: Column) -> Column:
    """Character trigrams (T3); a shorter word whole."""
    n = F.char_length(word)
    return F.when(n < 3, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(word, i, F.lit(3))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient over two arrays as multisets (T4)."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(2.0 * shared / (F.size(a) + F.size(b)))


def idf(df: Column, total: Column | int) -> Column:
    """How much a term that ``df`` of ``total`` entries hold tells."""
    total = F.lit(total) if isinstance(total, int) else total
    return F.log(1.0 + total.cast("double") / (1.0 + F.coalesce(df, F.lit(0))))


def round6(x: Column) -> Column:
    return F.round(x, 6)
