"""URL filters: a blocked Bloom filter lets possible hits through, an exact hash join settles them.

A listed URL is (host, path, verdict).  It fits a page if the page's host is that host or one of its
subdomains and the page's path starts with that path; of several fitting ones the longest wins.
Every URL is therefore tried under the keys ``suffix of the host + prefix of the path``, with
prefixes of the lengths that the list has.  A key goes to one 256-bit block of the filter, in which
eight bits must be set.  The filter's size follows the list up to ``MAX_BLOCKS`` blocks (32 MB), which
bounds what is broadcast; with a longer list more keys pass and the join, which Spark plans by size,
still gives exact results.  Each distinct URL is judged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

MAX_BLOCKS = 1 << 20
#: Room for a listed key; 16 bits give a false positive in some hundreds of keys.
BITS_PER_KEY = 16

#: The rules of the registered query, as (host, path, verdict): fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def canonical_parts(url):
    """(host, path) of a URL column: both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def bloom_filter(keys: DataFrame, column: str = "key") -> np.ndarray:
    """The filter of a column of strings: an array of blocks of eight 32-bit words."""
    hashes = keys.select(F.xxhash64(column).alias("h"))
    n = hashes.count()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 256 < n * BITS_PER_KEY:
        blocks *= 2
    word = lambda i: F.bit_or(F.call_function("shiftleft", F.lit(1), F.shiftright("h", 5 * i).bitwiseAND(F.lit(31)).cast("int"))).alias(f"w{i}")
    filled = hashes.groupBy(F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(blocks - 1)).alias("block")).agg(*(word(i) for i in range(8)))
    out = np.zeros((blocks, 8), np.int32)
    for row in filled.collect():  # a row for each block
        out[row[0]] = row[1:]
    return out.view(np.uint32)


def may_hold(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes the filter lets through."""
    h = hashes.view(np.uint64)
    rows = bloom[(h >> np.uint64(40)) & np.uint64(len(bloom) - 1)]
    bits = (h[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(5))) & np.uint64(31)
    return ((rows >> bits.astype(np.uint32)) & 1).all(axis=1)


def judge_urls(pages: DataFrame, listed: DataFrame, otherwise: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the fitting listed key, else null) and ``verdict``.

    ``listed`` has host, path and verdict; a key listed twice blocks if one of them blocks.  Pages
    that no listed URL fits, null URLs among them, get ``otherwise``.  Every row of ``pages`` comes
    back once; columns of ``pages`` named like the results are replaced.
    """
    spark = pages.sparkSession
    listed = listed.select("host", "path", "verdict", F.concat("host", "path").alias("key")).groupBy("key", F.length("path").alias("_len")).agg(F.max("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in listed.select("_len").distinct().collect())  # no more than the longest URL has characters
    bloom = spark.sparkContext.broadcast(bloom_filter(listed))

    @F.pandas_udf("boolean")
    def possible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            yield pd.Series(may_hold(bloom.value, h.to_numpy(np.int64)))

    host, path = canonical_parts(F.col("url"))
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct().select("url", host.alias("host"), path.alias("path")).where("host <> ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths or [0])), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = urls.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes)).select("url", F.concat("suffix", "prefix").alias("key"))
    passed = tried.withColumn("_h", F.xxhash64("key")).where(possible("_h")).drop("_h")
    hits = passed.join(listed, "key")
    best = hits.groupBy(F.col("url").alias("_url")).agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), "key")).alias("_best"))

    out = pages.drop("host", "path", "rule", "verdict").join(best, F.col("url") == F.col("_url"), "left")
    return out.withColumns({"host": host, "path": path, "rule": F.col("_best.key"), "verdict": F.coalesce("_best.verdict", F.lit(otherwise))}).drop("_url", "_best")
