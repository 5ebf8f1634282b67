"""Dense ranking of owners for a set of query vectors."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import written

#: Query vectors that one pass holds against all rows, about; a larger set takes several passes.
QUERIES = 10_000
#: Rows that are multiplied with them at once.
ROWS = 512
RRF_K = 60.0


def _ranked(scores: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "owner"))
    return scores.withColumn("score", F.round("score", 9)).withColumn("rank", rank)


def best_owners(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, owner, score, rank): for each query the best inner product among an owner's vectors.

    The queries are dealt into passes by a hash of their ids, and a pass is held against all rows:
    every batch of vectors is multiplied with the queries where it lies, and only its best for each
    query and owner goes on.  A query's own row does not count.
    """
    asked = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    passes = max(1, -(-asked.count() // QUERIES))
    if passes == 1:
        return _pass(asked, vectors)
    return functools.reduce(DataFrame.unionByName, (written(_pass(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i), vectors)) for i in range(passes)))


def _pass(asked: DataFrame, vectors: DataFrame) -> DataFrame:
    held = asked.collect()  # QUERIES rows, about
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in held]), np.array([r[1] for r in held])))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            if not batch.num_rows or not len(ids):
                continue
            own, owner = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(len(own), -1)
            score = q @ x.T
            score[ids[:, None] == own[None]] = -np.inf
            names, at = np.unique(owner, return_inverse=True)
            order = np.argsort(at, kind="stable")
            top = np.maximum.reduceat(score[:, order], np.searchsorted(at[order], np.arange(len(names))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(names))), pa.array(np.tile(names, len(ids)).astype(np.int64)), pa.array(top.ravel())], ["qid", "owner", "score"])

    rows = vectors.where("embedding is not null and label is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("owner"), F.col("embedding").cast("array<double>"))
    found = rows.mapInArrow(best, "qid long, owner long, score double")
    return _ranked(found.groupBy("qid", "owner").agg(F.max("score").alias("score")).where(F.col("score") > float("-inf")))


def centroid_owners(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, owner, score, rank): inner product with the mean vector of each owner."""
    parts = vectors.select(F.col("label").cast("long").alias("owner"), F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("owner", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    asked = queries.select(F.col("vec_id").alias("qid"), F.posexplode("embedding").alias("i", "q"))
    return _ranked(asked.join(mean, "i").groupBy("qid", "owner").agg(F.sum(F.col("q").cast("double") * F.col("m")).alias("score")))


def fuse_owners(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, owner, rrf, rank): reciprocal rank fusion of two rankings of owners."""
    both = a.select("qid", "owner", "rank").unionByName(b.select("qid", "owner", "rank"))
    fused = both.groupBy("qid", "owner").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 12).alias("rrf"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), "owner")))
