"""Cutting lineage where several plans read one result."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast; more are joined by a shuffle.
FEW = 200_000


def ensure_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where none is set and Spark is one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` in the cluster's checkpoint folder."""
    ensure_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as packed files in the cluster's checkpoint folder: computed once, and a fraction of what ``written`` takes.

    How its rows were partitioned is not kept.
    """
    path = f"{ensure_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def few(df: DataFrame) -> DataFrame:
    """``df`` written, and marked to be broadcast if it has few rows: what it is joined with then stays where it lies.

    Left alone, Spark has shuffled the large side by the time it knows that the other one is small.
    """
    kept = written(df)
    return F.broadcast(kept) if is_few(kept) else kept


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer tasks than there are, as that of one small file has.

    A table of many splits is read as it lies, so nothing large is ever moved for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
