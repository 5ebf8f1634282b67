"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``: the white space that the line and word rules of this subpackage know.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where none is set and Spark is one process.

    A cluster without the setting is an error: executors do not share the driver's folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that a Python worker turns into objects at once.
ROWS_AT_ONCE = 200


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of ``ROWS_AT_ONCE`` rows, so that only few whole texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Cells into which a label's rows are dealt when a sample of them is drawn.
CELLS = 64


def sample_of_each(rows: DataFrame, label: str, size: int) -> DataFrame:
    """Rows (doc_id, ``label``, ...) of each label, about ``size`` at most: the same ones however they lie.

    A label's rows are dealt into ``CELLS`` cells by a hash of doc_id, and the first ones of each
    cell by another hash are taken, so that no task sorts a whole label.
    """
    order = Window.partitionBy(label, "_cell").orderBy(F.xxhash64("doc_id"), "doc_id")
    dealt = rows.withColumn("_cell", F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.lit(CELLS)))
    return dealt.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= -(-size // CELLS)).drop("_cell", "_nth")
