"""Structured Streaming forms of the event folds; each ends with what has arrived (``availableNow``).

State and results are in the shared folder; every run has a folder of its own there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, logs
from ..sources.stages import ensure_folder
from . import sessions


def _folder(spark: SparkSession) -> str:
    return f"{ensure_folder(spark)}/stream-{uuid.uuid4()}"


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream; its schema is read from the files, not inferred anew for each batch."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{table}.parque[t]")  # a glob takes one file as well as a folder


def _run(writer, folder: str) -> None:
    query = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused questions counted as they arrive (ST4): the changed counts of each batch are appended under
    its number, and the newest of each key is the log."""
    folder = _folder(spark)
    events = logs.session_events(_stream(spark, sf_dir, "events")).where("kind = 'refused'").withColumn("key", F.lower("question"))
    counts = events.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("first"), F.max("ts").alias("last"))

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    _run(counts.writeStream.outputMode("update").foreachBatch(append), folder)
    newest = spark.read.option("recursiveFileLookup", True).schema("key string, count long, first timestamp, last timestamp, batch int").parquet(f"{folder}/out")
    best = newest.groupBy("key").agg(F.max_by(F.struct("count", "first", "last"), "batch").alias("n"))
    day = lambda c: F.date_format(f"n.{c}", "yyyy-MM-dd").alias(c)
    return best.select("key", "n.count", day("first"), day("last"))


#: How late an event may be, and how long a session may rest, in the registered streams.
LATENESS, GAP_SECONDS = "1 hour", 86_400


def owned_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``sessions.owned`` for the event table (ST1 to ST3).

    The log is read to its end; then a heartbeat behind it goes into a second source, and the stream is
    started again from its checkpoint, so that the watermark passes the last session and its timer fires.
    """
    folder = _folder(spark)
    kinds = "session string, seq long, ts timestamp, kind string, agent string"
    spark.createDataFrame([], kinds).write.parquet(f"{folder}/beats")
    as_timestamp = lambda df: df.select("session", "seq", F.col("ts").cast("timestamp").alias("ts"), "kind", "agent")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for beat in (False, True):
            if beat:
                end = F.expr(f"max(ts) + interval {LATENESS} + interval {2 * GAP_SECONDS} seconds").cast("timestamp")
                last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(end.alias("ts"))
                row = {"session": F.lit(None).cast("string"), "seq": F.lit(0).cast("long"), "kind": F.lit("heartbeat"), "agent": F.lit(None).cast("string")}
                last.withColumns(row).select("session", "seq", "ts", "kind", "agent").write.mode("append").parquet(f"{folder}/beats")
            events = as_timestamp(logs.session_events(_stream(spark, sf_dir, "events"))).unionByName(spark.readStream.schema(kinds).parquet(f"{folder}/beats"))
            _run(sessions.owned(events, LATENESS, GAP_SECONDS).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/owned"), folder)
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(sessions.OWNED).parquet(f"{folder}/owned")


def session_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the agent that owned its session when it came (ST2); a session ends after a day of rest."""
    return owned_sessions(spark, sf_dir).select("session", "seq", "kind", "owner")


def sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each routing of a session and whether it changes the agent (ST3)."""
    return owned_sessions(spark, sf_dir).where("kind = 'routed'").select("session", "seq", "agent", "switched")


def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files hashed into an index as they arrive (ST6), then reported against an older state."""
    folder = _folder(spark)
    files = _stream(spark, sf_dir, "documents").select(F.col("source").alias("base"), F.col("doc_id").cast("string").alias("rel"), "text")
    _run(index.hashed(files).writeStream.format("parquet").option("path", f"{folder}/index"), folder)
    new = spark.read.parquet(f"{folder}/index")
    return index.report(index.changes(new.where("cast(rel as long) % 7 <> 0"), new.where("cast(rel as long) % 11 <> 0")))
