"""The index as a stream keeps it and as a stream asks it (ST5, ST6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import store


def keep(notes: DataFrame, root: str, state: str, **how) -> None:
    """Brings the index up to a stream of notes, a version for each micro-batch, until what is there has been read.

    A batch that runs again after a failure is written under its old number and changes nothing.
    """
    notes.writeStream.foreachBatch(store.upsert(root, **how)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def answer(questions: DataFrame, root: str, state: str, out: str, ask: Callable[[store.Index, DataFrame], DataFrame] = lambda live, asked: live.answers(asked)) -> None:
    """Answers a stream of questions (qid, question) into ``out``, each micro-batch from the version that lives when it begins.

    A version that is published between two batches is picked up by the next one; rows say which it was.
    Answers of a batch that runs again replace its first ones.
    """

    def run(batch: DataFrame, number: int) -> None:
        live = store.open_index(batch.sparkSession, root)
        if live is None:
            raise ValueError(f"no index of schema {store.SCHEMA_VERSION} at {root}")
        ask(live, batch).withColumn("version", F.lit(live.version).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    questions.writeStream.foreachBatch(run).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
