"""Which proposed notes may be reviewed: whole blocks with sessions behind them (P20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import replies

#: Sessions that have to bear a note out: a fixed value.
LEAST_SESSIONS = 2


def blocks(texts: DataFrame) -> DataFrame:
    """(reply, block, slug, ..., refused): a row for each block of the replies (reply, text), numbered from 1."""
    found = texts.select("reply", F.posexplode(replies.proposals(F.col("text"))).alias("block", "p"))
    return found.select("reply", (F.col("block") + 1).alias("block"), "p.*")


def borne_out(proposed: DataFrame, sessions: DataFrame) -> DataFrame:
    """``proposed`` blocks with all reasons against them in ``refused``.

    Beside the parts that are missing these are ``sessions``, fewer than two different ones cited, and
    ``unknown <session>`` for each, in order, that ``sessions`` (session) does not have.
    """
    key = ["reply", "block"]
    cited = proposed.select(*key, F.explode(F.array_distinct("sources")).alias("session"))
    unknown = cited.join(sessions.select("session").where("session is not null").distinct(), "session", "left_anti")
    missing = unknown.groupBy(*key).agg(F.array_sort(F.collect_list(F.concat(F.lit("unknown "), "session"))).alias("_unknown"))
    few = F.when(F.size(F.array_distinct("sources")) < LEAST_SESSIONS, F.array(F.lit("sessions"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return proposed.join(missing, key, "left").withColumn("refused", F.concat("refused", few, F.coalesce("_unknown", none))).drop("_unknown")


def decided(proposed: DataFrame, reviews: DataFrame) -> DataFrame:
    """(reply, block, slug, written, reason): blocks after their reviews (reply, block, lens, text).

    Only a block without reasons against it, reviewed at least once and accepted by every lens, is written.  The
    reason is the first against it, else that of the first lens by name that rejects, else ``not reviewed``.
    Two blocks of one slug and folder are one note: the first by reply and block is written, later ones are ``taken``.
    """
    key = ["reply", "block"]
    read = reviews.select(*key, "lens", replies.review(F.col("text")).alias("r"))
    against = F.min(F.when(~F.col("r.accepted"), F.struct("lens", F.col("r.reason").alias("reason"))))
    lenses = read.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), against.alias("_no"))
    out = proposed.join(lenses, key, "left")
    reason = F.when(F.size("refused") > 0, F.element_at("refused", 1)).when(F.col("_n").isNull(), "not reviewed").when(F.col("_no").isNotNull(), F.concat("_no.lens", F.lit(": "), "_no.reason")).otherwise("")
    passed = out.withColumn("reason", reason)
    # A note many blocks ask for is folded to its first before anything moves.
    first = passed.where("reason = ''").groupBy("folder", "slug").agg(F.min(F.struct(*key)).alias("k")).select("k.*", F.lit(True).alias("_first"))
    passed = passed.join(first, key, "left").withColumn("reason", F.when((F.col("reason") == "") & F.col("_first").isNull(), "taken").otherwise(F.col("reason")))
    return passed.select(*key, "slug", (F.col("reason") == "").alias("written"), "reason")
