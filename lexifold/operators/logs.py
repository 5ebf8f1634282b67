"""Counted logs, session ownership, rounds and hand-offs: folds over append-only events (A17, A20-A22, F13, J12, Q20-Q22, ST3, W11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(events: DataFrame, key: Sequence[str], ts: str, payload: str, order: str) -> DataFrame:
    """(key, count, first, last, payload): one row for each key with its newest payload.

    ``order`` breaks ties of time.  The fold is associative, so hot keys are summed before the shuffle.
    """
    newest = F.max_by(payload, F.struct(ts, order))
    return events.groupBy(*key).agg(F.count(F.lit(1)).alias("count"), F.min(ts).alias("first"), F.max(ts).alias("last"), newest.alias("payload"))


def session_events(events: DataFrame) -> DataFrame:
    """Click events as session events: session, seq, ts, kind (routed, refused, conclusion), agent, question."""
    kind = F.when(F.col("event_type") == "purchase", "conclusion").when(F.col("event_type").isin("click", "login"), "routed").otherwise("refused")
    return events.select(
        F.col("user_id").cast("string").alias("session"),
        F.col("event_id").alias("seq"),
        "ts",
        kind.alias("kind"),
        F.when(kind == "routed", F.concat(F.lit("agent"), (F.col("event_id") % 4).cast("string"))).alias("agent"),
        F.when(kind == "refused", F.concat(F.col("event_type"), F.lit(" "), (F.floor("value") % 10).cast("string"))).alias("question"),
    )


def owners(events: DataFrame) -> DataFrame:
    """``events`` with ``owner``: the last agent routed to before, else the first one after.

    Sessions are the unit of order; an event of a session that was never routed has no owner.
    """
    by = Window.partitionBy("session").orderBy("ts", "seq")
    back = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("seq"))  # running frames in either direction take linear time
    before = F.last("agent", True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("agent", True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("owner", F.coalesce(before, after))


def routes(events: DataFrame) -> DataFrame:
    """Routing events that change the agent: repeats in a row are one."""
    by = Window.partitionBy("session").orderBy("ts", "seq")
    routed = events.where("kind = 'routed'").withColumn("_last", F.lag("agent").over(by))
    return routed.where(~F.col("agent").eqNullSafe(F.col("_last"))).drop("_last")


def deposits(events: DataFrame) -> DataFrame:
    """(session, owner, refused, conclusions, questions): what a session leaves for each owner (Q22, K5)."""
    owned = owners(events).where("owner is not null and kind <> 'routed'")
    questions = F.sort_array(F.collect_set(F.when(F.col("kind") == "refused", F.col("question"))))
    return owned.groupBy("session", "owner").agg(F.count_if(F.col("kind") == "refused").alias("refused"), F.count_if(F.col("kind") == "conclusion").alias("conclusions"), F.array_join(questions, "|").alias("questions"))


#: What is heard as vague unless a reason is given, reasons, and what makes an objection constitutional: fixed values.
VAGUE = ("i don't like the tone", "i don't like this approach", "feels wrong", "feels weird", "looks ugly", "feels a bit wordy", "needs more flair", "not a fan")
REASONS = ("because", "violates")
MARKERS = (
    "invariant", "violates", "violation", "mechanism", "failure mode", "use-after-free", "memory", "leak", "race condition", "concurrency", "deadlock", "overflow",
    "underflow", "rule", "adr-", "w03", "citation", "unbounded", "backpressure", "correctness", "security", "contract", "broken",
    "regression", "crash", "panic", "false", "incorrect", "error", "untrue", "claim", "latency",
)
BRIEF_BYTES = 10


def admissibility(text: Column, constitution: Column | None = None) -> Column:
    """brief, vague, constitutional or advisory (F12): whether an objection is heard, and as what.

    ``constitution`` is an array of lines; an objection that holds one of them, whatever its case, is
    constitutional, as is one with a marker.  Brief and vague ones are not heard.
    """
    said = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    lower = F.lower(said)
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(lower, w))
    grounded = holds(MARKERS)
    if constitution is not None:
        lines = F.filter(F.transform(constitution, lambda x: F.lower(F.trim(x))), lambda x: x != "")
        grounded = grounded | F.coalesce(F.exists(lines, lambda x: F.contains(lower, x)), F.lit(False))
    return F.when(F.octet_length(said) < BRIEF_BYTES, "brief").when(holds(VAGUE) & ~holds(REASONS), "vague").when(grounded, "constitutional").otherwise("advisory")


def admissible(text: Column) -> Column:
    """Whether an objection is heard at all."""
    return ~admissibility(text).isin("brief", "vague")


def ledger(rounds: DataFrame) -> DataFrame:
    """A row for each artifact of a panel: seats, who is silent, what blocks, whether it is closed.

    ``rounds`` has artifact, reviewer, seq, state (pending, objected, approved, resolved), blocking.
    """
    last = rounds.groupBy("artifact", "reviewer").agg(F.max_by(F.struct("state", "blocking"), "seq").alias("l"))
    return last.groupBy("artifact").agg(
        F.count(F.lit(1)).alias("seats"),
        F.count_if(F.col("l.state") == "pending").alias("silent"),
        F.count_if((F.col("l.state") == "objected") & F.col("l.blocking")).alias("blocking_open"),
        F.bool_and(F.col("l.state").isin("approved", "resolved")).alias("closed"),
    )


def handoffs(events: DataFrame) -> DataFrame:
    """(session, status, claimed_by, updated_at): the state of each hand-off from its events (Q21).

    A hand-off is pending until someone claims it, and completed for good once it is; the first claim
    holds.  Events are session, ts, seq, action (save, claim, complete), agent.
    """
    claimed = F.min_by(F.when(F.col("action") == "claim", F.col("agent")), F.when(F.col("action") == "claim", F.struct("ts", "seq")))
    status = F.when(F.bool_or(F.col("action") == "complete"), "completed").when(F.bool_or(F.col("action") == "claim"), "claimed").otherwise("pending")
    return events.groupBy("session").agg(status.alias("status"), claimed.alias("claimed_by"), F.max("ts").alias("updated_at"))


def sticky(events: DataFrame) -> DataFrame:
    """(session, seq, agent, switched): each routing of a session and whether it changes the agent (ST3).

    The first routing of a session switches, since no agent was there before.
    """
    by = Window.partitionBy("session").orderBy("ts", "seq")
    routed = events.where("kind = 'routed'")
    return routed.select("session", "seq", "agent", (~F.col("agent").eqNullSafe(F.lag("agent").over(by))).alias("switched"))


def numbered(rounds: DataFrame) -> DataFrame:
    """Objections (artifact, reviewer, at) with ``number`` in their artifact and ``seq`` for their reviewer, both by ``at``."""
    number = F.row_number().over(Window.partitionBy("artifact").orderBy("at"))
    seq = F.row_number().over(Window.partitionBy("artifact", "reviewer").orderBy("at"))
    return rounds.withColumns({"number": number, "seq": seq})


def panel_cost(seats: DataFrame) -> DataFrame:
    """(artifact, reviewers, boot, reading, total) of seats (artifact, boot, reading): each reviewer boots and reads all."""
    costs = seats.groupBy("artifact").agg(F.count(F.lit(1)).alias("reviewers"), F.sum("boot").alias("boot"), F.sum("reading").alias("reading"))
    return costs.withColumn("total", F.col("boot") + F.col("reading"))


def unsupported(proposals: DataFrame, sessions: DataFrame) -> DataFrame:
    """(proposal, distinct_sources, unknown, accepted) of proposals (proposal, source): evidence from two known sessions or more.

    Blank sources do not count; a proposal with one unknown session is not accepted.
    """
    cited = proposals.withColumn("session", F.trim("source")).select("proposal", F.when(F.col("session") != "", F.col("session")).alias("session")).distinct()
    known = sessions.select("session").distinct().withColumn("_known", F.lit(1))
    counts = cited.join(known, "session", "left").groupBy("proposal").agg(F.count("session").alias("distinct_sources"), F.count_if(F.col("session").isNotNull() & F.col("_known").isNull()).alias("unknown"))
    return counts.withColumn("accepted", (F.col("distinct_sources") >= 2) & (F.col("unknown") == 0))
