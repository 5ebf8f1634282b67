"""Blocks and labels in replies: proposed notes, reviews and listed refusals.

All are expressions over one text, so a reply of any length stays in its row and nothing is shuffled.  White space is
Unicode's, lines end at ``\\n`` or ``\\r\\n``.  What cannot be read is refused with its reason, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s&&[^\n]]*"
#: Parts that a proposed note cannot do without, and the folder of one that names none.
NEEDED, FOLDER = ("slug", "summary", "keys", "body"), "knowledge"
#: Headings above refused questions: fixed values.  Deposits are written with the second.
REFUSED = ("Refusals", "Questions the base could not answer")
#: Characters of an unreadable reply that its reason repeats.
SEEN = 200


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def _text(x: Column) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit("\r\n"), F.lit("\n"))


def _listed(x: Column) -> Column:
    return F.transform(F.split(x, ",", -1), _strip)


def _named(xs: Column) -> Column:
    return F.filter(xs, lambda s: s != "")


def proposals(reply: Column) -> Column:
    """The blocks of a reply from a line ``PROPOSAL`` to a line ``END`` or to the end of the text, in order.

    An array of (slug, folder, summary, keys, sources, body, refused): ``refused`` lists what of ``NEEDED`` is
    missing, and is empty for a block that may be reviewed.  Of a label that is there twice the last counts; all
    behind ``body:`` is body, labels and further ``PROPOSAL`` lines too.  No reply and no block give no rows.
    """
    blocks = F.regexp_extract_all(_text(reply), F.lit(rf"(?dmsU)^{_BLANK}PROPOSAL{_BLANK}$\n?(.*?)(?:^{_BLANK}END{_BLANK}$|\z)"), 1)
    start = rf"(?dmsU)^{_BLANK}body:{_BLANK}$"
    parts = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, rf"(?dmsU)\A(.*?)(?:^{_BLANK}body:{_BLANK}$|\z)", 1).alias("head"), _strip(F.regexp_extract(b, rf"{start}(.*)\z", 1)).alias("body")))

    def parsed(p: Column) -> Column:
        label = lambda name: _strip(F.regexp_extract(p["head"], rf"(?dmsU)\A.*^{_BLANK}{name}:([^\n]*)$", 1))
        keys = _named(F.transform(_listed(label("keys")), lambda k: F.regexp_replace(k, r"\A`+|`+\z", "")))
        folder = label("folder")
        return F.struct(
            label("slug").alias("slug"), F.when(folder == "", FOLDER).otherwise(folder).alias("folder"), F.regexp_replace(label("summary"), r"\.+\z", "").alias("summary"),
            keys.alias("keys"), _named(_listed(label("sources"))).alias("sources"), p["body"].alias("body"),
        )

    lacks = lambda r: F.array_compact(F.array(*(F.when(F.size(r["keys"]) == 0 if n == "keys" else r[n] == "", n) for n in NEEDED)))
    return F.transform(F.transform(parts, parsed), lambda r: F.struct(*(r[c].alias(c) for c in ("slug", "folder", "summary", "keys", "sources", "body")), lacks(r).alias("refused")))


def review(reply: Column) -> Column:
    """(accepted, readable, reason) of a reviewer's reply.

    Lines count without list marks, quotes, headings and emphasis; labels in any case and with blanks before the
    colon.  The last line labelled ``verdict`` with a word of its own decides, and one that has both words rejects; failing
    that the first line that is nothing but the word.  A reply without a verdict is a rejection and its reason
    begins with what was seen.  The first reason that is not empty counts.
    """
    bare = lambda s: _strip(F.replace(F.replace(_strip(F.regexp_replace(_strip(s), r"\A[-*>#`]+", "")), F.lit("**"), F.lit("")), F.lit("__"), F.lit("")))
    lines = F.transform(F.split(_text(reply), "\n", -1), bare)
    labelled = lambda name: F.transform(F.filter(lines, lambda s: s.rlike(rf"(?i)\A{name}(?U:\s*):")), lambda s: _strip(F.regexp_replace(s, r"(?s)\A[^:]*:", "")))
    word = lambda s: F.when(F.contains(s, F.lit("reject")), False).when(F.contains(s, F.lit("accept")), True)
    said = F.array_compact(F.transform(labelled("verdict"), lambda s: word(F.lower(s))))
    alone = F.filter(F.transform(lines, lambda s: F.regexp_replace(F.lower(s), r"\.+\z", "")), lambda s: s.isin("reject", "rejected", "accept", "accepted"))
    accepted = F.coalesce(F.try_element_at(said, F.lit(-1)), F.startswith(F.try_element_at(alone, F.lit(1)), F.lit("accept")))
    seen = F.left(_strip(F.regexp_replace(_text(reply), r"(?U)\s+", " ")), F.lit(SEEN))
    reason = F.coalesce(F.try_element_at(_named(labelled("reason")), F.lit(1)), F.lit("no reason given"))
    unread = F.when(seen == "", "nothing was returned").otherwise(F.concat(F.lit("no verdict: "), seen))
    return F.struct(F.coalesce(accepted, F.lit(False)).alias("accepted"), accepted.isNotNull().alias("readable"), F.when(accepted.isNull(), unread).otherwise(reason).alias("reason"))


def refused_questions(deposit: Column) -> Column:
    """The list items under the headings ``REFUSED`` of a deposit, in order, up to the next heading of any kind."""
    section = rf"(?dmsU)^{_BLANK}##? (?:{'|'.join(REFUSED)})[^\n]*$(.*?)(?=^{_BLANK}#|\z)"
    items = F.transform(F.regexp_extract_all(_text(deposit), F.lit(section), 1), lambda s: F.regexp_extract_all(s, F.lit(rf"(?dmU)^{_BLANK}- ([^\n]*\S[^\n]*)$"), 1))
    return F.transform(F.flatten(items), _strip)
