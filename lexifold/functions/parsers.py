"""Text to structure: questions, secrets, pages, conversations, front matter, links, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that part two questions, in the order in which they are tried: fixed values.
CONJUNCTIONS = (
    " e como ", " e qual ", " e quanto ", " e onde ", " e por que ", " e quem ", " alem disso ", " além disso ",
    " and how ", " and what ", " and why ", " and where ", " and when ", " and who ", " furthermore ", " moreover ",
)
#: Bytes of a token in prose and in code: fixed values.
PROSE_BYTES, CODE_BYTES = 3.99, 2.96


def decompose(text: Column) -> Column:
    """The questions that a message asks (P18), at least the message itself; a blank message asks none.

    Lines and clauses are parted first, then each at the first occurrence of every conjunction in
    turn; parts of under ten characters or two words are dropped.
    """
    clean = F.trim(text)
    parts = F.filter(F.transform(F.split(clean, r"[\n?;!]"), lambda s: F.trim(s)), lambda p: p != "")
    for conjunction in CONJUNCTIONS:
        at = lambda p, c=conjunction: F.locate(c, F.lower(p))
        first = lambda p: F.trim(F.substring(p, F.lit(1), at(p) - 1))
        second = lambda p: F.trim(F.substring(p, at(p) + 1, F.char_length(p)))
        cut = lambda p: F.when(at(p) > 0, F.array(first(p), second(p))).otherwise(F.array(p))
        parts = F.filter(F.flatten(F.transform(parts, cut)), lambda p: p != "")
    bare = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^(and|e) +", ""), r"^[^\p{IsAlphabetic}\p{N} ?]+|[^\p{IsAlphabetic}\p{N} ?]+$", ""))
    kept = F.filter(F.transform(parts, bare), lambda p: (F.char_length(p) >= 10) & F.contains(p, F.lit(" ")))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(kept) == 0, F.array(clean)).otherwise(kept)


_OPEN, _CLOSE = r"""(^|[\s"'`(\[{<=:])""", r"""(?=$|[\s"'`)\]}>,.;:])"""
_KEY_NAMES = "api_key|apikey|api-key|token|secret|password|access_token|auth_token"
_CORE = r"""[^\s,;"'`()\[\]{}<>]"""
_TOKENS = rf"sk-{_CORE}{{14,}}|sk_(?:live|test)_{_CORE}*|(?:gh[pousr]_|github_pat_){_CORE}{{7,}}|AIza{_CORE}{{13,}}|(?:AKIA|ASIA){_CORE}{{12,}}"


def redact(text: Column) -> Column:
    """Secrets out, white space folded (P19): bearer tokens, values of keys with telling names, and known prefixes."""
    folded = F.trim(F.regexp_replace(text, r"\s+", " "))
    bearer = F.regexp_replace(folded, r"(?i)(^|\s)(bearer:?) (\S{13,})", "$1$2 [REDACTED_TOKEN]")
    named = F.regexp_replace(bearer, rf"(?i){_OPEN}({_KEY_NAMES})[=:]([^\s\"'`)\]}}>,;]+)", "$1$2=[REDACTED_SECRET]")
    return F.regexp_replace(named, rf"{_OPEN}(?:{_TOKENS}){_CLOSE}", "$1[REDACTED_KEY]")


def html_text(html: Column) -> Column:
    """The text of a page (S17): scripts, styles and comments go with their content, tags become spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def conversation_notes(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, text): a conversation's turns in order, as one note."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    notes = turns.groupBy("conv_id").agg(said.alias("s"))
    return notes.select("conv_id", F.size("s").alias("turns"), F.array_join(F.transform("s", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("text"))


def token_estimate(all_bytes: Column, code_bytes: Column) -> Column:
    """Estimated tokens of a text with so many bytes, of them code."""
    return F.floor((all_bytes - code_bytes) / PROSE_BYTES + code_bytes / CODE_BYTES + 0.5).cast("long")


def invalidation_cost(blocks: DataFrame) -> DataFrame:
    """(base, pos, cost): tokens that must be sent again when a resident block changes."""
    after = Window.partitionBy("base").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.where("resident").select("base", "pos", F.sum("tokens").over(after).alias("cost"))


def front_matter(text: Column) -> Column:
    """The front matter as a map (P1): only if the first line is ``---`` and it ends; the first of a key counts."""
    body = F.regexp_extract(text, r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(\r?\n|$)", 1)
    lines = F.filter(F.split(body, r"\r?\n"), lambda s: s.rlike(r"^[^\s#][^:]*:"))
    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("key"), F.trim(F.regexp_replace(s, r"^[^:]*:", "")).alias("value")))
    seen = F.aggregate(pairs, F.slice(pairs, 1, 0), lambda acc, p: F.when(F.exists(acc, lambda a: a["key"] == p["key"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(seen)


def header(text: Column) -> tuple[Column, Column]:
    """Keys (array) and purpose that a note declares above its first section (P3, P4), in English or Portuguese."""
    above = F.regexp_replace(text, r"(?s)(^|\n)##.*$", "")
    line = lambda label: F.trim(F.regexp_replace(F.regexp_extract(above, rf"(?im)^[ \t]*[*_]*(?:{label})[*_]*:[*_]*[ \t]*(.*)$", 1), r"^[*_]+|[*_]+$", ""))
    keys = F.filter(F.transform(F.split(line("search for|buscar por"), "[,;]"), lambda k: F.trim(F.regexp_replace(k, "[`\"'•]", ""))), lambda k: k != "")
    return keys, F.regexp_replace(line("exists to|existe para"), r"\.$", "")


def note_lines(notes: DataFrame) -> DataFrame:
    """(base, rel, line, text): the lines of notes outside fenced blocks, numbered from 1.

    A line is inside if an odd number of fences came before it; the running count is over one note.
    """
    lines = notes.select("base", "rel", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    fence = F.col("text").rlike(r"^ {0,3}(```|~~~)")
    before = F.count_if(fence).over(Window.partitionBy("base", "rel").orderBy("line"))
    return lines.withColumn("_n", before).where(~fence & (F.col("_n") % 2 == 0)).select("base", "rel", (F.col("line") + 1).alias("line"), "text")


def links(text: Column, pattern: str = r"\[\[([^\]|#]+)[^\]]*\]\]") -> Column:
    """Targets of wiki links (P10), or of another ``pattern``, outside fenced blocks and inline code."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?ms)^[ ]{0,3}(```|~~~).*?(^[ ]{0,3}\1[^\n]*$|\z)", ""), r"`[^`\n]*`", "")
    return F.transform(F.regexp_extract_all(bare, F.lit(pattern), 1), lambda s: F.trim(s))


def citations(text: Column) -> Column:
    """Keys of source pointers."""
    return links(text, r"\[src:([^\]]+)\]")


def without_blocks(text: Column, tags: tuple[str, ...] = ("system-reminder", "task-notification")) -> Column:
    """A message without what a machine wrapped into ``tags``; a block that never ends takes the rest along."""
    for tag in tags:
        text = F.regexp_replace(text, rf"(?s)<{tag}>.*?(?:</{tag}>|\z)", "")
    return text
