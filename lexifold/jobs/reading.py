"""Registered queries over what a reader is shown: slices, passages, excerpts, evidence, and objections; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fulltext_tokens
from ..operators import analytics, ask, context, fulltext, keyword, logs
from ..sources import corpus
from ..sources.corpus import read
from ..sources.stages import few, stored
from . import library, oracles, registry

Query = Callable[[SparkSession, str], DataFrame]

RADIUS, MOST = 2, 1_500
SECTION = r"^#{1,6} Part (\d+)$"


def context_slices(spark, sf_dir):
    """Slices of the three best files of each question; a section of each is named as well."""
    parts = registry._asked(spark, sf_dir, text=False)
    anchors = F.array(((F.col("qid") % 5) * 12 + 3).cast("string"))
    served = parts["keyword"].where("rank <= 3").join(parts["asked"], "qid").select("qid", "base", "rel", "terms", anchors.alias("anchors"))
    found = context.slices(served, library.section_notes(spark, sf_dir).select("base", "rel", "text"), SECTION, RADIUS, MOST)
    return found.select("qid", "base", "rel", F.char_length("slice").alias("chars"), F.md5("slice").alias("digest"))


def _section_hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Questions (qid, terms), and their ranked section chunks with heading and text."""
    # By note, as sections are made: texts are shuffled whole, once, and not line by line.
    chunks = stored(library.numbered_chunks(library.section_notes(spark, sf_dir).repartition("base", "rel")))
    asked = keyword.question_terms(registry._questions(spark, sf_dir), registry._aliases(spark))
    ranked = fulltext.round_robin(fulltext.search(asked, chunks))
    return asked, few(ranked).join(chunks.select("base", "chunk_id", "heading", "text"), ["base", "chunk_id"])


def assembled_passages(spark, sf_dir):
    hits = _section_hits(spark, sf_dir)[1].withColumn("captured_from", F.lit(""))
    return context.assembled(hits).select("qid", "base", "rel", "heading", "at", F.char_length("text").alias("chars"), F.md5("text").alias("digest"))


def snippets(spark, sf_dir):
    asked, hits = _section_hits(spark, sf_dir)
    return hits.join(asked, "qid").select("qid", "base", "chunk_id", context.excerpt(F.col("text"), F.col("terms")).alias("excerpt"))


def evidence_taxonomy(spark, sf_dir):
    """Parts of each benchmark passage as golds, held against the ten best chunks of its question."""
    parts = registry._asked(spark, sf_dir)
    golds = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.split("text", "[.,;]")).alias("gold")).where(F.size(fulltext_tokens(F.col("gold"))) >= 4)
    served = few(parts["text"].where("rank <= 10")).join(registry._chunks(spark, sf_dir).select("base", "chunk_id", "text"), ["base", "chunk_id"]).select("qid", "text")
    notes = corpus.document_notes(registry._documents(spark, sf_dir).select("doc_id", "source", "text"))
    return analytics.evidence_taxonomy(golds, served, ask.fuse(parts["keyword"], parts["text"]), notes)


#: What is put before a turn's text to make it an objection, in both dialects: from vague, grounded, brief and plain openings.
OPENING = """CASE turn % 8 WHEN 0 THEN 'This feels wrong to me: ' WHEN 1 THEN 'It Looks Ugly because ' WHEN 2 THEN 'The Deadlock is ' WHEN 3 THEN 'not a fan; violates ' WHEN 4 THEN 'badly timed write to the log: ' WHEN 5 THEN 'keep it short ' WHEN 6 THEN '  ' ELSE 'A claim that ' END"""


def objection_admissibility(spark, sf_dir):
    """Turns of conversations as objections; every sixth constitution says what the turn begins with."""
    turns = read(spark, sf_dir, "conversations").withColumn("said", F.expr(f"CASE WHEN turn % 8 = 6 THEN '  ' || left(text, 7) ELSE {OPENING} || text END"))
    constitution = F.when(F.col("conv_id") % 6 == 0, F.array(F.lit(" "), F.lit("Keep it SHORT")))
    return turns.select("conv_id", "turn", logs.admissibility(F.col("said"), constitution).alias("verdict"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (context_slices, assembled_passages, snippets, evidence_taxonomy, objection_admissibility)}


# The same as SQL for the oracle database.

_PLACE = "PARTITION BY qid, base, rel ORDER BY i"
_SLICES = rf"""sl AS (SELECT k.qid, k.base, k.rel, a.terms, [((k.qid % 5) * 12 + 3)::VARCHAR] AS anchors, string_split(m.matter || m.rest, chr(10)) AS ls FROM kw k JOIN asked a USING (qid) JOIN made m ON m.base = k.base AND m.rel = k.rel WHERE k.rank <= 3),
sr AS (SELECT qid, base, rel, terms, anchors, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS i FROM sl),
sh AS (SELECT *, CASE WHEN len(list_filter(terms, lambda t: contains(lower(s), t))) > 0 THEN i END AS hit, nullif(regexp_extract(s, '^#{{1,6}} Part (\d+)$', 1), '') AS opened FROM sr),
sg AS (SELECT *, last_value(hit IGNORE NULLS) OVER ({_PLACE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, first_value(hit IGNORE NULLS) OVER ({_PLACE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f,
  last_value(opened IGNORE NULLS) OVER ({_PLACE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec FROM sh),
gr AS (SELECT *, CASE WHEN coalesce(list_contains(anchors, sec), false) THEN 0 WHEN coalesce(i - b <= 2, false) OR coalesce(f - i <= 2, false) THEN 1 END AS g FROM sg),
ga AS (SELECT *, count(g) OVER (PARTITION BY qid, base, rel) > 0 AS any_ FROM gr),
gs AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY qid, base, rel ORDER BY g, i) AS size FROM ga WHERE any_ AND g IS NOT NULL),
gm AS (SELECT qid, base, rel, i, CASE WHEN lag(i) OVER ({_PLACE}) IS NOT DISTINCT FROM i - 1 THEN s ELSE '[...]' || chr(10) || s END AS shown FROM gs WHERE size <= 1500),
slices AS (SELECT qid, base, rel, string_agg(shown, chr(10) ORDER BY i) AS slice FROM gm GROUP BY ALL
  UNION ALL SELECT qid, base, rel, left(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE i < 4), 1500) FROM ga WHERE NOT any_ GROUP BY ALL
  UNION ALL SELECT DISTINCT qid, base, rel, '' FROM ga x WHERE any_ AND NOT EXISTS (SELECT 1 FROM gm y WHERE y.qid = x.qid AND y.base = x.base AND y.rel = x.rel))"""

_WHITE = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_OVERLAP = "list_max(list_filter(range(1, least(length(x), length(y)) + 1), lambda n: right(x, n) = left(y, n) AND strlen(left(y, n)) >= 10))"
_MERGE = rf"""CASE WHEN contains(x, y) THEN x WHEN contains(y, x) THEN y WHEN {_OVERLAP} IS NOT NULL THEN x || chr(10) || regexp_replace(substring(y, {_OVERLAP} + 1), '^\s+', '') ELSE x || chr(10) || chr(10) || y END"""
_PARAGRAPH, _SENTENCE = r"regexp_extract(left(t, 1800), '(?s)^(.*)\n\n', 1)", r"regexp_extract(left(t, 1800), '(?s)^(.*)\. ', 1)"
_CAP = rf"""CASE WHEN length(t) <= 1800 THEN t WHEN length(regexp_extract(left(t, 1800), '(?s)^(.*)\n\n', 1)) > 900 THEN {_WHITE(_PARAGRAPH)}
  WHEN length(regexp_extract(left(t, 1800), '(?s)^(.*)\. ', 1)) > 900 THEN {_WHITE(_SENTENCE)} || '.' ELSE {_WHITE("left(t, 1800)")} END"""
_PASSAGES = rf"""hits AS (SELECT t.qid, t.base, t.rel, t.rank, c.heading, c.text, row_number() OVER (PARTITION BY t.qid, t.base, t.rel ORDER BY t.rank) AS nth FROM txt t JOIN chunks c ON c.base = t.base AND c.chunk_id = t.chunk_id),
folded AS (SELECT qid, base, rel, heading, min(rank) AS at_, count(*) AS n, min(text) AS lone, list({_WHITE('text')} ORDER BY rank) AS ts FROM hits WHERE nth <= 8 GROUP BY ALL),
whole AS (SELECT qid, base, rel, heading, at_, CASE WHEN n = 1 THEN lone ELSE list_reduce(ts, lambda x, y: {_MERGE}) END AS t FROM folded),
passages AS (SELECT qid, base, rel, heading, at_, {_CAP} AS t FROM whole)"""

_FOLD = lambda x: f"lower(translate({x}, '{oracles.ACCENTED}', '{oracles.PLAIN}'))"
_SNIPPETS = rf"""pieces_ AS (SELECT t.qid, t.base, t.chunk_id, a.terms, regexp_extract_all(c.text, '[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]+') AS ps FROM txt t JOIN chunks c ON c.base = t.base AND c.chunk_id = t.chunk_id JOIN asked a ON a.qid = t.qid),
tokens_ AS (SELECT *, list_transform(ps, lambda p: {_FOLD(r"regexp_replace(p, '^[^\p{L}\p{N}]+', '')")}) AS ws FROM pieces_),
rated AS (SELECT *, list_transform(range(1, greatest(len(ps) - 13, 1) + 1), lambda i: [len(list_distinct(list_filter(ws[i:i + 13], lambda w: list_contains(terms, w)))), len(list_filter(ws[i:i + 13], lambda w: list_contains(terms, w))), -i]) AS rs FROM tokens_),
placed AS (SELECT *, -list_max(rs)[3] AS at_ FROM rated),
snips AS (SELECT qid, base, chunk_id, CASE WHEN len(ps) = 0 THEN '' ELSE CASE WHEN at_ > 1 THEN ' ... ' ELSE '' END || regexp_replace(array_to_string(ps[at_:at_ + 13], ''), '^[^\p{{L}}\p{{N}}]+', '') || CASE WHEN at_ + 13 < len(ps) THEN ' ... ' ELSE '' END END AS excerpt FROM placed)"""


def _run(x: str) -> str:
    return f"array_to_string({oracles.fulltext(x)}, ' ')"


_TAXONOMY = rf"""golds AS (SELECT DISTINCT item_id AS qid, {_run('g')} AS gold FROM (SELECT item_id, unnest(string_split_regex(text, '[.,;]')) AS g FROM benchmark) WHERE len({oracles.fulltext('g')}) >= 4),
shown AS (SELECT t.qid, string_agg(' ' || {_run('c.text')} || ' ', ' | ') AS s FROM txt t JOIN chunks c ON c.base = t.base AND c.chunk_id = t.chunk_id WHERE t.rank <= 10 GROUP BY 1),
counted AS (SELECT g.qid, count(*) AS golds, count(*) FILTER (WHERE contains(coalesce(s.s, ''), ' ' || g.gold || ' ')) AS found FROM golds g LEFT JOIN shown s USING (qid) GROUP BY 1),
bodies_ AS (SELECT base, rel, ' ' || {_run('text')} || ' ' AS t FROM doc_notes),
held AS (SELECT g.qid, b.base, b.rel, count(*) AS n FROM golds g JOIN bodies_ b ON contains(b.t, ' ' || g.gold || ' ') GROUP BY ALL),
whole_ AS (SELECT h.qid, bool_or(EXISTS (SELECT 1 FROM fused f WHERE f.qid = h.qid AND f.base = h.base AND f.rel = h.rel)) AS ranked FROM held h JOIN counted c ON c.qid = h.qid AND c.golds = h.n GROUP BY 1)"""

_VAGUE = "['i don''t like the tone', 'i don''t like this approach', 'feels wrong', 'feels weird', 'looks ugly', 'feels a bit wordy', 'needs more flair', 'not a fan']"
_MARKERS = "['invariant', 'violates', 'violation', 'mechanism', 'failure mode', 'use-after-free', 'memory', 'leak', 'race condition', 'concurrency', 'deadlock', 'overflow', 'underflow', 'rule', 'adr-', 'w03', 'citation', 'unbounded', 'backpressure', 'correctness', 'security', 'contract', 'broken', 'regression', 'crash', 'panic', 'false', 'incorrect', 'error', 'untrue', 'claim', 'latency']"


def oracle_sql() -> dict[str, str]:
    made = library.note_jobs._SECTIONS[: library.note_jobs._SECTIONS.index(",\nls AS (")]
    return {
        "context_slices": oracles._with(f", {made}, {_SLICES} SELECT qid, base, rel, length(slice) AS chars, md5(slice) AS digest FROM slices"),
        "assembled_passages": library.with_sections(oracles._with(f", {_PASSAGES} SELECT qid, base, rel, heading, at_ AS at, length(t) AS chars, md5(t) AS digest FROM passages")),
        "snippets": library.with_sections(oracles._with(f", {_SNIPPETS} SELECT qid, base, chunk_id, excerpt FROM snips")),
        "evidence_taxonomy": oracles._with(f""", {_TAXONOMY} SELECT qid, golds, found, CASE WHEN found = golds THEN 'full' WHEN found > 0 THEN 'partial' ELSE 'none' END AS outcome,
  CASE WHEN found = golds THEN '' WHEN ranked THEN 'slice' WHEN ranked IS NOT NULL THEN 'route' ELSE 'not-verbatim' END AS miss FROM counted LEFT JOIN whole_ USING (qid)"""),
        "objection_admissibility": rf"""WITH o AS (SELECT conv_id, turn, CASE WHEN turn % 8 = 6 THEN left(text, 7) ELSE {OPENING} || text END AS raw FROM conversations),
t AS (SELECT conv_id, turn, {_WHITE('raw')} AS said, lower(raw) AS l FROM o)
SELECT conv_id, turn, CASE WHEN strlen(said) < 10 THEN 'brief' WHEN len(list_filter({_VAGUE}, lambda w: contains(l, w))) > 0 AND NOT contains(l, 'because') AND NOT contains(l, 'violates') THEN 'vague'
  WHEN len(list_filter({_MARKERS}, lambda w: contains(l, w))) > 0 OR (conv_id % 6 = 0 AND contains(l, 'keep it short')) THEN 'constitutional' ELSE 'advisory' END AS verdict FROM t""",
    }
