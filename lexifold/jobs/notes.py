"""Registered queries over notes as files: sections, provenance, source records, line checks, settings, and folds of panels and sessions, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers, records, sections
from ..functions.text import round6
from ..operators import analytics, ask, fulltext, keyword, logs, quality
from ..sources import corpus
from ..sources.corpus import read
from ..sources.stages import written
from . import oracles

Query = Callable[[SparkSession, str], DataFrame]

#: What stands before line ``i`` (from 0) of a document that is made a note, in both dialects.
BEFORE = """CASE WHEN i % 24 = 15 THEN '## Search for' || chr(10) WHEN i % 12 = 3 THEN repeat('#', CAST((i + doc_id) % 4 + 1 AS INT)) || ' Part ' || i || chr(10)
  WHEN i % 12 = 5 THEN '```' || chr(10) || '# inside' || chr(10) || '```' || chr(10) WHEN i % 12 = 7 THEN 'Search for: `x`' || chr(10) WHEN i % 3 = 0 THEN chr(10) ELSE '' END"""
MATTER = """CASE WHEN doc_id % 4 = 0 THEN '' ELSE '---' || chr(10) || 'provenance: ' || CASE doc_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'agent' ELSE 'external' END || chr(10) || '# comment' || chr(10)
  || CASE WHEN doc_id % 5 = 1 THEN 'stage: raw' || chr(10) ELSE '' END || '---' || chr(10) END"""
#: A source record, and a line of a note, from a page's number and URL, in both dialects.
RECORD = """CASE WHEN page_id % 17 = 3 THEN '' ELSE 'type = ' || CASE page_id % 5 WHEN 0 THEN 'book' WHEN 1 THEN 'article' WHEN 2 THEN 'webpage' WHEN 3 THEN 'blog' ELSE 'report' END || chr(10) END || '  # type = none' || chr(10) || 'no pair' || chr(10)
  || 'Title = Page ' || page_id || CASE WHEN page_id % 4 = 0 THEN '.' ELSE '' END || chr(10) || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'author = Name' || page_id % 7 || ', A.' || chr(10) END || CASE WHEN page_id % 3 = 2 THEN 'author = Guild' || chr(10) ELSE '' END
  || 'title = second' || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'container = Annals' || chr(10) || 'volume = ' || page_id % 9 || chr(10) ELSE 'doi = ' || chr(10) END || 'pages = ' || page_id || chr(10) || 'year = ' || (1990 + page_id % 30) || chr(10)
  || 'url = ' || coalesce(url, '') || chr(10) || 'retrieval_status = ' || CASE page_id % 11 WHEN 0 THEN 'lost' WHEN 1 THEN 'partial' WHEN 2 THEN 'metadata' ELSE 'full' END || chr(10)
  || CASE WHEN page_id % 13 = 0 THEN '' ELSE 'retrieved_on = 2024-0' || (page_id % 8 + 1) || '-1' || page_id % 10 END"""
RECORD_KEY = "CASE WHEN page_id % 29 = 0 THEN 'bad' ELSE translate(lpad(CAST(page_id AS STRING), 10, '0'), '01', 'XY') END"
NOTE_LINE = """CASE page_id % 6 WHEN 0 THEN '  - [src:K' || page_id || '] Title – rest' WHEN 1 THEN 'A dash — here – there' WHEN 2 THEN 'Sources, read: ' || page_id WHEN 3 THEN '* [src:K' || page_id || ']' WHEN 4 THEN ' Fontes: none' ELSE 'plain [src:x] line' END"""
MESSAGE = "'ask ' || page_id || '<system-reminder>' || chr(10) || 'x</system-reminder> more' || CASE WHEN page_id % 3 = 0 THEN '<task-notification>open' ELSE '' END"
#: The manifest of a base, in both dialects.
SETTINGS = """'name = ' || CASE WHEN n % 2 = 0 THEN 'Old' || chr(10) || 'name = Base ' || base ELSE '' END || ' # none' || chr(10) || 'role = keeps ' || n || ' notes' || chr(10) || CASE n % 3 WHEN 0 THEN 'private = .' WHEN 1 THEN 'private = a/, b //, ,' ELSE 'ends = x=y' END || chr(10) || 'private = late'"""
GOLD_LINE = """CASE item_id % 5 WHEN 0 THEN '# skip' WHEN 1 THEN 'question ' || item_id || chr(9) || '-' WHEN 2 THEN 'no tab ' || item_id WHEN 3 THEN '  ' ELSE ' question ' || item_id || chr(9) || 'a/b.md | c/d.md||' || chr(9) || 'e ' END"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes with front matter, headings, fences, lines of keys and blank lines of their own."""
    return made_notes(corpus.document_notes(read(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def made_notes(notes: DataFrame) -> DataFrame:
    """Notes of documents with the parts of a written note put in."""
    body = f"array_join(transform(split(text, '\\n', -1), (s, i) -> {BEFORE} || s), '\\n')"
    return notes.withColumn("text", F.expr(f"{MATTER} || {body}".replace("chr(10)", "'\\n'")))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Paths tell documents apart, so the number in them gives each chunk a number of its own.
    found = sections.chunks(_notes(spark, sf_dir))
    return found.withColumn("chunk_id", F.regexp_extract("rel", r"(\d+)\.md$", 1).cast("long") * 1_000_000 + F.col("section") * 1_000 + F.col("seq"))


def chunk_sections(spark, sf_dir):
    found = _sections(spark, sf_dir)
    return found.select("chunk_id", "base", "rel", "heading", F.coalesce("parent_heading", F.lit("")).alias("parent_heading"), "seq", F.md5("text").alias("digest"), F.char_length("text").alias("chars"))


def note_facets(spark, sf_dir):
    notes = _notes(spark, sf_dir).withColumn("_f", parsers.front_matter(F.col("text")))
    of = lambda k: F.coalesce(F.element_at("_f", F.lit(k)), F.lit("")).alias(k)
    return notes.groupBy("base", of("provenance"), of("stage")).agg(F.count(F.lit(1)).alias("notes"))


def section_search(spark, sf_dir):
    """BM25 over section chunks, with where each hit comes from."""
    notes = _notes(spark, sf_dir)
    chunks = written(_sections(spark, sf_dir).join(notes.select("base", "rel", "private"), ["base", "rel"]))
    asked = keyword.question_terms(corpus.questions(read(spark, sf_dir, "benchmark")))
    hits = fulltext.search(asked, chunks, top=20)
    return quality.with_provenance(hits, notes).select("qid", "base", "rel", "chunk_id", round6(F.col("bm25")).alias("bm25"), "base_rank", F.coalesce("provenance", F.lit("")).alias("provenance"), F.coalesce("stage", F.lit("")).alias("stage"))


def _records(spark, sf_dir) -> DataFrame:
    texts = read(spark, sf_dir, "pages").selectExpr("concat('base', page_id % 4) as base", f"{RECORD_KEY} as key", f"{RECORD} as text".replace("chr(10)", "'\\n'"))
    return records.sources(texts)


def source_records(spark, sf_dir):
    """Records with what is wrong with them, or the line that they render to."""
    found = _records(spark, sf_dir)
    return found.select("base", "key", F.coalesce("error", F.lit("")).alias("error"), F.when(F.col("error").isNull(), records.bibliography_entry()).otherwise("").alias("line"))


def sources_listing(spark, sf_dir):
    """Good records of each base, newest reading first (Q11)."""
    return quality.listing(_records(spark, sf_dir)).select("base", "key", "type", "retrieved_on", "position")


def csl_export(spark, sf_dir):
    item = lambda path: F.coalesce(F.get_json_object("item", path), F.lit(""))
    return records.csl(_records(spark, sf_dir)).select(
        "base", "key", item("$.type").alias("type"), item("$.title").alias("title"), item("$.author[0].family").alias("family"), item("$.author[1].literal").alias("second"),
        item("$['container-title']").alias("container"), item("$.custom.retrieval_status").alias("status"), item("$.accessed['date-parts'][0][2]").cast("double").alias("day"),
    )


def line_marks(spark, sf_dir):
    line = F.expr(NOTE_LINE)
    key, rest = records.bibliography_line(line)
    blank = lambda c: F.coalesce(c, F.lit(""))
    message = F.expr(MESSAGE.replace("chr(10)", "'\\n'"))
    return read(spark, sf_dir, "pages").select("page_id", blank(key).alias("key"), blank(rest).alias("rest"), records.prose_sources(line).alias("prose"), blank(records.first_dash(line)).alias("dash"), parsers.without_blocks(message).alias("said"))


def base_settings(spark, sf_dir):
    counts = read(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("base")).agg(F.count(F.lit(1)).alias("n"))
    found = records.bases(counts.selectExpr("base", f"{SETTINGS} as text".replace("chr(10)", "'\\n'")))
    return found.select("base", "name", "role", F.coalesce("ends", F.lit("")).alias("ends"), "whole", F.array_join("private", ",").alias("private"))


def gold_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "benchmark").selectExpr(f"{GOLD_LINE} as value".replace("chr(9)", "'\\t'"))
    found = records.gold(lines)
    return found.groupBy("question", F.array_join("answers", ",").alias("answers"), F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("lines"))


def session_switches(spark, sf_dir):
    return logs.sticky(logs.session_events(read(spark, sf_dir, "events")))


def objection_numbers(spark, sf_dir):
    rounds = read(spark, sf_dir, "events").where("event_id % 4 = 1").select((F.col("user_id") % 40).alias("artifact"), F.col("event_type").alias("reviewer"), F.col("event_id").alias("at"))
    return logs.numbered(rounds)


def panel_costs(spark, sf_dir):
    seats = read(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("artifact"), parsers.token_estimate(F.octet_length("text"), F.lit(0)).alias("boot"), F.lit(100).alias("reading"))
    return logs.panel_cost(seats)


def evidence_sessions(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    proposals = events.select((F.col("event_id") % 211).alias("proposal"), F.when(F.col("event_id") % 9 == 0, F.lit(" ")).otherwise(F.col("user_id").cast("string")).alias("source"))
    return logs.unsupported(proposals.where("event_id % 7 = 0"), events.where("user_id % 10 <> 3").select(F.col("user_id").cast("string").alias("session")))


def sampled_items(spark, sf_dir):
    items = read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 31 == 0, "_abs").otherwise("")).alias("id"), "lang")
    return analytics.sampled(items, 10, ["lang"])


def fused_agents(spark, sf_dir):
    from .registry import _asked

    parts = _asked(spark, sf_dir)
    return ask.fused_agents(ask.fuse(parts["keyword"], parts["text"])).withColumn("agent_score", round6(F.col("agent_score")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    chunk_sections, note_facets, section_search, source_records, sources_listing, csl_export, line_marks, base_settings, gold_lines,
    session_switches, objection_numbers, panel_costs, evidence_sessions, sampled_items, fused_agents,
)}


# The same as SQL for the oracle database.

_TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_STOP = r"""least(at_ - 1 + CASE WHEN at_ - 1 + 1800 < length(body) AND length(regexp_extract(substring(body, at_, 1800), '(?s)^(.*)\n\n', 1)) > 600
  THEN length(regexp_extract(substring(body, at_, 1800), '(?s)^(.*)\n\n', 1)) ELSE 1800 END, length(body))"""
_MADE = f"made AS (SELECT doc_id, base, rel, private, {MATTER} AS matter, array_to_string(list_transform(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))), lambda z: BEFORE_ || z[1]), chr(10)) AS rest FROM doc_notes)".replace(
    "BEFORE_", "(" + BEFORE.replace("(i + doc_id)", "(z[2] + doc_id)").replace("WHEN i %", "WHEN z[2] %").replace("|| i ||", "|| z[2] ||") + ")"
)
# Front matter is known here, so the SQL never has to find its end; headings, fences and keys are found line by line.
_SECTIONS = rf"""{_MADE},
ls AS (SELECT doc_id, base, rel, private, unnest(string_split(rest, chr(10))) AS s, generate_subscripts(string_split(rest, chr(10)), 1) AS i FROM made),
lf AS (SELECT *, count(*) FILTER (WHERE regexp_matches(s, '^\s*(```|~~~)')) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM ls),
lv AS (SELECT *, CASE WHEN fences % 2 = 0 AND regexp_matches(s, '^#{{1,6}} ') THEN length(regexp_extract(s, '^(#+)', 1)) END AS lvl FROM lf),
lw AS (SELECT *, count(lvl) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM lv),
heads AS (SELECT doc_id, section, lvl, {_TRIM('substring(s, lvl + 1)')} AS title FROM lw WHERE lvl IS NOT NULL),
paths AS (SELECT doc_id, section, list(title ORDER BY at_) AS path FROM (
  SELECT a.doc_id, a.section, b.section AS at_, b.title FROM heads a JOIN heads b ON b.doc_id = a.doc_id AND b.section <= a.section
  WHERE NOT EXISTS (SELECT 1 FROM heads c WHERE c.doc_id = a.doc_id AND c.section > b.section AND c.section <= a.section AND c.lvl <= b.lvl)) GROUP BY 1, 2),
bodies AS (SELECT doc_id, base, rel, private, section, {_TRIM("coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE lvl IS NULL AND NOT contains(s, 'Search for:')), '')")} AS body FROM lw GROUP BY ALL),
secs AS (SELECT b.*, coalesce(array_to_string(path, ' > '), '') AS heading, coalesce(path[-2], '') AS parent_heading FROM bodies b LEFT JOIN paths p USING (doc_id, section) WHERE body <> '' AND NOT starts_with(lower(coalesce(path[-1], '')), 'search for')),
cuts AS (SELECT *, 1::BIGINT AS at_, {_STOP.replace('at_', '1')} AS stop FROM secs
  UNION ALL SELECT * EXCLUDE (at_, stop), at_, {_STOP} AS stop FROM (SELECT * EXCLUDE (at_), greatest(stop - 300, at_) + 1 AS at_ FROM cuts WHERE stop < length(body))),
pieces AS (SELECT *, {_TRIM('substring(body, at_, stop - at_ + 1)')} AS piece FROM cuts),
section_chunks AS (SELECT *, doc_id * 1000000 + section * 1000 + seq AS chunk_id FROM (SELECT doc_id, base, rel, private, section, heading, parent_heading, row_number() OVER (PARTITION BY doc_id, section ORDER BY at_) - 1 AS seq, piece AS text FROM pieces WHERE piece <> ''))"""
_FIELDS = "CASE WHEN doc_id % 4 = 0 THEN '' ELSE ['human', 'agent', 'external'][doc_id % 3 + 1] END AS provenance, CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 = 1 THEN 'raw' ELSE '' END AS stage"

# Records from the numbers that made them, not by parsing their texts again.
_KEY = RECORD_KEY.replace("STRING", "VARCHAR")
_SOURCE = f"""r AS (SELECT page_id, 'base' || page_id % 4 AS base, {_KEY} AS key, CASE WHEN page_id % 17 <> 3 THEN ['book', 'article', 'webpage', 'blog', 'report'][page_id % 5 + 1] END AS type,
  'Page ' || page_id || CASE WHEN page_id % 4 = 0 THEN '.' ELSE '' END AS title, CASE WHEN page_id % 3 > 0 THEN 'Name' || page_id % 7 || ', A.' END AS a1, CASE WHEN page_id % 3 = 2 THEN 'Guild' END AS a2,
  CASE WHEN page_id % 2 = 0 THEN 'Annals ' || page_id % 9 || ', ' ELSE '' END || page_id AS place, (1990 + page_id % 30)::VARCHAR AS year, nullif(trim(url), '') AS url,
  CASE page_id % 11 WHEN 0 THEN 'lost' WHEN 1 THEN 'partial' WHEN 2 THEN 'metadata' ELSE 'full' END AS status, CASE WHEN page_id % 13 > 0 THEN '2024-0' || (page_id % 8 + 1) || '-1' || page_id % 10 END AS retrieved_on FROM pages),
e AS (SELECT *, CASE WHEN key = 'bad' THEN 'no key' WHEN type IS NULL THEN 'no type' WHEN type = 'blog' THEN 'unknown type' WHEN status = 'lost' THEN 'unknown retrieval_status' WHEN retrieved_on IS NULL THEN 'no retrieved_on' ELSE '' END AS error FROM r)"""
_PARTS = """list_filter([a1 || CASE WHEN a2 IS NULL THEN '' ELSE '; ' || a2 END, '"' || title || '"', place, year, url, CASE status WHEN 'partial' THEN 'read in part' WHEN 'metadata' THEN 'catalogue record only, not read' ELSE 'read in full' END || ', ' || retrieved_on], lambda x: x IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    recursive = lambda sql: sql.replace("WITH ", "WITH RECURSIVE ", 1)
    head = "WITH RECURSIVE doc_notes AS (SELECT doc_id, source AS base, CASE doc_id % 5 WHEN 3 THEN 'skills/' WHEN 4 THEN 'tools/' WHEN 2 THEN 'inbox/' ELSE 'knowledge/' END || doc_id || '.md' AS rel, coalesce(text, '') AS text, doc_id % 11 = 0 AS private FROM documents)"
    search = oracles._with(f"SELECT qid, b.base, b.rel, b.chunk_id, round(bm25, 6) AS bm25, base_rank, provenance, stage FROM bm_ranked b JOIN (SELECT base, rel, {_FIELDS} FROM doc_notes) f ON f.base = b.base AND f.rel = b.rel WHERE base_rank <= 20")
    at = search.index("\nchunks AS (")
    search = search[:at] + "\n" + _SECTIONS + ",\nchunks AS (SELECT doc_id, base, rel, private, chunk_id, seq, heading, text FROM section_chunks),\n" + search[search.index("chunk_tokens AS (") :]
    search = search.replace("unnest(terms) AS term FROM asked)", "unnest(terms) AS term FROM plain_asked)")
    return {
        "chunk_sections": f"{head},\n{_SECTIONS}\nSELECT chunk_id, base, rel, heading, parent_heading, seq::INTEGER AS seq, md5(text) AS digest, length(text)::INTEGER AS chars FROM section_chunks",
        "note_facets": f"SELECT base, provenance, stage, count(*) AS notes FROM (SELECT source AS base, {_FIELDS} FROM documents) GROUP BY ALL",
        "section_search": recursive(search),
        "source_records": f"WITH {_SOURCE} SELECT base, key, error, CASE WHEN error = '' THEN line || CASE WHEN line LIKE '%.' THEN '' ELSE '.' END ELSE '' END AS line FROM (SELECT *, list_reduce({_PARTS}, lambda x, y: x || CASE WHEN x LIKE '%.' THEN ' ' ELSE '. ' END || y) AS line FROM e)",
        "sources_listing": f"WITH {_SOURCE} SELECT base, key, type, retrieved_on, row_number() OVER (PARTITION BY base ORDER BY retrieved_on DESC, key) AS position FROM e WHERE error = ''",
        "csl_export": f"""WITH {_SOURCE} SELECT base, key, CASE type WHEN 'article' THEN 'article-journal' ELSE type END AS type, title, coalesce(split_part(a1, ',', 1), '') AS family, coalesce(a2, '') AS second, CASE WHEN page_id % 2 = 0 THEN 'Annals' ELSE '' END AS container,
  status, (10 + page_id % 10)::DOUBLE AS day FROM e WHERE error = ''""",
        "line_marks": r"""SELECT page_id, CASE WHEN page_id % 6 IN (0, 3) THEN 'K' || page_id ELSE '' END AS key, CASE page_id % 6 WHEN 0 THEN 'Title – rest' ELSE '' END AS rest, page_id % 6 IN (2, 4) AS prose,
  CASE page_id % 6 WHEN 1 THEN '—' ELSE '' END AS dash, 'ask ' || page_id || ' more' AS said FROM pages""",
        "base_settings": """SELECT source AS base, CASE WHEN n % 2 = 0 THEN 'Base ' || source ELSE upper(source[1]) || source[2:] END AS name, 'keeps ' || n || ' notes' AS role, CASE WHEN n % 3 = 2 THEN 'x=y' ELSE '' END AS ends, n % 3 = 0 AS whole,
  CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN 'a,b ' ELSE 'late' END AS private FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)""",
        "gold_lines": """SELECT question, answers, error, count(*) AS lines FROM (SELECT CASE item_id % 5 WHEN 2 THEN 'no tab ' || item_id ELSE 'question ' || item_id END AS question,
  CASE item_id % 5 WHEN 4 THEN 'a/b.md,c/d.md,' || chr(9) || 'e' ELSE '' END AS answers, CASE item_id % 5 WHEN 2 THEN 'no tab' ELSE '' END AS error FROM benchmark WHERE item_id % 5 IN (1, 2, 4)) GROUP BY ALL""",
        "session_switches": oracles._with("SELECT session, seq, agent, agent IS DISTINCT FROM lag(agent) OVER (PARTITION BY session ORDER BY ts, seq) AS switched FROM session_log WHERE kind = 'routed'"),
        "objection_numbers": "SELECT user_id % 40 AS artifact, event_type AS reviewer, event_id AS at, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS number, row_number() OVER (PARTITION BY user_id % 40, event_type ORDER BY event_id) AS seq FROM events WHERE event_id % 4 = 1",
        "panel_costs": f"SELECT doc_id % 50 AS artifact, count(*) AS reviewers, sum(t)::BIGINT AS boot, sum(100)::BIGINT AS reading, (sum(t) + sum(100))::BIGINT AS total FROM (SELECT doc_id, floor(strlen(text) / {parsers.PROSE_BYTES}::DOUBLE + 0.5)::BIGINT AS t FROM documents) GROUP BY 1",
        "evidence_sessions": """SELECT proposal, count(DISTINCT s) AS distinct_sources, count(DISTINCT s) FILTER (WHERE s % 10 = 3) AS unknown, count(DISTINCT s) >= 2 AND count(DISTINCT s) FILTER (WHERE s % 10 = 3) = 0 AS accepted
FROM (SELECT event_id % 211 AS proposal, CASE WHEN event_id % 9 <> 0 THEN user_id END AS s FROM events WHERE event_id % 7 = 0) GROUP BY 1""",
        "sampled_items": """SELECT id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id) AS nth FROM (SELECT doc_id::VARCHAR || CASE WHEN doc_id % 31 = 0 THEN '_abs' ELSE '' END AS id, lang FROM documents)) WHERE nth % 10 = 1 OR id LIKE '%\\_abs' ESCAPE '\\'""",
        "fused_agents": oracles._with("SELECT qid, base AS agent, round(agent_score, 6) AS agent_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY agent_score DESC, at_) AS nth FROM (SELECT qid, base, round(sum(rrf), 9) AS agent_score, min(rank) AS at_ FROM fused GROUP BY ALL)) WHERE nth = 1"),
    }
