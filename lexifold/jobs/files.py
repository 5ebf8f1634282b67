"""Registered queries over log files and block manifests, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import round6
from ..operators import ask, blocks
from ..sources import corpus, logfiles
from ..sources.corpus import read
from . import library, oracles, registry

Query = Callable[[SparkSession, str], DataFrame]

#: The question that a benchmark passage makes, as SQL.
_Q = "array_to_string(list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '')[1:12], ' ')"


def _miss_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): logs of sixteen benchmark questions each, some twice, with continued and broken rows."""
    q = corpus.questions(read(spark, sf_dir, "benchmark"))
    record = F.format_string("%d 2024-01-0%d\t2024-02-1%d  %s", F.col("qid") % 7, F.col("qid") % 9 + 1, F.col("qid") % 10, "question")
    like = F.when(F.col("qid") % 3 == 0, F.concat(F.lit("\n  looked like: "), F.element_at(F.split("question", " "), 1), F.lit(" , ,"), F.element_at(F.split("question", " "), -1)))
    broken = F.when(F.col("qid") % 4 == 1, "\nx 2024 2024 no count").when(F.col("qid") % 4 == 2, "\none two").when(F.col("qid") % 4 == 3, "\n# comment\n")
    again = F.when(F.col("qid") % 5 == 0, F.concat(F.lit("\n99 a b "), F.upper("question")))
    block = F.concat(record, *(F.coalesce(x, F.lit("")) for x in (like, broken, again)))
    texts = q.groupBy((F.col("qid") - F.col("qid") % 16).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("qid", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))
    return texts.select(F.col("file").cast("string").alias("file"), F.concat(F.lit("looked like: nothing above\n"), "text").alias("text"))


def misses_report(spark, sf_dir):
    """Questions that were once lost, the most frequent first, with what they score now (Q14)."""
    found = logfiles.misses(_miss_texts(spark, sf_dir))
    listed = logfiles.report(found, "question").withColumn("qid", F.xxhash64("file", "line"))
    parts = registry._asked(spark, sf_dir, listed.select("qid", "question"))
    now = ask.verdicts(listed.select("qid"), parts["keyword"], parts["text"], parts["n"])
    return listed.join(now, "qid").select("file", "position", "count", "first", "last", F.md5("question").alias("question"), F.array_join("looked_like", "|").alias("looked_like"), "verdict", round6(F.col("keyword_score")).alias("keyword_score"))


def misses_bad_rows(spark, sf_dir):
    found = logfiles.misses(_miss_texts(spark, sf_dir))
    return found.where("bad is not null").groupBy("file", "bad").agg(F.count(F.lit(1)).alias("rows"))


def _turn_texts(spark: SparkSession, sf_dir: str, line) -> DataFrame:
    """(file, text): a log for each conversation with a line for each turn."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    return turns.groupBy(F.col("conv_id").cast("string").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("b")))), lambda x: x["b"]), "\n").alias("text"))


def log_reports(spark, sf_dir):
    """Misroutes, abstentions and rejections of each log in the order of their reports."""
    t = F.col("turn")
    lines = {
        "misroutes": (F.concat_ws("\t", F.when(t % 3 == 0, "n").otherwise((t % 4).cast("string")), F.lit("a"), F.lit("b"), F.lit("x"), F.lit("y"), F.when(t % 5 != 4, F.left("text", F.lit(30))), F.lit("why")), "question"),
        "abstentions": (F.concat_ws("\t", F.when(t % 3 == 0, "n").otherwise((t % 4).cast("string")), F.lit("a"), F.lit("b"), F.lit("0"), F.lit("-"), F.left("text", F.lit(30)), F.lit("m")), "subject"),
        "rejections": (F.concat_ws("\t", (t % 4).cast("string"), F.lit("a"), F.lit("b"), F.col("role"), F.lit("s"), F.lit("lens"), F.left("text", F.lit(30)), F.lit("tail")), "reason"),
    }
    out = None
    for kind, (line, shown) in lines.items():
        layout = logfiles.LAYOUTS[kind]
        rows = logfiles.report(logfiles.tabbed(_turn_texts(spark, sf_dir, line), layout), layout.ties).select(F.lit(kind).alias("kind"), "file", "position", "count", F.md5(shown).alias("shown"))
        out = rows if out is None else out.unionByName(rows)
    return out


def blocks_report(spark, sf_dir):
    """Blocks of a manifest for each note: its own, and on demand the next note's and one that is not there."""
    notes = library.section_notes(spark, sf_dir)
    said = F.concat(F.lit("above.md\n[core] # first\n"), "rel", F.lit(" # own\n[broken\n[ more ] On-Demand\n"), F.regexp_replace("rel", r"\d+", (F.col("doc_id") + 5).cast("string")), F.lit("\nnone.md\n[empty]"))
    listed = blocks.manifest(notes.select(F.col("doc_id").alias("root"), "base", said.alias("text")))
    return blocks.report(listed, notes.select("base", "rel", "text")).select("root", "name", "resident", "files", "missing", "file_bytes", "bytes", "code_bytes", "tokens", F.coalesce("cost", F.lit(-1)).alias("cost"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (misses_report, misses_bad_rows, log_reports, blocks_report)}


# The same as SQL for the oracle database.


def oracle_sql() -> dict[str, str]:
    made = library.note_jobs._SECTIONS[: library.note_jobs._SECTIONS.index(",\nls AS (")]
    lost = rf"""lost AS (SELECT item_id AS id, item_id - item_id % 16 AS file, {_Q} AS q FROM benchmark),
records AS (SELECT id, file, id % 7 AS count, '2024-01-0' || (id % 9 + 1) AS first, '2024-02-1' || (id % 10) AS last, q, CASE WHEN id % 3 = 0 THEN array_to_string(list_filter(list_transform(string_split(string_split(q, ' ')[1] || ' , ,' || string_split(q, ' ')[-1], ','), lambda w: trim(w)), lambda w: w <> ''), '|') ELSE '' END AS looked_like FROM lost WHERE id % 5 <> 0
  UNION ALL SELECT id, file, 99, 'a', 'b', upper(q), '' FROM lost WHERE id % 5 = 0)"""
    asked = "SELECT id AS qid, q AS question FROM records"
    turn = "SELECT conv_id::VARCHAR AS file, turn, role, left(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), 30) AS t FROM conversations"
    place = lambda ties: f"row_number() OVER (PARTITION BY file ORDER BY count DESC, {ties}turn)"
    code = r"""code AS (SELECT doc_id, sum(CASE WHEN fence OR before % 2 = 1 THEN strlen(s) + 1 ELSE 0 END) AS code FROM (SELECT *, count(*) FILTER (WHERE fence) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT doc_id, s, i, starts_with(s, '```') AS fence FROM (SELECT doc_id, unnest(string_split(matter || rest, chr(10))) AS s, generate_subscripts(string_split(matter || rest, chr(10)), 1) AS i FROM made))) GROUP BY 1),
sized AS (SELECT m.doc_id, m.base, strlen(matter || rest) AS all_, strlen(regexp_replace(matter || rest, '(^|\n)Search for:[^\n]*(\n|$)', '\1', 'g')) AS sent, code FROM made m JOIN code USING (doc_id)),
b AS (SELECT d.doc_id AS root, 'core' AS name, true AS resident, 1 AS files, 0 AS missing, all_ AS file_bytes, sent AS bytes, code AS code_bytes FROM documents d JOIN sized s USING (doc_id)
  UNION ALL SELECT d.doc_id, 'more', false, CASE WHEN s.doc_id IS NULL THEN 0 ELSE 1 END, CASE WHEN s.doc_id IS NULL THEN 2 ELSE 1 END, coalesce(all_, 0), coalesce(sent, 0), coalesce(code, 0) FROM documents d LEFT JOIN sized s ON s.doc_id = d.doc_id + 5 AND s.base = d.source
  UNION ALL SELECT doc_id, 'empty', true, 0, 0, 0, 0, 0 FROM documents),
bt AS (SELECT root, name, resident, files::BIGINT AS files, missing::BIGINT AS missing, file_bytes::BIGINT AS file_bytes, bytes::BIGINT AS bytes, code_bytes::BIGINT AS code_bytes, floor((bytes - code_bytes) / 3.99::DOUBLE + code_bytes / 2.96::DOUBLE + 0.5)::BIGINT AS tokens FROM b)"""
    rescored = oracles._with("SELECT 1").replace("\nquestions AS (SELECT * FROM plain_questions)", f"\n{lost},\nquestions AS ({asked})").removesuffix("SELECT 1")
    return {
        "misses_report": f"""{rescored} SELECT file::VARCHAR AS file, row_number() OVER (PARTITION BY file ORDER BY count DESC, q) AS position, count, first, last, md5(q) AS question, looked_like, verdict, round(keyword_score, 6) AS keyword_score
FROM records JOIN verdicts ON qid = id""",
        "misses_bad_rows": "WITH f AS (SELECT item_id AS id, (item_id - item_id % 16)::VARCHAR AS file FROM benchmark) SELECT file, bad, count(*) AS rows FROM (SELECT DISTINCT file, 'no record above' AS bad, 0 AS id FROM f UNION ALL SELECT file, CASE id % 4 WHEN 1 THEN 'count' ELSE 'fields' END, id FROM f WHERE id % 4 IN (1, 2)) GROUP BY ALL",
        "log_reports": f"""WITH t AS ({turn}),
m AS (SELECT *, CASE WHEN turn % 3 = 0 THEN 1 ELSE turn % 4 END AS count FROM t)
SELECT 'misroutes' AS kind, file, {place('')} AS position, count::BIGINT AS count, md5(CASE WHEN turn % 5 <> 4 THEN t ELSE 'why' END) AS shown FROM m
UNION ALL SELECT 'abstentions', file, {place('t, ')}, count::BIGINT, md5(t) FROM (SELECT *, turn % 4 AS count FROM t WHERE turn % 3 <> 0)
UNION ALL SELECT 'rejections', file, {place('')}, count::BIGINT, md5(regexp_replace(t, '^\\s+', '') || chr(9) || 'tail') FROM (SELECT *, turn % 4 AS count FROM t)""",
        "blocks_report": oracles._with(f""", {made}, {code} SELECT root, name, resident, files, missing, file_bytes, bytes, code_bytes, tokens, CASE WHEN resident THEN tokens ELSE -1 END AS cost FROM bt"""),
    }
