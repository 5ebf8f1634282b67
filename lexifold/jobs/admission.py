"""Registered queries over what asks to be let in: candidate aliases, proposed notes and their reviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies
from ..operators import analytics, gate, keyword, proposals
from ..sources import corpus
from ..sources.corpus import read
from ..sources.stages import written
from . import oracles, registry

Query = Callable[[SparkSession, str], DataFrame]

#: What a candidate is made of, by id modulo 8, out of the words ``w`` of a benchmark question: alias, canonical, because.
_MADE = {
    0: ("reverse(w[1]) || 'zq'", "w[2] || ' ' || w[3]", "'what is ' || reverse(w[1]) || 'zq'"),
    1: ("w[1]", "w[2] || ' ' || w[3]", "reverse(w[1]) || 'zq'"),
    2: ("w[1]", "w[3]", "q"),
    3: ("w[1] || ' ' || w[2]", "w[-1]", "'zq' || w[1] || ' ' || w[2]"),
    4: ("w[4]", "w[1] || ' ' || w[2] || ' ' || w[3]", "w[4]"),
    5: ("CASE WHEN id % 3 = 0 THEN ' ' ELSE w[1] END", "CASE WHEN id % 3 = 1 THEN upper(w[1]) ELSE 'a=b' END", "CASE WHEN id % 2 = 0 THEN '' ELSE q END"),
    6: ("w[6]", "w[1] || ' ' || w[5]", "w[6]"),
    7: ("w[-1]", "w[2] || ' ' || w[1]", "w[-1]"),
}


def _made(part: int, element: str) -> str:
    """The expression of one part of a candidate; Spark counts elements with ``element_at``."""
    cases = " ".join(f"WHEN {k} THEN {v[part]}" for k, v in _MADE.items())
    text = f"CASE id % 8 {cases} END"
    for i in ("-1", "1", "2", "3", "4", "5", "6"):
        text = text.replace(f"w[{i}]", element.format(i))
    return text


def alias_candidates(spark, sf_dir):
    """Candidate aliases, one for each benchmark question, judged by all questions (Q13)."""
    questions = registry._questions(spark, sf_dir)
    entries = written(registry._entries(spark, sf_dir))
    gold = written(analytics.gold_by_passage(questions, corpus.document_notes(registry._documents(spark, sf_dir).select("doc_id", "source", "text"))))
    words = questions.select(F.col("qid").alias("id"), F.col("question").alias("q"), F.split("question", " ").alias("w"))
    candidates = words.select(F.col("id").alias("cid"), *(F.expr(_made(i, "coalesce(try_element_at(w, {0}), '')")).alias(name) for i, name in enumerate(("alias", "canonical", "because"))))
    n = registry._n_entries(spark, sf_dir)
    return gate.judge(candidates, questions, gold, keyword.entry_terms(entries), keyword.entry_phrases(entries), n, registry._aliases(spark))


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reply, text, said): a reply for each document that proposes its text and a second note of its first words."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", text.alias("t"), F.split(text, "\n").getItem(0).alias("first"), F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("w"))
    word = lambda i: F.coalesce(F.try_element_at("w", F.lit(i)), F.lit(""))
    d = F.col("doc_id")
    lines = [
        F.lit("Two notes.\nPROPOSAL"), F.concat(F.lit("slug: "), F.lower(word(1))), F.when(d % 7 != 3, F.concat(F.lit("  summary: "), F.left("first", F.lit(60)), F.lit(" .."))),
        F.when(d % 7 != 0, F.concat(F.lit("keys: "), word(1), F.lit(", `"), word(2), F.lit("`,,"))), F.format_string("sources: %d, %d", d % 90, (d + d % 4) % 90),
        F.when(d % 5 != 4, F.lit("body:")), F.when(d % 5 != 1, F.col("t")), F.when(d % 7 != 2, F.lit(" END")),
        F.lit("PROPOSAL"), F.concat(F.lit("slug: "), word(3)), F.lit("folder: skills/made"), F.concat(F.lit("summary: "), word(4)), F.concat(F.lit("keys: "), word(5)), F.format_string("sources: %d, %d", d % 90, d % 90 + 1), F.lit("body:"), word(6),
    ]
    return docs.select(d.alias("reply"), F.concat_ws("\n", *lines).alias("text"), "t", "first")


def proposals_report(spark, sf_dir):
    """Proposed notes of all replies: what each block lacks, which sessions bear it out, and what its reviews say (P20)."""
    replied = _proposed(spark, sf_dir)
    sessions = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"))
    blocks = written(proposals.borne_out(proposals.blocks(replied.select("reply", "text")), sessions))
    fit = F.when(F.col("reply") % 6 == 0, F.concat(F.lit("I would say\n> **Verdict** : Reject, not accept\n- Reason: "), "first")).when(F.col("reply") % 6 == 1, F.col("t")).otherwise("Accepted.")
    first = replied.select("reply", F.lit(1).alias("block"), F.lit("fit").alias("lens"), fit.alias("text"))
    both = blocks.where("reply % 3 <> 0 or block = 1").select("reply", "block", F.lit("new").alias("lens"), F.lit("VERDICT: accept\nreason: fine").alias("text"))
    notes = proposals.decided(blocks, first.unionByName(both)).join(blocks.drop("slug"), ["reply", "block"])
    return notes.select("reply", "block", "slug", "folder", "summary", F.array_join("keys", "|").alias("keys"), F.array_join("refused", "|").alias("refused"), F.md5("body").alias("body"), "written", "reason")


def refused_report(spark, sf_dir):
    """Questions that the deposits of conversations list as refused, with how many deposits list each."""
    turn = F.col("turn")
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    line = F.concat(F.when(turn % 5 == 0, "## Questions the base could not answer\n").when(turn % 5 == 2, " # Refusals\n").when(turn % 5 == 3, "### Said\n").otherwise(""), F.when(turn % 4 != 3, "- ").otherwise("text "), said)
    lines = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("s"))
    items = lines.select("conv_id", F.explode(replies.refused_questions(F.array_join(F.transform("s", lambda x: x["line"]), "\n"))).alias("question"))
    return items.groupBy("question").agg(F.count(F.lit(1)).alias("times"), F.count_distinct("conv_id").alias("deposits"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (alias_candidates, proposals_report, refused_report)}


# The same as SQL for the oracle database.


def _alias_candidates_sql() -> str:
    """Every candidate against every question, each scored anew if the alias adds a word."""
    made = f"""
cand0 AS (SELECT item_id AS id, q, string_split(q, ' ') AS w FROM (SELECT qid AS item_id, question AS q FROM plain_questions)),
cand1 AS (SELECT id AS cid, {', '.join(f"{_made(i, "coalesce(w[{0}], '')")} AS {name}" for i, name in enumerate(('alias', 'canonical', 'because')))} FROM cand0),
cand AS (SELECT *, {oracles.norm('alias')} AS a, {oracles.norm('canonical')} AS c, CASE WHEN trim(alias) = '' OR trim(canonical) = '' THEN 'empty side' WHEN lower(trim(alias)) = lower(trim(canonical)) THEN 'same word'
  WHEN trim(because) = '' THEN 'no question' WHEN contains(alias, '=') OR contains(canonical, '=') THEN 'equals sign' END AS problem FROM cand1),
questions AS (SELECT * FROM plain_questions UNION ALL SELECT cid + 1000000, because FROM cand WHERE problem IS NULL),"""
    common = oracles.COMMON.replace("\nquestions AS (SELECT * FROM plain_questions),", made).replace("\nasked AS (", "\nasked0 AS (")
    asked = """
again AS (SELECT p.qid, cid, terms0, list_filter(list_distinct(c), lambda x: NOT list_contains(terms0, x)) AS more, c FROM (SELECT p.*, a0.terms AS terms0 FROM plain_asked p JOIN asked0 a0 USING (qid)) p, cand
  WHERE problem IS NULL AND (p.qid < 1000000 OR p.qid = cid + 1000000) AND len(a) > 0 AND CASE WHEN len(a) > 1 THEN contains(array_to_string(p.terms, ' '), array_to_string(a, ' ')) ELSE list_contains(p.terms, a[1]) END),
asked AS (SELECT qid, question, terms FROM asked0 UNION ALL SELECT (cid + 1) * 10000000 + qid, '', list_concat(terms0, more) FROM again WHERE len(more) > 0),"""
    at = common.index("\nkw_terms AS (")
    common = common[:at] + asked + common[at:]
    return f"""WITH {common},
keyed AS (SELECT qid AS k, qid, NULL AS cid FROM questions UNION ALL SELECT (cid + 1) * 10000000 + qid, qid, cid FROM again WHERE len(more) > 0),
o AS (SELECT k.qid, k.cid, f.tb IS NOT NULL AS found, EXISTS (SELECT 1 FROM gold g WHERE g.qid = k.qid AND g.base = f.tb AND g.rel = f.tr)::INT AS file,
  EXISTS (SELECT 1 FROM gold g WHERE g.qid = k.qid AND g.base = agents.agent)::INT AS agent,
  (NOT EXISTS (SELECT 1 FROM gold g WHERE g.qid = k.qid) AND coalesce(f.keyword_score >= {oracles.FLOOR}, false))::INT AS answered
  FROM keyed k LEFT JOIN first_two f ON f.qid = k.k LEFT JOIN agents ON agents.qid = k.k),
t AS (SELECT sum(file) AS file, sum(agent) AS agent, sum(answered) AS answered FROM o WHERE cid IS NULL AND qid < 1000000),
d AS (SELECT n.cid, count(*) AS touched, sum(n.file - b.file) AS file, sum(n.agent - b.agent) AS agent, sum(n.answered - b.answered) AS answered FROM o n JOIN o b ON b.qid = n.qid AND b.cid IS NULL WHERE n.cid IS NOT NULL AND n.qid < 1000000 GROUP BY 1),
r AS (SELECT c.*, coalesce(d.touched, 0) AS touched, NOT b.found AS missing, NOT b.found AND coalesce(n.found, b.found) AS fixes, t.file AS file_before, t.agent AS agent_before, t.answered AS answered_before,
  t.file + coalesce(d.file, 0) AS file_after, t.agent + coalesce(d.agent, 0) AS agent_after, t.answered + coalesce(d.answered, 0) AS answered_after
  FROM cand c CROSS JOIN t LEFT JOIN d USING (cid) LEFT JOIN o b ON b.qid = c.cid + 1000000 AND b.cid IS NULL LEFT JOIN o n ON n.qid = c.cid + 1000000 AND n.cid = c.cid),
s AS (SELECT *, CASE WHEN problem IS NOT NULL THEN problem WHEN NOT missing THEN 'does not miss' WHEN NOT fixes THEN 'still finds nothing' WHEN file_after < file_before OR agent_after < agent_before OR answered_after > answered_before THEN 'costs elsewhere' ELSE '' END AS reason FROM r)
SELECT cid, alias, canonical, reason = '' AS admitted, reason, CASE WHEN problem IS NULL THEN missing END AS missing, CASE WHEN problem IS NULL THEN fixes END AS fixes,
  {', '.join(f'CASE WHEN problem IS NULL THEN {x}::BIGINT END AS {x}' for x in ('touched', 'file_before', 'agent_before', 'answered_before', 'file_after', 'agent_after', 'answered_after'))} FROM s"""


_PROPOSALS = r"""WITH d AS (SELECT doc_id AS d, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10))[1] AS first, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM documents),
replies AS (SELECT d AS reply, t, first, concat_ws(chr(10), 'Two notes.', 'PROPOSAL', 'slug: ' || lower(coalesce(w[1], '')), CASE WHEN d % 7 <> 3 THEN '  summary: ' || left(first, 60) || ' ..' END,
  CASE WHEN d % 7 <> 0 THEN 'keys: ' || coalesce(w[1], '') || ', `' || coalesce(w[2], '') || '`,,' END, 'sources: ' || d % 90 || ', ' || (d + d % 4) % 90, CASE WHEN d % 5 <> 4 THEN 'body:' END, CASE WHEN d % 5 <> 1 THEN t END, CASE WHEN d % 7 <> 2 THEN ' END' END,
  'PROPOSAL', 'slug: ' || coalesce(w[3], ''), 'folder: skills/made', 'summary: ' || coalesce(w[4], ''), 'keys: ' || coalesce(w[5], ''), 'sources: ' || d % 90 || ', ' || (d % 90 + 1), 'body:', coalesce(w[6], '')) AS text FROM d),
lines AS (SELECT reply, i, s, regexp_replace(s, '^\s+|\s+$', '', 'g') AS b FROM (SELECT reply, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS s FROM replies)),
marks AS (SELECT *, lag(b) OVER (PARTITION BY reply ORDER BY i) AS before FROM lines WHERE b IN ('PROPOSAL', 'END')),
opens AS (SELECT reply, i, row_number() OVER (PARTITION BY reply ORDER BY i) AS block FROM marks WHERE b = 'PROPOSAL' AND coalesce(before, 'END') = 'END'),
owned AS (SELECT l.*, o.block, min(l.i) FILTER (WHERE l.b = 'END') OVER (PARTITION BY l.reply, o.block) AS stop FROM lines l ASOF JOIN opens o ON l.reply = o.reply AND l.i > o.i),
inside AS (SELECT *, min(i) FILTER (WHERE b = 'body:') OVER (PARTITION BY reply, block) AS body_at FROM owned WHERE stop IS NULL OR i < stop),
parts AS (SELECT reply, block, LABELS, coalesce(regexp_replace(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE i > body_at), '^\s+|\s+$', '', 'g'), '') AS body FROM inside GROUP BY ALL),
read_ AS (SELECT reply, block, coalesce(slug, '') AS slug, coalesce(nullif(folder, ''), 'knowledge') AS folder, regexp_replace(coalesce(summary, ''), '\.+$', '') AS summary, body,
  list_filter(list_transform(string_split(coalesce(keys, ''), ','), lambda k: trim(trim(k), '`')), lambda k: k <> '') AS keys,
  list_distinct(list_filter(list_transform(string_split(coalesce(sources, ''), ','), lambda k: trim(k)), lambda k: k <> '')) AS sources FROM parts),
checked AS (SELECT *, list_concat(list_filter([CASE WHEN slug = '' THEN 'slug' END, CASE WHEN summary = '' THEN 'summary' END, CASE WHEN len(keys) = 0 THEN 'keys' END, CASE WHEN body = '' THEN 'body' END, CASE WHEN len(sources) < 2 THEN 'sessions' END], lambda x: x IS NOT NULL),
  list_transform(list_sort(list_filter(sources, lambda s: NOT list_contains(us, s))), lambda s: 'unknown ' || s)) AS refused FROM read_, (SELECT list(DISTINCT user_id::VARCHAR) AS us FROM events)),
said AS (SELECT c.*, CASE WHEN len(refused) > 0 THEN refused[1] WHEN block > 1 AND c.reply % 3 = 0 THEN 'not reviewed' WHEN block > 1 THEN ''
  WHEN c.reply % 6 = 0 THEN 'fit: ' || coalesce(nullif(regexp_replace(replace(replace(first, '**', ''), '__', ''), '^\s+|\s+$', '', 'g'), ''), 'no reason given')
  WHEN c.reply % 6 = 1 THEN 'fit: ' || CASE WHEN trim(regexp_replace(t, '\s+', ' ', 'g')) = '' THEN 'nothing was returned' ELSE 'no verdict: ' || left(trim(regexp_replace(t, '\s+', ' ', 'g')), 200) END ELSE '' END AS reason FROM checked c JOIN replies USING (reply)),
done AS (SELECT * REPLACE (CASE WHEN reason = '' AND row_number() OVER (PARTITION BY folder, slug, reason = '' ORDER BY reply, block) > 1 THEN 'taken' ELSE reason END AS reason) FROM said)
SELECT reply, block, slug, folder, summary, array_to_string(keys, '|') AS keys, array_to_string(refused, '|') AS refused, md5(body) AS body, reason = '' AS written, reason FROM done"""

_REFUSED = r"""WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS s FROM conversations),
l AS (SELECT *, CASE WHEN turn % 5 IN (0, 2) THEN true WHEN turn % 5 = 3 THEN false END AS heads FROM t),
h AS (SELECT *, last_value(heads IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM l)
SELECT trim(s) AS question, count(*) AS times, count(DISTINCT conv_id) AS deposits FROM h WHERE inside AND turn % 4 <> 3 AND trim(s) <> '' GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    label = lambda n: f"max_by(trim(substring(b, {len(n) + 2})), i) FILTER (WHERE starts_with(b, '{n}:') AND (body_at IS NULL OR i < body_at)) AS {n}"
    labels = ", ".join(map(label, ("slug", "folder", "summary", "keys", "sources")))
    return {"alias_candidates": _alias_candidates_sql(), "proposals_report": _PROPOSALS.replace("LABELS", labels), "refused_report": _REFUSED}
