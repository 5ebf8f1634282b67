"""The registered queries as SQL for the oracle database: one list of common tables, and a select for each query."""

from __future__ import annotations

import math

from ..functions.parsers import CODE_BYTES, CONJUNCTIONS, PROSE_BYTES  # noqa: F401
from ..functions.text import ACCENTED, KEY_STOPWORDS, LOWER, PLAIN, STOPWORDS, UPPER
from ..operators.analytics import REFUSALS
from ..operators.ask import CALIBRATED_AT, SCORE_FLOOR

ALIASES = "(VALUES (0, 'that', 'worthless onthsh'), (1, 'hein ti', 'tisher'), (2, 'unheard', 'nothing')) a(pos, alias, canonical)"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def norm(x: str) -> str:
    """T1 tokens of an expression."""
    words = rf"regexp_extract_all(translate(coalesce({x}, ''), '{ACCENTED}', '{PLAIN}'), '[\p{{L}}\p{{N}}]+')"
    return f"list_filter(list_transform({words}, lambda w: translate(w, '{UPPER}', '{LOWER}')), lambda w: strlen(w) > 1 AND NOT list_contains({_list(STOPWORDS)}, w))"


def fulltext(x: str) -> str:
    """T2 tokens of an expression."""
    return rf"regexp_extract_all(lower(translate(coalesce({x}, ''), '{ACCENTED}', '{PLAIN}')), '[\p{{L}}\p{{N}}]+')"


def keys(source: str, key: str, prefix: str, cap: int) -> str:
    """Common tables ``<prefix>_keys`` (key, keywords) of a table with ``key`` and ``text``."""
    stop = lambda w: f"(strlen({w}) < 4 OR list_contains({_list(KEY_STOPWORDS)}, {w}))"
    return rf"""
{prefix}_words AS (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM {source}),
{prefix}_one AS (SELECT {key}, k, count(*) AS c FROM (SELECT {key}, unnest(w) AS k FROM {prefix}_words) WHERE NOT {stop('k')} GROUP BY ALL),
{prefix}_two AS (SELECT {key}, a || ' ' || b AS k, count(*) AS c FROM (SELECT {key}, unnest(w[1:len(w)-1]) AS a, unnest(w[2:]) AS b FROM {prefix}_words WHERE len(w) > 1)
  WHERE NOT {stop('a')} AND NOT {stop('b')} GROUP BY ALL HAVING count(*) >= 2),
{prefix}_lists AS (SELECT o.{key}, o.ks AS one, coalesce(t.ks, []::VARCHAR[]) AS two
  FROM (SELECT {key}, list(k ORDER BY c DESC, k) AS ks FROM {prefix}_one GROUP BY 1) o
  LEFT JOIN (SELECT {key}, list(k ORDER BY c DESC, k) AS ks FROM {prefix}_two GROUP BY 1) t USING ({key})),
{prefix}_keys AS (SELECT {key}, list_reduce(list_prepend(two[1:{cap // 3}], list_transform(one, lambda k: [k])),
  lambda acc, x: CASE WHEN len(acc) >= {cap} OR len(list_filter(acc, lambda h: contains(h, x[1]))) > 0 THEN acc ELSE list_concat(acc, x) END) AS keywords FROM {prefix}_lists)"""


FLOOR = f"({SCORE_FLOOR!r}::DOUBLE / {math.log(1 + CALIBRATED_AT / 2)!r}::DOUBLE * ln(1 + (SELECT count(*) FROM documents) / 2.0::DOUBLE))"
IDF = "ln(1.0::DOUBLE + (SELECT count(*) FROM documents)::DOUBLE / (1.0::DOUBLE + coalesce(df, 0)))"
KIND = "CASE WHEN split_part({0}, '/', 1) IN ('skills', 'tools') THEN split_part({0}, '/', 1) ELSE 'memory' END"

COMMON = rf"""
doc_notes AS (SELECT doc_id, source AS base,
  CASE doc_id % 5 WHEN 3 THEN 'skills/' WHEN 4 THEN 'tools/' WHEN 2 THEN 'inbox/' ELSE 'knowledge/' END || doc_id || '.md' AS rel,
  doc_id::VARCHAR AS stem, coalesce(text, '') AS text, doc_id % 11 = 0 AS private FROM documents),
{keys('documents', 'doc_id', 'doc', 24)},
entries AS (SELECT n.doc_id, n.base, n.rel, n.stem, string_split(n.text, chr(10))[1] AS title, coalesce(string_split(n.text, chr(10))[2], '') AS purpose,
  coalesce(k.keywords, []::VARCHAR[]) AS keywords FROM doc_notes n LEFT JOIN doc_keys k USING (doc_id)),
entry_terms AS (
  SELECT base, rel, unnest(list_distinct(t)) AS term, w AS weight FROM (
    SELECT base, rel, flatten(list_filter(list_transform(list_filter(keywords, lambda k: NOT contains(k, ' ')), lambda k: {norm('k')}), lambda t: len(t) = 1)) AS t, 6.0::DOUBLE AS w FROM entries
    UNION ALL SELECT base, rel, {norm('title')}, 3.0 FROM entries
    UNION ALL SELECT base, rel, {norm('stem')}, 3.0 FROM entries
    UNION ALL SELECT base, rel, {norm('purpose')}, 1.0 FROM entries)),
entry_phrases AS (SELECT base, rel, pos, original, array_to_string(n, ' ') AS norm FROM (
  SELECT base, rel, generate_subscripts(keywords, 1) - 1 AS pos, unnest(keywords) AS original, {norm('unnest(keywords)')} AS n FROM entries) WHERE len(n) > 1),
keyword_df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT base, rel, term FROM entry_terms) GROUP BY 1),
plain_questions AS (SELECT item_id AS qid, array_to_string(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> '')[1:12], ' ') AS question FROM benchmark),
questions AS (SELECT * FROM plain_questions),
plain_asked AS (SELECT qid, question, {norm('question')} AS terms FROM questions),
alias_hits AS (SELECT q.qid, a.pos, {norm('a.canonical')} AS c FROM plain_asked q, {ALIASES}
  WHERE len({norm('a.alias')}) > 0 AND CASE WHEN len({norm('a.alias')}) > 1 THEN contains(array_to_string(q.terms, ' '), array_to_string({norm('a.alias')}, ' ')) ELSE list_contains(q.terms, ({norm('a.alias')})[1]) END),
alias_words AS (SELECT qid, list(word ORDER BY pos, i) AS more FROM (
    SELECT qid, word, min(pos) AS pos, min_by(i, pos * 1000 + i) AS i FROM (SELECT qid, pos, generate_subscripts(c, 1) AS i, unnest(c) AS word FROM alias_hits) GROUP BY 1, 2) GROUP BY 1),
asked AS (SELECT q.qid, q.question, list_concat(q.terms, list_filter(coalesce(w.more, []::VARCHAR[]), lambda x: NOT list_contains(q.terms, x))) AS terms FROM plain_asked q LEFT JOIN alias_words w USING (qid)),
kw_terms AS (SELECT qid, term, count(*) AS times, min(pos) AS pos FROM (SELECT qid, generate_subscripts(terms, 1) - 1 AS pos, unnest(terms) AS term FROM asked) GROUP BY 1, 2),
kw_parts AS (
  SELECT k.qid, t.base, t.rel, k.times * {IDF} * t.weight AS part, 1 AS g, k.pos AS pos, k.term AS name FROM kw_terms k JOIN keyword_df USING (term) JOIN entry_terms t USING (term)
  UNION ALL
  SELECT qid, base, rel, 10.0 * avg({IDF}), 0, pos, original FROM (
    SELECT q.qid, p.base, p.rel, p.pos, p.original, unnest(string_split(p.norm, ' ')) AS term FROM asked q JOIN entry_phrases p ON contains(array_to_string(q.terms, ' '), p.norm))
  LEFT JOIN keyword_df USING (term) GROUP BY qid, base, rel, pos, original),
kw_scored AS (SELECT qid, base, rel, round(sum(part), 9) AS score FROM kw_parts GROUP BY ALL),
kw_matched AS (SELECT qid, base, rel, array_to_string(list(name ORDER BY g, pos, name), '|') AS matched FROM (SELECT DISTINCT qid, base, rel, g, pos, name FROM kw_parts) GROUP BY ALL),
kw AS (SELECT * FROM (SELECT qid, base, rel, score, matched, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rel, base) AS rank FROM kw_scored JOIN kw_matched USING (qid, base, rel) WHERE score > 0) WHERE rank <= 40),
chunks AS (SELECT doc_id, base, rel, private, doc_id * 1000000 + i AS chunk_id, i AS seq, string_split(text, chr(10))[1] AS heading, substring(text, i * 1500 + 1, 1800) AS text FROM (
  SELECT *, unnest(range(0, CASE WHEN length(text) <= 1800 THEN 1 ELSE ceil((length(text) - 1800) / 1500.0)::BIGINT + 1 END)) AS i FROM doc_notes)),
chunk_tokens AS (SELECT base, rel, chunk_id, unnest({fulltext('heading')}) AS term, 2.0::DOUBLE AS w FROM chunks UNION ALL SELECT base, rel, chunk_id, unnest({fulltext('text')}), 1.0 FROM chunks),
postings AS (SELECT base, term, chunk_id, rel, sum(w) AS tf FROM chunk_tokens GROUP BY ALL),
text_df AS (SELECT base, term, count(*) AS df FROM postings GROUP BY ALL),
chunk_len AS (SELECT base, chunk_id, len({fulltext('heading')}) + len({fulltext('text')}) AS length FROM chunks),
text_bases AS (SELECT base, count(*) AS n_chunks, avg(length) AS mean_length FROM chunk_len GROUP BY 1),
bm_scored AS (SELECT t.qid, p.base, p.rel, p.chunk_id,
    round(sum(CASE WHEN ln((n_chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END
      * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))), 9) AS bm25
  FROM (SELECT DISTINCT qid, unnest(terms) AS term FROM asked) t JOIN postings p USING (term) JOIN text_df d ON d.base = p.base AND d.term = t.term
  JOIN chunk_len l ON l.base = p.base AND l.chunk_id = p.chunk_id JOIN text_bases b ON b.base = p.base GROUP BY ALL),
bm_ranked AS (SELECT s.*, row_number() OVER (PARTITION BY qid, s.base ORDER BY bm25 DESC, s.chunk_id) AS base_rank FROM bm_scored s JOIN chunks c ON c.base = s.base AND c.chunk_id = s.chunk_id WHERE NOT c.private),
bm AS (SELECT * FROM bm_ranked WHERE base_rank <= 60),
txt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY base_rank, base) AS rank FROM bm) WHERE rank <= 60),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, rel, base) AS rank FROM (
  SELECT qid, base, rel, keyword_rank, text_rank, passages, round(coalesce(1.0::DOUBLE / (60.0::DOUBLE + keyword_rank), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + text_rank), 0), 12) AS rrf FROM (
    SELECT qid, base, rel, min(kr) AS keyword_rank, min(tr) AS text_rank, count(tr) AS passages FROM (
      SELECT qid, base, rel, rank AS kr, NULL::BIGINT AS tr FROM kw UNION ALL SELECT qid, base, rel, NULL, rank FROM txt) GROUP BY ALL))) WHERE rank <= 10),
first_two AS (SELECT qid, max(score) FILTER (WHERE rank = 1) AS keyword_score, max(score) FILTER (WHERE rank = 2) AS second, max(base) FILTER (WHERE rank = 1) AS tb, max(rel) FILTER (WHERE rank = 1) AS tr FROM kw GROUP BY 1),
verdicts AS (SELECT q.qid,
  CASE WHEN f.tb IS NULL THEN 'nothing' WHEN f.keyword_score >= {FLOOR} AND (SELECT count(*) FROM documents) >= 2 THEN 'hit' ELSE 'guess' END AS verdict,
  CASE WHEN f.tb IS NULL THEN 0 WHEN EXISTS (SELECT 1 FROM txt t WHERE t.qid = q.qid AND t.base = f.tb AND t.rel = f.tr) THEN 2 ELSE 1 END AS agreement,
  coalesce(f.keyword_score, 0.0::DOUBLE) AS keyword_score,
  CASE WHEN f.tb IS NULL THEN 0.0::DOUBLE WHEN f.second > 0 THEN f.keyword_score / f.second ELSE 1.0::DOUBLE END AS margin, {FLOOR} AS floor, f.tb || '/' || f.tr AS keyword_top
  FROM questions q LEFT JOIN first_two f USING (qid)),
species AS (SELECT qid, base, {KIND.format('rel')} AS kind, max(score) AS best, min(rank) AS first_at FROM kw GROUP BY ALL),
agents AS (SELECT qid, agent, agent_score, files, contenders, agent_margin FROM (
  SELECT qid, base AS agent, agent_score, files, count(*) OVER (PARTITION BY qid) AS contenders, row_number() OVER o AS nth,
    CASE WHEN lead(agent_score) OVER o > 0 THEN agent_score / lead(agent_score) OVER o END AS agent_margin
  FROM (SELECT qid, base, round(sum(best), 9) AS agent_score, count(*) AS files, min(first_at) AS first_at FROM species GROUP BY ALL) WINDOW o AS (PARTITION BY qid ORDER BY agent_score DESC, first_at)) WHERE nth = 1),
answers AS (SELECT v.*, agent, agent_score, files, contenders, agent_margin, coalesce(found, 0) AS found FROM verdicts v LEFT JOIN agents USING (qid) LEFT JOIN (SELECT qid, count(*) AS found FROM fused GROUP BY 1) USING (qid)),
gold AS (SELECT DISTINCT q.qid, n.base, n.rel FROM (SELECT qid, array_to_string(({fulltext('question')})[1:8], ' ') AS run FROM questions WHERE len({fulltext('question')}) >= 8) q
  JOIN (SELECT base, rel, ' ' || array_to_string({fulltext('text')}, ' ') || ' ' AS t FROM doc_notes) n ON contains(n.t, ' ' || q.run || ' ')),
graded AS (SELECT a.qid, a.verdict, a.keyword_score, a.agent, g.answers IS NULL AS must_abstain, coalesce(list_contains(g.answers, f.base || '/' || f.rel), false) AS file_hit,
  coalesce(list_contains(g.answers, a.keyword_top), false) AS keyword_hit, coalesce(list_contains(g.owners, a.agent), false) AS agent_hit, g.owners
  FROM answers a LEFT JOIN (SELECT * FROM fused WHERE rank = 1) f USING (qid) LEFT JOIN (SELECT qid, list(DISTINCT base || '/' || rel) AS answers, list(DISTINCT base) AS owners FROM gold GROUP BY 1) g USING (qid)),
session_log AS (SELECT user_id::VARCHAR AS session, event_id AS seq, ts, CASE WHEN event_type = 'purchase' THEN 'conclusion' WHEN event_type IN ('click', 'login') THEN 'routed' ELSE 'refused' END AS kind,
  CASE WHEN event_type IN ('click', 'login') THEN 'agent' || (event_id % 4) END AS agent,
  CASE WHEN event_type NOT IN ('purchase', 'click', 'login') THEN event_type || ' ' || (floor(value)::BIGINT % 10) END AS question FROM events),
owned AS (SELECT *, coalesce(last_value(agent IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  first_value(agent IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS owner FROM session_log)
"""


def _with(select: str, **changed: str) -> str:
    common = COMMON
    for name, sql in changed.items():
        common = common.replace(f"\n{name} AS (SELECT * FROM plain_questions)", f"\n{name} AS ({sql})")
    return f"WITH {common}\n{select}"


#: Sessions that end after a day of rest.
_PARTS = """, parts AS (SELECT *, count(*) FILTER (WHERE cut) OVER (PARTITION BY session ORDER BY ts, seq) AS part FROM (
  SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts, seq) > 86400000000, false) AS cut FROM session_log))"""


#: Documents as notes with the links of ``check_findings`` on their last line.
LINKED = """n AS (SELECT doc_id, source AS base, doc_id::VARCHAR AS stem, CASE doc_id % 5 WHEN 3 THEN 'skills/' WHEN 4 THEN 'tools/' WHEN 2 THEN 'inbox/' ELSE 'knowledge/' END || doc_id || '.md' AS rel,
  length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 5 AS line FROM documents)"""


def _agreement(by: str, source: str) -> str:
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""
WITH c AS (SELECT {lead}count(*) AS n, count_if(q AND t) AS both_yes, count_if(q AND NOT t) AS first_only, count_if(NOT q AND t) AS second_only, count_if(NOT q AND NOT t) AS neither FROM ({source}) {group}),
r AS (SELECT *, (both_yes + neither) / n::DOUBLE AS p0, (both_yes + first_only) / n::DOUBLE AS a, (both_yes + second_only) / n::DOUBLE AS b FROM c),
k AS (SELECT *, CASE WHEN abs(1.0::DOUBLE - (a * b + (1.0::DOUBLE - a) * (1.0::DOUBLE - b))) < 2.220446049250313e-16 THEN NULL ELSE (p0 - (a * b + (1.0::DOUBLE - a) * (1.0::DOUBLE - b))) / (1.0::DOUBLE - (a * b + (1.0::DOUBLE - a) * (1.0::DOUBLE - b))) END AS kappa FROM r)
SELECT {lead}n, both_yes, first_only, second_only, neither, round(p0, 6) AS agreement, round(kappa, 6) AS kappa,
  CASE WHEN kappa IS NULL THEN NULL WHEN kappa < 0 THEN 'worse than chance' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS strength
FROM k"""


def _triad() -> str:
    content = lambda x: rf"list_filter(list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w)), lambda w: strlen(w) > 2 AND NOT list_contains({_list(STOPWORDS)}, w))"
    refused = " OR ".join(f"contains(a, '{r}')" for r in REFUSALS)
    two = lambda x: f"floor(({x}) * 100 + 0.5) / 100"
    return rf"""
WITH turns AS (SELECT *, lag(text) OVER w AS question, lag(role) OVER w AS asker, list_filter([lag(text, 2) OVER w, lag(text, 1) OVER w], lambda x: x IS NOT NULL) AS context
  FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
rows_ AS (SELECT conv_id * 1000 + turn AS qid, context, lower(trim(text)) AS a, lower(array_to_string(context, ' ')) AS c, {content('trim(text)')} AS aw, {content('trim(question)')} AS qt,
  list_filter(list_transform(flatten(list_transform(context, lambda x: regexp_split_to_array(x, '[.\n;]'))), lambda s: trim(s)), lambda s: strlen(s) >= 10) AS sentences
  FROM turns WHERE role = 'assistant' AND asker = 'user')
SELECT qid,
  {two(f"CASE WHEN {refused} THEN 1.0::DOUBLE WHEN len(aw) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(aw, lambda t: contains(c, t))) / len(aw)::DOUBLE END")} AS faithfulness,
  {two(f"CASE WHEN {refused} THEN (CASE WHEN len(context) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) WHEN len(qt) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(qt, lambda t: contains(a, t))) / len(qt)::DOUBLE END")} AS answer_relevance,
  {two(f"CASE WHEN {refused} THEN (CASE WHEN len(context) = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) WHEN len(context) = 0 THEN 0.0::DOUBLE WHEN len(sentences) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(sentences, lambda s: len(list_filter(qt, lambda t: contains(lower(s), t))) > 0)) / len(sentences)::DOUBLE END")} AS context_relevancy
FROM rows_"""


def _grams(word: str) -> str:
    return f"CASE WHEN length({word}) < 3 THEN [{word}] ELSE list_transform(range(1, length({word}) - 1), lambda i: substring({word}, i, 3)) END"


def _decomposed() -> str:
    parts = r"list_filter(list_transform(regexp_split_to_array(trim(text), '[\n?;!]'), lambda p: trim(p)), lambda p: p <> '')"
    steps = [f"s0 AS (SELECT conv_id, turn, trim(text) AS clean, {parts} AS parts FROM conversations WHERE role = 'user')"]
    for i, c in enumerate(CONJUNCTIONS):
        at = f"strpos(lower(p), '{c}')"
        cut = f"CASE WHEN {at} > 0 THEN [trim(substring(p, 1, {at} - 1)), trim(substring(p, {at} + 1))] ELSE [p] END"
        steps.append(f"s{i + 1} AS (SELECT conv_id, turn, clean, list_filter(flatten(list_transform(parts, lambda p: {cut})), lambda p: p <> '') AS parts FROM s{i})")
    bare = r"trim(regexp_replace(regexp_replace(p, '^(and|e) +', ''), '^[^\p{L}\p{N} ?]+|[^\p{L}\p{N} ?]+$', '', 'g'))"
    last = f"s{len(CONJUNCTIONS)}"
    steps.append(f"kept AS (SELECT conv_id, turn, clean, list_filter(list_transform(parts, lambda p: {bare}), lambda p: length(p) >= 10 AND contains(p, ' ')) AS k FROM {last})")
    steps.append("ready AS (SELECT conv_id, turn, CASE WHEN clean = '' THEN []::VARCHAR[] WHEN len(k) = 0 THEN [clean] ELSE k END AS k FROM kept)")
    return "WITH " + ",\n".join(steps) + "\nSELECT conv_id, turn, (generate_subscripts(k, 1) - 1)::INTEGER AS pos, unnest(k) AS part FROM ready"


def _counts(sql: str) -> str:
    """``count_if`` gives a wider integer than a count there; filtered counts do not."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if(') : end - 1]}){sql[end:]}"
    return sql


def oracle_sql() -> dict[str, str]:
    return {name: _counts(sql) for name, sql in _queries().items()}


def _queries() -> dict[str, str]:
    tokens = f"floor(strlen(text) / {PROSE_BYTES}::DOUBLE + 0.5)::BIGINT"
    r6 = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    dense_pairs = "SELECT q.vec_id AS qid, v.label::BIGINT AS owner, max(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id GROUP BY ALL"
    dense_ranked = f"dense AS (SELECT qid, owner, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, owner) AS rank FROM ({dense_pairs}))"
    centroids = """means AS (SELECT label::BIGINT AS owner, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL),
cent AS (SELECT qid, owner, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, owner) AS rank FROM (
  SELECT qid, owner, sum(q * m) AS score FROM (SELECT vec_id AS qid, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0) JOIN means USING (i) GROUP BY ALL))"""
    labelled = """SELECT qid, question FROM plain_questions
UNION ALL SELECT qid + 1000000, array_to_string(list_reverse(string_split(question, ' '))[1:3], ' ') FROM plain_questions
UNION ALL SELECT qid + 2000000, array_to_string(list_transform(string_split(question, ' '), lambda w: reverse(w)), ' ') FROM plain_questions"""
    asked_words = f"(SELECT DISTINCT qid, unnest({norm('question')}) AS word FROM questions)"
    return {
        "ask": _with(f"SELECT qid, verdict, agreement, {r6('keyword_score', 'margin', 'floor')}, keyword_top, agent, {r6('agent_score')}, coalesce(files, 0) AS files, coalesce(contenders, 0) AS contenders, {r6('agent_margin')}, found FROM answers"),
        "normalise_tokens": f"SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {norm('text')} AS t FROM documents)",
        "mechanical_keys": _with("SELECT doc_id, array_to_string(keywords, '|') AS keywords FROM doc_keys"),
        "entry_classification": f"""
WITH p AS (SELECT doc_id, ['', 'inbox/', 'records/', 'skills/', 'tools/x/calculation-log/', 'knowledge/'][doc_id % 6 + 1] || CASE WHEN doc_id % 13 = 0 THEN 'README.md' ELSE doc_id || '.md' END AS rel, length(text) > 400 AS has_keys FROM documents)
SELECT doc_id, rel, CASE WHEN lower(regexp_extract(rel, '([^/]+)$', 1)) IN ('readme.md', 'what-goes-here.md', 'moved.md', 'map.md', 'agents.md', 'claude.md') OR regexp_matches(rel, '^(inbox|records)/|calculation-log/') THEN 'exempt' WHEN has_keys THEN 'entry' ELSE 'unreachable' END AS class,
  {KIND.format('rel')} AS kind, CASE WHEN list_contains(string_split(rel, '/'), 'inbox') THEN 'short' ELSE 'long' END AS layer FROM p""",
        "keyword_idf": _with(f"SELECT term, df, round({IDF}, 6) AS idf FROM keyword_df"),
        "alias_expand": _with("SELECT qid, array_to_string(terms, ' ') AS terms FROM asked"),
        "keyword_route": _with("SELECT qid, base, rel, round(score, 6) AS score, matched, rank FROM kw"),
        "postings_df": _with("SELECT base, term, df FROM text_df"),
        "prune_terms": _with("""SELECT qid, base, term, df FROM (SELECT *, max(ok::INTEGER) OVER (PARTITION BY qid, base) AS any_ok FROM (
  SELECT qid, d.base, t.term, df, n_chunks < 10 OR df <= n_chunks // 4 AS ok FROM (SELECT DISTINCT qid, unnest(terms) AS term FROM plain_asked) t JOIN text_df d USING (term) JOIN text_bases b ON b.base = d.base)) WHERE ok OR any_ok = 0"""),
        "bm25_search": _with("SELECT qid, base, rel, chunk_id, round(bm25, 6) AS bm25, base_rank FROM bm"),
        "round_robin_merge": _with("SELECT qid, rank, base, chunk_id FROM txt"),
        "rrf_fuse": _with("SELECT qid, rank, base, rel, round(rrf, 6) AS rrf, coalesce(keyword_rank, 0) AS keyword_rank, coalesce(text_rank, 0) AS text_rank, passages FROM fused"),
        "confidence_verdict": _with(f"SELECT qid, verdict, agreement, {r6('keyword_score', 'margin', 'floor')}, keyword_top FROM verdicts"),
        "species_fold": _with(f"SELECT qid, agent, {r6('agent_score')}, files, contenders, {r6('agent_margin')} FROM agents"),
        "species_pivot": _with(f"""SELECT qid, base, {', '.join(f"round(max(score) FILTER (WHERE {KIND.format('rel')} = '{k}'), 6) AS {k}" for k in ('memory', 'skills', 'tools'))} FROM kw WHERE rank <= 20 GROUP BY qid, base"""),
        "suggest_terms": _with(f"""
, qw AS (SELECT word, {_grams('word')} AS g FROM (SELECT DISTINCT word FROM {asked_words})), qg AS (SELECT word, len(g) AS n, gram, count(*) AS times FROM (SELECT word, g, unnest(g) AS gram FROM qw) GROUP BY word, len(g), gram),
ks AS (SELECT DISTINCT keyword, unnest({norm('keyword')}) AS part FROM (SELECT DISTINCT unnest(keywords) AS keyword FROM entries)), kg AS (SELECT part, len(g) AS m, gram, count(*) AS others FROM (SELECT part, g, unnest(g) AS gram FROM (SELECT part, {_grams('part')} AS g FROM (SELECT DISTINCT part FROM ks))) GROUP BY part, len(g), gram),
alike AS (SELECT * FROM (SELECT word, part, 2.0::DOUBLE * sum(least(times, others)) / (n + m) AS likeness FROM qg JOIN kg USING (gram) GROUP BY word, n, part, m) WHERE likeness >= 0.65::DOUBLE)
SELECT qid, keyword, round(likeness, 6) AS likeness, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY likeness DESC, keyword) AS rank FROM (
  SELECT qid, keyword, round(max(likeness), 9) AS likeness FROM {asked_words} JOIN alike USING (word) JOIN ks USING (part) GROUP BY ALL)) WHERE rank <= 8""").replace("\n\n,", ","),
        "near_misses": _with(f"""SELECT f.qid, f.rank, f.base, f.rel, round(coalesce(k.score, 0), 6) AS keyword_score, len(e.keywords)::INTEGER AS keys
FROM fused f LEFT JOIN kw k USING (qid, base, rel) LEFT JOIN entries e ON e.base = f.base AND e.rel = f.rel WHERE coalesce(k.score, 0) < {FLOOR}"""),
        "shortfall": _with("""SELECT qid, array_to_string(list_filter([CASE WHEN keyword_score > 0 AND keyword_score < floor THEN printf('scored %.1f against a floor of %.1f', keyword_score, floor) END,
  CASE WHEN keyword_score <= 0 THEN 'no term matched a key' END], lambda x: x IS NOT NULL), '; ') AS causes FROM verdicts WHERE verdict <> 'hit'"""),
        "remember_claims": _with(f"""
, ev AS (SELECT r.qid, r.chunk_id, r.rank, list_sort(list_filter(w, lambda x: list_contains(own, x))) AS shared, list_sort(list_filter(w, lambda x: NOT list_contains(own, x))) AS missing, len(w) AS n
  FROM (SELECT t.qid, t.chunk_id, t.rank, list_distinct(a.terms) AS w, {norm('c.text')} AS own FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY base_rank, base) AS rank FROM bm WHERE base_rank <= 25) WHERE rank <= 25) t JOIN asked a USING (qid) JOIN chunks c ON c.base = t.base AND c.chunk_id = t.chunk_id) r),
best AS (SELECT * FROM (SELECT *, len(shared) / n::DOUBLE AS containment, row_number() OVER (PARTITION BY qid ORDER BY len(shared) / n::DOUBLE DESC, rank) AS nth FROM ev) WHERE nth = 1)
SELECT a.qid, CASE WHEN containment >= 0.9 THEN 'NOOP' WHEN containment >= 0.55 THEN 'UPDATE' ELSE 'ADD' END AS outcome, round(containment, 6) AS containment, array_to_string(shared, ' ') AS shared, array_to_string(missing, ' ') AS missing, coalesce(chunk_id, -1) AS chunk_id
FROM asked a LEFT JOIN best USING (qid)""").replace("\n\n,", ","),
        "list_facets": _with(f"SELECT base, {KIND.format('rel')} AS kind, CASE WHEN list_contains(string_split(rel, '/'), 'inbox') THEN 'short' ELSE 'long' END AS layer, count(*) AS notes, sum(strlen(text))::BIGINT AS bytes FROM doc_notes WHERE NOT private GROUP BY ALL"),
        "incremental_sync_report": """
SELECT base, count_if(o IS NULL OR (n IS NOT NULL AND o <> n)) AS reindexed, count_if(o = n) AS unchanged, count_if(n IS NULL) AS removed FROM (
  SELECT source AS base, CASE WHEN doc_id % 7 <> 0 THEN sha256(coalesce(text, '')) END AS o, CASE WHEN doc_id % 11 <> 0 THEN sha256(coalesce(CASE WHEN doc_id % 5 = 0 THEN text || ' more' ELSE text END, '')) END AS n FROM documents)
WHERE o IS NOT NULL OR n IS NOT NULL GROUP BY base""",
        "eval_summary": _with("""SELECT count_if(NOT must_abstain) AS answerable, count_if(NOT must_abstain AND file_hit) AS file_hits, count_if(NOT must_abstain AND keyword_hit) AS keyword_hits, count_if(NOT must_abstain AND agent_hit) AS agent_hits,
  count_if(NOT must_abstain AND NOT keyword_hit AND verdict <> 'hit') AS misses_flagged, count_if(NOT must_abstain AND NOT keyword_hit) AS misses_total, count_if(NOT must_abstain AND keyword_hit AND verdict <> 'hit') AS hits_demoted,
  count_if(must_abstain AND verdict = 'nothing') AS abstention_refused, count_if(must_abstain AND verdict = 'guess') AS abstention_hedged, count_if(must_abstain AND verdict = 'hit') AS abstention_answered, count_if(must_abstain) AS abstention_expected FROM graded"""),
        "best_fixed_agent": _with("SELECT agent, count(*) AS hits FROM (SELECT unnest(owners) AS agent FROM graded) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
        "score_separation": _with("""SELECT round(l, 6) AS lowest_hit, round(h, 6) AS highest_miss, l > h AS separable FROM (
  SELECT min(keyword_score) FILTER (WHERE NOT must_abstain AND keyword_hit) AS l, max(keyword_score) FILTER (WHERE NOT must_abstain AND NOT keyword_hit) AS h FROM graded)"""),
        "triad_scores": _triad(),
        "abstention_matrix": _with("""SELECT CASE WHEN qid < 1000000 THEN 'in-scope' WHEN qid < 2000000 THEN 'near-oos' ELSE 'noise' END AS label, count_if(verdict = 'hit') AS confident, count_if(verdict = 'guess') AS guess, count_if(verdict = 'nothing') AS nothing, count(*) AS total FROM verdicts GROUP BY 1""", questions=labelled),
        "judge_agreement": _agreement("", "SELECT quality = 1 AS q, toxic = 0 AS t FROM labels"),
        "judge_by_group": _agreement("lang", "SELECT lang, quality = 1 AS q, toxic = 0 AS t FROM labels JOIN documents USING (doc_id)"),
        "alias_gate": _with("""
, before_ AS (SELECT qid, base, rel FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rel, base) AS rank FROM (
  SELECT qid, base, rel, round(sum(part), 9) AS score FROM (
    SELECT k.qid, t.base, t.rel, k.times * IDF_ * t.weight AS part FROM (SELECT qid, unnest(terms) AS term, 1 AS times FROM plain_asked) k JOIN keyword_df USING (term) JOIN entry_terms t USING (term)
    UNION ALL SELECT qid, base, rel, 10.0 * avg(IDF_) FROM (SELECT q.qid, p.base, p.rel, p.pos, p.original, unnest(string_split(p.norm, ' ')) AS term FROM plain_asked q JOIN entry_phrases p ON contains(array_to_string(q.terms, ' '), p.norm)) LEFT JOIN keyword_df USING (term) GROUP BY qid, base, rel, pos, original) GROUP BY ALL)) WHERE rank = 1)
SELECT *, file_after >= file_before AND agent_after >= agent_before AS admitted FROM (SELECT
  (SELECT count(*) FROM before_ SEMI JOIN gold USING (qid, base, rel)) AS file_before, (SELECT count(*) FROM before_ SEMI JOIN gold USING (qid, base)) AS agent_before,
  (SELECT count(*) FROM (SELECT * FROM kw WHERE rank = 1) SEMI JOIN gold USING (qid, base, rel)) AS file_after, (SELECT count(*) FROM (SELECT * FROM kw WHERE rank = 1) SEMI JOIN gold USING (qid, base)) AS agent_after)""".replace("IDF_", IDF)).replace("\n\n,", ","),
        "latency_percentiles": """
SELECT event_type, n, v[n] AS max, v[floor((n - 1) * 0.5::DOUBLE)::BIGINT + 1] AS p50, v[floor((n - 1) * 0.95::DOUBLE)::BIGINT + 1] AS p95
FROM (SELECT event_type, count(*) AS n, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)""",
        "session_owner_asof": _with("SELECT session, seq, kind, owner FROM owned"),
        "session_routes": _with("SELECT session, seq, agent FROM (SELECT *, lag(agent) OVER (PARTITION BY session ORDER BY ts, seq) AS before FROM session_log WHERE kind = 'routed') WHERE agent IS DISTINCT FROM before"),
        "counted_log_fold": _with("SELECT lower(question) AS key, count(*) AS count, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last, last(question ORDER BY ts, seq) AS payload FROM session_log WHERE kind = 'refused' GROUP BY 1"),
        "session_deposit": _with("SELECT session, owner, count_if(kind = 'refused') AS refused, count_if(kind = 'conclusion') AS conclusions, coalesce(array_to_string(list_sort(list(DISTINCT question) FILTER (WHERE kind = 'refused')), '|'), '') AS questions FROM owned WHERE owner IS NOT NULL AND kind <> 'routed' GROUP BY 1, 2"),
        "panel_ledger": """
SELECT artifact, count(*) AS seats, count_if(state = 'pending') AS silent, count_if(state = 'objected' AND blocking) AS blocking_open, bool_and(state IN ('approved', 'resolved')) AS closed FROM (
  SELECT artifact, reviewer, last(state ORDER BY seq) AS state, last(blocking ORDER BY seq) AS blocking FROM (
    SELECT user_id % 40 AS artifact, event_type AS reviewer, event_id AS seq, ['pending', 'objected', 'approved', 'resolved'][event_id % 4 + 1] AS state, value > 20 AS blocking FROM events) GROUP BY 1, 2) GROUP BY 1""",
        "handoff_state": """
SELECT user_id AS session, CASE WHEN bool_or(event_id % 97 = 0) THEN 'completed' WHEN bool_or(event_id % 13 = 0) THEN 'claimed' ELSE 'pending' END AS status,
  first(event_type ORDER BY ts, event_id) FILTER (WHERE event_id % 13 = 0 AND event_id % 97 <> 0) AS claimed_by, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events GROUP BY 1""",
        "conversation_notes": f"""
WITH cn AS (SELECT conv_id, count(*)::INTEGER AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1),
{keys('cn', 'conv_id', 'c', 12)}
SELECT conv_id, turns, md5(text) AS digest, array_to_string(keywords, '|') AS keywords FROM cn LEFT JOIN c_keys USING (conv_id)""",
        "decompose_questions": _decomposed(),
        "chunk_windows": _with("SELECT chunk_id, seq::INTEGER AS seq, length(text)::INTEGER AS chars, md5(text) AS digest FROM chunks"),
        "token_estimate": f"SELECT doc_id, {tokens} AS tokens FROM documents",
        "invalidation_cost": f"SELECT source AS base, doc_id AS pos, sum({tokens}) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS cost FROM documents WHERE doc_id % 3 <> 0",
        "broken_refs": "SELECT l_partkey, count(*) AS refs FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 17 <> 0) GROUP BY 1",
        "orphan_records": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
        "check_findings": f"""
WITH {LINKED}, records AS (SELECT DISTINCT base, 'r' || (doc_id % 40) AS key, CASE WHEN doc_id % 40 = 7 THEN 'r8' END AS replaces FROM n UNION SELECT DISTINCT base, 'u' || (doc_id % 3), NULL FROM n),
later AS (SELECT base, replaces AS key, min(key) AS by_ FROM records WHERE replaces IS NOT NULL GROUP BY 1, 2), cited AS (SELECT base, rel, line, 'r' || (doc_id % 60) AS key FROM n),
found AS (
  SELECT base, rel, 'E01' AS code, 'no note ' || dst AS message, line FROM (SELECT base, rel, line, unnest([doc_id + 1, doc_id * 2])::VARCHAR AS dst FROM n) l ANTI JOIN (SELECT base, stem AS dst FROM n) USING (base, dst)
  UNION ALL SELECT base, rel, 'E05', 'no record ' || key, line FROM cited ANTI JOIN records USING (base, key)
  UNION ALL SELECT base, rel, 'W09', key || ' is replaced by ' || by_, line FROM cited JOIN later USING (base, key)
  UNION ALL SELECT base, 'records', 'E06', key || ' is not cited', NULL FROM (SELECT DISTINCT base, key FROM records) ANTI JOIN cited USING (base, key) ANTI JOIN later USING (base, key))
SELECT base, rel, code, message, coalesce(string_agg(DISTINCT line::VARCHAR, ','), '') AS lines FROM found GROUP BY ALL""",
        "cross_base_references": f"WITH {LINKED} SELECT m.base, m.rel, m.to_base, m.to_rel FROM (SELECT base, rel, 'src' || (doc_id % 7) AS to_base, 'knowledge/' || (doc_id + 5) || '.md' AS to_rel FROM n) m SEMI JOIN (SELECT base AS to_base, rel AS to_rel FROM n) USING (to_base, to_rel) WHERE m.base <> m.to_base",
        "note_degrees": f"""
WITH {LINKED}, e AS (SELECT DISTINCT base || '/' || stem AS src, base || '/' || unnest([doc_id + 1, doc_id * 2]) AS dst FROM n)
SELECT node, sum(o)::BIGINT AS cites, sum(i)::BIGINT AS cited_by FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1""",
        "judge_pairs": """
SELECT lang, count_if(a = b) AS agreed, count_if(a <> b) AS disagreed, count_if(b IS NULL) AS only_first, count_if(a IS NULL) AS only_second FROM
  (SELECT doc_id, lang, quality = 1 AS a FROM labels JOIN documents USING (doc_id) WHERE doc_id % 3 <> 0) FULL JOIN (SELECT doc_id, lang, toxic = 0 AS b FROM labels JOIN documents USING (doc_id) WHERE doc_id % 4 <> 0) USING (doc_id, lang) GROUP BY lang""",
        "qa_accuracy": "SELECT lang, count(*) AS n, round(avg((quality = 1)::INT::DOUBLE), 6) AS accuracy FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL AND quality IS NOT NULL GROUP BY ROLLUP (lang)",
        "superseded_refs": "SELECT l_orderkey AS key, replaced_by, count(*) AS refs FROM lineitem JOIN (SELECT o_orderkey - 1 AS replaces, min(o_orderkey) AS replaced_by FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1) ON l_orderkey = replaces GROUP BY 1, 2",
        "link_graph_degree": """
WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)
SELECT node, sum(o)::BIGINT AS cites, sum(i)::BIGINT AS cited_by FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1""",
        "dense_rank": f"WITH {dense_ranked} SELECT qid, owner, round(score, 6) AS score, rank FROM dense",
        "dense_keyword_rrf": f"WITH {dense_ranked}, {centroids} SELECT qid, owner, round(rrf, 6) AS rrf, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, owner) AS rank FROM (SELECT qid, owner, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf FROM (SELECT qid, owner, rank FROM dense UNION ALL SELECT qid, owner, rank FROM cent) GROUP BY ALL)",
        "evidence_recall": _with("""SELECT q.qid, coalesce(golds, 0) AS golds, coalesce(found, 0) AS found, CASE WHEN golds IS NULL THEN 'no gold' WHEN found = golds THEN 'full' WHEN found > 0 THEN 'partial' ELSE 'none' END AS outcome
FROM questions q LEFT JOIN (SELECT g.qid, count(*) AS golds, count(f.qid) AS found FROM gold g LEFT JOIN fused f USING (qid, base, rel) GROUP BY 1) USING (qid)"""),
        "stream_log_fold": _with("SELECT lower(question) AS key, count(*) AS count, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last FROM session_log WHERE kind = 'refused' GROUP BY 1"),
        "stream_session_owner": _with(f"{_PARTS} SELECT session, seq, kind, coalesce(last_value(agent IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(agent IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS owner FROM parts WINDOW w AS (PARTITION BY session, part ORDER BY ts, seq)"),
        "stream_sticky": _with(f"{_PARTS} SELECT session, seq, agent, agent IS DISTINCT FROM lag(agent) OVER (PARTITION BY session, part ORDER BY ts, seq) AS switched FROM parts WHERE kind = 'routed'"),
        "stream_index_sync": """
SELECT source AS base, count_if(doc_id % 7 = 0) AS reindexed, count_if(doc_id % 7 <> 0 AND doc_id % 11 <> 0) AS unchanged, count_if(doc_id % 11 = 0) AS removed
FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 11 <> 0 GROUP BY 1""",
    }
