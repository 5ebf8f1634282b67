"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, fingerprints, language_id, line_dedup, mixing, neighbours, secrets, sharding, simhash, toxicity, url_filter, whitening
from .common import checkpointed, table



def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.with_kept_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE s.keeper <> k.doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE s.keeper IS NULL OR s.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s USING (key)
GROUP BY k.doc_id
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), parts AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
)
SELECT p.page_id, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
       coalesce(max_by(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM parts p LEFT JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY p.n, p.page_id, p.host, p.path
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query_components(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = checkpointed(docs.select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("n_tokens")))
    dealt = mixing.with_copies(sized, entropy=0.95, repeat=2.0, tokens=F.col("n_tokens"))
    return dealt.select("doc_id", "source", "n_tokens", "weight", "copies")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(table(spark, sf_dir, "embeddings"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: (rank, kind, pattern, group, least) of the scan, spelt out for the oracle.
_OP12_RULES = (
    (0, "assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (1, "access", "AKIA[A-Z0-9]+", 0, 20),
    (2, "hex", "[0-9a-f]+", 0, 24),
    (3, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    (4, "github", "gh[pousr]_[A-Za-z0-9]{36}", 0, 0),
    (5, "slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    (6, "google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    (7, "jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
)
_OP12_FOUND = " UNION ALL ".join(
    f"""SELECT n, {rank} AS rank, '{kind}' AS kind, pos, part, length(regexp_extract(part, '{pattern}', 0)) AS size, length(regexp_extract(part, '{pattern}', {group})) >= {least} AS enough
        FROM (SELECT n, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM (SELECT n, regexp_extract_all(text, '(?s).*?(?:{pattern})') AS parts FROM docs))"""
    for rank, kind, pattern, group, least in _OP12_RULES
)
OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_OP12_FOUND}),
placed AS (SELECT n, rank, kind, size, enough, sum(length(part)) OVER (PARTITION BY n, rank ORDER BY pos) AS stop FROM found),
spans AS (SELECT n, rank, kind, stop - size AS start, concat_ws(':', kind, (stop - size)::BIGINT, stop::BIGINT) AS said FROM placed WHERE enough)
SELECT d.doc_id, count(s.n) FILTER (WHERE kind = 'assign') AS n_assign, count(s.n) FILTER (WHERE kind = 'access') AS n_access, count(s.n) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(said, ',' ORDER BY start, rank) FILTER (WHERE rank <= 2), '')) AS base_sha256,
       coalesce(string_agg(said, ',' ORDER BY start, rank), '') AS spans
FROM docs d LEFT JOIN spans s ON d.n = s.n GROUP BY d.n, d.doc_id
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), sizes(k) AS (VALUES (1), (2), (3), (4), (5)),
grams AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM pieces, sizes WHERE len(ws) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND f >= 100),
hidden AS (
  SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN candidates d
  ON c.lang = d.lang AND d.size > c.size AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')
), cuts AS (
  SELECT c.lang, c.phrase, c.a, i AS k, array_to_string(c.w[1:i], ' ') AS first, array_to_string(c.w[i + 1:], ' ') AS rest
  FROM candidates c ANTI JOIN hidden h ON c.lang = h.lang AND c.phrase = h.phrase, range(1, 5) t(i) WHERE i < c.size
), scored AS (
  SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * x.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts x JOIN counts l ON l.lang = x.lang AND l.phrase = x.first JOIN counts r ON r.lang = x.lang AND r.phrase = x.rest JOIN totals t ON t.lang = x.lang
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst QUALIFY rank <= 2000
"""


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_url_filters": op3_url_filters,
        "op4_sharding": op4_sharding,
        "op5_simhash": op5_simhash,
        "op6_language_id": op6_language_id,
        "op7_mixing": op7_mixing,
        "op8_neighbours": op8_neighbours,
        "op9_fingerprints": op9_fingerprints,
        "op10_bpe": op10_bpe,
        "op11_whitening": op11_whitening,
        "op12_secrets": op12_secrets,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op3_url_filters": OP3_SQL, "op12_secrets": OP12_SQL, "op13_collocations": OP13_SQL}
