"""The registered queries for the retrieval operators, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsers
from ..functions.text import fulltext_tokens, idf, normalise, round6
from ..operators import analytics, ask, dense, fulltext, index, keyword, logs, quality, suggest
from ..sources import corpus
from ..sources.corpus import read
from ..sources.stages import spread, stored, written
from ..streaming import jobs as streams
from . import notes, oracles

Query = Callable[[SparkSession, str], DataFrame]

#: (pos, alias, canonical): one alias of one word, one of two, and one that nothing matches.
ALIASES = [(0, "that", "worthless onthsh"), (1, "hein ti", "tisher"), (2, "unheard", "nothing")]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_entries(_documents(spark, sf_dir).select("doc_id", "source", "text"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_chunks(_documents(spark, sf_dir).select("doc_id", "source", "text"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.questions(read(spark, sf_dir, "benchmark"))


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "pos int, alias string, canonical string")


def _n_entries(spark: SparkSession, sf_dir: str) -> int:
    return _documents(spark, sf_dir).count()


def _asked(spark: SparkSession, sf_dir: str, questions: DataFrame | None = None, text: bool = True) -> dict:
    """Both rankings, written once since several results read them."""
    questions = _questions(spark, sf_dir) if questions is None else questions
    entries = stored(_entries(spark, sf_dir))
    asked = keyword.question_terms(questions, _aliases(spark))
    n = _n_entries(spark, sf_dir)
    out = {"questions": questions, "asked": asked, "entries": entries, "n": n, "keyword": written(keyword.route(asked, entries, n))}
    if text:
        out["text"] = written(fulltext.round_robin(fulltext.search(asked, _chunks(spark, sf_dir))))
    return out


def normalise_tokens(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", normalise(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


def mechanical_keys(spark, sf_dir):
    return corpus.mechanical_keys(_documents(spark, sf_dir)).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


def entry_classification(spark, sf_dir):
    named = _documents(spark, sf_dir).select("doc_id", quality.document_paths(F.col("doc_id")).alias("rel"), (F.char_length("text") > 400).alias("has_keys"))
    return named.select("doc_id", "rel", quality.classify(F.col("rel"), F.col("has_keys")).alias("class"), corpus.kind(F.col("rel")).alias("kind"), corpus.layer(F.col("rel")).alias("layer"))


def keyword_idf(spark, sf_dir):
    df = keyword.document_frequency(keyword.entry_terms(_entries(spark, sf_dir)))
    return df.withColumn("idf", round6(idf(F.col("df"), _n_entries(spark, sf_dir))))


def alias_expand(spark, sf_dir):
    return keyword.question_terms(_questions(spark, sf_dir), _aliases(spark)).select("qid", F.array_join("terms", " ").alias("terms"))


def keyword_route(spark, sf_dir):
    hits = _asked(spark, sf_dir, text=False)["keyword"]
    return hits.select("qid", "base", "rel", round6(F.col("score")).alias("score"), F.array_join("matched", "|").alias("matched"), "rank")


def postings_df(spark, sf_dir):
    return fulltext.document_frequency(fulltext.postings(_chunks(spark, sf_dir)))


def prune_terms(spark, sf_dir):
    asked = keyword.question_terms(_questions(spark, sf_dir))
    chunks = _chunks(spark, sf_dir)
    df = fulltext.document_frequency(fulltext.postings(chunks, asked.select(F.explode("terms").alias("term"))))
    return fulltext.pruned(asked, df, fulltext.base_statistics(chunks)[1], least=10).select("qid", "base", "term", "df")


def bm25_search(spark, sf_dir):
    hits = fulltext.search(keyword.question_terms(_questions(spark, sf_dir), _aliases(spark)), _chunks(spark, sf_dir))
    return hits.select("qid", "base", "rel", "chunk_id", round6(F.col("bm25")).alias("bm25"), "base_rank")


def round_robin_merge(spark, sf_dir):
    hits = fulltext.round_robin(fulltext.search(keyword.question_terms(_questions(spark, sf_dir), _aliases(spark)), _chunks(spark, sf_dir)))
    return hits.select("qid", "rank", "base", "chunk_id")


def rrf_fuse(spark, sf_dir):
    parts = _asked(spark, sf_dir)
    fused = ask.fuse(parts["keyword"], parts["text"])
    return fused.select("qid", "rank", "base", "rel", round6(F.col("rrf")).alias("rrf"), F.coalesce("keyword_rank", F.lit(0)).alias("keyword_rank"), F.coalesce("text_rank", F.lit(0)).alias("text_rank"), "passages")


def _verdict_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({c: round6(F.col(c)) for c in ("keyword_score", "margin", "floor")})


def confidence_verdict(spark, sf_dir):
    parts = _asked(spark, sf_dir)
    return _verdict_columns(ask.verdicts(parts["questions"], parts["keyword"], parts["text"], parts["n"]))


def species_fold(spark, sf_dir):
    return ask.choose_agents(_asked(spark, sf_dir, text=False)["keyword"]).withColumns({c: round6(F.col(c)) for c in ("agent_score", "agent_margin")})


def species_pivot(spark, sf_dir):
    bests = ask.species_bests(_asked(spark, sf_dir, text=False)["keyword"].where("rank <= 20"))
    return bests.groupBy("qid", "base").pivot("kind", ["memory", "skills", "tools"]).agg(F.max("best")).select("qid", "base", *(round6(F.col(c)).alias(c) for c in ("memory", "skills", "tools")))


def ask_query(spark, sf_dir):
    parts = _asked(spark, sf_dir)
    out = _verdict_columns(ask.answers(parts["questions"], parts))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("files", "contenders")}
    return out.withColumns({c: round6(F.col(c)) for c in ("agent_score", "agent_margin")} | counts)


def suggest_terms(spark, sf_dir):
    found = suggest.suggest(_questions(spark, sf_dir), _entries(spark, sf_dir))
    return found.withColumn("likeness", round6(F.col("likeness")))


def near_misses(spark, sf_dir):
    parts = _asked(spark, sf_dir)
    missed = suggest.near_misses(ask.fuse(parts["keyword"], parts["text"]), parts["keyword"], parts["entries"], ask.floor_for(parts["n"]))
    return missed.select("qid", "rank", "base", "rel", round6(F.col("keyword_score")).alias("keyword_score"), F.size("keys").alias("keys"))


def shortfall(spark, sf_dir):
    parts = _asked(spark, sf_dir)
    judged = ask.verdicts(parts["questions"], parts["keyword"], parts["text"], parts["n"])
    return suggest.shortfalls(judged, parts["n"], 0).select("qid", F.array_join("causes", "; ").alias("causes"))


def remember_claims(spark, sf_dir):
    asked, chunks = keyword.question_terms(_questions(spark, sf_dir), _aliases(spark)), _chunks(spark, sf_dir)
    ranked = fulltext.round_robin(fulltext.search(asked, chunks, suggest.EVIDENCE_WIDTH), suggest.EVIDENCE_WIDTH)
    found = suggest.remember(asked, ranked, chunks)
    return found.select("qid", "outcome", round6(F.col("containment")).alias("containment"), F.array_join("shared", " ").alias("shared"), F.array_join("missing", " ").alias("missing"), F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"))


def list_facets(spark, sf_dir):
    notes = corpus.document_notes(_documents(spark, sf_dir).select("doc_id", "source", "text"))
    facets = notes.select("base", corpus.kind(F.col("rel")).alias("kind"), corpus.layer(F.col("rel")).alias("layer"), "private", F.octet_length("text").alias("bytes"))
    return quality.list_notes(facets, private=False).groupBy("base", "kind", "layer").agg(F.count(F.lit(1)).alias("notes"), F.sum("bytes").cast("long").alias("bytes"))


def incremental_sync_report(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", F.col("source").alias("base"), F.col("doc_id").cast("string").alias("rel"), "text")
    old = docs.where("doc_id % 7 <> 0")
    new = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    return index.report(index.changes(index.hashed(old), index.hashed(new)))


def _graded(spark, sf_dir) -> DataFrame:
    parts = _asked(spark, sf_dir)
    notes = corpus.document_notes(_documents(spark, sf_dir).select("doc_id", "source", "text"))
    gold = analytics.gold_by_passage(parts["questions"], notes)
    return analytics.graded(ask.answers(parts["questions"], parts), ask.fuse(parts["keyword"], parts["text"]), gold)


def eval_summary(spark, sf_dir):
    return analytics.summary(_graded(spark, sf_dir))


def best_fixed_agent(spark, sf_dir):
    return analytics.best_fixed_agent(_graded(spark, sf_dir))


def score_separation(spark, sf_dir):
    out = analytics.separation(_graded(spark, sf_dir))
    return out.withColumns({c: round6(F.col(c)) for c in ("lowest_hit", "highest_miss")})


def triad_scores(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    by = Window.partitionBy("conv_id").orderBy("turn")
    before = turns.withColumns({"question": F.lag("text").over(by), "asker": F.lag("role").over(by), "context": F.array(F.lag("text", 2).over(by), F.lag("text", 1).over(by))})
    rows = before.where("role = 'assistant' and asker = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "question", F.array_compact("context").alias("context"), F.col("text").alias("answer"))
    return analytics.triad(rows)


def _labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Questions as they are (in-scope), with reversed words (near-oos) and with reversed letters (noise)."""
    asked = _questions(spark, sf_dir)
    reversed_words = F.array_join(F.transform(F.split("question", " "), F.reverse), " ")
    every = asked.withColumn("label", F.lit("in-scope")).unionByName(asked.select((F.col("qid") + 1_000_000).alias("qid"), F.array_join(F.slice(F.reverse(F.split("question", " ")), 1, 3), " ").alias("question"), F.lit("near-oos").alias("label")))
    every = every.unionByName(asked.select((F.col("qid") + 2_000_000).alias("qid"), reversed_words.alias("question"), F.lit("noise").alias("label")))
    return every.select("qid", "question"), every.select("qid", "label")


def abstention_matrix(spark, sf_dir):
    questions, labels = _labelled(spark, sf_dir)
    parts = _asked(spark, sf_dir, questions, text=False)
    nothing = parts["keyword"].select("qid", "base", "rel").limit(0)
    return analytics.abstention_matrix(ask.verdicts(questions, parts["keyword"], nothing, parts["n"]), labels)


def _judges(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("first"), (F.col("toxic") == 0).alias("second"))


def judge_agreement(spark, sf_dir):
    return analytics.judge_agreement(_judges(spark, sf_dir))


def judge_by_group(spark, sf_dir):
    return analytics.judge_agreement(_judges(spark, sf_dir).join(_documents(spark, sf_dir).select("doc_id", "lang"), "doc_id"), ["lang"])


def alias_gate(spark, sf_dir):
    """Whether an alias may be let in: hits before and after, and admitted if no count gets worse (Q13)."""
    questions = _questions(spark, sf_dir)
    n, entries = _n_entries(spark, sf_dir), written(_entries(spark, sf_dir))
    gold = written(analytics.gold_by_passage(questions, corpus.document_notes(_documents(spark, sf_dir).select("doc_id", "source", "text"))))

    owners, files = gold.select("qid", "base").distinct().withColumn("agent", F.lit(1)), gold.withColumn("file", F.lit(1))

    def hits(aliases: DataFrame | None, when: str) -> DataFrame:
        top = keyword.route(keyword.question_terms(questions, aliases), entries, n).where("rank = 1")
        return top.join(files, ["qid", "base", "rel"], "left").join(owners, ["qid", "base"], "left").select(F.lit(when).alias("when"), "file", "agent")

    both = hits(None, "before").unionByName(hits(_aliases(spark), "after"))
    counts = both.agg(*(F.count(F.when(F.col("when") == w, F.col(c))).alias(f"{c}_{w}") for w in ("before", "after") for c in ("file", "agent")))
    return counts.withColumn("admitted", (F.col("file_after") >= F.col("file_before")) & (F.col("agent_after") >= F.col("agent_before")))


def latency_percentiles(spark, sf_dir):
    return analytics.latency_percentiles(read(spark, sf_dir, "events"), "value", "event_type")


def _session_events(spark, sf_dir) -> DataFrame:
    return logs.session_events(read(spark, sf_dir, "events"))


def session_owner_asof(spark, sf_dir):
    return logs.owners(_session_events(spark, sf_dir)).select("session", "seq", "kind", "owner")


def session_routes(spark, sf_dir):
    return logs.routes(_session_events(spark, sf_dir)).select("session", "seq", "agent")


def counted_log_fold(spark, sf_dir):
    asked = _session_events(spark, sf_dir).where("kind = 'refused'").withColumn("key", F.lower("question"))
    return logs.counted(asked, ["key"], "ts", "question", "seq").withColumns({"first": F.date_format("first", "yyyy-MM-dd"), "last": F.date_format("last", "yyyy-MM-dd")})


def session_deposit(spark, sf_dir):
    return logs.deposits(_session_events(spark, sf_dir))


def panel_ledger(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    state = F.element_at(F.array(*map(F.lit, ("pending", "objected", "approved", "resolved"))), (F.col("event_id") % 4 + 1).cast("int"))
    rounds = events.select((F.col("user_id") % 40).alias("artifact"), F.col("event_type").alias("reviewer"), F.col("event_id").alias("seq"), state.alias("state"), (F.col("value") > 20).alias("blocking"))
    return logs.ledger(rounds)


def handoff_state(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    action = F.when(F.col("event_id") % 97 == 0, "complete").when(F.col("event_id") % 13 == 0, "claim").otherwise("save")
    steps = events.select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), action.alias("action"), F.col("event_type").alias("agent"))
    return logs.handoffs(steps).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


def conversation_notes(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    notes = parsers.conversation_notes(turns)
    keys = corpus.mechanical_keys(notes, "conv_id", 12)
    return notes.join(keys, "conv_id", "left").select("conv_id", "turns", F.md5("text").alias("digest"), F.array_join("keywords", "|").alias("keywords"))


def decompose_questions(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", F.posexplode(parsers.decompose(F.col("text"))).alias("pos", "part"))


def redact_secrets(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    clean = parsers.redact(F.col("text"))
    return docs.select("doc_id", F.regexp_count(clean, F.lit(r"\[REDACTED_[A-Z]+\]")).alias("redacted"), F.md5(clean).alias("digest"))


def chunk_windows(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", "seq", F.char_length("text").alias("chars"), F.md5("text").alias("digest"))


def html_extract(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", parsers.html_title(F.col("html")).alias("title"), F.md5(parsers.html_text(F.col("html"))).alias("digest"), F.char_length(parsers.html_text(F.col("html"))).alias("chars"))


def token_estimate(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", parsers.token_estimate(F.octet_length("text"), F.lit(0)).alias("tokens"))


def invalidation_cost(spark, sf_dir):
    blocks = _documents(spark, sf_dir).select(F.col("source").alias("base"), F.col("doc_id").alias("pos"), parsers.token_estimate(F.octet_length("text"), F.lit(0)).alias("tokens"), (F.col("doc_id") % 3 != 0).alias("resident"))
    return parsers.invalidation_cost(blocks)


def broken_refs(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return quality.broken(lines, read(spark, sf_dir, "part").where("p_partkey % 17 <> 0").select("p_partkey"), "l_partkey", "p_partkey").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("refs"))


def orphan_records(spark, sf_dir):
    """Customers none of whose orders is still in part open."""
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def superseded_refs(spark, sf_dir):
    records = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderkey") - 1).alias("replaces"))
    cited = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return quality.superseded(cited, records)


def _linked_notes(spark, sf_dir) -> DataFrame:
    """Documents as notes, each with lines of its own behind its text: a fence with a link inside, links, a citation, a path."""
    notes = corpus.document_notes(_documents(spark, sf_dir).select("doc_id", "source", "text"))
    made = F.format_string("\n```\n[[hidden]]\n```\n[[%d]] `[[code]]` [[%d|twice]] [src:r%d] see src%d/knowledge/%d.md", F.col("doc_id") + 1, F.col("doc_id") * 2, F.col("doc_id") % 60, F.col("doc_id") % 7, F.col("doc_id") + 5)
    return notes.withColumn("text", F.concat("text", made))


def _records(spark, sf_dir) -> DataFrame:
    """Records of each base: cited ones, one that replaces another, and some that nobody cites."""
    docs = _documents(spark, sf_dir).where("source is not null").select(F.col("source").alias("base"), "doc_id")
    cited = docs.select("base", F.concat(F.lit("r"), F.col("doc_id") % 40).alias("key"), F.when(F.col("doc_id") % 40 == 7, F.lit("r8")).alias("replaces"))
    return cited.unionByName(docs.select("base", F.concat(F.lit("u"), F.col("doc_id") % 3).alias("key"), F.lit(None).cast("string").alias("replaces"))).distinct()


def check_findings(spark, sf_dir):
    found = quality.findings(_linked_notes(spark, sf_dir), _records(spark, sf_dir))
    return found.withColumn("lines", F.array_join("lines", ","))


def cross_base_references(spark, sf_dir):
    return quality.cross_references(_linked_notes(spark, sf_dir))


def note_degrees(spark, sf_dir):
    """Links between notes, each node with its base; broken links count as nodes too."""
    edges = quality.note_links(_linked_notes(spark, sf_dir))
    named = lambda c: F.concat_ws("/", "base", c)
    return quality.degrees(edges.select(named("src").alias("src"), named("dst").alias("dst")))


def judge_pairs(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").join(_documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    first = labels.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), "lang", (F.col("quality") == 1).alias("yes"))
    return analytics.judge_pairs(first, labels.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), "lang", (F.col("toxic") == 0).alias("yes")), ["lang"])


def qa_accuracy(spark, sf_dir):
    answers = read(spark, sf_dir, "labels").join(_documents(spark, sf_dir).select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 1).alias("right"))
    return analytics.accuracy(answers, "lang").withColumn("accuracy", round6(F.col("accuracy")))


def link_graph_degree(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return quality.degrees(edges)


def dense_rank(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return dense.best_owners(vectors.where("vec_id % 50 = 0"), vectors).withColumn("score", round6(F.col("score")))


def dense_keyword_rrf(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    ranked = dense.best_owners(vectors.where("vec_id % 50 = 0"), vectors)
    other = dense.centroid_owners(vectors.where("vec_id % 50 = 0"), vectors)
    return dense.fuse_owners(ranked, other).withColumn("rrf", round6(F.col("rrf")))


def evidence_recall(spark, sf_dir):
    parts = _asked(spark, sf_dir)
    notes = corpus.document_notes(_documents(spark, sf_dir).select("doc_id", "source", "text"))
    gold = analytics.gold_by_passage(parts["questions"], notes)
    return analytics.evidence(parts["questions"], ask.fuse(parts["keyword"], parts["text"]), gold)


def stream_log_fold(spark, sf_dir):
    return streams.log_fold(spark, sf_dir)


def stream_session_owner(spark, sf_dir):
    return streams.session_owner(spark, sf_dir)


def stream_sticky(spark, sf_dir):
    return streams.sticky(spark, sf_dir)


def stream_index_sync(spark, sf_dir):
    return streams.index_sync(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "ask": ask_query,
    **{f.__name__: f for f in (
        normalise_tokens, mechanical_keys, entry_classification, keyword_idf, alias_expand, keyword_route, postings_df, prune_terms,
        bm25_search, round_robin_merge, rrf_fuse, confidence_verdict, species_fold, species_pivot, suggest_terms, near_misses, shortfall,
        remember_claims, list_facets, incremental_sync_report, eval_summary, best_fixed_agent, score_separation, triad_scores,
        abstention_matrix, judge_agreement, judge_by_group, alias_gate, latency_percentiles, session_owner_asof, session_routes,
        counted_log_fold, session_deposit, panel_ledger, handoff_state, conversation_notes, decompose_questions, redact_secrets,
        chunk_windows, html_extract, token_estimate, invalidation_cost, broken_refs, orphan_records, superseded_refs, link_graph_degree,
        check_findings, cross_base_references, note_degrees, judge_pairs, qa_accuracy,
        dense_rank, dense_keyword_rrf, evidence_recall, stream_log_fold, stream_session_owner, stream_sticky, stream_index_sync,
    )},
}


def queries() -> dict[str, Query]:
    from . import admission, files, library, reading  # they are built from the queries above

    return QUERIES | notes.QUERIES | library.QUERIES | reading.QUERIES | files.QUERIES | admission.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import admission, files, library, reading

    return {k: v for k, v in oracles.oracle_sql().items() if k in QUERIES} | notes.oracle_sql() | library.oracle_sql() | reading.oracle_sql() | files.oracle_sql() | admission.oracle_sql()
