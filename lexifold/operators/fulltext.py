"""BM25 over chunks with statistics of each base, and the round robin over bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import counted, fulltext_tokens
from ..sources.stages import few, is_few, stored, written

#: BM25 parameters and column weights: fixed values.
K1, B, W_HEADING, W_TEXT, IDF_FLOOR = 1.2, 0.75, 2.0, 1.0, 1e-6
#: From this many chunks of a base on, terms that over a quarter of them hold are pruned.
PRUNE_CHUNKS = 10_000
OVERSAMPLE = 6


def postings(chunks: DataFrame, wanted: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """(base, term, chunk_id, rel, private, length, tf): weighted term frequencies; only of ``wanted`` (term) where given.

    A chunk's tokens are counted inside its row.  With ``unique`` no chunk comes twice, and nothing is
    shuffled; its postings stay together.  What else is known of a chunk rides along, so that no join has
    to fetch it.
    """
    private = F.col("private") if "private" in chunks.columns else F.lit(False)
    known = ("base", "rel", "chunk_id", "private", "length")
    split = chunks.select("base", "rel", "chunk_id", private.alias("private"), fulltext_tokens(F.col("heading")).alias("_h"), fulltext_tokens(F.col("text")).alias("_t"))
    split = split.withColumn("length", F.size("_h") + F.size("_t"))
    every = F.concat(*["_h"] * int(W_HEADING / W_TEXT), "_t")  # a token of the heading counts as several
    posts = split.select(*known, F.explode(counted(every)).alias("t")).select("t.term", *known, (F.col("t.n") * W_TEXT).alias("tf"))
    if wanted is not None:
        posts = posts.join(few(wanted.select("term").distinct()), "term", "left_semi")
    return posts if unique else posts.groupBy("term", *known).agg(F.sum("tf").alias("tf"))


def _lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("base", "rel", "chunk_id", (F.size(fulltext_tokens(F.col("heading"))) + F.size(fulltext_tokens(F.col("text")))).alias("length"))


def base_statistics(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, chunk_id, length) and (base, n_chunks, mean_length), over all tokens of all chunks."""
    length = _lengths(chunks).drop("rel")
    return length, length.groupBy("base").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("length").alias("mean_length"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("base", "term").agg(F.count(F.lit(1)).alias("df"))


def pruned(asked: DataFrame, df: DataFrame, bases: DataFrame, least: int = PRUNE_CHUNKS) -> DataFrame:
    """(qid, base, term): terms that take part, with the terms over the ceiling left out in large bases.

    Where nothing would be left of a question in a base, all its terms stay.
    """
    terms = asked.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    seen = terms.join(df, "term").join(bases.select("base", "n_chunks"), "base")
    ok = (F.col("n_chunks") < least) | (F.col("df") <= F.expr("n_chunks div 4"))
    some = F.max(ok.cast("int")).over(Window.partitionBy("qid", "base"))
    return seen.withColumn("_ok", ok).withColumn("_some", some).where("_ok or _some = 0").select("qid", "base", "term", "df", "n_chunks")


def search(asked: DataFrame, chunks: DataFrame, top: int = 10 * OVERSAMPLE, public: bool = True, prune_from: int = PRUNE_CHUNKS) -> DataFrame:
    """(qid, base, rel, chunk_id, bm25, base_rank): the best chunks of each base (Q2).

    ``asked`` is (qid, terms).  Statistics are over all chunks of a base; with ``public``, private
    ones are not found.  Larger scores are better.
    """
    place = F.count_distinct(F.struct("rel", "chunk_id"))
    bases = written(_lengths(chunks).groupBy("base").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("length").alias("mean_length"), place.alias("_places")))
    unique = bases.where("n_chunks <> _places").isEmpty()
    posts = stored(postings(chunks, asked.select(F.explode("terms").alias("term")), unique))
    return scored(asked, posts, bases.drop("_places"), top, public, prune_from)


def scored(asked: DataFrame, posts: DataFrame, bases: DataFrame, top: int = 10 * OVERSAMPLE, public: bool = True, prune_from: int = PRUNE_CHUNKS) -> DataFrame:
    """As ``search``, from postings of the asked terms and the (base, n_chunks, mean_length) of all chunks.

    Only postings are shuffled, by base and parts of it of about one size; questions come to them.  So the
    scores of a chunk are summed where its postings are, and a part passes on its best chunks alone.
    """
    bases = written(bases)
    terms = pruned(asked, document_frequency(posts), bases, prune_from)
    n, df = F.col("n_chunks").cast("double"), F.col("df")
    raw = F.log((n - df + 0.5) / (df + 0.5))
    weight = F.when(raw <= 0, IDF_FLOOR).otherwise(raw)
    weights = written(terms.withColumn("idf", weight).join(bases.select("base", "mean_length"), "base").select("qid", "base", "term", "idf", "mean_length"))
    posts, place = posts.where("not private") if public else posts, ["base", "rel", "chunk_id"]
    if is_few(weights):
        tasks = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        whole = bases.agg(F.sum("n_chunks").alias("_all"))
        parts = bases.crossJoin(F.broadcast(whole)).select("base", F.ceil(F.col("n_chunks") * tasks / F.col("_all")).alias("_parts"))
        posts = posts.join(few(parts), "base").withColumn("_part", F.pmod(F.xxhash64("rel"), "_parts")).drop("_parts").repartition("base", "_part")
        weights, place = F.broadcast(weights), [*place, "_part"]
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    hits = posts.join(weights, ["base", "term"]).groupBy("qid", *place).agg(F.round(F.sum(part), 9).alias("bm25")).select("qid", "base", "rel", "chunk_id", "bm25")
    rank = F.row_number().over(Window.partitionBy("qid", "base").orderBy(F.desc("bm25"), "chunk_id"))
    return hits.withColumn("base_rank", rank).where(F.col("base_rank") <= top)


def round_robin(hits: DataFrame, limit: int = 10 * OVERSAMPLE) -> DataFrame:
    """``hits`` with ``rank``: the first of every base, then the second, up to ``limit``.

    Scores of different bases do not compare, ranks do.
    """
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("base_rank", "base"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit)
