"""Secret scans: a trigram inverted index tells which texts a rule can match, regular expressions verify them.

For every rule a Boolean query over trigrams is derived from its regular expression: strings that a
match must hold give their trigrams, alternatives give alternatives (``trigram_query``).  Postings are
a table (gram, word, bits): ``bits`` has a bit for each of the 64 ids of a word that hold the gram in
their lower-cased text.  A conjunction intersects postings with ``bit_and``, alternatives are united
with ``bit_or``, and only the texts left are held against the expression.  A rule of which no trigram
is mandatory scans every text.

Nothing but built-in functions runs.  A posting stands for an id, not for a row: rows that share an id
share its bits, and rows without an id are always verified, so every text is found by itself.

Null and empty texts have no spans; a text of any length is read whole; an empty table gives an empty
result; columns that the caller has stay, but for ``spans``, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import checkpointed

#: Strings that a part of an expression can be, and alternatives of a query, beyond which nothing is derived from it.
MOST_STRINGS, MOST_CLAUSES = 64, 64
#: Words of candidates that are broadcast; more are joined by a shuffle.
FEW_WORDS = 200_000
#: Lengths that are summed in one go; more are summed block by block.
BLOCK = 128


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters or more.

    Matches are leftmost and do not overlap; one that is too short still uses up its characters.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),  # the greedy runs of 24 or more
)
#: Public formats of keys and tokens.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE

Clauses = frozenset  # of conjunctions, each a frozenset of trigrams; {frozenset()} asks for nothing
ANYTHING: Clauses = frozenset([frozenset()])


def _least(clauses) -> Clauses:
    """Without conjunctions that a weaker one makes superfluous."""
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(other < c for other in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > MOST_CLAUSES:  # either alone is a weaker query, and still one that every match meets
        return min(a, b, key=len)
    return _least(x | y for x, y in product(a, b))


def _of_strings(strings: set[str]) -> Clauses:
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _characters(items) -> set[str] | None:
    """The lower-cased characters of a class, or None if they are too many or not all ASCII."""
    out: set[str] = set()
    for kind, value in items:
        low, high = (value, value) if kind is op.LITERAL else value if kind is op.RANGE else (0, 255)
        if high > 127 or high - low > MOST_STRINGS:
            return None
        out |= {chr(c).lower() for c in range(low, high + 1)}
    return out


def _node(kind, value) -> tuple[set[str] | None, Clauses]:
    """(strings, query) of one part: all it can be, if they are few, and what its matches hold."""
    if kind is op.LITERAL:
        return ({chr(value).lower()} if value < 128 else None), ANYTHING
    if kind is op.IN:
        return _characters(value), ANYTHING
    if kind is op.AT:
        return {""}, ANYTHING
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), ANYTHING
        found = _least(c for s, q in parts for c in (_both(_of_strings(s), q) if s is not None else q))
        return None, found if len(found) <= MOST_CLAUSES else ANYTHING
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, ANYTHING
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            return {"".join(x) for x in product(strings, repeat=low)}, ANYTHING
        return None, (_both(_of_strings(strings), query) if strings is not None else query) if low else ANYTHING
    return None, ANYTHING


def _sequence(parts) -> tuple[set[str] | None, Clauses]:
    query, run, whole = ANYTHING, {""}, True
    for kind, value in parts:
        strings, asks = _node(kind, value)
        query = _both(query, asks)
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:  # what came before is a run of its own
            query, whole = _both(query, _of_strings(run)), False
            run = {""} if strings is None else strings
    return (run, query) if whole else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Clauses:
    """The conjunctions of lower-cased trigrams of which every text that matches meets one."""
    strings, query = _sequence(regex.parse(pattern))
    return query if strings is None else _both(query, _of_strings(strings))


def _id(docs: DataFrame) -> Column:
    """A number for the id: itself, or the hash of one that is no integer; null without an id."""
    x = F.col("doc_id")
    return x.cast("long") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.when(x.isNotNull(), F.xxhash64(x))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, word, bits): the ids 64 * word to 64 * word + 63 whose lower-cased text holds the gram; ``gram`` is its place in the list."""
    low = docs.select(_id(docs).alias("id"), F.lower("text").alias("low")).where(F.col("id").isNotNull())
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    rows = low.select(F.shiftright("id", 6).alias("word"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bit"), F.explode(held).alias("gram"))
    return rows.groupBy("gram", "word").agg(F.bit_or("bit").alias("bits"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame | None, list[int]]:
    """(word, c<i>, ...) with the candidate bits of each indexed rule, and the places of these rules."""
    queries = [trigram_query(r.pattern) for r in rules]
    indexed = [i for i, q in enumerate(queries) if frozenset() not in q]
    grams = sorted({g for i in indexed for clause in queries[i] for g in clause})
    if not grams:
        return None, []
    asked = [(i, c, grams.index(g), len(clause)) for i in indexed for c, clause in enumerate(sorted(queries[i], key=sorted)) for g in sorted(clause)]
    clauses = docs.sparkSession.createDataFrame(asked, "rule int, clause int, gram int, need long")
    lists = postings(docs, grams).join(F.broadcast(clauses), "gram")
    met = lists.groupBy("rule", "clause", "need", "word").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where("n = need and bits <> 0")
    united = met.groupBy("word").agg(*(F.bit_or(F.when(F.col("rule") == i, F.col("bits"))).alias(f"c{i}") for i in indexed))
    return checkpointed(united), indexed


def _running(lengths: Column) -> Column:
    """The running sums of an array, block by block so that long arrays take linear time."""
    add = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: add(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    before = add(F.transform(blocks, lambda s: F.element_at(s, -1)))
    sums = F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda s, base: F.transform(F.slice(s, 2, BLOCK), lambda x: x + base))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(F.flatten(sums))


def _spans(rule: Rule, rank: int, parts: str) -> Column:
    """Spans of a rule from ``parts``: the text cut behind each match."""
    ends = _running(F.transform(parts, lambda p: F.char_length(p)))

    def span(part: Column, end: Column) -> Column:
        found = F.regexp_extract(part, rule.pattern, 0)
        enough = F.char_length(F.regexp_extract(part, rule.pattern, rule.group)) >= rule.least
        return F.when(enough, F.struct((end - F.char_length(found)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))

    return F.array_compact(F.zip_with(parts, ends, span))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``spans``: an array of (start, rank, end, kind) by start, then by the order of the rules.

    Starts and ends count code points, the end is exclusive.
    """
    docs = docs.drop("spans")
    names = docs.columns
    found, indexed = candidates(docs.select("doc_id", "text"), rules)
    rows = docs.withColumns({"_id": _id(docs), "_text": F.coalesce("text", F.lit(""))})
    if found is not None:
        few = found.limit(FEW_WORDS + 1).count() <= FEW_WORDS
        rows = rows.withColumn("_word", F.shiftright("_id", 6))
        found = found.withColumnsRenamed({"word": "_word"} | {f"c{i}": f"_c{i}" for i in indexed})
        rows = rows.join(F.broadcast(found) if few else found, "_word", "left")
    cut = {}
    for i, rule in enumerate(rules):
        parts = F.regexp_extract_all("_text", F.lit(rf"(?s)\G.*?(?:{rule.pattern})"), F.lit(0))
        if i in indexed:
            asked = F.col("_id").isNull() | (F.getbit(F.coalesce(f"_c{i}", F.lit(0).cast("long")), (F.col("_id").bitwiseAND(63)).cast("int")) == 1)
            parts = F.when(asked, parts).otherwise(F.array().cast("array<string>"))
        cut[f"_p{i}"] = parts
    rows = rows.withColumns(cut)
    return rows.select(*names, F.array_sort(F.concat(*(_spans(rule, i, f"_p{i}") for i, rule in enumerate(rules)))).alias("spans"))


def named(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    found = with_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
