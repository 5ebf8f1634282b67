"""Texts of ``key = value`` lines: settings of a base, aliases, source records and how they are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a source record may say, its keys, and the words for how far it was read: fixed values.
KEY = "^[23456789ABCDEFGHIJKLMNPQRSTUVWXYZ]{10}$"
TYPES = ("book", "chapter", "article", "report", "webpage", "recording")
STATUS = {"full": "read in full", "partial": "read in part", "metadata": "catalogue record only, not read", "unreachable": "could not be reached"}
CSL_TYPES = {"book": "book", "chapter": "chapter", "article": "article-journal", "report": "report", "recording": "motion_picture", "webpage": "webpage"}
CSL_FIELDS = {"container": "container-title", "volume": "volume", "pages": "page", "publisher": "publisher", "url": "URL", "doi": "DOI", "isbn": "ISBN", "lang": "language", "note": "note"}
ONCE = ("type", "title", "year", "container", "volume", "pages", "publisher", "url", "doi", "isbn", "lang", "retrieved_on", "retrieval_status", "replaces", "note")
#: Private folders of a base that declares none, and the base that is private as a whole: fixed values.
PRIVATE, PERSON = ("profile", "projects", "records"), "person"


def pairs(text: Column, comments: str = "anywhere") -> Column:
    """The (key, value) pairs of a text in the order of its lines; a line without ``=`` or with an empty key is none.

    Comments start at a ``#`` anywhere, or with ``comments="lines"`` only at the start of a line.  Values may be empty.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), lambda s: F.trim(F.regexp_replace(s, "#.*$" if comments == "anywhere" else r"^\s*#.*$", "")))
    found = F.transform(F.filter(lines, lambda s: F.contains(s, F.lit("="))), lambda s: F.struct(F.trim(F.substring_index(s, "=", 1)).alias("key"), F.trim(F.regexp_replace(s, "^[^=]*=", "")).alias("value")))
    return F.filter(found, lambda p: p["key"] != "")


def values(found: Column, key: str) -> Column:
    """All values of a key that are not empty, in order."""
    return F.transform(F.filter(found, lambda p: (p["key"] == key) & (p["value"] != "")), lambda p: p["value"])


def first(found: Column, key: str) -> Column:
    return F.try_element_at(values(found, key), F.lit(1))


def last(found: Column, key: str) -> Column:
    return F.try_element_at(values(found, key), F.lit(-1))


def fleets(texts: DataFrame) -> DataFrame:
    """(root, attach, disable, classifier) of manifests (root, text): lists in order, the last classifier (S3)."""
    p = pairs(F.col("text"))
    return texts.select("root", values(p, "attach").alias("attach"), values(p, "disable").alias("disable"), last(p, "classifier").alias("classifier"))


def bases(texts: DataFrame) -> DataFrame:
    """(base, name, role, ends, whole, private) of manifests (base, text), null where there is none.

    The last name, role and ends count, the first ``private``; a base without a name is called after its
    folder.  ``private = .`` makes it private as a whole, a list names folders, an empty one none.
    """
    p = pairs(F.col("text"))
    said = F.try_element_at(F.filter(p, lambda x: x["key"] == "private"), F.lit(1))["value"]
    folders = F.filter(F.transform(F.split(said, ","), lambda f: F.regexp_replace(F.trim(f), "/+$", "")), lambda f: f != "")
    person = F.lower("base") == PERSON
    whole = F.when(said.isNull(), person).otherwise(said == ".")
    default = F.when(person, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, PRIVATE)))
    called = F.concat(F.upper(F.substring("base", 1, 1)), F.expr("substr(base, 2)"))
    return texts.select("base", F.coalesce(last(p, "name"), called).alias("name"), last(p, "role").alias("role"), last(p, "ends").alias("ends"), whole.alias("whole"), F.when(said.isNull(), default).when(whole, F.array().cast("array<string>")).otherwise(folders).alias("private"))


def aliases(texts: DataFrame) -> DataFrame:
    """(base, pos, alias, canonical) of alias files (base, text), both sides not empty."""
    return texts.select("base", F.posexplode(F.filter(pairs(F.col("text")), lambda p: p["value"] != "")).alias("pos", "p")).select("base", "pos", F.col("p.key").alias("alias"), F.col("p.value").alias("canonical"))


def gold(lines: DataFrame) -> DataFrame:
    """(question, answers, error) of lines (value): a question, a tab, and paths parted by ``|``; ``-`` is to be declined.

    Blank lines and those that start with ``#`` go; a line without a tab has an error and no answers.
    """
    line = F.rtrim("value")
    answers = F.filter(F.transform(F.split(F.regexp_replace(line, "^[^\t]*\t", ""), r"\|"), lambda a: F.trim(a)), lambda a: a != "")
    tab = F.contains(line, F.lit("\t"))
    kept = lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    none = F.array().cast("array<string>")
    declined = F.trim(F.regexp_replace(line, "^[^\t]*\t", "")) == "-"
    return kept.select(F.trim(F.substring_index(line, "\t", 1)).alias("question"), F.when(~tab | declined, none).otherwise(answers).alias("answers"), F.when(~tab, F.lit("no tab")).alias("error"))


def sources(texts: DataFrame) -> DataFrame:
    """Source records of files (base, key, text): a column for each field, ``authors`` in order, and ``error``.

    The first of a field counts and names of fields are lower-cased; ``error`` is null for a good record, else
    the first thing that is wrong with it.
    """
    p = F.transform(pairs(F.col("text"), "lines"), lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")))
    found = texts.withColumn("_p", p).select("base", "key", *(first(F.col("_p"), c).alias(c) for c in ONCE), values(F.col("_p"), "author").alias("authors"))
    checks = (
        (~F.col("key").rlike(KEY), "no key"), (F.col("type").isNull(), "no type"), (~F.col("type").isin(*TYPES), "unknown type"),
        (F.col("retrieval_status").isNull(), "no retrieval_status"), (~F.col("retrieval_status").isin(*STATUS), "unknown retrieval_status"),
        (~F.col("replaces").rlike(KEY), "replaces no key"), (F.col("replaces") == F.col("key"), "replaces itself"),
        (F.col("title").isNull(), "no title"), (F.col("retrieved_on").isNull(), "no retrieved_on"),
    )
    return found.withColumn("error", F.coalesce(*(F.when(wrong, F.lit(said)) for wrong, said in checks)))


def bibliography_entry() -> Column:
    """The line that a record of ``sources`` renders to (P24): parts end with one full stop each."""
    said = lambda c, before="": F.when(F.col(c).isNotNull(), F.concat(F.lit(before), F.col(c)))
    held = F.when(F.col("container").isNotNull(), F.concat_ws(" ", "container", "volume"))
    place = F.nullif(F.concat_ws(", ", held, "pages"), F.lit(""))
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[F.col("retrieval_status")]
    parts = F.array_compact(F.array(
        F.when(F.size("authors") > 0, F.array_join("authors", "; ")), F.concat(F.lit('"'), "title", F.lit('"')), place,
        said("publisher"), said("year"), said("doi", "DOI "), said("isbn", "ISBN "), said("url"), F.concat(status, F.lit(", "), "retrieved_on"),
    ))
    stop = lambda s, more: F.concat(s, F.when(s.endswith("."), F.lit("")).otherwise(F.lit(".")), F.lit(more))
    return F.aggregate(parts, F.lit(""), lambda acc, x: F.when(acc == "", x).otherwise(F.concat(stop(acc, " "), x)), lambda acc: stop(acc, ""))


def date_parts(date: Column) -> Column:
    """Up to three numbers of a date; what is no number goes."""
    return F.array_compact(F.transform(F.slice(F.split(date, "-"), 1, 3), lambda p: F.trim(p).try_cast("double")))


def csl(records: DataFrame) -> DataFrame:
    """(base, key, item): good records as CSL items, one JSON object each, fields without a value left out (K6, Q11)."""
    names = F.when(F.size("authors") > 0, F.transform("authors", csl_author))
    dated = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.array(date_parts(F.col(c))).alias("date-parts")))
    kind = F.create_map(*(F.lit(x) for kv in CSL_TYPES.items() for x in kv))[F.col("type")]
    item = F.struct(
        F.col("key").alias("id"), kind.alias("type"), "title", names.alias("author"), *(F.col(c).alias(n) for c, n in CSL_FIELDS.items()),
        dated("year").alias("issued"), dated("retrieved_on").alias("accessed"), F.struct("retrieval_status", "replaces").alias("custom"),
    )
    return records.where("error is null").select("base", "key", F.to_json(item).alias("item"))


def csl_author(name: Column) -> Column:
    """Family and given name where a comma parts them, else the name as it is."""
    family, given = F.trim(F.substring_index(name, ",", 1)), F.trim(F.regexp_replace(name, "^[^,]*,?", ""))
    two = given != ""
    return F.struct(F.when(two, family).alias("family"), F.when(two, given).alias("given"), F.when(~two, name).alias("literal"))


def bibliography_line(line: Column) -> tuple[Column, Column]:
    """Key and rest of a list item that opens with a source pointer, else nulls."""
    pattern = r"^\s*[-*] \[src:([^\]]*)\](.*)$"
    return tuple(F.when(line.rlike(pattern), F.trim(F.regexp_extract(line, pattern, i))) for i in (1, 2))


def prose_sources(line: Column) -> Column:
    """Whether a line opens a paragraph of sources in prose."""
    return F.lower(line).rlike(r"^\s*(sources|fontes)(, |:)")


def first_dash(line: Column) -> Column:
    """The first en or em dash of a line that is no bibliography entry, else null."""
    found = F.regexp_extract(line, "[–—]", 0)
    return F.when(bibliography_line(line)[0].isNull() & (found != ""), found)
