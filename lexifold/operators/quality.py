"""Classification of notes, facets, references and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsers import citations, front_matter, links, note_lines

#: Files that orient a reader and are no notes: fixed values.
ORIENTATION = ("readme.md", "what-goes-here.md", "moved.md", "map.md", "agents.md", "claude.md")


def orientation(rel: Column) -> Column:
    return F.lower(F.regexp_extract(rel, r"([^/]+)$", 1)).isin(*ORIENTATION)


def classify(rel: Column, has_keys: Column) -> Column:
    """Entry, unreachable or exempt (F3): every note is one of them."""
    exempt = orientation(rel) | rel.rlike(r"^(inbox|records)/|calculation-log/")
    return F.when(exempt, "exempt").when(has_keys, "entry").otherwise("unreachable")


def document_paths(doc_id: Column) -> Column:
    """Paths of all the kinds that classification knows, from a document's id."""
    folder = F.element_at(F.array(*map(F.lit, ("", "inbox/", "records/", "skills/", "tools/x/calculation-log/", "knowledge/"))), (doc_id % 6 + 1).cast("int"))
    return F.concat(folder, F.when(doc_id % 13 == 0, "README.md").otherwise(F.concat(doc_id.cast("string"), F.lit(".md"))))


def list_notes(notes: DataFrame, **facets) -> DataFrame:
    """Notes whose columns equal all given facets; an omitted facet does not filter."""
    for name, value in facets.items():
        if name not in notes.columns:
            raise ValueError(f"no facet {name}")
        if value is not None:
            notes = notes.where(F.col(name) == value)
    return notes


def broken(refs: DataFrame, targets: DataFrame, ref: str, target: str) -> DataFrame:
    """References that lead nowhere."""
    return refs.join(targets.select(F.col(target).alias("_t")), F.col(ref) == F.col("_t"), "left_anti")


def ambiguous(targets: DataFrame, target: str) -> DataFrame:
    """Targets that several files answer to, with their number."""
    return targets.groupBy(target).agg(F.count(F.lit(1)).alias("files")).where("files > 1")


def superseded(cited: DataFrame, records: DataFrame) -> DataFrame:
    """(key, replaced_by, refs): cited records that a later one replaces."""
    later = records.where("replaces is not null").groupBy("replaces").agg(F.min("key").alias("replaced_by"))
    return cited.groupBy("key").agg(F.count(F.lit(1)).alias("refs")).join(later, F.col("key") == F.col("replaces")).select("key", "replaced_by", "refs")


def bibliography_drift(lines: DataFrame, records: DataFrame) -> DataFrame:
    """(base, key, written, rendered): bibliography lines that are not what their record renders to.

    ``lines`` has base, pos, key, written; of several lines for a key the last counts.
    """
    last = lines.groupBy("base", "key").agg(F.max_by("written", "pos").alias("written"))
    return last.join(records.select("base", "key", "rendered"), ["base", "key"]).where(~F.col("written").eqNullSafe(F.col("rendered")))


def note_links(notes: DataFrame) -> DataFrame:
    """(src, dst): wiki links between the stems of notes (base, stem, text) of one base, broken ones too."""
    return notes.select("base", F.col("stem").alias("src"), F.explode(links(F.col("text"))).alias("dst")).distinct()


def findings(notes: DataFrame, records: DataFrame) -> DataFrame:
    """(base, rel, code, message, lines): what a check of notes (base, rel, stem, text) against records (base, key, replaces) finds.

    E01 a link to no note of the base, E05 a citation of no record, E06 a record that nobody cites and
    none replaces, W09 a citation of a replaced record.  Findings of one file, code and message are one
    row with their lines in order; a record's finding has no lines.
    """
    lines = note_lines(notes)
    linked = lines.select("base", "rel", "line", F.explode(links(F.col("text"))).alias("dst"))
    cited = lines.select("base", "rel", "line", F.explode(citations(F.col("text"))).alias("key"))
    known = records.select("base", "key").distinct()
    later = records.where("replaces is not null").groupBy("base", F.col("replaces").alias("key")).agg(F.min("key").alias("by"))
    row = lambda code, message: ("base", "rel", F.lit(code).alias("code"), message.alias("message"), "line")
    e01 = linked.join(notes.select("base", F.col("stem").alias("dst")), ["base", "dst"], "left_anti").select(*row("E01", F.concat(F.lit("no note "), "dst")))
    e05 = cited.join(known, ["base", "key"], "left_anti").select(*row("E05", F.concat(F.lit("no record "), "key")))
    w09 = cited.join(later, ["base", "key"]).select(*row("W09", F.concat("key", F.lit(" is replaced by "), "by")))
    idle = known.join(cited.select("base", "key").distinct(), ["base", "key"], "left_anti").join(later, ["base", "key"], "left_anti")
    e06 = idle.withColumns({"rel": F.lit("records"), "line": F.lit(None).cast("int")}).select(*row("E06", F.concat("key", F.lit(" is not cited"))))
    found = e01.unionByName(e05).unionByName(w09).unionByName(e06)
    return found.groupBy("base", "rel", "code", "message").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def cross_references(notes: DataFrame) -> DataFrame:
    """(base, rel, to_base, to_rel): files of other bases that a note names as ``base/path.md``.

    A name is a whole run of path characters, letters of any script too, so one that is part of a longer path is none.
    """
    named = notes.select("base", "rel", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)([\w.\-]+(?:/[\w.\-]+)+\.md)\b"), 1))).alias("_path"))
    parts = named.select("base", "rel", F.substring_index("_path", "/", 1).alias("to_base"), F.regexp_replace("_path", "^[^/]*/", "").alias("to_rel"))
    files = notes.select(F.col("base").alias("to_base"), F.col("rel").alias("to_rel")).distinct()
    return parts.where("base <> to_base").join(files, ["to_base", "to_rel"], "left_semi").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, cites, cited_by): distinct neighbours in both directions.

    Edges are made distinct first; the counts are summed before they are shuffled, so a node that very
    many others cite is no hot spot.
    """
    edges = edges.select("src", "dst").distinct()
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("cites"), F.sum("i").alias("cited_by"))


def with_provenance(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """``hits`` (base, rel, ...) with provenance, stage and captured_from of their note's front matter, null where it says none.

    Only notes that were hit are parsed and shuffled; a hit without a note stays.
    """
    wanted = notes.join(hits.select("base", "rel").distinct(), ["base", "rel"], "left_semi").withColumn("_f", front_matter(F.col("text")))
    said = wanted.select("base", "rel", *(F.element_at("_f", F.lit(k)).alias(k) for k in ("provenance", "stage", "captured_from")))
    return hits.join(said, ["base", "rel"], "left")


def listing(records: DataFrame) -> DataFrame:
    """Good source records with their ``position`` in their base: newest reading first, then by key (Q11)."""
    position = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("retrieved_on"), "key"))
    return records.where("error is null").withColumn("position", position)
