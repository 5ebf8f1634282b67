"""Canonical exact digests of documents, and exact groups with byte comparison.

The canonical form of a text is NFC, case folded, NFC again, with runs of white space folded to one
space and none at the ends.  Its digest is the 128-bit XXH3 of the form's UTF-8, as 32 hex digits.
Digests are exact: two fingerprints are alike (1.0) when digest and canonical bytes agree, else not
(0.0).

``exact_groups`` groups by digest and compares bytes inside each bucket by the smallest and the
largest form in it, which is summed before the shuffle, so a bucket with a third of all rows is one
row for each task.  ``edited_fingerprints`` reads the documents in the order of their ids with one
shuffle of the text: the ids are cut at ids that occur, and the first document behind a cut is also
sent to the range before it.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions, slices

#: Places of the filter that tells which texts can be in a group of two or more; 64 places to a word.
FILTER_WORDS = 1 << 17
_NO_ID = -(1 << 63)


def canonical(text: str | None) -> str:
    """The canonical form; a null text is an empty one."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return " ".join(folded.split())


def digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = [digest(canonical(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests, "doc_id long, digest string")


def _place(digest_column):
    """A digest's place in the filter: word and bit, from its first 23 bits."""
    place = F.conv(F.substring(digest_column, 1, 6), 16, 10).cast("long") % (FILTER_WORDS * 64)
    return F.shiftright(place, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, group_id) of rows whose canonical text another row has; group_id is the smallest id.

    Rows alone in their group are left out.  Only texts whose digest may occur twice are compared:
    a filter of fixed size (``FILTER_WORDS`` words) lets all of them and a few others through.
    """
    spark = docs.sparkSession
    found = digests(docs)
    multiple = checkpointed(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("digest"))
    bits = np.zeros(FILTER_WORDS, np.int64)
    for word, value in multiple.select(*_place(F.col("digest"))).groupBy("word").agg(F.bit_or("bit")).collect():  # FILTER_WORDS rows at most
        bits[word] = value
    shared = spark.sparkContext.broadcast(bits.view(np.uint64))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = FILTER_WORDS * 64
        for batch in slices(batches):
            ids, keys, forms = [], [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                form = canonical(t)
                key = digest(form)
                at = int(key[:6], 16) % places
                if int(shared.value[at >> 6]) >> (at & 63) & 1:
                    ids.append(i)
                    keys.append(key)
                    forms.append(form)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(forms, pa.string())], ["doc_id", "digest", "form"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(candidates, "doc_id long, digest string, form string")
    buckets = rows.groupBy("digest").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n"), F.min("form").alias("low"), F.max("form").alias("high"))
    buckets = checkpointed(buckets.where("n > 1").select("digest", "group_id", (F.col("low") == F.col("high")).alias("same")))
    alike = found.join(buckets.where("same"), "digest").select("doc_id", "digest", "group_id")
    # Different texts under one digest: group by the bytes themselves.
    unlike = rows.join(buckets.where("not same").select("digest"), "digest")
    forms = unlike.groupBy("digest", "form").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return alike.unionByName(unlike.join(forms, ["digest", "form"]).select("doc_id", "digest", "group_id"))


def _cuts(docs: DataFrame, ranges: int) -> np.ndarray:
    """Ids that occur, in ascending order; a range begins at each.  The first is the smallest id."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"))
    at = F.percentile_approx("id", [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 20 * ranges))
    low, inner = ids.agg(F.min("id"), at).first()
    return np.unique(np.array([low, *inner], np.int64)) if low is not None else np.zeros(1, np.int64)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document.

    The edited text is the text with its last ``n_chars // 4`` code points replaced by the first as
    many (or all) of the next document in ascending order of ids; after the last comes the first.
    Null texts are empty; rows without an id come first; rows that share an id follow each other in
    the order of their text; a lone document is its own next.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    cuts = spark.sparkContext.broadcast(_cuts(docs, 4 * partitions))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row goes to its range; the first id of a range also to the range before, as what follows it."""
        for batch in batches:
            ids = batch.column("key").to_numpy()
            ranges = np.searchsorted(cuts.value, ids, "right").astype(np.int32) - 1
            heads = np.flatnonzero(cuts.value[ranges] == ids)
            n = len(cuts.value)
            for rows, at, ahead in ((None, ranges, False), (heads, (ranges[heads] - 1) % n, True)):
                part = batch if rows is None else batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at.astype(np.int32)), pa.array([ahead] * len(at), pa.bool_())], ["doc_id", "key", "text", "at", "ahead"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        rows: list[tuple] = []
        for batch in slices(batches):
            for doc_id, at, ahead, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "ahead", "text")), strict=True):
                form = canonical(text)
                now = (doc_id, at, ahead, text, form, digest(form))
                if before is not None and before[1] == at and not before[2]:
                    rows.append(_judge(before, now))
                before = now
            yield _batch(rows)
            rows = []

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ranged = keyed.mapInArrow(dealt, "doc_id long, key long, text string, at int, ahead boolean").repartition(partitions, "at")
    return ranged.sortWithinPartitions("at", "ahead", "key", "text").mapInArrow(judged, _JUDGED)


_JUDGED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(row: tuple, following: tuple) -> tuple:
    doc_id, _, _, text, form, key = row
    n = len(text)
    k = n // 4
    edited = text[: n - k] + following[3][:k]
    edited_form = canonical(edited)
    edited_key = digest(edited_form)
    near_edited = float(edited_key == key and edited_form == form)
    near_next = float(following[5] == key and following[4] == form)
    return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), key, edited_key, near_edited, near_next


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _JUDGED.split(", ")])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """``edited_fingerprints`` with ``group_id``: the smallest id among the rows with the same canonical text."""
    groups = exact_groups(docs).groupBy("digest", F.col("doc_id").alias("_doc")).agg(F.min("group_id").alias("group_id"))
    judged = edited_fingerprints(docs)
    joined = judged.join(groups, (judged.fingerprint == groups.digest) & judged.doc_id.eqNullSafe(groups._doc), "left")
    return joined.withColumn("group_id", F.coalesce("group_id", "doc_id")).drop("_doc", "digest")
