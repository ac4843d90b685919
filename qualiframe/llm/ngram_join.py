"""Jaccard join of documents on word n-grams by MinHash banding.

Documents with one n-gram set are a class.  Classes are banded, shuffled on band hashes, and every
pair that shares a band is verified on the full sets (see ``linkage``), so a class of copies costs
one member and no link between different texts is dropped after banding.

Words are runs of anything but ASCII white space, compared as they are.  Defined cases: a text of
fewer than n words has one n-gram of all its words; a null, empty or blank text has none, links with
nothing and is a class of its own; repeated rows are copies; a null doc_id takes part, but does not
name a class; a very long text needs some ten times its size in its task; an empty table gives an
empty table; other columns pass by under any name.

The number of links is counted pair by pair, so n different texts that all resemble each other cost
n * n comparisons (in blocks of bounded size); ``keep_one`` needs components only and is spared this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import minhash
from .linkage import link
from .scratch import Scratch

VALUES, RECALL = 128, 0.998


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return minhash.distinct(*minhash.windows(*minhash.word_hashes(*minhash.text_bytes(column)), n))


def _signed(n: int, bands: int, rows: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in minhash.parts(batch.column(2)):
                values, number = _sets(texts, n)
                ids = minhash.fingerprints(values, number).view(np.int64)
                keys = minhash.band_keys(values, number, bands, rows, threshold)
                arrays = [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(ids, mask=number == 0), pa.array(keys, pa.list_(pa.int64())), pa.array(8 * number, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row_key", "id", "keys", "size"])

    return run


def _same(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_numpy()
            for at, texts in minhash.parts(batch.column(1)):
                same = np.flatnonzero(minhash.fingerprints(*_sets(texts, n)).view(np.int64) == wanted[at : at + len(texts)])
                yield pa.RecordBatch.from_arrays([pa.array(wanted[at + same], pa.int64()), texts.take(pa.array(same))], names=["id", "payload"])

    return run


def _ready(n: int):
    def prepare(texts: pa.Array) -> list[np.ndarray]:
        values, number = _sets(texts, n)
        return np.split(values, np.cumsum(number)[:-1])

    return prepare


def _named(row_id: str, at_text: int, n: int):
    """Rows with the fingerprint of their text's n-gram set behind the other columns; null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in minhash.parts(batch.column(at_text)):
                values, number = _sets(texts, n)
                ids = pa.array(minhash.fingerprints(values, number).view(np.int64), mask=number == 0)
                some = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*some.columns, ids], names=[*some.schema.names, row_id])

    return run


def _classes(docs: DataFrame, work: Scratch, key: str, text: str, n: int, threshold: float, recall: float, count: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """((doc_id, id) of each row, (id, w, least, label) of each different set, (id, links) if counted)."""
    bands, rows = minhash.bands_for(threshold, recall, VALUES)
    # A document without an id is found again by its text; ids are never compared with such keys alone.
    row_key = F.coalesce(F.col(key).cast("long"), F.xxhash64(text))
    base = docs.select(F.col(key).cast("long").alias("doc_id"), row_key.alias("row_key"), F.col(text).alias("text"))
    signed = work.save(base.mapInArrow(_signed(n, bands, rows, threshold), "doc_id long, row_key long, id long, keys array<long>, size long"), "signed")
    classes = signed.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("w"), F.min("row_key").alias("row_key"), F.min("doc_id").alias("least"))
    classes = work.save(classes, "classes")

    def payload(ids: DataFrame) -> DataFrame:
        """The text of one document of each class; of rows that share its id, the one with its set."""
        chosen = work.save(classes.join(ids, "id", "left_semi").select("id", "row_key"), "chosen")
        texts = base.select("row_key", "text").join(work.broadcast_if_small(chosen, "chosen"), "row_key").select("id", "text")
        # Of rows with one id and one set, any one will do.
        return work.save(texts.mapInArrow(_same(n), "id long, payload string").groupBy("id").agg(F.min("payload").alias("payload")), "texts")

    flat = signed.select("id", F.explode("keys").alias("key"), "size")
    totals, labels = link(flat, classes, payload, _ready(n), lambda sets: minhash.jaccard_links(sets, threshold), work, count=count)
    totals, labels = totals if totals is None else work.save(totals, "totals"), work.save(labels.withColumnRenamed("node", "id"), "labels")
    named = work.save(classes.select("id", "w", "least").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "named")
    return signed.select("doc_id", "id"), named, totals


_STEPS = ("shared_keys", "pairs", "buckets", "shared", "chosen", "texts", "links", "classes", "named", "totals", "labels", "first_links", "first_labels", "places", "large", "main", "rest", "wanted", "second_links")


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, copies) of every document.

    class_id is the smallest doc_id of all documents that links reach, n_links counts the other
    documents with a similarity of at least ``threshold``, copies those with the same n-gram set.
    """
    work = Scratch(docs.sparkSession, "ngrams")
    signed, named, totals = _classes(docs, work, key, text, n, threshold, recall, True)
    roots = work.save(named.groupBy("label").agg(F.min("least").alias("class_id")), "roots")
    told = work.save(named.join(roots, "label").join(totals, "id", "left").select("id", "class_id", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), (F.col("w") - 1).alias("copies")), "told")
    work.drop(*_STEPS, "roots")
    out = signed.join(told, "id", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("copies", zero).alias("copies"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest doc_id, and of several texts with this id the one with the least fingerprint.

    Rows without a doc_id stay, as none of them names a class, and so do rows without words.
    """
    work = Scratch(docs.sparkSession, "keep_one")
    signed, named, _ = _classes(docs, work, key, text, n, threshold, recall, False)
    first = F.min(F.when(F.col("least").isNotNull(), F.struct("least", "id"))).alias("first")
    told = work.save(named.join(work.save(named.groupBy("label").agg(first), "roots"), "label").select("id", "first"), "told")
    stays = F.col("id").isNull() | F.col("doc_id").isNull() | F.col("first").isNull() | ((F.col("doc_id") == F.col("first.least")) & (F.col("id") == F.col("first.id")))
    rows = work.save(signed.join(told, "id", "left").select("doc_id", "id", stays.alias("stays")).filter("doc_id is not null"), "rows")
    work.drop(*_STEPS, "roots")
    decided = work.save(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("stays").alias("any")).filter("n > 1 or not any"), "decided")
    gone, several = decided.filter("not any").select(F.col("doc_id").alias("_gone")), decided.filter("any").select(F.col("doc_id").alias("_several"))
    slots = [f"_c{i}" for i in range(len(docs.columns))]
    whole, of = docs.toDF(*slots), dict(zip(docs.columns, slots))
    out = whole.join(gone, F.col(of[key]).cast("long") == F.col("_gone"), "left_anti")
    if several.isEmpty():
        return out.toDF(*docs.columns)
    # Rows that share an id are told apart by their sets; of equal ones one stays.  Both are partial aggregates.
    rest = out.join(several, F.col(of[key]).cast("long") == F.col("_several"), "left_anti")
    again = out.join(several, F.col(of[key]).cast("long") == F.col("_several"), "left_semi")
    schema = T.StructType([*again.schema.fields, T.StructField("_id", T.LongType())])
    again = again.mapInArrow(_named("_id", docs.columns.index(text), n), schema).withColumn("_row", F.struct(*slots))
    kept = rows.filter("stays and id is not null").select(F.col("doc_id").alias("_doc"), F.col("id").alias("_id")).distinct()
    once = again.join(kept, (F.col(of[key]).cast("long") == F.col("_doc")) & (again["_id"] == kept["_id"]))
    once = once.groupBy("_doc", again["_id"]).agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return rest.unionByName(again.filter("_id is null").select(*slots)).unionByName(once).toDF(*docs.columns)
