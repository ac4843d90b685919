"""Fuzzy line dedup: character shingles, MinHash banding, exact Jaccard, union-find, one line a component.

Lines are what ``\\n`` separates.  Equal lines are one member; members that share a band are verified
on their full shingle sets (see ``linkage``) and components keep their first line by (doc_id, line
number), all others are removed from their documents.

Defined cases: a line of ASCII white space only is no line to compare and always stays; a line
shorter than a shingle has one shingle, itself; a null or empty text has no lines and stays as it
is; rows with equal doc_id and text are one document and keep the same lines, and so do rows with
equal doc_id but other texts where they have the same line at the same number; a null doc_id takes
its place by a hash of its text; a text that loses every line becomes null; an empty table gives an
empty table; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .linkage import link
from .scratch import Scratch

SHINGLE, VALUES, RECALL = 7, 36, 0.99
_BLANK = " \t\n\r\x0b\x0c"


def _shingles(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of each line, repeats included, and their number by line."""
    codes = np.frombuffer("".join([x + "\n" for x in lines]).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(x) for x in lines], np.int64)
    number = np.maximum(length - k + 1, (length > 0).astype(np.int64))
    wide = np.zeros(len(codes) + k, np.uint64)
    wide[: len(codes)] = codes
    hashed = wide[: len(codes)].copy()
    for j in range(1, k):
        hashed *= minhash._GOLD
        hashed += wide[j : j + len(codes)]
    hashed = minhash.mixed(hashed)
    begin = np.cumsum(length + 1) - length - 1
    # A shingle counts if it ends within its line; the one of a short line is made of all it has.
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + number, -1)
    short = np.flatnonzero((length > 0) & (length < k))
    for i in short:
        hashed[begin[i]] = xxhash.xxh3_64_intdigest(lines[i].encode("utf-8", "surrogatepass"))
    return hashed[np.cumsum(edge[:-1]) > 0], number


def _lines(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in minhash.parts(batch.column(1), 1_000_000):
                owner, place, lines = [], [], []
                for key, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts.to_pylist()):
                    for i, line in enumerate((text or "").split("\n")):
                        if line.strip(_BLANK):
                            owner.append(key)
                            place.append(i)
                            lines.append(line)
                if not lines:
                    continue
                ids = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], np.uint64).view(np.int64)
                values, number = _shingles(lines, k)
                signature = minhash._binned(values, number, bands * rows)
                keys = minhash._keys(signature, bands, rows, 2)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(place, pa.int32()), pa.array(ids), flat, pa.array(8 * number, pa.int64())], names=["row_key", "line", "id", "keys", "size"])

    return run


def _ready(k: int):
    def prepare(lines: pa.Array) -> list[np.ndarray]:
        values, number = minhash.distinct(*_shingles(lines.to_pylist(), k))
        return np.split(values, np.cumsum(number)[:-1])

    return prepare


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, payload) of the lines in ``lines`` of each text, if the line there has that id."""
    for batch in batches:
        ids, out = [], []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            split = (text or "").split("\n")
            for w in wanted:
                if w["line"] < len(split) and np.uint64(xxhash.xxh3_64_intdigest(split[w["line"]].encode("utf-8", "surrogatepass"))).view(np.int64) == w["id"]:
                    ids.append(w["id"])
                    out.append(split[w["line"]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "payload"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, before, gone = [], [], []
        for text, removed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = (text or "").split("\n")
            found = {(w["line"], w["id"]) for w in removed or ()}
            kept = [x for i, x in enumerate(lines) if not found or (i, int(np.uint64(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))).view(np.int64))) not in found]
            left = len(kept) == len(lines) or any(x.strip(_BLANK) for x in kept)
            texts.append(text if len(kept) == len(lines) else "\n".join(kept) if left else None)
            before.append(len(lines) if text is not None else 0)
            gone.append(len(lines) - len(kept))
        rest = [batch.column(i) for i in range(2, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64()), *rest], names=["_text", "n_lines", "n_removed", *batch.schema.names[2:]])


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the lines that stay in ``text``, and n_lines and n_removed behind the other columns."""
    work = Scratch(docs.sparkSession, "lines")
    bands, rows = minhash.bands_for(threshold, RECALL, VALUES)
    row_key = F.coalesce(F.col(key).cast("long"), F.xxhash64(text))
    base = docs.select(row_key.alias("row_key"), F.col(text).alias("text"))
    lines = work.save(base.mapInArrow(_lines(shingle, bands, rows), "row_key long, line int, id long, keys array<long>, size long"), "lines")
    classes = lines.groupBy("id").agg(F.count(F.lit(1)).alias("w"), F.min(F.struct("row_key", "line")).alias("first"))
    classes = work.save(classes, "classes")

    def payload(ids: DataFrame) -> DataFrame:
        chosen = classes.join(ids, "id", "left_semi").select("id", "first.*").groupBy("row_key").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))
        chosen = work.save(chosen, "chosen")
        texts = work.save(base.join(chosen, "row_key").select("text", "wanted").mapInArrow(_pick, "id long, payload string"), "texts")
        work.release()
        return texts

    _, labels = link(lines.select("id", F.explode("keys").alias("key"), "size"), classes, payload, _ready(shingle), lambda sets: minhash.jaccard_links(sets, threshold), work, count=False)
    labels = work.save(labels.withColumnRenamed("node", "id"), "labels")
    named = classes.select("id", "w", "first").join(labels, "id", "left").filter("w > 1 or label is not null").withColumn("label", F.coalesce("label", "id"))
    named = work.save(named, "named")
    kept = work.save(named.groupBy("label").agg(F.min("first").alias("kept")), "kept")
    told = work.save(named.join(kept, "label").select("id", "kept"), "told")
    removed = lines.select("row_key", "line", "id").join(told, "id").filter("row_key <> kept.row_key or line <> kept.line")
    removed = work.save(removed.groupBy("row_key").agg(F.collect_set(F.struct("line", "id")).alias("_removed")), "removed")
    work.drop("lines", "classes", "shared_keys", "pairs", "buckets", "shared", "chosen", "texts", "first_links", "first_labels", "places", "large", "main", "rest", "wanted", "second_links", "labels", "named", "kept", "told")

    names = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    slots = [f"_c{i}" for i in range(len(names))]
    whole = docs.select(row_key.alias("_row_key"), F.col(text).alias("_text"), *[F.col(f"`{n}`").alias(s) for n, s in zip(names, slots)])
    whole = whole.join(removed.withColumnRenamed("row_key", "_row_key"), "_row_key", "left").select("_text", "_removed", *slots)
    kinds = [f.dataType for f in whole.schema.fields]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), *[T.StructField(s, k) for s, k in zip(slots, kinds[2:])]])
    out = whole.mapInArrow(_apply, schema)
    back = [F.col("_text").alias(text) if c == text else F.col(slots[names.index(c)]).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*back, "n_lines", "n_removed")
