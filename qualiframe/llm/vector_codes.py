"""Vectors as short codes: one codebook for each part of a vector, fitted by delta-maintained Lloyd rounds.

See ``lloyd``: previous assignments and running integer sums are stored, and a round shuffles only
plus and minus contributions of parts whose assignment changed.

Defined cases: vectors that are null or hold null or non-finite components are left out, and so are
those of another length than most of the rest (the longer of two equally frequent; only lengths that
the number of parts divides count); starts are the smallest vec_ids, of rows that share one that with
the smallest components, and of no row without one unless there are no others; with fewer vec_ids
than entries a codebook has fewer entries; a component whose integer is beyond 2^26 counts as that
bound, and sums that no long holds as the largest long; labels may be of any type that can be
grouped, nulls are one label; an empty table gives an empty table; other columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lloyd import finite, integers, long_sum, rounds
from .scratch import Scratch


@dataclass
class Codes:
    """``rows`` (vec_id, label, codes array<int>, errors array<bigint>) and ``books``, parts x entries x width integers at ``scale``."""

    rows: DataFrame
    books: np.ndarray
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decode(self) -> DataFrame:
        """(vec_id, vector array<double>): the middle of the cell that each component's code stands for."""
        books, scale = (self.books + 0.5) / self.scale, self.books.shape[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
                vectors = np.concatenate([books[p][codes[:, p]] for p in range(scale)], axis=1) if len(batch) else np.zeros((0, 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], names=["vec_id", "vector"])

        return self.rows.select("vec_id", "codes").mapInArrow(run, "vec_id bigint, vector array<double>")


def fit(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, scale: int = 1024, times: int = 4) -> Codes:
    work = Scratch(vectors.sparkSession, "codes")
    kept = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(finite(F.col("v")) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    most = kept.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = most[0]["dims"] if most else parts
    points = work.save(kept.filter(F.size("v") == dims).select("vec_id", "label", integers(F.col("v"), scale).alias("x")), "points")
    ids = points.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()
    named = [r["vec_id"] for r in ids if r["vec_id"] is not None]
    # at most ``entries`` ids, whatever the number of rows that share one
    few = points.filter(F.col("vec_id") <= named[-1]) if named else points
    first = few.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    starts = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    state, books = rounds(points, starts, times, work)
    return Codes(state.select("vec_id", "label", F.col("owner").alias("codes"), F.col("far").alias("errors")), books, scale)


def compress(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector kept; options as for ``fit``."""
    fitted = fit(vectors, **options)
    work = Scratch(vectors.sparkSession, "labels")
    digits = max(2, len(f"{max(fitted.books.shape[1] - 1, 0):x}"))
    rows = fitted.rows.select(
        "vec_id", "label", F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")), "").alias("code"),
        F.aggregate("errors", F.lit(0).cast("long"), lambda total, e: total + e).alias("error"),
    )
    by_label = work.save(rows.groupBy(F.col("label").alias("_label")).agg(long_sum(F.col("error")).alias("label_error")), "by_label")
    by_label = work.broadcast_if_small(by_label, "by_label")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(fitted.digest()).alias("codebooks_sha256"))
