"""Exact integer Lloyd rounds that keep their state and move sums by differences.

Vectors are cut into parts, each with a codebook of its own (one part: plain clustering).  A round
reads the stored assignments, compares a part only with entries that changed since the last round,
or with all entries if its own one changed, and stores the new assignments.  Only parts whose
assignment differs then send their components, with a plus to the new entry and a minus to the old
one; they are added up inside each task, so a round shuffles at most one row an entry and task.
Running sums are a stored table too.  Entries are the only thing the driver sees: parts x entries
rows, set by parameters and not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: Integer components are held within this bound, so squared distances of a vector fit a long.
LIMIT = 1 << 26
BLOCK = 4096
LONG_MAX = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """True where a vector is not null and has no null or non-finite component."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * component) as array<int>, held within ``LIMIT``."""
    bound = F.lit(float(LIMIT))
    return F.transform(vector, lambda v: F.greatest(F.least(F.floor(v.cast("double") * F.lit(float(scale))).cast("double"), bound), -bound).cast("int"))


def long_sum(value: Column) -> Column:
    """A sum that stops at the largest long."""
    return F.least(F.sum(value.cast("decimal(20,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries."""
    big = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * big * big < 1 << 53:  # every sum below is then exact in doubles
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        gap = x[:, j, None] - entries[None, :, j]
        out += gap * gap
    return out


def nearest(x: np.ndarray, entries: np.ndarray, changed: np.ndarray, owner: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties: lower number) and its squared distance, from the owner and distance of the last round; owner -1: none yet."""
    owner, far = owner.copy(), far.copy()
    anew = (owner < 0) | changed[owner]
    some = np.flatnonzero(changed)
    for rows, among in ((np.flatnonzero(anew), np.arange(len(entries))), (np.flatnonzero(~anew), some)):
        if not len(among):
            continue
        for at in range(0, len(rows), BLOCK):
            these = rows[at : at + BLOCK]
            d = squared_distances(x[these], entries[among])
            best = d.argmin(1)
            d, best = d[np.arange(len(these)), best], among[best]
            if among is some:  # the owner did not change: it stays unless a changed entry is nearer
                wins = (d < far[these]) | ((d == far[these]) & (best < owner[these]))
                these, d, best = these[wins], d[wins], best[wins]
            owner[these], far[these] = best, d
    return owner, far


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.int64)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def _assign(carried: int, entries: np.ndarray, changed: np.ndarray, names: list[str], first: bool):
    """State rows (carried columns, x, owner, far, before, moved) under new entries; the first round has no state but x."""
    parts, _, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (n := len(batch)):
                continue
            x = _matrix(batch.column(carried), n)
            before = np.full((n, parts), -1, np.int64) if first else _matrix(batch.column(carried + 1), n)
            far = np.zeros((n, parts), np.int64) if first else _matrix(batch.column(carried + 2), n)
            owner = before.copy()
            for p in range(parts):
                owner[:, p], far[:, p] = nearest(x[:, p * width : (p + 1) * width], entries[p], changed[p], before[:, p], far[:, p])
            moved = pa.array((owner != before).any(1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: carried + 1], _lists(owner, pa.int32()), _lists(far, pa.int64()), _lists(before, pa.int32()), moved], names=names)

    return run


def _transfers(parts: int, entries: int, width: int):
    """(part, entry, n, sums): what a task's changed assignments add to and take from each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        touched = np.zeros((parts, entries), bool)
        for batch in batches:
            if not (n := len(batch)):
                continue
            x, owner, before = (_matrix(batch.column(i), n) for i in range(3))
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                moved = owner[:, p] != before[:, p]
                for sign, to in ((1, owner[:, p]), (-1, before[:, p])):
                    rows = np.flatnonzero(moved & (to >= 0))
                    at = to[rows]
                    # weights are doubles: a batch adds up to less than 2 ** 53
                    flat = np.bincount((at[:, None] * width + np.arange(width)).ravel(), part[rows].ravel(), entries * width)
                    sums[p] += sign * flat.astype(np.int64).reshape(entries, width)
                    counts[p] += sign * np.bincount(at, minlength=entries)
                    touched[p, at] = True
        p, e = np.nonzero(touched)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), _lists(sums[p, e], pa.int64())], names=["part", "entry", "n", "sums"])

    return run


def rounds(points: DataFrame, starts: np.ndarray, times: int, work: Scratch) -> tuple[DataFrame, np.ndarray]:
    """``points`` (columns of any kind and x array<int>, last) with owner and far, arrays with a place for each part, after ``times`` rounds and a last assignment; and the final entries.

    ``starts`` is parts x entries x width.  An entry without members stays as it is; others become
    the floor of the mean of theirs.
    """
    entries = starts.astype(np.int64)
    parts, size, width = entries.shape
    changed = np.ones((parts, size), bool)
    fields = [*points.schema.fields, *T.StructType.fromDDL("owner array<int>, far array<bigint>, before array<int>, moved boolean").fields]
    schema, carried = T.StructType(fields), len(points.columns) - 1
    state, sums = points, None
    for turn in range(times + 1):
        step = _assign(carried, entries, changed, [f.name for f in fields], turn == 0)
        state = work.save((state if turn == 0 else state.drop("before", "moved")).mapInArrow(step, schema), f"state{turn}")
        if turn:
            work.drop(f"state{turn - 1}", release=False)
        if turn == times:
            break
        moves = state.filter("moved").select("x", "owner", "before").mapInArrow(_transfers(parts, size, width), "part int, entry int, n bigint, sums array<bigint>")
        moves = moves if sums is None else moves.unionByName(sums)
        added = moves.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
        sums = work.save(added.select("part", "entry", "n", F.array(*[f"s{j}" for j in range(width)]).alias("sums")), f"sums{turn}")
        last = entries.copy()
        for r in sums.filter("n > 0").collect():  # at most parts x entries rows
            entries[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
        changed = (entries != last).any(2)
        if not changed.any():
            break
    return state.drop("before", "moved"), entries
