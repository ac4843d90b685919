"""Packing as cutting stock: column generation over the length histogram.

Documents are cut into whole sequences and a rest.  Lengths are rounded up to units, so the
histogram and everything the driver solves has a fixed size: a linear program over patterns (how
many pieces of each length share a sequence), priced by a knapsack dynamic program.  Patterns are
used a whole number of times; what rounding leaves over, at most a few sequences a pattern, is
placed best-fit-decreasing.  Pieces are ranked within their length by salted partial counts, and a
rank determines sequence and slot.

Defined cases: a null or empty text is the end id alone; equal rows are packed once each and, being
alike, have their places as a group; a very long text is cut into pieces inside one task; a null
doc_id is carried along; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import minhash
from .scratch import Scratch
from .tokens import word_tokens

UNIT, SALT_ROWS = 16, 4096


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best total value of any number of each item within the capacity, and how many of each."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = size <= c
        got = np.where(fits, value + best[np.where(fits, c - size, 0)], -1.0)
        i = int(got.argmax())
        best[c], last[c] = best[c - 1], -1
        if got[i] > best[c] + 1e-12:
            best[c], last[c] = got[i], i
    count, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            count[last[c]] += 1
            c -= int(size[last[c]])
    return float(best[capacity]), count


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan steps. LAPACK's own threads can deadlock in a driver process that has forked."""
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        others = work[:, k].copy()
        others[k] = 0.0
        work -= others[:, None] * work[k]
    return work[:, n:]


def solve_patterns(demand: dict[int, int], capacity: int, gap: float = 1e-4, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """(pattern {length: pieces}, times) that cover the demand {length: pieces}; lengths and capacity in units.

    Gilmore and Gomory's column generation with an explicit basis inverse: start from patterns of one
    length, let the dual prices choose the next pattern, stop when no pattern is worth more than
    1 + ``gap`` sequences.  Then times are rounded down and the rest is placed best-fit-decreasing.
    """
    size = np.array(sorted(demand), np.int64)
    if not len(size):
        return []
    need = np.array([demand[s] for s in size.tolist()], float)
    m = len(size)
    basis = np.diag(capacity // size).astype(float)
    cost = np.ones(m)
    inverse = np.diag(1.0 / np.diag(basis))
    level = inverse @ need
    for turn in range(rounds):
        price = cost @ inverse
        low = int(price.argmin())
        if price[low] < -1e-9:  # more pieces than asked for would be cheaper: let them be a surplus
            column, worth = np.zeros(m), 0.0
            column[low] = -1.0
        else:
            worth, count = knapsack(price, size, capacity)
            if worth <= 1 + gap:
                break
            column, worth = count.astype(float), 1.0
        step = inverse @ column
        can = step > 1e-9
        if not can.any():
            break
        ratio = np.where(can, level / np.where(can, step, 1.0), np.inf)
        out = int(ratio.argmin())
        level = level - ratio[out] * step
        level[out] = ratio[out]
        level = np.maximum(level, 0.0)
        basis[:, out], cost[out] = column, worth
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        if turn % 200 == 199:
            inverse = inverted(basis)
            level = np.maximum(inverse @ need, 0.0)
    left, plan = need.astype(np.int64), []
    for j in np.argsort(-level, kind="stable"):
        if cost[j] == 0:
            continue
        count = np.rint(basis[:, j]).astype(np.int64)
        used = count > 0
        times = int(min(math.floor(level[j] + 1e-6), (left[used] // count[used]).min()))
        if times > 0:
            plan.append(({int(s): int(c) for s, c in zip(size[used], count[used])}, times))
            left -= times * count
    rest = [int(s) for s, n in zip(size, left) for _ in range(int(n))]
    open_: list[tuple[list[int], int]] = []
    for s in sorted(rest, reverse=True):
        fit = min((x for x in range(len(open_)) if open_[x][1] >= s), key=lambda x: open_[x][1], default=None)
        if fit is None:
            open_.append(([s], capacity - s))
        else:
            open_[fit] = (open_[fit][0] + [s], open_[fit][1] - s)
    for items, _ in open_:
        plan.append(({s: items.count(s) for s in sorted(set(items), reverse=True)}, 1))
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end of ranks, pieces a sequence, first sequence, first slot) of every length in every pattern."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        slot = 0
        for length, pieces in sorted(pattern.items(), reverse=True):
            first = rank.get(length, 0)
            rank[length] = first + pieces * times
            rows.append((length, first, rank[length], pieces, sequence, slot))
            slot += pieces
        sequence += times
    return rows


def _cut(vocabulary: str, end_id: int, length: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = word_tokens(vocabulary), np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        for batch in batches:
            for at, texts in minhash.parts(batch.column(1), 500_000):
                rows = []
                for doc, ids in zip(batch.column(0).slice(at, len(texts)).to_pylist(), model.encode([x or "" for x in texts.to_pylist()])):
                    ids += end
                    for s in range(0, len(ids), 4 * length):
                        part = ids[s : s + 4 * length]
                        rows.append((doc, s // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if keep_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def pack(docs: DataFrame, vocabulary: str, *, end_id: int = 2, length: int = 4096, unit: int = UNIT, keep_ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    work = Scratch(spark, "cutting")
    base = docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text")
    pieces = base.mapInArrow(_cut(vocabulary, end_id, length, keep_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    pieces = pieces.withColumn("units", F.ceil(F.col("length") / unit).cast("int"))
    pieces = work.save(pieces if keep_ids else pieces.drop("ids"), "pieces")
    # At most length / unit rows, whatever the input.
    demand = {r["units"]: r["n"] for r in pieces.groupBy("units").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = slots(solve_patterns(demand, length // unit))
    salts = spark.createDataFrame([(u, math.ceil(n / SALT_ROWS)) for u, n in demand.items()], "units int, salts int")
    # Equal pieces (repeated rows, rows without a key) are one row with a count, so no salt holds more than its share of different ones.
    what = [c for c in pieces.columns if c != "units"]
    counted = pieces.groupBy("units", *what).agg(F.count(F.lit(1)).alias("n"))
    salted = counted.join(F.broadcast(salts), "units").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts")).cast("int"))
    before = F.sum("sum").over(W.partitionBy("units").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    counts = salted.groupBy("units", "salt").agg(F.sum("n").alias("sum")).select("units", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    upto = F.sum("n").over(W.partitionBy("units", "salt").orderBy("doc_id", "start", *what[2:]).rowsBetween(W.unboundedPreceding, 0))
    ranked = salted.withColumn("first_copy", upto - F.col("n")).join(counts, ["units", "salt"])
    # Copies come back in blocks, so one piece with very many of them makes no huge array.
    ranked = ranked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SALT_ROWS).cast("long"))))
    block_end = F.least(F.col("n"), F.col("block") + SALT_ROWS) - 1
    ranked = ranked.withColumn("copy", F.explode(F.sequence("block", block_end))).withColumn("rank", F.col("before") + F.col("first_copy") + F.col("copy"))
    # Patterns by lengths: bounded by the number of units, not by the documents.
    table = spark.createDataFrame(plan, "p_units int, first long, upto long, pieces long, sequence long, slot long")
    placed = ranked.join(F.broadcast(table), (F.col("units") == F.col("p_units")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("upto")))
    nth = F.col("rank") - F.col("first")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor(nth / F.col("pieces"))).withColumn("slot", F.col("slot") + nth % F.col("pieces"))
    offset = F.coalesce(F.sum("length").over(W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset")]
    return placed.select(*names, *(["ids"] if keep_ids else []))
