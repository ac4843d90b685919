"""Packed id matrices: best-fit-decreasing with a segment tree over free space.

Each task tokenises its documents and packs windows of a fixed number of tokens, so nothing is
shuffled, memory is bounded, and a lost task is repeated alone.  Documents longer than a row are cut
into whole rows and a rest, so every id is kept.

Defined cases: a null or empty text is the end id alone; equal rows are packed once each; a null
doc_id is kept in the list of its row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import minhash
from .scratch import bounded_batches
from .tokens import ByteTokens

SCHEMA = "n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"


class FreeSpace:
    """Open rows by free space: the one with least space that is enough, in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, row: int, space: int) -> None:
        self.rows[space].append(row)
        self._add(space, 1)

    def _add(self, space: int, by: int) -> None:
        at = space + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(row, its free space), or None; the row is no longer open."""
        at, count = least + self.size, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        space = at - self.size
        self._add(space, -1)
        return self.rows[space].pop(), space


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Places of the lengths in each row."""
    free, rows = FreeSpace(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        if found is None:
            rows.append([])
            found = len(rows) - 1, capacity
        row, space = found
        rows[row].append(i)
        if space > lengths[i]:
            free.put(row, space - lengths[i])
    return rows


def _pack(pieces: list[tuple], length: int, pad: int, kind: str) -> Iterator[pa.RecordBatch]:
    """pieces: (doc_id, start, ids)."""
    rows = best_fit_decreasing([len(p[2]) for p in pieces], length)
    for at in range(0, len(rows), 256):
        columns: list[list] = [[] for _ in range(7)]
        for row in rows[at : at + 256]:
            ids, positions = np.full(length, pad, kind), np.zeros(length, "<u2" if length <= 65536 else "<u4")
            ends = [0]
            for i in row:
                n = len(pieces[i][2])
                ids[ends[-1] : ends[-1] + n] = pieces[i][2]
                positions[ends[-1] : ends[-1] + n] = np.arange(n)
                ends.append(ends[-1] + n)
            for c, v in zip(columns, (ends[-1], ids.tobytes(), positions.tobytes(), ends, ends[:-1], [pieces[i][0] for i in row], [pieces[i][1] for i in row])):
                c.append(v)
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = [x.strip().split(" ")[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def pack(docs: DataFrame, vocabulary: str, pattern: str, *, end_id: int, length: int = 2048, window: int = 4_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``length`` ids with cumulative segment lengths, position ids and where they restart.

    ids holds unsigned little-endian numbers (16 bits if the vocabulary allows, else 32), padded
    with ``end_id``; cu_seqlens starts with 0 and ends with n_tokens; doc_starts are the ids of the
    document before each segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteTokens(vocabulary, pattern)
        kind = "<u2" if max(model.size, end_id + 1) <= 65536 else "<u4"
        pieces: list[tuple] = []
        held = 0
        for batch in batches:
            for at, texts in minhash.parts(batch.column(1)):
                for doc, value in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts):
                    ids = np.append(model.encode(value.as_py() or ""), np.uint32(end_id)).astype(kind)
                    pieces += [(doc, s, ids[s : s + length]) for s in range(0, len(ids), length)]
                    held += len(ids)
                    if held >= window:
                        yield from _pack(pieces, length, end_id, kind)
                        pieces, held = [], 0
        yield from _pack(pieces, length, end_id, kind)

    bounded_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, SCHEMA)
