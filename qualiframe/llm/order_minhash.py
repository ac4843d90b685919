"""Fingerprints by order MinHash: how much of two texts agrees, in the same order.

Every k-mer of a text (k code points; a shorter text is one k-mer) gets the number of its earlier
occurrences, so repeats count.  For each of ``count`` hash functions the ``size`` smallest numbered
k-mers are chosen, put back into the order of the text, and their k-mers hashed as one tuple: 16 bits
of the fingerprint.  The share of equal tuples estimates a likeness that moving text around lowers,
as edits do, and that a plain set of k-mers does not see.

Texts meet their successor by one range shuffle on (doc_id, text hash), dealt with a random number
for rows that are alike; each task works through its sorted texts one after the other, and the first
and last text of each task meet in a second small step.  The wide step is stored once.

Defined cases: a null text is empty; an empty text has no k-mer, and its fingerprint equals that of
any other empty text and shares no tuple with the rest (0.0); ids come in ascending order, null ids
last, rows that share an id by a hash of their text; repeated rows are each other's successors; a
single row is its own; a text is handled whole by one task, at some sixty times its size in memory;
an empty table gives an empty table; other columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import mixed
from .scratch import Scratch, bounded_batches

K, SIZE, COUNT = 6, 2, 64
_GOLD, _TOP = np.uint64(0x9E3779B97F4A7C15), (1 << 32) - 1
_WIDE = 2048


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def kmers(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit polynomial hash of each k-mer; of the whole text if it is shorter."""
    k = min(k, len(points))
    if not k:
        return np.zeros(0, np.uint64)
    whole, length, power, size = None, 0, (points + np.uint64(1)) * _GOLD, 1
    while True:  # strings of 1, 2, 4, ... code points, put together by the binary digits of k
        if k & size:
            whole = power if whole is None else whole[: len(points) - length - size + 1] * np.uint64(pow(int(_GOLD), size, 1 << 64)) + power[length : len(points) - size + 1]
            length += size
        if length == k:
            return whole
        power = power[: len(power) - size] * np.uint64(pow(int(_GOLD), size, 1 << 64)) + power[size:]
        size *= 2


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How often each value came before in the array; values count as equal by the bits that a place leaves free in 64 (about 50 for a page, 40 for 16 million places)."""
    n = len(hashes)
    bits = np.uint64(max(1, n.bit_length()))
    places = np.arange(n, dtype=np.uint64)
    ranked = np.sort((hashes >> bits) << bits | places)  # one sort of plain integers, much faster than an order by value and place
    value, place = ranked >> bits, (ranked & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.concatenate(([True], value[1:] != value[:-1]))[:n]
    out = np.empty(n, np.uint64)
    out[place] = places - np.maximum.accumulate(np.where(start, places, np.uint64(0)))
    return out


class Sketch:
    """The hash functions of one (k, size, count)."""

    def __init__(self, k: int = K, size: int = SIZE, count: int = COUNT):
        self.k, self.size, self.count = k, size, count
        self.factors = (mixed(np.arange(1, count + 1, dtype=np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self._values, self._low = np.empty(count * _WIDE, np.uint32), np.empty(count * _WIDE + 8, bool)

    def below(self, numbered: np.ndarray, start: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(function, place, value) of the values up to ``bound`` from a place of the text on."""
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        for at in range(start, len(numbered), _WIDE):
            wide = min(_WIDE, len(numbered) - at)
            cells = self.count * wide
            values, low = self._values[:cells], self._low[: cells + -cells % 8]
            np.multiply(self.factors[:, None], numbered[None, at : at + wide], out=values.reshape(self.count, wide))
            low[cells:] = False
            np.less_equal(values, np.uint32(bound), out=low[:cells])
            eights = np.flatnonzero(low.view(np.uint64))  # few cells are low: skip eight at a time
            some = np.flatnonzero(low.reshape(-1, 8)[eights])
            flat = eights[some // 8] * 8 + some % 8
            parts.append((flat // wide, flat % wide + at, values[flat]))
        return parts[1] if len(parts) == 2 else tuple(np.concatenate(x) for x in zip(*parts))

    def tuples(self, found: np.ndarray, candidates: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes | None:
        """The fingerprint, 16 bits a function; None if a function has too few candidates."""
        take, bits = min(self.size, len(found)), len(found).bit_length()
        function, place, value = candidates
        counts = np.bincount(function, minlength=self.count)
        if counts.min() < take:
            return None
        if self.count.bit_length() + 32 + bits <= 64:
            ranked = np.sort((function.astype(np.uint64) << np.uint64(32) | value) << np.uint64(bits) | place.astype(np.uint64))
            ranked = (ranked & np.uint64((1 << bits) - 1)).astype(np.int64)
        else:
            ranked = place[np.lexsort((place, value, function))]
        first = np.cumsum(counts) - counts
        chosen = np.sort(ranked[first[:, None] + np.arange(take)], axis=1) if take else np.zeros((self.count, 0), np.int64)
        out = np.full(self.count, take, np.uint64)
        for j in range(take):
            out = mixed(out * _GOLD + found[chosen[:, j]])
        return (out >> np.uint64(48)).astype(">u2").tobytes()

    def sketched(self, text: str, like: "Sketched | None" = None, common: int = 0) -> "Sketched":
        """A text under these functions; what it has in common with the start of another sketched text is taken from there."""
        found = kmers(code_points(text), self.k)
        numbered = (mixed(found + occurrences(found) * _GOLD) >> np.uint64(32)).astype(np.uint32)  # 32 bits order millions of places well; ties go by place
        n, wanted = len(found), 8 * self.size
        bound = _TOP if wanted >= n else _TOP // n * wanted
        candidates = None
        if like is not None and common >= self.k:
            # k-mers inside the common start are the same, numbers included
            bound, shared = like.bound, common - self.k + 1
            head = like.candidates[1] < shared
            candidates = tuple(np.concatenate((a[head], b)) for a, b in zip(like.candidates, self.below(numbered, shared, bound)))
        while candidates is None or (prints := self.tuples(found, candidates)) is None:
            if candidates is not None:
                wanted *= 2
                bound = _TOP if wanted >= n else _TOP // n * wanted
            candidates = self.below(numbered, 0, bound)
        return Sketched(text, prints, candidates, bound)


@dataclass
class Sketched:
    text: str
    fingerprint: bytes
    candidates: tuple[np.ndarray, np.ndarray, np.ndarray]
    bound: int

    def likeness(self, other: "Sketched") -> float:
        """Share of equal tuples; two empty texts are alike, an empty one and another are not."""
        if not self.text or not other.text:
            return float(self.text == other.text)
        return float((np.frombuffer(self.fingerprint, ">u2") == np.frombuffer(other.fingerprint, ">u2")).mean())


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter replaced by the start of the following one, and how many code points stay."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter], len(text) - quarter


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, size: int = SIZE, count: int = COUNT) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every text, 4 hex digits a hash function; without a shuffle."""
    sketch = Sketch(k, size, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            prints = [sketch.sketched(t).fingerprint.hex() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
EDGES = RESULT + ", part int, first_text string, last_text string"
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], _TYPES[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _judged(sketch: Sketch, doc: int | None, own: Sketched, following: Sketched) -> tuple:
    new, kept = edited(own.text, following.text)
    changed = sketch.sketched(new, own, kept)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(own.text), digest, own.fingerprint, changed.fingerprint, own.likeness(changed), own.likeness(following)


def _inside(sketch: Sketch):
    """Rows of all texts of a sorted partition but its last, and one edge row with its first and its last text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = doc = None
        for batch in batches:
            rows = []
            for doc_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                now = sketch.sketched(text.as_py() or "")
                if last is None:
                    first = now.text
                else:
                    rows.append(_judged(sketch, doc, last, now))
                doc, last = doc_, now
            yield _batch(rows, EDGES)
        if last is not None:
            yield _batch([(doc, *[None] * 6, TaskContext.get().partitionId(), first, last.text)], EDGES)

    return run


def _across(sketch: Sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, following in zip(*(batch.column(i) for i in range(3))):
                yield _batch([_judged(sketch, doc.as_py(), sketch.sketched(text.as_py()), sketch.sketched(following.as_py()))], RESULT)

    return run


def compare_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, size: int = SIZE, count: int = COUNT) -> DataFrame:
    """Fingerprints of every text and of its edit (see ``edited``), and how like it the edit and the next text in order of ids are."""
    spark = docs.sparkSession
    work, sketch = Scratch(spark, "order"), Sketch(k, size, count)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    order = [F.asc_nulls_last("doc_id"), F.asc("hash")]
    dealt = rows.repartitionByRange(*order, F.rand(7)).sortWithinPartitions(*order).select("doc_id", "text")
    found = work.save(dealt.mapInArrow(_inside(sketch), EDGES), "found")
    edges = found.filter("part is not null")
    parts = sorted(r["part"] for r in edges.select("part").collect())  # one number a task of the range shuffle
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    firsts = edges.select(F.col("part").alias("next"), F.col("first_text").alias("following"))
    across = edges.select("doc_id", "part", "last_text").join(F.broadcast(follows), "part").join(firsts, "next").select("doc_id", "last_text", "following")
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    out = found.filter("part is null").select(*names).unionByName(across.mapInArrow(_across(sketch), RESULT))
    return out.withColumns({n: F.lower(F.hex(n)) for n in ("fingerprint", "edited_fingerprint")})
