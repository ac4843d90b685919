"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Every passage is encoded from its bytes (shape figures,
byte pairs, hashed word shapes), a gated attention weighs the passages, and the weighted sum of their
encodings is scored.  Only documents are labelled; the weights of passages are learned from that.

The model is fitted on the driver from a bounded, balanced sample of labelled documents: of each
label the first ``per_class`` by a hash of their id, of these the shorter ones whose words add up to at
most ``class_words`` (the shortest of a label always stays, so no label is lost).  A sampled document teaches with all of its passages; scoring reads every passage of
every document.

Defined cases: a null, empty or blank text has no passage and scores 0; labels that are null are
ignored, a document with several labels has their majority (ties: 1); with labels of one kind or
none every text with words gets that share (0.5 for none); ties in the sample order go by doc_id;
equal rows have equal scores; a very long text needs some ten times its size in its task; an empty
table gives an empty table; other columns pass by under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import minhash
from .scratch import Scratch, bounded_batches
from .words import word_count

PASSAGE, PAIRS, SHAPES, FIGURES = 64, 256, 128, 12
WIDTH = FIGURES + PAIRS + SHAPES
PER_CLASS, CLASS_WORDS, HIDDEN, GATE = 1500, 4_000_000, 24, 12

_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _SIGN = range(6)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[128:] = _HIGH
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("a") : ord("z") + 1] = _LOWER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[32, 9, 10, 11, 12, 13]] = _SPACE


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages of some texts (rows of WIDTH) and their number by text."""
    n = len(offsets) - 1
    kind = _KIND[data]
    space = kind == _SPACE
    begins = ~space
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    if len(data):
        begins[1:] &= space[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    count = np.diff(np.searchsorted(starts, offsets))
    number = -(-count // PASSAGE)
    total = int(number.sum())
    if not total:
        return np.zeros((0, WIDTH), np.float32), number
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
    word_passage = np.repeat(np.cumsum(number) - number, count) + nth // PASSAGE
    # Bytes belong to the passage of the last word that began before them; what stands before the first word to none.
    at = starts[0]
    spans = np.diff(np.append(starts, len(data)))
    owner = np.repeat(word_passage, spans)
    text, kind = data[at:], kind[at:]
    begins = begins[at:]
    out = np.zeros((total, WIDTH), np.float32)
    size = np.bincount(owner, minlength=total).astype(np.float32)
    words = np.bincount(word_passage, minlength=total).astype(np.float32)
    for k in range(6):
        out[:, k] = np.bincount(owner[kind == k], minlength=total) / size
    hashes, _ = minhash.word_hashes(data, offsets)
    fresh = np.ones(len(hashes), bool)
    order = np.lexsort((hashes, word_passage))
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_passage[order][1:] != word_passage[order][:-1])
    out[:, 6] = np.bincount(word_passage[order][fresh], minlength=total) / words
    length = np.diff(np.append(starts, len(data))).astype(np.float32)
    out[:, 7] = np.bincount(word_passage, length, total) / words / 16
    out[:, 8] = np.sqrt(np.maximum(np.bincount(word_passage, length**2, total) / words - (out[:, 7] * 16) ** 2, 0)) / 16
    out[:, 9] = np.log1p(words) / 4
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    out[:, 10] = np.bincount(owner[change], minlength=total) / size
    same = np.zeros(len(text), bool)
    same[1:] = text[1:] == text[:-1]
    out[:, 11] = np.bincount(owner[same], minlength=total) / size
    # Byte pairs with letters folded to lower case, hashed to a byte.
    folded = np.where(kind == _UPPER, text + 32, text).astype(np.uint32)
    pair = (folded[:-1] * np.uint32(31) + folded[1:] * np.uint32(7)) & np.uint32(PAIRS - 1)
    inner = ~begins[1:]
    cell = owner[:-1][inner].astype(np.int64) * PAIRS + pair[inner]
    out[:, FIGURES : FIGURES + PAIRS] = np.sqrt(np.bincount(cell, minlength=total * PAIRS).reshape(total, PAIRS) / size[:, None])
    # Word shapes: the kinds of a word's bytes without repeats, hashed.
    mark = change | begins
    value = np.where(mark & (kind != _SPACE), (kind.astype(np.uint64) + np.uint64(1)), np.uint64(0))
    place = np.cumsum(mark) - np.repeat(np.cumsum(mark)[starts - at], spans)
    value *= minhash._POWERS[np.minimum(place, 4095)]
    shape = (minhash.mixed(np.add.reduceat(value, starts - at)) % np.uint64(SHAPES)).astype(np.int64)
    cell = word_passage * SHAPES + shape
    out[:, FIGURES + PAIRS :] = np.sqrt(np.bincount(cell, minlength=total * SHAPES).reshape(total, SHAPES) / words[:, None])
    return out, number


def _segments(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(number) - number, np.repeat(np.arange(len(number)), number)


def _forward(model: dict[str, np.ndarray], x: np.ndarray, number: np.ndarray):
    starts, owner = _segments(number)
    h = np.tanh(x @ model["enc"] + model["enc_b"])
    v, u = np.tanh(h @ model["att_v"]), 1 / (1 + np.exp(-(h @ model["att_u"])))
    raw = (v * u) @ model["att_w"]
    e = np.exp(raw - np.maximum.reduceat(raw, starts)[owner])
    a = e / np.add.reduceat(e, starts)[owner]
    z = np.add.reduceat(h * a[:, None], starts)
    p = 1 / (1 + np.exp(-np.clip(z @ model["out"] + model["out_b"], -30, 30)))
    return p, (h, v, u, a, z, starts, owner)


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -4, 4).astype(np.float32)


def predict(model: dict[str, np.ndarray], x: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Score of each bag; 0 for one without passages."""
    out = np.zeros(len(number))
    full = number > 0
    if full.any():
        out[full] = model["share"][0] if "share" in model else _forward(model, _scaled(x, model["mean"], model["scale"]), number[full])[0]
    return out


def gradient(model: dict[str, np.ndarray], x: np.ndarray, number: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted log loss of the bags' labels."""
    p, (h, v, u, a, z, starts, owner) = _forward(model, x, number)
    d = (p - y) * weight
    dz = d[:, None] * model["out"]
    dh = dz[owner] * a[:, None]
    da = (h * dz[owner]).sum(axis=1)
    dr = a * (da - np.add.reduceat(a * da, starts)[owner])
    dvu = dr[:, None] * model["att_w"]
    dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
    dh += dv @ model["att_v"].T + du @ model["att_u"].T
    dx = dh * (1 - h * h)
    return {"enc": x.T @ dx, "enc_b": dx.sum(axis=0), "att_v": h.T @ dv, "att_u": h.T @ du, "att_w": (v * u).T @ dr, "out": z.T @ d, "out_b": d.sum(keepdims=True)}


def train(x: np.ndarray, number: np.ndarray, label: np.ndarray, share: float | None = None, *, steps: int = 160, rate: float = 0.01, decay: float = 1e-2, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit by full-batch Adam; label 1 weighs ``share`` of all, by default its share of ``label``."""
    if len(label) == 0 or label.min() == label.max():
        return {"share": np.array([float(label.mean()) if len(label) else 0.5])}
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = _scaled(x, mean, scale)
    shapes = {"enc": (x.shape[1], HIDDEN), "enc_b": (HIDDEN,), "att_v": (HIDDEN, GATE), "att_u": (HIDDEN, GATE), "att_w": (GATE,), "out": (HIDDEN,), "out_b": (1,)}
    model = {k: (rng.standard_normal(s) / np.sqrt(s[0]) if not k.endswith("_b") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    y = label.astype(np.float32)
    share = float(y.mean()) if share is None else share
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()).astype(np.float32)
    for step in range(1, steps + 1):
        for k, g in gradient(model, x, number, y, weight).items():
            g = g + decay * model[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            model[k] = (model[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model | {"mean": mean.astype(np.float32), "scale": scale.astype(np.float32)}


def held_out(key: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in minhash.parts(batch.column(2), 500_000):
            x, number = passages(*minhash.text_bytes(texts))
            starts = np.cumsum(number) - number
            rows = [x[s : s + n].astype(np.float16).tobytes() for s, n in zip(starts, number)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(rows, pa.binary())], names=["doc_id", "label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, class_words: int = CLASS_WORDS) -> dict[str, np.ndarray]:
    """A model from a bounded sample: the labelled documents of each label that come first by a hash of their id, one row of each, at most ``per_class`` with ``class_words`` words in all."""
    work = Scratch(docs.sparkSession, "quality")
    told = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    told = told.filter(~held_out(F.col("doc_id")))
    told = work.save(told, "told")
    ones = told.agg(F.avg("label")).first()[0]
    chosen = None
    for value in (0, 1):
        # A top-k of fixed size, so the tables below are bounded by 2 * per_class rows.
        top = told.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = top if chosen is None else chosen.unionByName(top)
    chosen = work.save(chosen, "chosen")
    sample = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    # One row of each id, whatever their number, so at most 2 * per_class rows reach the driver.
    sample = sample.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"))).alias("text"))
    sample = work.save(sample.withColumn("words", word_count(F.col("text"))), "sample")
    # Shorter documents first: the sum stops only before the long ones, and the shortest of a label always stays.
    by_length = W.partitionBy("label").orderBy("words", F.xxhash64("doc_id"), "doc_id")
    upto, nth = F.sum("words").over(by_length.rowsBetween(W.unboundedPreceding, 0)), F.row_number().over(by_length)
    few = sample.select("doc_id", "label", "words").withColumns({"upto": upto, "nth": nth}).filter((F.col("upto") <= class_words) | (F.col("nth") == 1))
    few = work.save(few.select("doc_id"), "few")
    sample = sample.select("doc_id", "label", "text").join(F.broadcast(few), "doc_id").select("doc_id", "label", "text")
    rows = sample.mapInArrow(_bags, "doc_id long, label int, bag binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["bag"]))
    held = [(np.frombuffer(r["bag"], np.float16).reshape(-1, WIDTH), r["label"]) for r in rows if r["bag"]]
    work.drop("told", "chosen", "sample", "few")
    x = np.concatenate([h[0] for h in held]).astype(np.float32) if held else np.zeros((0, WIDTH), np.float32)
    return train(x, np.array([len(h[0]) for h in held], np.int64), np.array([h[1] for h in held]), ones)


def score(docs: DataFrame, model: dict[str, np.ndarray], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every document, from all of its passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in minhash.parts(batch.column(1), 500_000):
                got = predict(model, *passages(*minhash.text_bytes(texts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(got, pa.float64())], names=["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: dict[str, np.ndarray], *, text: str = "text", least: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score below ``least``; scored where they are read, without a join."""
    slots = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*slots)
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in minhash.parts(batch.column(at_text), 500_000):
                good = predict(model, *passages(*minhash.text_bytes(texts))) >= least
                yield batch.slice(at, len(texts)).filter(pa.array(good))

    bounded_batches(docs.sparkSession)
    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)
