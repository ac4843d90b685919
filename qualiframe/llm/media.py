"""Texts as media columns: each text is stored as a Matroska file, parsed again and described.

Defined cases: a null text is the empty text; the payload of an empty text is one frame of spaces;
equal texts give equal files; a text is handled whole, one row at a time, so a very long one needs
some ten times its size in its task; repeated rows stay repeated; an empty table gives an empty
table; columns beyond id and text are not read, whatever their names.  A null file has no packets; a
broken one has a single row with what is wrong with it in ``error``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import matroska
from .scratch import bounded_batches

PACKETS = "doc_id long, packet long, track int, timestamp_ns long, is_key boolean, start long, end long, error string"
MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_payload(text: str | None, unit: int = matroska.FRAME) -> tuple[bytes, int]:
    """UTF-8 bytes with spaces up to a positive multiple of ``unit``, and their number without the spaces."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (unit - len(raw) if not raw else -len(raw) % unit), len(raw)


def feature(movie: matroska.Movie, data: bytes, payload: bytes) -> str:
    """Track, counts and signal figures of a parsed file, all from the bytes that were read back."""
    t = movie.tracks[1]
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(samples.mean(dtype=np.float64))
    crossings = int(np.count_nonzero(np.diff(samples >= 128)))
    good = len({position for _, _, position in movie.cues} & set(movie.clusters))
    return (
        f"codec={t.codec};rate={t.rate:.0f};channels={t.channels};bits={t.bits};packets={len(movie.packets)};clusters={len(movie.clusters)};cues={good};"
        f"lacing={'/'.join(map(str, movie.laced))};keys={sum(p[2] for p in movie.packets)};end_ns={movie.packets[-1][1] + t.frame_ns};"
        f"mean={mean:.4f};std={float(samples.std(dtype=np.float64)):.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};crossings={crossings}"
    )


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split(" ")[0] for x in MEDIA.split(",")]
    for batch in batches:
        rows: dict[str, list] = {n: [] for n in names}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            payload, n = to_payload(text.as_py())
            data = matroska.write(payload)
            movie = matroska.parse(data)
            back = matroska.payload_of(data, movie)
            tail = b"".join(data[a:b] for _, _, _, a, b in movie.packets[-1:])[-16:]
            row = (doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature(movie, data, back))
            for name, value in zip(names, row):
                rows[name].append(value)
        kinds = {"doc_id": pa.int64(), "payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array(rows[n], kinds.get(n, pa.int64())) for n in names], names=names)


def describe_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: sizes and digests of payload and file, and its features."""
    bounded_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text").mapInArrow(_describe, MEDIA)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): each text as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([matroska.write(to_payload(value.as_py())[0])], pa.binary())], names=["doc_id", "media"])

    return docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of (doc_id, media): track, timestamp, key flag and byte range in the file; a broken file has one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "packet", "track", "timestamp_ns", "is_key", "start", "end", "error"]
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1)):
                if (data := value.as_py()) is None:
                    continue
                try:
                    rows, error = matroska.parse(data).packets, None
                except matroska.MatroskaError as e:
                    rows, error = [(None,) * 5], str(e)
                columns = [[doc.as_py()] * len(rows), [None] if error else list(range(len(rows))), *([r[i] for r in rows] for i in range(5)), [error] * len(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return media.select("doc_id", "media").mapInArrow(run, PACKETS)
