"""Removal of byte strings that repeat across documents, by sorting suffixes.

Every window of ``span`` bytes has an anchor: the 16 bytes inside it whose hash is least (the first
of equals).  Equal windows have equal anchors at equal places, so only the suffixes that start at
anchors are sorted, about one byte in eighteen, and of these only anchors met in two documents.

1. Texts are written once as chunks of some megabytes.
2. Chunks exchange anchor hashes and learn, as bit maps, which of theirs another document has and
   which of these are hot, that is have so many different surroundings that they would fill a task.
3. Each chunk sorts its anchor suffixes by (share, right context, left context read backwards) and
   sends front-coded runs.  Shares are ranges of the anchor's hash, so the order is global over
   shares and lexical within one.  Runs are merged by loser trees that keep, for each waiting suffix,
   the prefix it is known to share with the last winner and compare only what lies behind it.
4. A run is cut into at most ``FAN`` parts at a time.  Where there are more shares than that, merging
   takes several levels, each of which joins the runs of some chunks before the next cut, so runs
   stay long at any size; a task merges about the text of one share at each level.
5. The merged order with its common prefixes gives, for each window, the smallest document that has
   it; the chunks turn that into removed byte ranges.
6. Windows at hot anchors are not sorted in one task: their 128-bit hashes, once a chunk, are grouped
   by Spark with partial aggregates, and the smallest documents go back to the chunks.

Nothing depends on how chunks are cut.  Sorted windows are compared byte by byte; only those at hot
anchors are equal by hash.  Rows of the hash exchange grow with chunks times parts until each holds
one hash, so they stay within a constant factor of the anchors.

Defined cases: a null text is empty; texts shorter than a window stay; a text keeps what it repeats
only within itself; rows with one doc_id do not remove each other's bytes; a row without doc_id
removes nothing and loses what any numbered document has; a text longer than a chunk is a chunk of
its own, so it needs some twenty times its size in one task; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import _GOLD, mixed, text_bytes
from .scratch import Scratch

ANCHOR, CHUNK, BLOCK, SHARE = 16, 4_000_000, 900_000, 4_000_000
#: Parts that a run is cut into at once; shares that exchange their hashes in one task.
FAN, HASH_SHARES = 512, 4
#: A hash is hot above this many marks: one for each two chunks or documents, one for each eight surroundings in a chunk.
HOT, PER_MARK = 4096, 8
#: Suffixes whose windows are resolved at a time.
RESOLVED = 50_000
_NONE = np.iinfo(np.int64).max


# ---- anchors ---------------------------------------------------------------------------------


def _block(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, document, hash) of each run of windows with one anchor."""
    n = len(data)
    if n < span:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    word = data.astype(np.uint64)
    for width in (1, 2, 4):
        word = word[:-width] | word[width:] << np.uint64(8 * width)
    hashed = word[:-8] * _GOLD
    hashed ^= hashed >> np.uint64(32)
    hashed += word[8:]
    hashed = mixed(hashed)
    # The place in the low bits makes the first of equal hashes the least.
    least = hashed & ~np.uint64(0xFFFFF) | np.arange(len(hashed), dtype=np.uint64)
    reach, width = span - ANCHOR + 1, 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    place = (least & np.uint64(0xFFFFF)).astype(np.int64)
    edge = np.zeros(len(place) + 1, np.int64)
    long = np.diff(offsets) >= span
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - span + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    anchor = place[first]
    # What stands at both ends tells most surroundings of an anchor apart.
    ends = mixed(word[first]) + word[last + span - 8]
    # Anchors have low hashes, as each is a least one; mixed once more, they are spread evenly over the tasks.
    return anchor, first, last, np.searchsorted(offsets, first, "right") - 1, mixed(hashed[anchor]), ends


def scan(data: np.ndarray, offsets: np.ndarray, span: int) -> list[np.ndarray]:
    """``_block`` over a chunk, in blocks; documents above a block are read in overlapping pieces."""
    found, doc = [], 0
    while doc < len(offsets) - 1:
        to = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + BLOCK, "right")) - 1)
        begin, end = int(offsets[doc]), int(offsets[to])
        if end - begin <= BLOCK:
            pieces = [(begin, end, offsets[doc : to + 1])]
        else:
            pieces = [(s, min(s + BLOCK + span - 1, end), None) for s in range(begin, end, BLOCK)]
        for s, e, own in pieces:
            a, p, q, d, *two = _block(data[s:e], (own if own is not None else np.array([s, e])) - s, span)
            found.append((a + s, p + s, q + s, d + doc, *two))
        doc = to
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64 if i > 3 else np.int64) for i in range(6)]


def _part(hashes: np.ndarray, shares: int) -> np.ndarray:
    """Task of a hash; it never falls as the hash grows."""
    return ((hashes >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


def _slices(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(task, from, to) of equal neighbours."""
    cuts = np.flatnonzero(np.diff(parts)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)]):
        if hi > lo:
            yield int(parts[lo]), lo, hi


# ---- chunks ----------------------------------------------------------------------------------


def _chunks(limit: int):
    return lambda batches: _chunked(batches, limit)


def _chunked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    number, ids, sizes, data, held = TaskContext.get().partitionId() << 32, [], [], [], 0

    def full() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        row = [[number], [np.concatenate(ids).tobytes()], [offsets.tobytes()], [b"".join(data)]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["chunk", "ids", "offsets", "data"])

    for batch in batches:
        keys = batch.column(0).fill_null(_NONE).to_numpy()
        raw, offsets = text_bytes(batch.column(1))
        at = 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit - held, "right")) - 1)
            ids.append(keys[at:to])
            sizes.append(np.diff(offsets[at : to + 1]))
            data.append(raw[offsets[at] : offsets[to]].tobytes())
            held += len(data[-1])
            at = to
            if held >= limit or at < len(keys):
                yield full()
                number, ids, sizes, data, held = number + 1, [], [], [], 0
    if ids:
        yield full()


def _opened(batch: pa.RecordBatch):
    """(chunk, doc ids, offsets, bytes, row) of each chunk of a batch that starts with these columns."""
    for i in range(len(batch)):
        chunk, ids, offsets, data = (batch.column(c)[i] for c in range(4))
        yield chunk.as_py(), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(offsets.as_buffer(), np.int64), np.frombuffer(data.as_buffer(), np.uint8) if len(data.as_buffer()) else np.zeros(0, np.uint8), i


# ---- which anchors repeat --------------------------------------------------------------------


def _marks(hashes: np.ndarray, docs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted hashes of a chunk: once, or twice if two documents have one, and once more for each ``PER_MARK`` surroundings."""
    order = np.lexsort((ends, hashes))
    h, e = hashes[order], ends[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (e[1:] != e[:-1])
    known, surroundings = np.unique(h[new], return_counts=True)
    starts = np.searchsorted(h, known)
    d = docs[order]
    if len(known):
        times = 1 + (np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)) + surroundings // PER_MARK
        return np.repeat(known, times)
    return known


def _send_hashes(span: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, offsets, data, _ in _opened(batch):
                _, _, _, docs, hashes, ends = scan(data, offsets, span)
                hashes = _marks(hashes, ids[docs], ends)
                rows = [(t, hashes[lo:hi].tobytes()) for t, lo, hi in _slices(_part(hashes, parts))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["t", "chunk", "hashes"])

    return run


def _repeated(hot: int):
    """Bits for each hash of a chunk and part: whether another document has it, and whether it is hot."""

    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        out = []
        for chunk, t, x in zip(table.column("chunk").to_pylist(), table.column("t").to_pylist(), lists):
            got = counts[np.searchsorted(values, np.unique(x))]
            if (got > 1).any():
                out.append((chunk, t, np.packbits((got > 1) & (got <= hot)).tobytes(), np.packbits(got > hot).tobytes() if (got > hot).any() else None))
        kinds = {"chunk": pa.int64(), "t": pa.int64(), "bits": pa.binary(), "hot": pa.binary()}
        return pa.table({k: pa.array([o[i] for o in out], kind) for i, (k, kind) in enumerate(kinds.items())})

    return run


def _chosen(hashes: np.ndarray, told: pa.Array | None, parts: int, name: str) -> np.ndarray:
    """Which of these hashes have their bit set in ``told``, rows of (t, bits, hot) of one chunk."""
    known = np.unique(hashes)
    flags = np.zeros(len(known), bool)
    at = {} if told is None else {t: i for i, t in enumerate(told.field("t").to_pylist())}
    bits = None if told is None else told.field(name)
    for t, lo, hi in _slices(_part(known, parts)):
        if t in at and bits[at[t]].is_valid:
            flags[lo:hi] = np.unpackbits(np.frombuffer(bits[at[t]].as_buffer(), np.uint8), count=hi - lo).astype(bool)
    return flags[np.searchsorted(known, hashes)] if len(known) else np.zeros(0, bool)


# ---- suffix runs -----------------------------------------------------------------------------

#: Bytes of the share's number in front of a suffix.
HEAD = 4
RUNS = "t long, g long, n long, run binary, low binary, high binary, chunks binary, which binary, nth binary"


def _width(span: int) -> int:
    return -(-(HEAD + 2 * span - ANCHOR + 2) // 8) * 8


class Suffixes:
    """Distinct anchor suffixes of a chunk in the order (share, bytes), and where they occur."""

    def __init__(self, ids, offsets, data, told: pa.Array | None, span: int, shares: int, parts: int):
        anchor, first, last, docs, hashes, _ = scan(data, offsets, span)
        use = _chosen(hashes, told, parts, "bits")
        anchor, first, last, docs, hashes = anchor[use], first[use], last[use], docs[use], hashes[use]
        ahead, back, n = span, span - ANCHOR, len(anchor)
        self.width = _width(span)
        rows = np.zeros((n, self.width), np.uint8)
        right, left = last + span - anchor, anchor - first
        for lo in range(0, n, 20_000):
            s = slice(lo, lo + 20_000)
            a, b = np.arange(ahead), np.arange(back)
            rows[s, HEAD : HEAD + ahead] = np.where(a < right[s, None], data[np.minimum(anchor[s, None] + a, len(data) - 1)], 0)
            rows[s, HEAD + ahead : HEAD + ahead + back] = np.where(b < left[s, None], data[np.maximum(anchor[s, None] - 1 - b, 0)], 0)
        rows[:, :HEAD] = _part(hashes, shares).astype(">u4").view(np.uint8).reshape(-1, HEAD)
        rows[:, -2], rows[:, -1] = right, left
        del hashes, first, last, right, left
        columns = rows.view(">u8")
        order = np.lexsort([columns[:, c] for c in range(columns.shape[1] - 1, -1, -1)]) if n else np.zeros(0, np.int64)
        rows = rows[order]
        shared = np.zeros(n, np.int64)
        for lo in range(1, n, 20_000):
            other = rows[lo : lo + 20_000] != rows[lo - 1 : min(lo + 20_000, n) - 1]
            shared[lo : lo + 20_000] = np.where(other.any(axis=1), other.argmax(axis=1), self.width)
        starts = np.flatnonzero(shared < self.width)
        #: distinct suffixes; common prefix with the one before; smallest and largest document
        self.rows, self.shared = rows[starts], shared[starts]
        which = ids[docs[order]]
        self.low = np.minimum.reduceat(which, starts) if n else which
        self.high = np.maximum.reduceat(which, starts) if n else which
        #: occurrences by suffix: ends of each suffix's part, anchors and documents
        self.ends = np.append(starts[1:], n) if n else starts
        self.anchors, self.docs = anchor[order], which


def _levels(shares: int, fan: int) -> tuple[int, int]:
    """(levels, parts that each of them cuts a run into): as few levels as ``fan`` allows, with parts as even as can be.

    Runs cut by ranges of ``unit`` shares come from ``unit`` groups of chunks, so what one task merges is
    about the text of one share at every level.
    """
    levels = 1
    while fan**levels < shares:
        levels += 1
    step = max(1, math.ceil(shares ** (1 / levels)))
    while step**levels < shares:
        step += 1
    return levels, step


def _share_of(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :HEAD]).view(">u4").ravel().astype(np.int64)


def _front_coded(rows: np.ndarray, shared: np.ndarray) -> bytes:
    """Shared lengths and tails of sorted suffixes; one that equals the one before has no row."""
    width, shared = rows.shape[1], shared.copy()
    shared[0] = 0
    tails = rows[np.arange(width) >= shared[shared < width, None]]
    return zstandard.ZstdCompressor(level=1).compress(shared.astype(np.uint8).tobytes() + tails.tobytes())


def _of_told(batch: pa.RecordBatch, column: int, i: int) -> pa.Array | None:
    value = batch.column(column)[i]
    return value.values if value.is_valid else None


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _send_runs(span: int, shares: int, parts: int, unit: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, offsets, data, i in _opened(batch):
                own = Suffixes(ids, offsets, data, _of_told(batch, 4, i), span, shares, parts)
                g = int(mixed(np.array([chunk], np.uint64))[0] % np.uint64(groups))
                out = []
                for t, lo, hi in _slices(_share_of(own.rows) // unit):
                    out.append((t, g, hi - lo, _front_coded(own.rows[lo:hi], own.shared[lo:hi]), own.low[lo:hi].tobytes(), own.high[lo:hi].tobytes(), np.array([chunk]).tobytes(), b"", np.arange(lo, hi, dtype=np.int32).tobytes()))
                yield _batch(out, RUNS)

    return run


def unpack(n: int, run: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """(prefix shared with the one before, bytes) of each suffix of a front-coded run."""
    raw, at, before = zstandard.ZstdDecompressor().decompress(run), n, b""
    for i in range(n):
        shared = raw[i]
        to = at + width - shared
        before = before[:shared] + raw[at:to]
        at = to
        yield shared, before


def mismatch(x: bytes, y: bytes, at: int, width: int) -> int:
    """First place from ``at`` on where x and y differ, ``width`` if none; bytes before ``at`` are not read."""
    while at < width:
        p, q = x[at : at + 16], y[at : at + 16]
        if p != q:
            return at + len(p) - 1 - ((int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_length() - 1 >> 3)
        at += 16
    return width


def merge(runs: list[Iterator[tuple[int, bytes]]], width: int) -> Iterator[tuple[int, int, bytes]]:
    """(run, prefix shared with the last one given, bytes) of all suffixes in order.

    A loser tree.  With each waiting suffix goes the length of the prefix it shares with the last
    winner: of two, the one that shares more is smaller, and only on a tie are bytes behind that
    prefix compared, which also tells what the loser shares with the new winner.
    """
    size = 1
    while size < len(runs):
        size *= 2
    text: list = [next(r, (0, None))[1] for r in runs] + [None] * (size - len(runs))
    shared = [0] * size
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is then the one shared with the winner."""
        x, y = text[a], text[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        known = shared[a]
        if known != shared[b]:
            return (a, b) if known > shared[b] else (b, a)
        common = mismatch(x, y, known, width)
        if common == width or x[common] < y[common]:
            shared[b] = common
            return a, b
        shared[a] = common
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if size > 1 else 0
    while text[winner] is not None:
        yield winner, shared[winner], text[winner]
        shared[winner], text[winner] = next(runs[winner], (0, None))
        node = (winner + size) >> 1
        while node:
            winner, loser[node] = play(winner, loser[node])
            node >>= 1


class Merged:
    """All suffixes of a table of runs in order: shared prefixes, texts of different ones, documents, chunk and place in it."""

    def __init__(self, table: pa.Table, width: int):
        counts = table.column("n").to_pylist()
        source, shared, texts = array("i"), bytearray(), bytearray()
        runs = [unpack(n, r.as_buffer(), width) for n, r in zip(counts, table.column("run"))]
        for r, s, text in merge(runs, width):
            source.append(r)
            shared.append(s)
            if s < width:
                texts += text
        del runs
        source = np.frombuffer(source, np.int32) if len(source) else np.zeros(0, np.int32)
        self.shared = np.frombuffer(shared, np.uint8).astype(np.int64)
        self.rows = np.frombuffer(texts, np.uint8).reshape(-1, width)
        # Within its run a suffix has the place of its turn, as runs are sorted.
        order = np.argsort(source, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))

        def column(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])

        self.low, self.high, self.nth = column("low", np.int64)[back], column("high", np.int64)[back], column("nth", np.int32)[back]
        chunk = []
        for n, names, which in zip(counts, table.column("chunks"), table.column("which")):
            names, which = np.frombuffer(names.as_buffer(), np.int64), np.frombuffer(which.as_buffer(), np.int32)
            chunk.append(names[which] if len(which) else np.repeat(names, n))
        self.chunk = np.concatenate(chunk)[back]


def _forwarded(span: int, unit: int, fan: int):
    """The runs of a group merged and cut again, into parts of ``unit`` shares."""

    def run(table: pa.Table) -> pa.Table:
        all_, out = Merged(table, _width(span)), []
        row = np.cumsum(all_.shared < _width(span)) - 1
        g = table.column("g")[0].as_py() // fan
        for t, lo, hi in _slices((_share_of(all_.rows) // unit)[row]):
            names, which = np.unique(all_.chunk[lo:hi], return_inverse=True)
            coded = _front_coded(all_.rows[row[lo] : row[hi - 1] + 1], all_.shared[lo:hi])
            out.append((t, g, hi - lo, coded, all_.low[lo:hi].tobytes(), all_.high[lo:hi].tobytes(), names.tobytes(), which.astype(np.int32).tobytes() if len(names) > 1 else b"", all_.nth[lo:hi].tobytes()))
        return pa.Table.from_batches([_batch(out, RUNS)])

    return run


def _least_documents(rows: np.ndarray, shared: np.ndarray, low: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(suffix, first, last offset, document) for distinct sorted suffixes: the smallest document with a window, by how far before its anchor it starts."""
    left = span - ANCHOR
    right_len, left_len = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    group = np.cumsum(shared < HEAD + ANCHOR) - 1
    alone = np.bincount(group)[group] == 1
    where, from_, to, doc = [np.flatnonzero(alone)], [span - right_len[alone]], [left_len[alone]], [low[alone]]
    many = np.flatnonzero(~alone)
    if len(many):
        best = np.full((len(many), left + 1), _NONE)
        inside = np.zeros((len(many), left + 1), bool)
        back = np.zeros(len(many), np.int64)
        for o in range(left + 1):
            if o:
                # Classes of equal left contexts, one byte longer each time.
                back = np.unique(back << 8 | rows[many, HEAD + span + o - 1], return_inverse=True)[1]
            has = (left_len[many] >= o) & (span - right_len[many] <= o)
            if not has.any():
                continue
            # Windows are equal if what follows the anchor is (a class of the sorted order) and what precedes it.
            key = np.cumsum(shared < HEAD + span - o)[many] * (len(many) + 1) + back
            some = np.flatnonzero(has)
            order = np.argsort(key[some], kind="stable")
            k = key[some][order]
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            least = np.minimum.reduceat(low[many][some][order], starts)
            best[some[order], o] = np.repeat(least, np.diff(np.append(starts, len(k))))
            inside[some, o] = True
        change = inside.copy()
        change[:, 1:] &= ~inside[:, :-1] | (best[:, 1:] != best[:, :-1])
        stop = inside.copy()
        stop[:, :-1] &= ~inside[:, 1:] | (best[:, 1:] != best[:, :-1])
        r, o1 = np.nonzero(change)
        _, o2 = np.nonzero(stop)
        where.append(many[r])
        from_.append(o1)
        to.append(o2)
        doc.append(best[r, o1])
    return tuple(np.concatenate(x) for x in (where, from_, to, doc))


def _resolved(rows: np.ndarray, shared: np.ndarray, low: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """``_least_documents``, some whole anchors at a time."""
    begins = np.append(np.flatnonzero(shared < HEAD + ANCHOR), len(rows))
    found, lo = [], 0
    while lo < len(rows):
        hi = int(begins[max(np.searchsorted(begins, lo, "right"), np.searchsorted(begins, lo + RESOLVED, "right") - 1)])
        some = shared[lo:hi].copy()
        some[0] = 0
        where, *rest = _least_documents(rows[lo:hi], some, low[lo:hi], span)
        order = np.argsort(where, kind="stable")
        found.append((where[order] + lo, *(x[order] for x in rest)))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found))


def _answers(span: int):
    """What each chunk has to remove: (place of the suffix in the chunk, first, last offset, document that has the windows)."""
    width = _width(span)
    schema = "chunk long, nth binary, first binary, last binary, doc binary"

    def run(table: pa.Table) -> pa.Table:
        all_ = Merged(table, width)
        new = all_.shared < width
        starts, unique = np.flatnonzero(new), np.cumsum(new) - 1
        where, first, last, doc = _resolved(all_.rows, all_.shared[starts], np.minimum.reduceat(all_.low, starts), span)
        per = np.bincount(where, minlength=len(starts))
        begin = np.cumsum(per) - per
        times = per[unique]
        element = np.repeat(np.arange(len(unique)), times)
        answer = np.repeat(begin[unique] - (np.cumsum(times) - times), times) + np.arange(len(element))
        keep = doc[answer] < all_.high[element]
        element, answer = element[keep], answer[keep]
        by = np.argsort(all_.chunk[element], kind="stable")
        element, answer = element[by], answer[by]
        out = []
        for chunk, lo, hi in _slices(all_.chunk[element]):
            e, a = element[lo:hi], answer[lo:hi]
            out.append((chunk, all_.nth[e].tobytes(), first[a].astype(np.uint8).tobytes(), last[a].astype(np.uint8).tobytes(), doc[a].tobytes()))
        return pa.Table.from_batches([_batch(out, schema)])

    return run


# ---- windows at hot anchors ------------------------------------------------------------------


def _hot_windows(ids, offsets, data, told: pa.Array | None, span: int, parts: int) -> tuple[np.ndarray, ...]:
    """(start, document, two hashes) of each window whose anchor is hot."""
    _, first, last, docs, hashes, _ = scan(data, offsets, span)
    use = _chosen(hashes, told, parts, "hot")
    first, docs, times = first[use], docs[use], (last - first + 1)[use]
    start = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    one, two = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for k in range(span):
        byte = data[start + k].astype(np.uint64) + np.uint64(1)
        one = one * _GOLD + byte
        two = (two ^ byte) * np.uint64(0x100000001B3)
    return start, ids[np.repeat(docs, times)], mixed(one), mixed(two)


def _send_windows(span: int, parts: int):
    """(chunk, h1, h2, low, high) of each different window at a hot anchor of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, offsets, data, i in _opened(batch):
                _, doc, one, two = _hot_windows(ids, offsets, data, _of_told(batch, 4, i), span, parts)
                order = np.lexsort((two, one))
                one, two, doc = one[order], two[order], doc[order]
                starts = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else np.zeros(0, np.int64)
                low, high = (f.reduceat(doc, starts) if len(starts) else doc for f in (np.minimum, np.maximum))
                arrays = [pa.array(np.full(len(starts), chunk)), pa.array(one[starts].view(np.int64)), pa.array(two[starts].view(np.int64)), pa.array(low), pa.array(high)]
                yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "h1", "h2", "low", "high"])

    return run


# ---- removal ---------------------------------------------------------------------------------


def _remove_sorted(edge: np.ndarray, ids, offsets, data, told, answers: pa.Array, span: int, shares: int, parts: int) -> None:
    own = Suffixes(ids, offsets, data, told, span, shares, parts)
    begins = np.concatenate([[0], own.ends[:-1]])
    kinds = (("nth", np.int32), ("first", np.uint8), ("last", np.uint8), ("doc", np.int64))
    parts = [[np.frombuffer(x.as_buffer(), kind) for x in answers.field(k)] for k, kind in kinds]
    # Answers of another share are another row; rows are the smaller the more shares there are, so some are taken at once.
    ends, lo = np.cumsum([len(x) for x in parts[0]]), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RESOLVED, "right")))
        nth, first, last, doc = (np.concatenate(x[lo:hi]) for x in parts)
        times = own.ends[nth] - begins[nth]
        answer = np.repeat(np.arange(len(nth)), times)
        place = np.repeat(begins[nth] - (np.cumsum(times) - times), times) + np.arange(len(answer))
        hit = own.docs[place] > doc[answer]
        answer, anchor = answer[hit], own.anchors[place[hit]]
        np.add.at(edge, anchor - last[answer], 1)
        np.add.at(edge, anchor - first[answer] + span, -1)
        lo = hi


def _remove_hot(edge: np.ndarray, ids, offsets, data, told, answers: pa.Array, span: int, parts: int) -> None:
    start, doc, one, two = _hot_windows(ids, offsets, data, told, span, parts)
    h1, h2, low = (answers.field(k).to_numpy() for k in ("h1", "h2", "low"))
    pair = np.dtype([("a", np.uint64), ("b", np.uint64)])
    known, asked = np.empty(len(h1), pair), np.empty(len(one), pair)
    known["a"], known["b"], asked["a"], asked["b"] = h1.view(np.uint64), h2.view(np.uint64), one, two
    both, inverse = np.unique(np.concatenate([known, asked]), return_inverse=True)
    least = np.full(len(both), _NONE)
    least[inverse[: len(known)]] = low
    hit = least[inverse[len(known) :]] < doc
    np.add.at(edge, start[hit], 1)
    np.add.at(edge, start[hit] + span, -1)


def _remove(span: int, shares: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["doc_id", "n_bytes", "starts", "ends", "kept"]
        for batch in batches:
            for _, ids, offsets, data, i in _opened(batch):
                edge = np.zeros(len(data) + 1, np.int32)
                told = _of_told(batch, 4, i)
                if (answers := _of_told(batch, 5, i)) is not None:
                    _remove_sorted(edge, ids, offsets, data, told, answers, span, shares, parts)
                if (answers := _of_told(batch, 6, i)) is not None:
                    _remove_hot(edge, ids, offsets, data, told, answers, span, parts)
                gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
                del edge, told, answers
                rows = []
                for k in range(len(ids)):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    cut = gone[a:b]
                    step = np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8))
                    kept = data[a:b].tobytes() if not cut.any() else data[a:b][~cut].tobytes()
                    rows.append((None if ids[k] == _NONE else int(ids[k]), b - a, np.flatnonzero(step == 1), np.flatnonzero(step == -1), kept))
                    if len(rows) == 500 or k == len(ids) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)
                        rows = []

    return run


def remove_repeats(docs: DataFrame, *, span: int = 50, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, share: int = SHARE, fan: int = FAN, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): maximal removed byte ranges of each text, and the bytes that stay.

    A byte goes if it lies in a string of ``span`` bytes that also starts in a document with a
    smaller doc_id, judged on the texts as they come.  ``chunk`` and ``share`` are bytes of text,
    ``fan`` and ``hot`` are as the constants say; none of them changes a result.
    """
    work = Scratch(docs.sparkSession, "suffixes")
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = work.save(base.mapInArrow(_chunks(chunk), "chunk long, ids binary, offsets binary, data binary"), "chunks", large_rows=True)
    size, n_chunks = chunks.agg(F.sum(F.length("data")), F.count(F.lit(1))).first()
    shares = max(32, math.ceil((size or 0) / share))
    parts = max(32, math.ceil(shares / HASH_SHARES))
    hashes = chunks.mapInArrow(_send_hashes(span, parts), "t long, chunk long, hashes binary")
    bits = work.save(hashes.groupBy("t").applyInArrow(_repeated(hot), "chunk long, t long, bits binary, hot binary"), "bits")
    any_hot = not bits.filter("hot is not null").isEmpty()
    told = work.save(bits.groupBy("chunk").agg(F.collect_list(F.struct("t", "bits", "hot")).alias("told")), "told", large_rows=True)
    work.drop("bits")
    known = chunks.join(work.broadcast_if_small(told, "told"), "chunk", "left").select("chunk", "ids", "offsets", "data", "told")

    levels, step = _levels(shares, fan)
    unit = step ** (levels - 1)
    runs = known.mapInArrow(_send_runs(span, shares, parts, unit, unit), RUNS)
    while unit > 1:
        unit //= step
        runs = runs.groupBy("t", "g").applyInArrow(_forwarded(span, unit, step), RUNS)
    found = work.save(runs.groupBy("t").applyInArrow(_answers(span), "chunk long, nth binary, first binary, last binary, doc binary"), "found")
    answers = work.save(found.groupBy("chunk").agg(F.collect_list(F.struct("nth", "first", "last", "doc")).alias("answers")), "answers", large_rows=True)
    work.drop("found")
    if any_hot:
        windows = work.save(known.filter(F.exists("told", lambda x: x["hot"].isNotNull())).mapInArrow(_send_windows(span, parts), "chunk long, h1 long, h2 long, low long, high long"), "windows")
        least = windows.groupBy("h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("h1", "h2", "low")
        least = work.save(least, "least")
        hit = windows.withColumnRenamed("low", "own").join(least, ["h1", "h2"]).filter("low < high")
        hot_answers = work.save(hit.groupBy("chunk").agg(F.collect_list(F.struct("h1", "h2", "low")).alias("windows")), "hot_answers", large_rows=True)
        work.drop("windows", "least")
        answers = answers.join(hot_answers, "chunk", "full").select("chunk", "answers", "windows")
    else:
        answers = answers.withColumn("windows", F.lit(None).cast("array<struct<h1:long,h2:long,low:long>>"))
    last = chunks.join(told, "chunk", "left").join(answers, "chunk", "left").select("chunk", "ids", "offsets", "data", "told", "answers", "windows")
    return last.mapInArrow(_remove(span, shares, parts), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
