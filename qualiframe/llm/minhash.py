"""Shingle sets and MinHash band keys, vectorised over whole Arrow batches.

Large sets use one permutation with bins (empty bins are filled from others by a fixed rule), small
ones a permutation for each value.  Sets near the border get the keys of both, so two sets whose
similarity reaches the threshold always have keys of one kind in common.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def bands_for(threshold: float, recall: float, values: int) -> tuple[int, int]:
    """(bands, rows): most rows a band for which ``values`` MinHash values give the recall at the threshold."""
    best = None
    for rows in range(1, 13):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= values:
            best = bands, rows
    if best is None:
        raise ValueError(f"{values} values can't give a recall of {recall}")
    return best


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each text (one more than texts); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(column: pa.Array, limit: int = 2_000_000):
    """(first row, column slice) of at most ``limit`` bytes each, or of one longer text."""
    _, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (run without ASCII white space) and the number of words of each text."""
    n = len(offsets) - 1
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    begins[1:] &= space[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    count = np.diff(np.searchsorted(starts, offsets))
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], spans)
    # Bytes behind a word, up to the next one, count as nothing.
    weight = np.where(space[starts[0] :], np.uint64(0), (data[starts[0] :].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095] + (place >> 12).astype(np.uint64))
    return mixed(np.add.reduceat(weight, starts - starts[0])), count


def windows(items: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` items within a text, and their number by text; a shorter text has one run of all its items."""
    ends = np.cumsum(count)
    number = np.maximum(count - width + 1, (count > 0).astype(count.dtype))
    if not len(items):
        return items, number
    begin = np.repeat(ends - count - (np.cumsum(number) - number), number) + np.arange(number.sum())
    stop = np.repeat(ends, number)
    out = np.zeros(len(begin), np.uint64)
    for k in range(width):
        at = begin + k
        inside = at < stop
        out = out * _GOLD + np.where(inside, items[np.minimum(at, len(items) - 1)], np.uint64(k + 1))
    return mixed(out), number


def distinct(values: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and once, and their number by text."""
    out, ends = [], np.cumsum(number)
    for lo, hi in zip((ends - number).tolist(), ends.tolist()):
        one = np.sort(values[lo:hi])
        if hi - lo > 1:
            new = np.empty(hi - lo, bool)
            new[0] = True
            np.not_equal(one[1:], one[:-1], out=new[1:])
            one = one[new]
        out.append(one)
    return (np.concatenate(out) if out else values), np.array([len(x) for x in out], np.int64)


def fingerprints(values: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set of ``distinct``; 0 for an empty set."""
    out = np.zeros(len(number), np.uint64)
    full = number > 0
    if full.any():
        starts = (np.cumsum(number) - number)[full]
        total = np.add.reduceat(mixed(values + _GOLD), starts)
        both = np.bitwise_xor.reduceat(values, starts)
        out[full] = mixed(total ^ mixed(both ^ number[full].astype(np.uint64)))
    return out


def _permuted(values: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    starts = np.cumsum(number) - number
    out = np.empty((len(number), k), np.uint64)
    factors = mixed(np.arange(1, k + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    turned = np.empty_like(values)
    for j in range(k):
        np.multiply(values, factors[j], out=turned)
        out[:, j] = np.minimum.reduceat(turned, starts)
    return out


def _binned(values: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    owner = np.repeat(np.arange(len(number)), number)
    bins = ((values >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    out = np.full(len(number) * k, _EMPTY)
    np.minimum.at(out, owner * k + bins, values)
    out = out.reshape(len(number), k)
    given, empty = out.copy(), out == _EMPTY
    rows, cols = np.nonzero(empty)
    for turn in range(1, 65):
        if not len(rows):
            break
        source = (mixed(cols.astype(np.uint64) * np.uint64(65) + np.uint64(turn)) % np.uint64(k)).astype(np.int64)
        got = given[rows, source]
        have = got != _EMPTY
        out[rows[have], cols[have]] = got[have]
        rows, cols = rows[~have], cols[~have]
    for step in range(1, k):  # what 64 draws have not met: the next full bin
        if not len(rows):
            break
        got = given[rows, (cols + step) % k]
        have = got != _EMPTY
        out[rows[have], cols[have]] = got[have]
        rows, cols = rows[~have], cols[~have]
    return out


def _keys(signature: np.ndarray, bands: int, rows: int, kind: int) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), (kind * 1000 + b + 1) * 0x9E3779B9, np.uint64)
        for r in range(rows):
            key = mixed(key * _GOLD + signature[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def band_keys(values: np.ndarray, number: np.ndarray, bands: int, rows: int, threshold: float = 0.8, cut: int = 256) -> list[np.ndarray]:
    """Band keys of each set: permuted for sets up to ``cut``, binned from ``threshold`` times ``cut``, so those between have both."""
    k = bands * rows
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(number)
    owner_of = np.repeat(number, number)
    for kind, chosen, mask in (
        (0, (number > 0) & (number <= cut), (owner_of <= cut)),
        (1, number >= max(1, math.floor(cut * threshold)), owner_of >= max(1, math.floor(cut * threshold))),
    ):
        which = np.flatnonzero(chosen)
        if not len(which):
            continue
        signature = (_binned if kind else _permuted)(values[mask], number[which], k)
        for i, keys in zip(which, _keys(signature, bands, rows, kind)):
            out[i] = np.concatenate([out[i], keys]) if len(out[i]) else keys
    return out


def _add_common(common: np.ndarray, sets: list[np.ndarray]) -> None:
    """Add the number of values that each two sets share."""
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = counts[inverse] > 1
    column, owner = column[inverse[kept]], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(columns, max(256, 4_000_000 // len(sets)))
    for at in range(0, columns, max(1, width)):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        common += block @ block.T


def jaccard_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Symmetric matrix: which two of these sorted sets reach the threshold exactly."""
    t = Fraction(str(threshold))
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = common * t.denominator >= t.numerator * (int(sizes.sum()) - common) and common > 0
        return np.array([[False, hit], [hit, False]])
    common = np.zeros((len(sets), len(sets)), np.float64)
    # Values are compared range by range, so memory beyond the sets themselves is bounded.
    ranges = -(-int(sizes.sum()) // 500_000)
    edges = np.array([(1 << 64) * k // ranges for k in range(1, ranges)], np.uint64)
    cuts = np.array([[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets])
    for k in range(ranges):
        _add_common(common, [s[lo:hi] for s, lo, hi in zip(sets, cuts[:, k], cuts[:, k + 1])])
    common = common.astype(np.int64)
    hit = (common * t.denominator >= t.numerator * (sizes[:, None] + sizes[None, :] - common)) & (common > 0)
    np.fill_diagonal(hit, False)
    return hit
