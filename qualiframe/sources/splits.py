"""Places of rows in files, and CSV records whose quoted cells hold line breaks, over byte ranges read in parallel.

A file is read in byte ranges (splits).  What a range does to the reader's state, inside or outside
of a quoted cell, is a function of two values, so all ranges are surveyed at once for both; a scan
over the ranges, one small row each, then fixes the state at the start of each, and with it which
lines start records, how many come before and which range holds the start of a record that goes on.
A second pass cuts each range into records by its own lines; the pieces of a record that crosses
ranges are put together by a grouping of at most two pieces a range.  Records and ids are the same
however the files are split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BOM = b"\xef\xbb\xbf"


def _free(name: str, taken: list[str]) -> str:
    low = {t.lower() for t in taken}
    while name in low:
        name += "_"
    return name


def path_order(df: DataFrame) -> dict[int, int]:
    """Rank in order of paths by the hash of a path as Spark tells it in ``_metadata``."""
    # the two name the root of a store differently
    paths = [(p, i) for i, one in enumerate(sorted(df.inputFiles())) for p in {one, one.replace(":///", ":/")}]
    return {r["hash"]: r["rank"] for r in df.sparkSession.createDataFrame(paths, "path string, rank int").select(F.xxhash64("path").alias("hash"), "rank").collect()}


def number_rows(scan: DataFrame, name: str) -> DataFrame:
    """A plain scan of files with ``name``: the place of each row from 0, files in order of their paths.

    A row has a place in its file (Parquet) or in its byte range (text); counts of files or ranges,
    one small row each, are summed up before them.
    """
    file, block, nth, shift = (_free(n, scan.columns) for n in ("_file", "_block", "_nth", "_shift"))
    path = F.xxhash64("_metadata.file_path").alias(file)
    if "row_index" in scan.select("_metadata").schema["_metadata"].dataType.names:
        placed = scan.select("*", path, F.lit(0).cast("long").alias(block), F.col("_metadata.row_index").alias(nth))
        first = F.lit(0).cast("long")
    else:
        placed = scan.select("*", path, F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(nth))
        first = F.min(nth)
    counts = placed.groupBy(file, block).agg(F.count(F.lit(1)).alias("n"), first.alias("first")).collect()
    rank, shifts, total = path_order(scan), [], 0
    for r in sorted(counts, key=lambda r: (rank[r[file]], r[block])):
        shifts.append((r[file], r[block], total - r["first"]))
        total += r["n"]
    table = scan.sparkSession.createDataFrame(shifts, f"`{file}` long, `{block}` long, `{shift}` long")
    return placed.join(F.broadcast(table), [file, block]).select(*[F.col(f"`{c}`") for c in scan.columns], (F.col(nth) + F.col(shift)).alias(name))


class Quotes:
    """Quoted cells of lines: a quote opens a cell at its start only, doubled ones stand for themselves."""

    def __init__(self, delimiter: str):
        self.delimiter = delimiter.encode("iso-8859-1")
        d = rb"\x%02x" % self.delimiter[0]
        cell = rb'(?:"[^"]*+(?:""[^"]*+)*+"[^' + d + rb']*+|(?!")[^' + d + rb"]*+)"
        self.whole = re.compile(cell + rb"(?:" + d + cell + rb")*+")
        self.closing = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')

    def inside_after(self, line: bytes, inside: bool) -> bool:
        if inside:
            if not (found := self.closing.match(line)):
                return True
            at = line.find(self.delimiter, found.end())
            if at < 0:
                return False
            line = line[at + 1 :]
        return self.whole.fullmatch(line) is None

    def walk(self, lines: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
        """(whether each line starts inside of a quoted cell, whether the next line would); only lines with a quote are looked at."""
        before = np.empty(len(lines), bool)
        at = 0
        for i in np.flatnonzero(pc.find_substring(lines, b'"').to_numpy(zero_copy_only=False) >= 0):
            before[at : i + 1] = inside
            inside = self.inside_after(lines[int(i)].as_py(), inside)
            at = i + 1
        before[at:] = inside
        return before, inside


def _full(lines: pa.Array) -> np.ndarray:
    """Lines that are not only white space."""
    lengths = pc.binary_length(lines).to_numpy(zero_copy_only=False)
    full = lengths > 0
    first = pc.binary_slice(lines, 0, 1) if len(lines) else lines
    for i in np.flatnonzero(full & (pc.less_equal(first, pa.scalar(b" ", lines.type)).to_numpy(zero_copy_only=False))):
        full[i] = bool(lines[int(i)].as_py().strip(bytes(range(33))))
    return full


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array, bool]]:
    """((file, block, ...), lines, whether the range starts here) for rows (value, file, block, ...) in order."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        file, block = (batch.column(i).to_numpy() for i in (1, 2))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            key = tuple(batch.column(i)[a].as_py() for i in range(1, batch.num_columns))
            lines = batch.column(0).slice(a, b - a)
            fresh = key != last
            if fresh and key[1] == 0 and (top := lines[0].as_py()).startswith(_BOM):
                lines = pa.concat_arrays([pa.array([top[3:]], lines.type), lines.slice(1)])
            yield key, lines, fresh
            last = key


def _survey(quotes: Quotes):
    """(file, block, end0, starts0, end1, starts1): for a range that starts outside (0) or inside (1), whether it ends inside and how many records start in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, ends, starts, open_ = [], None, [False, True], [0, 0], [False, False]
        for at, lines, fresh in _stretches(batches):
            if fresh:
                if key is not None:
                    done.append((*key, *ends, *starts, *open_))
                key, ends, starts, open_ = at[:2], [False, True], [0, 0], [False, False]
            full = _full(lines)
            same = ends[0] == ends[1]
            for s in (0, 1):
                if s and same:
                    before = None
                else:
                    before, after = quotes.walk(lines, ends[s])
                    begun = int((~before & full).sum())
                ends[s] = after
                starts[s] += begun
                open_[s] |= begun > 0
        if key is not None:
            done.append((*key, *ends, *starts, *open_))
        names = ["file", "block", "end0", "end1", "starts0", "starts1", "open0", "open1"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)

    return run


SURVEY = "file long, block long, end0 boolean, end1 boolean, starts0 long, starts1 long, open0 boolean, open1 boolean"
PIECES = "file long, block long, nth long, piece long, text binary"


def _cut(quotes: Quotes):
    """Records (file, block, nth, text) of ranges, and with ``piece`` the parts of those that cross ranges, under the range that holds their start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, opened, count = None, False, None, 0  # opened: [owner block, nth or None, lines] of the record that is not closed yet

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([opened[0]]), pa.array([opened[1]], pa.int64()), pa.array([key[1]]), pa.array([b"\n".join(opened[2])], pa.binary())], names=_NAMES)

        for at, lines, fresh in _stretches(batches):
            if fresh:
                if opened:
                    yield piece()
                key, inside, count = at[:2], at[2], 0
                opened = [at[3], None, []] if inside else None
            before, inside = quotes.walk(lines, inside)
            begins = ~before & _full(lines)
            nth = count + np.cumsum(begins) - 1
            goes_on = np.append(before[1:], inside)
            alone = begins & ~goes_on
            texts, numbers = [lines.filter(pa.array(alone))], [nth[alone]]
            long_texts, long_numbers = [], []
            for i in np.flatnonzero(before | (begins & goes_on)):
                if begins[i]:
                    opened = [key[1], int(nth[i]), []]
                opened[2].append(lines[int(i)].as_py())
                if not goes_on[i]:
                    if opened[1] is None:
                        yield piece()
                    else:
                        long_texts.append(b"\n".join(opened[2]))
                        long_numbers.append(opened[1])
                    opened = None
            count += int(begins.sum())
            texts.append(pa.array(long_texts, pa.binary()))
            numbers = np.concatenate([*numbers, np.array(long_numbers, np.int64)])
            n = len(numbers)
            text = pa.concat_arrays([t.cast(pa.binary()) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(numbers), pa.nulls(n, pa.int64()), text], names=_NAMES)
        if opened:
            yield piece()

    return run


_NAMES = [x.split(" ")[0] for x in PIECES.split(", ")]


def quoted_records(spark: SparkSession, path: str, delimiter: str, store: str, *, header: bool = True) -> DataFrame:
    """(_row_id, text binary) of every record but headers and blank ones, cut once and stored at ``store``.

    A quote that is never closed ends with its file.  A record must fit a task, a file need not.
    """
    quotes = Quotes(delimiter)
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = scan.select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rank, states, total, last = path_order(scan), [], 0, None
    surveyed = lines.mapInArrow(_survey(quotes), SURVEY).collect()  # one row a range
    for r in sorted(surveyed, key=lambda r: (rank[r["file"]], r["block"])):
        if r["file"] != last:
            last, inside, owner, in_file = r["file"], False, r["block"], 0
        k = "1" if inside else "0"
        # id of the range's first record; -1 for a header, which is record 0 of a file
        base = total if in_file or not header else total - 1
        states.append((r["file"], r["block"], inside, owner, base, header and not in_file))
        if r[f"open{k}"]:
            owner = r["block"]
        total += r[f"starts{k}"] - (1 if header and not in_file and r[f"starts{k}"] else 0)
        in_file += r[f"starts{k}"]
        inside = r[f"end{k}"]
    table = F.broadcast(spark.createDataFrame(states, "file long, block long, inside boolean, owner long, base long, top boolean"))
    known = lines.join(table, ["file", "block"]).select("value", "file", "block", "inside", "owner")
    known.mapInArrow(_cut(quotes), PIECES).write.mode("overwrite").parquet(store)
    cut = spark.read.schema(PIECES).parquet(store)
    whole = cut.filter("piece is null").select("file", "block", "nth", "text")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda p: F.decode(p["text"], "iso-8859-1"))  # bytes as characters, to join any encoding
    joined = cut.filter("piece is not null").groupBy("file", "block").agg(F.max("nth").alias("nth"), F.encode(F.array_join(parts, "\n"), "iso-8859-1").alias("text"))
    records = whole.unionByName(joined).join(table, ["file", "block"])
    return records.filter("not (top and nth = 0)").select((F.col("base") + F.col("nth")).alias("_row_id"), "text")


# ---- delimiters --------------------------------------------------------------------------------

CELLS = "file long, block long, inside boolean, odd boolean, delimiter string, cells long, n long"
_QUOTED = re.compile(rb'"[^"]*+(?:""[^"]*+)*+"')


def _tally(candidates: list[str]):
    """How many lines have so many of each candidate outside of quotes, for ranges that start outside and inside of a quoted cell; ``odd`` tells that the range turns the state.

    Quotes come in pairs but for those of a cell that goes on in the next line, so their parity is
    the state, whatever the delimiter.  Lines that start or end inside are not counted.
    """
    marks = [c.encode("iso-8859-1") for c in candidates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[tuple, int]] = {}
        parity: dict[tuple, int] = {}
        for at, lines, _ in _stretches(batches):
            key = at[:2]
            counts = held.setdefault(key, {})
            quotes = pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False)
            after = (parity.get(key, 0) + np.cumsum(quotes)) % 2
            whole = (quotes % 2 == 0) & _full(lines)
            parity[key] = int(after[-1])
            bare = lines
            if (some := np.flatnonzero(quotes)).size:
                texts = lines.to_pylist()
                for i in some:
                    texts[i] = _QUOTED.sub(b"", texts[i])
                bare = pa.array(texts, pa.binary())
            for name, mark in zip(candidates, marks):
                found = pc.count_substring(bare, mark).to_numpy(zero_copy_only=False)
                for inside in (False, True):
                    for cells, n in zip(*np.unique(found[whole & (after == int(inside))], return_counts=True)):
                        counts[inside, name, int(cells)] = counts.get((inside, name, int(cells)), 0) + int(n)
        rows = [(*key, inside, bool(parity[key]), name, cells, n) for key, counts in held.items() for (inside, name, cells), n in counts.items()]
        rows += [(*key, False, bool(parity[key]), None, 0, 0) for key in held]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split(" ")[0] for x in CELLS.split(", ")])

    return run


def delimiter_counts(spark: SparkSession, path: str, candidates: list[str]) -> dict[str, dict[int, int]]:
    """For each candidate, how many lines have it so many times, from all lines of all ranges that no quoted cell crosses."""
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = scan.select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    tallied = lines.mapInArrow(_tally(candidates), CELLS).persist()
    rank, states, last, inside = path_order(scan), [], None, False
    for r in sorted(tallied.filter("delimiter is null").select("file", "block", "odd").collect(), key=lambda r: (rank[r["file"]], r["block"])):  # one row a range
        inside = inside if r["file"] == last else False
        last = r["file"]
        # a tally under ``inside`` holds lines whose parity counted from the range's start is odd: outside, if the range starts inside
        states.append((r["file"], r["block"], inside))
        inside ^= r["odd"]
    table = F.broadcast(spark.createDataFrame(states, "file long, block long, inside boolean"))
    counted = tallied.filter("delimiter is not null").join(table, ["file", "block", "inside"]).groupBy("delimiter", "cells").agg(F.sum("n").alias("n"))
    out: dict[str, dict[int, int]] = {c: {} for c in candidates}
    for r in counted.collect():
        out[r["delimiter"]][r["cells"]] = r["n"]
    tallied.unpersist()
    return out
