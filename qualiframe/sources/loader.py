"""Loading CSV, Excel and Parquet tables with a stable row id, and writing results.

CSV text is read by Spark with an explicit all-text schema made from the header line, then typed by
one aggregate pass over the columns.  Row ids are places in the files, whatever the number of tasks.  The delimiter and the encoding
are told from all lines and bytes.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from . import encodings, splits, xlsx
from .encodings import code_page
from .files import AS_IT_IS, folder, put_bytes


class LoadError(Exception):
    """A file that cannot be loaded, told in words for the user."""


@dataclass
class Loaded:
    df: DataFrame
    name: str
    kind: str
    encoding: str | None = None
    delimiter: str | None = None
    sheet: str | None = None
    header: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


# ---- what a sample of bytes tells ------------------------------------------------------------


def marked_encoding(sample: bytes) -> str | None:
    """Encoding that a byte order mark names."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if sample.startswith(mark):
            return name
    return None


def _is_utf8(encoding: str) -> bool:
    return encoding.lower().replace("_", "-") in ("utf-8", "utf8", "utf-8-sig")


def _fails(encoding: str, raw: Column, text: Column) -> Column | None:
    """Whether a line does not decode strictly; None if lines alone cannot tell. ``text`` is the line read as iso-8859-1."""
    if _is_utf8(encoding):
        return ~F.is_valid_utf8(raw)
    page = code_page(encoding)
    if page is None:
        return None
    holes = "".join(f"\\x{b:02x}" for b, c in enumerate(page, 128) if c is None)
    return text.rlike(f"[{holes}]") if holes else F.lit(False)


def choose_encoding(spark: SparkSession, path: str, preferred: str | None) -> str:
    """``preferred``, the encoding that the bytes look like if that is sure enough, or a fallback: the first that decodes every byte."""
    found = None
    if not preferred:
        found, confidence = encodings.detect(spark, path).get("", ("utf-8", 1.0))
        if confidence < encodings.UNSURE:
            found = "utf-8"
        if found == "utf-8" and confidence == 1.0:
            return found
    wanted = list(dict.fromkeys([preferred or found, *C.ENCODING_FALLBACKS]))
    raw = F.col("value")
    text = F.decode(raw.cast("binary"), "iso-8859-1")
    tests = {e: t for e in wanted if (t := _fails(e, raw, text)) is not None}
    got = spark.read.option("lineSep", "\n").text(path).agg(*[F.count_if(t).alias(f"f{i}") for i, t in enumerate(tests.values())]).first()
    failed = {e: got[f"f{i}"] for i, e in enumerate(tests)}
    for e in wanted:
        if e in failed and not failed[e] or e not in failed and _decodes(spark, path, e):
            return e
    raise LoadError("No known encoding fits the file.")


def _decodes(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether a file in an encoding of several bytes decodes; such a file is read whole by one task."""
    def test(f: tuple[str, bytes]) -> bool:
        try:
            f[1].decode(encoding)
            return True
        except (UnicodeDecodeError, LookupError):
            return False

    return all(spark.sparkContext.binaryFiles(path).map(test).collect())


def detect_delimiter(text: str) -> str:
    """From a sample alone."""
    try:
        return csv.Sniffer().sniff(text[: C.SNIFF_BYTES], "".join(C.DELIMITERS)).delimiter
    except csv.Error:
        line = text.split("\n", 1)[0]
        best = max(C.DELIMITERS, key=line.count)
        return best if line.count(best) else C.DELIMITERS[0]


def steadiest_delimiter(counts: dict[str, dict[int, int]]) -> str | None:
    """The candidate that most lines have equally often, at least once and in half of the lines; on a tie the one they have more often, then the first. None if there is none."""
    best, least = None, (0.5, 0)
    for d in C.DELIMITERS:
        lines = sum(counts.get(d, {}).values())
        times, n = max(((k, n) for k, n in counts.get(d, {}).items() if k), key=lambda x: (x[1], x[0]), default=(0, 0))
        if n and (mark := (n / lines, times)) > least:
            best, least = d, mark
    return best


def looks_headerless(header: list[str]) -> bool:
    """Whether more than half of the labels are blank, unnamed or numbers."""
    odd = sum(not h.strip() or h.lower().startswith("unnamed:") or bool(re.fullmatch(r"\s*[+-]?\d+(\.\d+)?\s*", h)) for h in header)
    return bool(header) and odd > len(header) / 2


def dedupe_columns(header: list[str]) -> tuple[list[str], list[str]]:
    """(names, warnings): blank labels become ``column``, repeats get _1, _2 and so on until unused."""
    names: list[str] = []
    warnings = []
    for h in header:
        base = "column" if not h.strip() or h.lower().startswith("unnamed:") else h
        name, k = base, 0
        while name in names:
            k += 1
            name = f"{base}_{k}"
        if name != base:
            warnings.append(f"Column {base!r} occurs again and is now {name!r}.")
        names.append(name)
    return names, warnings


def check_size(size: int, limit_mb: int | None = C.MAX_FILE_MB) -> None:
    if limit_mb is not None and size > limit_mb * 1024 * 1024:
        raise LoadError(f"The file has {human_size(size)}; the limit is {limit_mb} MB.")


def human_size(size: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1024 or unit == "TB":
            return f"{int(size)} B" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return ""


# ---- types and row ids -----------------------------------------------------------------------


def null_tokens(df: DataFrame) -> DataFrame:
    """Null in place of each token; one parsed expression a column, as literals made one by one are slow on wide tables."""
    tokens = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in C.NA_TOKENS)
    column = {f.name: "`" + f.name.replace("`", "``") + "`" for f in df.schema}
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(*[F.expr(f"CASE WHEN {c} NOT IN ({tokens}) THEN {c} END").alias(n) if n in text else F.col(c) for n, c in column.items()])


#: What a present cell rules out for its column.
NO_LONG, NO_DOUBLE, NO_BOOLEAN = 1, 2, 4


def ruled_out(cell: Column) -> Column:
    """The types that a cell cannot have, as bits.  An integer is a number too, so a column's types are those that no cell rules out."""
    bare = F.trim(cell)
    long = bare.rlike(r"^[+-]?[0-9]+$") & bare.try_cast("bigint").isNotNull()
    double = bare.rlike(r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$")
    boolean = cell.isin("True", "False", "true", "false", "TRUE", "FALSE")
    bits = [F.when(ok, 0).otherwise(bit) for ok, bit in ((long, NO_LONG), (double, NO_DOUBLE), (boolean, NO_BOOLEAN))]
    return bits[0] + bits[1] + bits[2]


def storage_types(df: DataFrame) -> dict[str, str]:
    """Types of text columns that have one, by what their cells rule out; null tokens count as no cell.

    Cells are dealt to (column, cell) rows and or-ed together inside each task, so the compiled
    code is that of one cell whatever the width, and a task ships one row a column.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return {}
    cells = df.select(F.posexplode(F.array(*[F.col(f"`{n}`") for n in names])).alias("at", "cell"))
    found = cells.filter(~F.col("cell").isin(*C.NA_TOKENS)).groupBy("at").agg(F.bit_or(ruled_out(F.col("cell"))).alias("out")).collect()
    out = {}
    for at, mask in found:
        kind = next((k for k, bit in (("bigint", NO_LONG), ("double", NO_DOUBLE), ("boolean", NO_BOOLEAN)) if not mask & bit), None)
        if kind:
            out[names[at]] = kind
    return out


def infer_storage(df: DataFrame) -> DataFrame:
    """Null tokens are null, and text columns whose present values are all integers, numbers or true and false get that type."""
    types, df = storage_types(df), null_tokens(df)
    cell = {n: F.col(f"`{n}`") for n in types}
    typed = {n: (cell[n] if kind == "boolean" else F.trim(cell[n])).try_cast(kind) for n, kind in types.items()}
    return df.withColumns(typed) if typed else df


# ---- formats ---------------------------------------------------------------------------------


def _head(spark: SparkSession, path: str) -> tuple[bytes, int]:
    """First bytes of a file, or of the first one of a folder, and the size of all, by Spark's own file access, so any store it reads will do."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        top = fs.getFileStatus(hadoop)
        found = [top] if top.isFile() else sorted((f for f in fs.listStatus(hadoop) if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "_."), key=lambda f: f.getPath().toString())
    except Exception as e:
        raise LoadError(f"{path} cannot be read.") from e
    if not found:
        return b"", 0
    stream = fs.open(found[0].getPath())
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(min(found[0].getLen(), C.SNIFF_BYTES)))), sum(f.getLen() for f in found)
    finally:
        stream.close()


def how_to_read(spark: SparkSession, path: str, delimiter: str) -> str:
    """``lines`` if each line is a record; ``records`` if a quoted cell may hold a line break; ``whole`` if a carriage return stands inside a line, as only a reader of the whole file tells what it ends. One distributed count."""
    if len(delimiter) != 1 or delimiter in '"\r\n' or ord(delimiter) > 127:
        return "whole"
    d = delimiter if delimiter.isalnum() else f"\\x{ord(delimiter):02x}"
    cell = f'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{d}]*+)'
    line = F.decode(F.regexp_replace("value", r"\r$", "").cast("binary"), "iso-8859-1")
    odd = line.contains('"') & ~line.rlike(f"^{cell}(?:{d}{cell})*+$")
    got = spark.read.option("lineSep", "\n").text(path).agg(F.count_if(line.contains("\r")).alias("returns"), F.count_if(odd).alias("odd")).first()
    return "whole" if got["returns"] else "records" if got["odd"] else "lines"


def read_records(spark: SparkSession, path: str, schema: T.StructType, *, delimiter: str, header: bool, codec: str) -> DataFrame:
    """Rows with ``_row_id`` of a CSV whose quoted cells hold line breaks, cut by all tasks (see ``splits``) and parsed by Spark."""
    records = splits.quoted_records(spark, path, delimiter, f"{folder(spark)}/records-{uuid.uuid4().hex}", header=header)
    text = F.regexp_replace(F.decode("text", codec), r"\r\z", "")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)
    parsed = F.from_csv(text, fields, {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true"})
    return records.select(C.ROW_ID, parsed.alias("_cells")).select("_cells.*", C.ROW_ID)


def as_page(df: DataFrame, page: Sequence[str | None]) -> DataFrame:
    """Cells read as iso-8859-1 with the characters of another code page."""
    pairs = [(chr(b), c) for b, c in enumerate(page, 128) if c and c != chr(b)]
    if not pairs:
        return df
    a, z = ("".join(x) for x in zip(*pairs))
    other = "[" + "".join(f"\\x{ord(c):02x}" for c in a) + "]"
    shown = lambda c: F.when(c.rlike(other), F.translate(c, a, z)).otherwise(c)  # noqa: E731  most cells have none of these, and to look is cheaper
    return df.select(*[shown(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def _parsed(encoding: str, delimiter: str, width: int, header: bool):
    def rows(f: tuple[str, bytes]) -> Iterator[tuple[str | None, ...]]:
        lines = csv.reader(io.StringIO(f[1].decode(encoding), newline=""), delimiter=delimiter)
        for i, r in enumerate(r for r in lines if r):
            if i or not header:
                yield tuple(x or None for x in (r + [None] * width)[:width])

    return rows


def load_csv(spark: SparkSession, path: str, *, encoding: str | None = None, delimiter: str | None = None, header: bool = True, limit_mb: int | None = None) -> Loaded:
    sample, size = _head(spark, path)
    check_size(size, limit_mb)
    if not sample.strip():
        raise LoadError("The file is empty.")
    encoding = choose_encoding(spark, path, encoding or marked_encoding(sample))
    text = sample.decode(encoding, "replace").lstrip("﻿")
    delimiter = delimiter or steadiest_delimiter(splits.delimiter_counts(spark, path, list(C.DELIMITERS))) or detect_delimiter(text)
    first = next(csv.reader(io.StringIO(text), delimiter=delimiter))
    labels = first if header else [f"column_{i}" for i in range(len(first))]
    names, warnings = dedupe_columns(labels)
    if header and looks_headerless(labels):
        warnings.append("The first row looks like data, not like a header.")
    if len(names) == 1 and delimiter != ",":
        warnings.append("Only one column was found; the delimiter may be wrong.")
    more = "_more_cells"
    while more in names:
        more += "_"
    # One column more than the header has, to see rows with more cells.
    reader_schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, more]])
    reader = spark.read.schema(reader_schema).option("sep", delimiter).option("header", header).option("quote", '"').option("escape", '"')
    page = None if _is_utf8(encoding) else code_page(encoding)
    wide = encoding.lower().replace("_", "-") in ("utf-16", "utf-16le", "utf-16be", "utf-16-le", "utf-16-be", "utf-32", "utf-32-le", "utf-32-be")
    codec = "utf-8" if _is_utf8(encoding) else "iso-8859-1" if page else re.sub("(?<=16|32)-", "", encoding.lower().replace("_", "-"))
    try:
        if page or wide or _is_utf8(encoding):
            how = "whole" if wide else how_to_read(spark, path, delimiter)
            if how == "records":
                df = read_records(spark, path, reader_schema, delimiter=delimiter, header=header, codec=codec)
            else:
                df = splits.number_rows(reader.option("multiLine", how == "whole").option("encoding", codec).csv(path), C.ROW_ID)
            df = as_page(df, page) if page else df
        else:  # other encodings of several bytes, read only if they are named: a file is parsed by one task
            rows = spark.sparkContext.binaryFiles(path).flatMap(_parsed(encoding, delimiter, len(names) + 1, header)).zipWithIndex()
            df = spark.createDataFrame(rows.map(lambda r: (*r[0], r[1])), T.StructType([*reader_schema.fields, T.StructField(C.ROW_ID, T.LongType())]))
        if not df.filter(F.col(f"`{more}`").isNotNull()).isEmpty():
            raise LoadError(f"{path} has rows with more cells than its {len(names)} columns.")
        loaded = df.drop(more)
    except AnalysisException as e:
        raise LoadError(f"{path} cannot be read as CSV.") from e
    loaded = infer_storage(loaded)
    if loaded.isEmpty():
        warnings.append("The file has a header but no rows.")
    return Loaded(loaded, path.rsplit("/", 1)[-1], "csv", encoding, delimiter, None, labels, warnings)


def _workbook(spark: SparkSession, path: str, limit_mb: int | None) -> DataFrame:
    """The file as a binaryFile row; its content stays on the executors."""
    book = spark.read.format("binaryFile").load(path)
    try:
        sizes = book.select("length").take(1)
    except AnalysisException as e:
        raise LoadError(f"{path} cannot be read.") from e
    if not sizes:
        raise LoadError(f"{path} cannot be read.")
    check_size(sizes[0][0], limit_mb)
    return book.select("content")


def _sheets(batches: Iterator) -> Iterator:
    for batch in batches:
        for data in batch["content"]:
            try:
                yield pd.DataFrame({"name": xlsx.sheet_names(data)}).assign(at=lambda t: t.index, failed=False)
            except Exception:
                yield pd.DataFrame({"name": [None], "at": [0], "failed": [True]})


def _names(book: DataFrame, path: str) -> list[str]:
    rows = sorted(book.mapInPandas(_sheets, "name string, at long, failed boolean").collect(), key=lambda r: r["at"])
    if any(r["failed"] for r in rows):
        raise LoadError(f"{path} is no workbook that can be read.")
    return [r["name"] for r in rows]


def excel_sheets(spark: SparkSession, path: str) -> list[str]:
    return _names(_workbook(spark, path, None), path)


def _rows(sheet: str | None, many: int = 5000):
    """Rows of a sheet as texts with the kind of each cell; a row at -1 tells that the file cannot be read."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for data in batch["content"]:
                held: list[tuple[int, list[str | None], list[str | None]]] = []
                try:
                    for i, r in enumerate(xlsx.read_sheet(data, sheet)):
                        held.append((i, [None if v is None else str(v) for v in r], [None if v is None else "whole" if isinstance(v, float) and v.is_integer() else type(v).__name__ for v in r]))
                        if len(held) == many:
                            yield pd.DataFrame(held, columns=["at", "cells", "kinds"])
                            held = []
                except Exception:
                    held.append((-1, [], []))
                yield pd.DataFrame(held, columns=["at", "cells", "kinds"])

    return run


def load_excel(spark: SparkSession, path: str, *, sheet: str | None = None, header: bool = True, limit_mb: int | None = C.MAX_FILE_MB) -> Loaded:
    """One sheet of a workbook, parsed by one executor task, as a workbook cannot be split; its size is limited."""
    book = _workbook(spark, path, limit_mb)
    sheets = _names(book, path)
    if sheet is not None and sheet not in sheets:
        raise LoadError(f"There is no sheet {sheet!r}; there are {', '.join(sheets)}.")
    rows = book.mapInPandas(_rows(sheet), "at long, cells array<string>, kinds array<string>").persist(StorageLevel.DISK_ONLY)
    facts = rows.agg(F.min("at").alias("first"), F.max(F.size("cells")).alias("width")).first()
    if facts["first"] is None:
        raise LoadError("The sheet is empty.")
    if facts["first"] < 0:
        raise LoadError(f"{path} is no workbook that can be read.")
    width, top = facts["width"], rows.filter("at = 0").first()
    shown = list(top["cells"])
    labels = ["" if v is None else v for v in shown + [None] * (width - len(shown))] if header else [f"column_{i}" for i in range(width)]
    names, warnings = dedupe_columns(labels)
    body = rows.filter(F.col("at") >= int(header))
    total = body.count()
    seen: dict[int, dict[str, int]] = {i: {} for i in range(width)}
    for r in body.select(F.posexplode("kinds").alias("i", "kind")).filter("kind is not null").groupBy("i", "kind").count().collect():
        seen[r["i"]][r["kind"]] = r["count"]
    fitted = []
    for i, n in enumerate(names):
        c, kinds = F.get("cells", F.lit(i)), set(seen[i])
        if kinds == {"whole"} and seen[i]["whole"] == total:
            c = c.cast("double").cast("bigint")
        elif kinds and kinds <= {"whole", "float"}:
            c = c.cast("double")
        elif kinds in ({"bool"}, {"datetime"}):
            c = c.cast("boolean" if kinds == {"bool"} else "timestamp_ntz")
        fitted.append(c.alias(n))
    df = body.select((F.col("at") - int(header)).alias(C.ROW_ID), *fitted)
    return Loaded(null_tokens(df), path.rsplit("/", 1)[-1], "excel", None, None, sheet or sheets[0], labels, warnings)


def load_bytes(spark: SparkSession, name: str, data: bytes, **options) -> Loaded:
    """An upload: its bytes are put into the shared folder under their name and loaded from there."""
    return load(spark, put_bytes(spark, f"{folder(spark)}/uploads-{uuid.uuid4().hex}/{name}", data), **options)


def load(spark: SparkSession, path: str, **options) -> Loaded:
    """By extension; a Parquet table is read as it is."""
    low = path.lower().rstrip("/")
    if low.endswith(C.CSV_EXTENSIONS):
        return load_csv(spark, path, **options)
    if low.endswith(C.EXCEL_EXTENSIONS):
        return load_excel(spark, path, **options)
    if low.endswith(".parquet"):
        df = spark.read.parquet(path)
        return Loaded(df if C.ROW_ID in df.columns else splits.number_rows(df, C.ROW_ID), path.rsplit("/", 1)[-1], "parquet", header=df.columns)
    raise LoadError(f"{path.rsplit('/', 1)[-1]} is of a type that is not supported.")


# ---- writing ---------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    df.drop(C.ROW_ID).write.mode("overwrite").options(**AS_IT_IS).csv(path)


def to_excel(df: DataFrame, sheet: str = "Cleaned") -> bytes:
    """A workbook of the rows, streamed to the driver partition by partition; meant for tables that fit a workbook."""
    shown = df.drop(C.ROW_ID)
    return xlsx.write_sheet(shown.columns, (tuple(r) for r in shown.toLocalIterator()), sheet)


def write_logs(folder: str, **tables: DataFrame) -> None:
    """Audit, decisions, unresolved issues and the like, each as a CSV folder of its name."""
    for name, table in tables.items():
        simple = table.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in table.schema])
        simple.write.mode("overwrite").options(**AS_IT_IS).csv(f"{folder}/{name}")
