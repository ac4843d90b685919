"""Issue detection: 33 rules gated by the effective type of a column.

Three plans make up the issues: one scan for what a cell tells by itself, one join of cells to the
flagged distinct values (spellings, shapes, repeats, and numbers and dates kept as text, which are
parsed once a value), one grouping for repeated rows.  Findings about whole columns are a handful of
driver rows.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import expr as E
from ..functions import names as N
from . import ranks as R
from .profile import NUMERIC, TIMES, ColumnProfile, data_columns, normalize_name, text_cells, value_table

FINDING = "issue_type string, severity string, confidence double, column_name string, row_index long, current_value string, suggested_value string"
ACTIONS = {
    "exact_duplicate_row": "Remove the repeat after approval.", "empty_row": "Remove the row.", "empty_column": "Remove the column.",
    "duplicate_column_name": "Rename one of the columns.", "near_duplicate_column_name": "Check whether both columns are needed.", "column_name_whitespace": "Trim the name.",
    "inconsistent_column_name_formatting": "Choose one style.", "missing_null": "Decide how to fill it.", "blank_string": "Make it null.", "whitespace_only_string": "Make it null.", "missing_placeholder": "Make it null.",
    "numeric_stored_as_text": "Convert the column.", "value_fails_type_conversion": "Correct the value.", "date_stored_as_text": "Convert the column.", "mixed_data_types": "Split or convert the column.",
    "unexpected_text_in_numeric_column": "Correct the value.", "leading_trailing_whitespace": "Trim the value.", "repeated_internal_spaces": "Collapse the spaces.", "non_printable_characters": "Remove the characters.",
    "similar_category_values": "Choose one spelling.", "inconsistent_capitalization": "Choose one spelling.", "infinite_value": "Correct the value.", "possible_outlier": "Check the value.", "negative_value": "Check the value.",
    "suspiciously_constant_column": "Check the column.", "numeric_format_inconsistency": "Choose one format.", "invalid_date": "Correct the date.", "mixed_date_formats": "Choose one format.", "unusually_old_date": "Check the date.",
    "unusually_future_date": "Check the date.", "identifier_missing_values": "Fill the identifiers.", "identifier_duplicate_value": "Check the identifiers.", "identifier_inconsistent_format": "Check the identifier.",
}


@dataclass
class Finding:
    """A rule on one cell: where it holds, and what it tells."""

    issue_type: str
    holds: Column
    severity: str | Column
    suggested: Column | None = None
    shows_value: bool = True
    names: list[str] | None = None  # the columns that it can hold for, None for any

    def struct(self) -> Column:
        text = F.lit(None).cast("string")
        value = F.struct(
            F.lit(self.issue_type).alias("issue_type"), (F.lit(self.severity) if isinstance(self.severity, str) else self.severity).alias("severity"), F.lit(float(C.ISSUES[self.issue_type][1])).alias("confidence"),
            (F.col("value") if self.shows_value else text).alias("current_value"), (text if self.suggested is None else self.suggested).alias("suggested_value"),
        )
        return F.when(self.holds, value)


def severity_of(count: int, total: int, cutoffs: tuple[float, float, float]) -> str:
    ratio = count / total if total else 0.0
    return next((s for s, limit in zip(C.SEVERITIES, cutoffs) if ratio < limit), C.SEVERITIES[-1])


def larger_severity(a: str, b: str) -> str:
    return max(a, b, key=C.SEVERITIES.index)


def name_style(name: str) -> str | None:
    """Style of a column name; None if it follows none."""
    return next((style for style, shape in N.STYLES if re.fullmatch(shape, name.strip())), None)


def name_findings(names: list[str]) -> list[tuple]:
    """Findings about column names alone; the list may hold repeats, which no frame can."""
    out = []
    by_name: dict[str, list[str]] = {}
    for n in names:
        by_name.setdefault(normalize_name(n), []).append(n)
    for same in by_name.values():
        if len(same) > 1:
            kind, severity = ("duplicate_column_name", "Critical") if len(set(same)) < len(same) else ("near_duplicate_column_name", "Medium")
            out += [(kind, severity, 1.0, n, None, None, None) for n in same]
    out += [("column_name_whitespace", "Low", 1.0, n, None, None, n.strip()) for n in names if n != n.strip()]
    styles = [name_style(n) for n in names]
    if len({s for s in styles if s}) > 1:
        out += [("inconsistent_column_name_formatting", "Low", 0.7, n, None, None, normalize_name(n)) for n, s in zip(names, styles) if s]
    return out


def header_findings(headers: DataFrame) -> DataFrame:
    """The same findings for the names of any number of tables at once: (dataset, place, issue_type, severity, confidence, column_name, suggested_value).

    ``headers`` has a row for each column of each table: dataset, place and name.  A null name counts
    as an empty one.  Rows are grouped by (dataset, plain name) and by dataset with partial counts.
    """
    name = F.coalesce("name", F.lit(""))
    named = headers.select("dataset", "place", name.alias("name"), N.normalized(name).alias("plain"), N.style(name).alias("style"))
    same = named.groupBy("dataset", "plain", "name").agg(F.count(F.lit(1)).alias("k")).groupBy("dataset", "plain").agg(F.sum("k").alias("n"), F.max("k").alias("most"))
    repeated = named.join(same.filter("n > 1"), ["dataset", "plain"])
    styles = named.filter("style is not null").groupBy("dataset", "style").agg(F.count(F.lit(1)).alias("k")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    styled = named.filter("style is not null").join(styles, "dataset", "left_semi")

    def found(rows: DataFrame, kind: Column, severity: Column, confidence: float, suggested: Column) -> DataFrame:
        return rows.select("dataset", "place", kind.alias("issue_type"), severity.alias("severity"), F.lit(confidence).alias("confidence"), F.col("name").alias("column_name"), suggested.alias("suggested_value"))

    exact, low = F.col("most") > 1, F.lit("Low")
    return (
        found(repeated, F.when(exact, "duplicate_column_name").otherwise("near_duplicate_column_name"), F.when(exact, "Critical").otherwise("Medium"), 1.0, F.lit(None).cast("string"))
        .unionByName(found(named.filter(F.col("name") != E.strip(F.col("name"))), F.lit("column_name_whitespace"), low, 1.0, E.strip(F.col("name"))))
        .unionByName(found(styled, F.lit("inconsistent_column_name_formatting"), low, 0.7, F.col("plain")))
    )


# ---- what a cell tells by itself ---------------------------------------------------------------


def cell_table(df: DataFrame, kinds: dict[str, str], whole: bool = False, parsed: bool = True) -> DataFrame:
    """(_row_id, column, value, trimmed, cleaned, number, day, gone) of each cell: rules are written once, not once a column.

    ``number`` is there for columns of numeric types and ``day`` for those of dates, stored as such or as text;
    with ``whole``, ``row`` holds all columns of the row; without ``parsed``, text is not read as numbers or dates.
    """
    text = [n for n in kinds if E.is_text(df, n)]
    cells = []
    for n in kinds:
        c, kind = F.col(f"`{n}`"), df.schema[n].dataType
        number = c.cast("double") if isinstance(kind, NUMERIC) else F.lit(None).cast("double")
        stamp = c.cast("timestamp_ntz") if isinstance(kind, TIMES) else F.lit(None).cast("timestamp_ntz")
        cells.append(F.struct(F.lit(n).alias("column"), c.cast("string").alias("value"), number.alias("stored"), stamp.alias("stamp"), E.missing(df, n).alias("gone")))
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if whole else []
    rest = ["row"] if whole else []
    if len(text) == len(kinds) and not whole:
        flat = text_cells(df, text).select("*", F.lit(None).cast("double").alias("stored"), F.lit(None).cast("timestamp_ntz").alias("stamp"), F.col("value").isNull().alias("gone"))
    else:
        flat = df.select(F.col(C.ROW_ID), *row, F.explode(F.array(*cells)).alias("cell")).select(C.ROW_ID, *rest, "cell.*")
    # Trimmed text and cleaned numbers are columns of their own, so the rules behind them do not repeat their patterns.
    numbers, days = ([n for n in text if kinds[n] in some] if parsed else [] for some in (C.NUMERIC_TYPES, C.DATE_TYPES))
    cleaned = F.when(_within([*numbers, *[n for n in text if kinds[n] == C.MIXED]]), E.clean_number(F.col("value")))
    flat = flat.select(C.ROW_ID, *rest, "column", "value", "stored", "stamp", "gone", E.strip(F.col("value")).alias("trimmed"), cleaned.alias("cleaned"))
    flat = flat.withColumn("dated", F.when(_within(days), F.lower("trimmed")))
    number = F.when(_within(numbers), F.when(F.col("cleaned").rlike(E.NUMBER), F.col("cleaned").try_cast("double"))).otherwise(F.col("stored"))
    day = F.when(_within(days), E.parse_date(F.col("dated"), trimmed=True).cast("timestamp_ntz")).otherwise(F.col("stamp"))
    return flat.select(C.ROW_ID, *rest, "column", "value", "trimmed", "cleaned", "gone", number.alias("number"), day.alias("day"))


def parsed_values(values: DataFrame, numbers: list[str], days: list[str]) -> DataFrame:
    """Distinct values of text columns of numbers and of dates with what ``cell_table`` tells of a cell."""
    flat = values.filter(_within([*numbers, *days])).withColumn("trimmed", E.strip(F.col("value")))
    flat = flat.withColumn("cleaned", F.when(_within(numbers), E.clean_number(F.col("value")))).withColumn("dated", F.when(_within(days), F.lower("trimmed")))
    number = F.when(F.col("cleaned").rlike(E.NUMBER), F.col("cleaned").try_cast("double"))
    return flat.select("column", "value", "n", "first_row", "trimmed", "cleaned", number.alias("number"), E.parse_date(F.col("dated"), trimmed=True).cast("timestamp_ntz").alias("day"))


def _within(names: list[str]) -> Column:
    return F.col("column").isin(*names) if names else F.lit(False)


def _by_column(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("column")]


def missing_tests(text: list[str]) -> dict[str, Column]:
    """Conditions of the missing-value rules on a cell."""
    v = F.col("value")
    return {
        "missing_null": F.col("gone"), "blank_string": _within(text) & (v == ""), "whitespace_only_string": _within(text) & (F.col("trimmed") == "") & (v != ""),
        "missing_placeholder": _within(text) & F.lower("trimmed").isin(*E.PLACEHOLDERS) & (F.col("trimmed") != ""),
    }


def finite_number() -> Column:
    v = F.col("number")
    return F.when((F.abs(v) != float("inf")) & ~F.isnan(v), v)


def text_findings(names: list[str]) -> list[Finding]:
    c = F.col("value")
    trimmed, here = F.col("trimmed"), _within(names)
    return [
        Finding("leading_trailing_whitespace", here & (c != trimmed), "Low", trimmed, names=names),
        Finding("repeated_internal_spaces", here & trimmed.rlike(r"  |[^\x21-\x7e ]") & trimmed.rlike(E.WS + "{2,}"), "Low", E.collapse(c), names=names),
        Finding("non_printable_characters", here & E.unprintable(c), "Medium", E.printable(c), names=names),
    ]


def numeric_findings(names: list[str], fences: dict[str, tuple[float, float]]) -> list[Finding]:
    v, here = finite_number(), _within(names)
    out = [Finding("infinite_value", here & (F.abs("number") == float("inf")), "Critical", names=names), Finding("negative_value", here & (v < 0), "Low", names=names)]
    if fences:
        outside = (v < _by_column({n: f[0] for n, f in fences.items()})) | (v > _by_column({n: f[1] for n, f in fences.items()}))
        out.append(Finding("possible_outlier", _within(list(fences)) & outside, "Low", names=list(fences)))
    return out


def date_findings(names: list[str], written: list[str], now: str) -> list[Finding]:
    """``now`` as text makes the rules repeatable."""
    at, day = F.lit(now).cast("timestamp_ntz"), F.col("day")
    old, far = at - F.expr(f"INTERVAL '{C.OLD_YEARS}' YEAR"), at + F.expr(f"INTERVAL '{C.FUTURE_YEARS}' YEAR")
    return [
        Finding("unusually_old_date", _within(names) & (day < old), "Low", names=names), Finding("unusually_future_date", _within(names) & (day > far), "Low", names=names),
        Finding("invalid_date", _within(written) & F.col("value").isNotNull() & day.isNull(), "High", names=written),
    ]


def type_findings(profiles: list[ColumnProfile], text: list[str]) -> list[Finding]:
    c, some = F.col("cleaned"), [p for p in profiles if p.original_name in text]
    is_number = c.rlike(E.NUMBER) | c.rlike(E.SPECIAL_NUMBER)
    numbers = [p.original_name for p in some if p.effective_logical_type == C.NUMERIC_TEXT]
    mixed = [p.original_name for p in some if p.effective_logical_type == C.MIXED and p.evidence.get("dominant") == "numeric"]
    out = [Finding("value_fails_type_conversion", _within(numbers) & ~is_number, "Medium", names=numbers)] if numbers else []
    return out + ([Finding("unexpected_text_in_numeric_column", _within(mixed) & ~is_number & (F.col("trimmed") != ""), "High", names=mixed)] if mixed else [])


def every_finding(findings: list[Finding]) -> Column:
    """A row for each rule, null where it does not hold: dropped by a filter, as ``array_compact`` is not generated code and neither would be the rules inside."""
    return F.explode(F.array(*[f.struct() for f in findings])).alias("f")


def explode_findings(cells: DataFrame, findings: list[Finding]) -> DataFrame:
    """All findings of all cells in one scan."""
    if not findings:
        return cells.sparkSession.createDataFrame([], FINDING)
    found = cells.select(F.col(C.ROW_ID), "column", every_finding(findings)).filter("f is not null")
    return found.select("f.issue_type", "f.severity", "f.confidence", F.col("column").alias("column_name"), F.col(C.ROW_ID).alias("row_index"), "f.current_value", "f.suggested_value")


# ---- what needs other rows ---------------------------------------------------------------------


#: Most rows, and characters of text, that are sent to every executor.
FEW, FEW_CHARS = 200_000, 8 << 20


def _stored(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows kept for several readers, and their number; few rows are marked for broadcast, so what they are joined to is not shuffled."""
    rows = R.few_parts(rows).persist()
    chars = sum((F.coalesce(F.sum(F.length(n)), F.lit(0)) for n in rows.columns if E.is_text(rows, n) and n != "column"), F.lit(0))
    size = rows.agg(F.count(F.lit(1)).alias("n"), chars.alias("chars")).first()
    return (F.broadcast(rows) if size["n"] <= FEW and size["chars"] <= FEW_CHARS else rows), size["n"]


def spelling_variants(values: DataFrame) -> DataFrame:
    """(column, value, issue_type, suggested) of spellings that are not the most frequent of their cluster; ties go to the first seen.

    Clusters of ``similar_category_values`` differ in more than case once other characters than
    letters and digits are dropped; what they hold is no matter for ``inconsistent_capitalization``.
    Hashes tell first which spellings are not alone, so the others are not grouped as text.
    """
    best = F.max(F.struct("n", (-F.col("first_row")).alias("early"), "value"))
    fold = F.lower(E.strip(F.col("value")))
    key = F.when(F.col("similar"), F.regexp_replace(F.lower("value"), "[^a-z0-9]+", ""))
    # What spellings are told apart by is worked out once and read by each of the groupings below.
    values = values.select("column", "value", "n", "first_row", key.alias("key"), F.xxhash64(fold).alias("hash")).persist()

    def shared(rows: DataFrame, hash: Column) -> tuple[DataFrame, int]:
        return _stored(rows.groupBy("column", hash.alias("hash")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("column", "hash"))

    keyed = values.filter("key <> ''")
    often, _ = shared(keyed, F.xxhash64("key"))
    alike = keyed.drop("hash").withColumn("hash", F.xxhash64("key")).join(often, ["column", "hash"])
    similar = alike.groupBy("column", "key").agg(F.count(F.lit(1)).alias("k"), F.count_distinct(fold).alias("folds"), best.alias("best")).filter("k > 1 and folds > 1")
    similar, clusters = _stored(similar.select("column", "key", F.col("best.value").alias("suggested")))
    first = keyed.drop("hash").join(similar, ["column", "key"]).filter("value <> suggested").select("column", "value", F.lit("similar_category_values").alias("issue_type"), "suggested")
    rest = values.join(similar.select("column", "key"), ["column", "key"], "left_anti") if clusters else values
    often, count = shared(rest, F.col("hash"))
    if not count:
        return first
    rest = rest.join(often, ["column", "hash"]).withColumn("fold", fold)
    case = rest.groupBy("column", "fold").agg(F.count(F.lit(1)).alias("k"), best.alias("best")).filter("k > 1").select("column", "fold", F.col("best.value").alias("suggested"))
    second = rest.join(case, ["column", "fold"]).filter("value <> suggested").select("column", "value", F.lit("inconsistent_capitalization").alias("issue_type"), "suggested")
    return first.unionByName(second)


def odd_shapes(values: DataFrame, shape: Column, issue_type: str, least: int = 0) -> DataFrame:
    """Values whose shape is not the dominant one of their column; ties go to the first seen."""
    shaped = values.withColumn("shape", shape)
    counts = shaped.groupBy("column", "shape").agg(F.sum("n").alias("k"), F.min("first_row").alias("seen"))
    main = counts.groupBy("column").agg(F.max(F.struct("k", (-F.col("seen")).alias("early"), "shape")).alias("best"), F.sum("k").alias("all")).filter(F.col("all") >= least)
    return shaped.join(F.broadcast(main), "column").filter(~F.col("shape").eqNullSafe(F.col("best.shape"))).select("column", "value", F.lit(issue_type).alias("issue_type"), F.lit(None).cast("string").alias("suggested"))


def mixed_decimals(values: DataFrame) -> DataFrame:
    """Values of the rarer of decimal comma and decimal point, if a column has both; on a tie those with a point."""
    v = E.strip(F.col("value"))
    marked = values.withColumn("style", F.when(v.rlike(E.DOT_DECIMAL), "dot").when(v.rlike(E.COMMA_DECIMAL), "comma")).filter("style is not null")
    counts = marked.groupBy("column").agg(F.sum(F.when(F.col("style") == "dot", F.col("n")).otherwise(0)).alias("dots"), F.sum(F.when(F.col("style") == "comma", F.col("n")).otherwise(0)).alias("commas"))
    odd = counts.filter("dots > 0 and commas > 0").select("column", F.when(F.col("dots") <= F.col("commas"), "dot").otherwise("comma").alias("style"))
    return marked.join(F.broadcast(odd), ["column", "style"]).select("column", "value", F.lit("numeric_format_inconsistency").alias("issue_type"), F.lit(None).cast("string").alias("suggested"))


def repeated_identifiers(values: DataFrame) -> DataFrame:
    trimmed = values.withColumn("trimmed", E.strip(F.col("value")))
    trimmed = trimmed.withColumn("hash", F.xxhash64("trimmed"))
    shared, _ = _stored(trimmed.groupBy("column", "hash").agg(F.sum("n").alias("k")).filter("k > 1").select("column", "hash"))
    trimmed = trimmed.join(shared, ["column", "hash"])
    often = trimmed.groupBy("column", "trimmed").agg(F.sum("n").alias("k")).filter("k > 1")
    return trimmed.join(often, ["column", "trimmed"]).select("column", "value", F.lit("identifier_duplicate_value").alias("issue_type"), F.lit(None).cast("string").alias("suggested"))


def flag_values(values: DataFrame, findings: list[Finding]) -> DataFrame:
    """(column, value, issue_type, suggested): rules on a cell as rules on distinct values."""
    found = values.select("column", "value", every_finding(findings)).filter("f is not null")
    return found.select("column", "value", "f.issue_type", F.col("f.suggested_value").alias("suggested"))


#: Severities of findings on values where they are not Medium.
_VALUE_SEVERITY = {
    "inconsistent_capitalization": "Low", "identifier_inconsistent_format": "Low", "infinite_value": "Critical", "negative_value": "Low", "possible_outlier": "Low",
    "unusually_old_date": "Low", "unusually_future_date": "Low", "invalid_date": "High",
}


def flagged_findings(df: DataFrame, flagged: DataFrame) -> list[DataFrame]:
    """``value_findings`` of the columns with a flagged value only; columns with few of them are not shuffled."""
    flagged = R.few_parts(flagged).persist()
    chars = F.sum(F.length("value") + F.coalesce(F.length("suggested"), F.lit(0)))
    sizes = sorted((r["chars"], r["n"], r["column"]) for r in flagged.groupBy("column").agg(F.count(F.lit(1)).alias("n"), chars.alias("chars")).collect())
    few, total = [], [0, 0]
    for k, n, column in sizes:
        total = [total[0] + n, total[1] + k]
        if total[0] <= FEW and total[1] <= FEW_CHARS:
            few.append(column)
    many = sorted(c for *_, c in sizes if c not in few)
    out = [value_findings(df, F.broadcast(flagged.filter(_within(few))), sorted(few))] if few else []
    return out + ([value_findings(df, flagged.filter(_within(many)), many)] if many else [])


def value_findings(df: DataFrame, flagged: DataFrame, names: list[str]) -> DataFrame:
    """Flagged (column, value) pairs as findings on every row that holds the value."""
    rows = text_cells(df, names).filter("value is not null").join(flagged, ["column", "value"])
    trimmed = F.col("issue_type").isin("numeric_format_inconsistency", "identifier_duplicate_value", "identifier_inconsistent_format")
    severity = F.coalesce(F.create_map(*[F.lit(x) for pair in _VALUE_SEVERITY.items() for x in pair])[F.col("issue_type")], F.lit("Medium"))
    confidence = F.create_map(*[F.lit(x) for k, v in C.ISSUES.items() if v[1] is not None for x in (k, float(v[1]))])
    return rows.select("issue_type", severity.alias("severity"), confidence[F.col("issue_type")].alias("confidence"), F.col("column").alias("column_name"), F.col(C.ROW_ID).alias("row_index"), F.when(trimmed, E.strip(F.col("value"))).otherwise(F.col("value")).alias("current_value"), F.col("suggested").alias("suggested_value"))


def _hashed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, hashes): row id, whole row and its hash, and the hashes that are not alone; only hashes are shuffled for all rows."""
    names = data_columns(df)
    whole = F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    slots = df.select(F.col(C.ROW_ID), whole.alias("whole"), F.xxhash64(*[F.col(f"`{n}`") for n in names]).alias("hash"))
    return slots, slots.groupBy("hash").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("hash")


def _groups(rows: DataFrame) -> DataFrame:
    """First row and size of each group of equal rows among rows that share a hash.

    Partial minima and a join back mean that a row that makes up much of the table is not gathered in one task.
    """
    return rows.groupBy("hash", "whole").agg(F.min(C.ROW_ID).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def _later(rows: DataFrame, groups: DataFrame) -> DataFrame:
    first = groups.select(F.col("hash").alias("h"), F.col("whole").alias("w"), "first")
    return rows.join(first, (F.col("hash") == F.col("h")) & F.col("whole").eqNullSafe(F.col("w"))).filter(F.col(C.ROW_ID) > F.col("first")).select(C.ROW_ID)


def repeated_rows(df: DataFrame) -> DataFrame:
    """Row ids of rows that repeat an earlier one; null equals null and NaN equals NaN."""
    slots, often = _hashed(df)
    rows = slots.join(often, "hash")
    return _later(rows, _groups(rows))


def duplicate_findings(df: DataFrame, total: int) -> DataFrame | None:
    """Findings on repeated rows, or None if there are none; rows that share a hash are stored, as they are counted first."""
    slots, often = _hashed(df)
    often, shared = _stored(often)
    if not shared:
        return None
    rows = R.few_parts(slots.join(often, "hash")).persist()
    groups = R.few_parts(_groups(rows)).persist()
    count = groups.agg(F.sum(F.col("n") - 1)).first()[0]
    if not count:
        return None
    none = F.lit(None).cast("string")
    return _later(rows, groups).select(F.lit("exact_duplicate_row").alias("issue_type"), F.lit(severity_of(count, total, C.DUPLICATE_CUTOFFS)).alias("severity"), F.lit(1.0).alias("confidence"), none.alias("column_name"), F.col(C.ROW_ID).alias("row_index"), none.alias("current_value"), none.alias("suggested_value"))


# ---- all together ------------------------------------------------------------------------------


def _finite_of(df: DataFrame, name: str) -> Column:
    v = E.number_of(df, name)
    return F.when((F.abs(v) != float("inf")) & ~F.isnan(v), v)


def detect(df: DataFrame, profiles: list[ColumnProfile], *, dataset: str = "dataset", run_id: str = "run", now: str = "2026-01-01 00:00:00", header: list[str] | None = None, only: Collection[str] | None = None, values: DataFrame | None = None) -> DataFrame:
    """All issues of a table with ``_row_id``, or those of the types in ``only``, whose plan then has nothing of other rules.

    ``header`` holds the names as read, repeats included; ``values`` is the stored ``value_table`` of all columns, if there is one.
    """
    def asked_for(*types: str) -> bool:
        return only is None or any(t in only for t in types)

    spark: SparkSession = df.sparkSession
    names = data_columns(df)
    kinds = {p.original_name: p.effective_logical_type for p in profiles}
    text = [n for n in names if E.is_text(df, n)]
    numeric = [n for n in names if kinds[n] in C.NUMERIC_TYPES]
    empty_row = None
    for n in names:
        empty_row = E.missing(df, n) if empty_row is None else empty_row & E.missing(df, n)
    stored, tests, finite = [n for n in numeric if n not in text], missing_tests(text), finite_number()
    # Numbers and dates kept as text are parsed once for each distinct value.
    ranged = asked_for("possible_outlier", "suspiciously_constant_column")
    spoken = [n for n in numeric if n in text and (ranged or asked_for("infinite_value", "negative_value", "value_fails_type_conversion", "numeric_format_inconsistency"))]
    dated = [n for n in text if kinds[n] in C.DATE_TYPES and asked_for("unusually_old_date", "unusually_future_date", "invalid_date", "mixed_date_formats")]
    spelled = [n for n in text if kinds[n] in (C.CATEGORICAL, C.IDENTIFIER, C.FREE_TEXT) and asked_for("similar_category_values", "inconsistent_capitalization")]
    ids = [n for n in names if kinds[n] == C.IDENTIFIER and asked_for("identifier_duplicate_value", "identifier_inconsistent_format")]
    some = sorted({*spelled, *ids, *dated, *spoken})
    own = values if values is not None else R.few_parts(value_table(df, some)).persist() if some else None  # read by every rule about values, several times each
    parsed = parsed_values(own, spoken, dated).persist() if spoken or dated else None

    figures = []
    for i, n in enumerate(stored if ranged else []):
        v = _finite_of(df, n)
        figures += [F.count(v).alias(f"{i}_finite"), F.min(v).alias(f"{i}_low"), F.max(v).alias(f"{i}_high")]
    got = df.agg(F.count(F.lit(1)).alias("total"), (F.count_if(empty_row) if names else F.lit(0)).alias("empty"), *figures).first()
    total = got["total"]
    of = {n: {k: got[f"{i}_{k}"] for k in ("finite", "low", "high")} for i, n in enumerate(stored)} if ranged else {}
    if ranged and spoken:
        known = parsed.filter(_within(spoken)).groupBy("column").agg(F.sum(F.when(finite.isNotNull(), F.col("n")).otherwise(0)).alias("finite"), F.min(finite).alias("low"), F.max(finite).alias("high"))
        of |= {r["column"]: r.asDict() for r in known.collect()}
    # How often the rules of missing values hold, by column.
    counted = bool(names) and asked_for(*tests, "empty_column", "identifier_missing_values")
    counts = {(n, k): 0 for n in names for k in tests}
    if counted:
        if values is not None:  # they have a row for each present value
            flat = values.select("column", "value", "n", E.strip(F.col("value")).alias("trimmed"), F.lit(False).alias("gone"))
        else:
            flat = cell_table(df, kinds, parsed=False).select("column", "value", F.lit(1).alias("n"), "trimmed", "gone")
        tally = flat.groupBy("column").agg(F.sum("n").alias("present"), *[F.sum(F.when(t, F.col("n")).otherwise(0)).alias(k) for k, t in tests.items()])
        held = {r["column"]: r for r in tally.collect()}
        counts |= {(n, k): r[k] for n, r in held.items() for k in tests}
        if values is not None:
            counts |= {(n, "missing_null"): total - (held[n]["present"] if n in held else 0) for n in names}
    quartiles = {}
    if asked_for("possible_outlier") and numeric:
        parts = [R.value_counts(df, {n: _finite_of(df, n) for n in stored})] if stored else []
        if spoken:
            parts.append(parsed.filter(_within(spoken) & finite.isNotNull()).groupBy("column", finite.alias("value")).agg(F.sum("n").alias("n")))
        known = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        known = R.few_parts(known).persist()
        quartiles = R.percentiles(known, (0.25, 0.75))
        known.unpersist()

    whole = name_findings(header or names)
    for n in names:
        if counted and counts[n, "missing_null"] == total:
            whole.append(("empty_column", "High", 1.0, n, None, None, None))
        if kinds[n] == C.IDENTIFIER and counts[n, "missing_null"]:
            severity = larger_severity("Medium", severity_of(counts[n, "missing_null"], total, C.MISSING_CUTOFFS))
            whole.append(("identifier_missing_values", severity, 1.0, n, None, None, None))
    for p in profiles:
        kind = {C.NUMERIC_TEXT: ("numeric_stored_as_text", "Medium"), C.DATE_TEXT: ("date_stored_as_text", "Medium"), C.MIXED: ("mixed_data_types", "High")}.get(p.effective_logical_type)
        if kind:
            whole.append((*kind, round(float(p.confidence), 3), p.original_name, None, None, None))

    rules: list[Finding] = []  # on cells
    told: list[Finding] = []  # on distinct values
    for k, test in tests.items():
        if hit := {n: severity_of(counts[n, k], total, C.MISSING_CUTOFFS) for n in names if counts[n, k]}:  # rules without a hit are left out of the scan
            rules.append(Finding(k, test, _by_column(hit), shows_value=k != "missing_null", names=list(hit)))
    for r in type_findings(profiles, text):
        (told if r.issue_type == "value_fails_type_conversion" else rules).append(r)
    if wordy := [n for n in text if kinds[n] in C.TEXT_TYPES]:
        rules += text_findings(wordy)
    if numeric:
        fences = {}
        for n in numeric:
            q = quartiles.get(n)
            if q and n in of and of[n]["finite"] >= 4 and q[1] > q[0]:
                reach = C.IQR_FACTOR * (q[1] - q[0])
                fences[n] = (q[0] - reach, q[1] + reach)
            if n in of and of[n]["finite"] >= 2 and of[n]["low"] == of[n]["high"]:
                whole.append(("suspiciously_constant_column", "Low", 0.6, n, None, None, None))
        for kept, group in ((rules, stored), (told, spoken)):
            if group:
                kept += numeric_findings(group, {n: f for n, f in fences.items() if n in group})
    if days := [n for n in names if kinds[n] in C.DATE_TYPES and n not in text]:
        rules += date_findings(days, [], now)
    if dated:
        told += date_findings(dated, dated, now)

    rules, told = ([r for r in kept if asked_for(r.issue_type)] for kept in (rules, told))
    wanted = [n for n in names if any(r.names is None or n in r.names for r in rules)]
    found = []
    for group in ([n for n in wanted if n in text], [n for n in wanted if n not in text]):  # text by itself, as its cells are told by less code
        if own_rules := [r for r in rules if group and (r.names is None or set(r.names) & set(group))]:
            found.append(explode_findings(cell_table(df, {n: kinds[n] for n in group}, parsed=False), own_rules))
    found.append(spark.createDataFrame([w for w in whole if asked_for(w[0])], FINDING))
    none = F.lit(None).cast("string")
    if names and got["empty"] and asked_for("empty_row"):
        found.append(df.filter(empty_row).select(F.lit("empty_row").alias("issue_type"), F.lit(severity_of(got["empty"], total, C.EMPTY_ROW_CUTOFFS)).alias("severity"), F.lit(float(C.ISSUES["empty_row"][1])).alias("confidence"), none.alias("column_name"), F.col(C.ROW_ID).alias("row_index"), none.alias("current_value"), none.alias("suggested_value")))
    if names and asked_for("exact_duplicate_row") and (repeats := duplicate_findings(df, total)) is not None:
        found.append(repeats)
    if some:
        of_columns = lambda group: own.filter(_within(group))
        flagged = [flag_values(parsed, told)] if told and parsed is not None else []
        if spelled:
            flagged.append(spelling_variants(of_columns(spelled).withColumn("similar", _within([n for n in spelled if kinds[n] == C.CATEGORICAL]))))
        if ids and asked_for("identifier_duplicate_value"):
            flagged.append(repeated_identifiers(of_columns(ids)))
        if ids and asked_for("identifier_inconsistent_format"):
            flagged.append(odd_shapes(of_columns(ids), E.signature(E.strip(F.col("value"))), "identifier_inconsistent_format", C.IDENTIFIER_MIN_ROWS))
        if mixed := [n for n in dated if kinds[n] == C.DATE_TEXT and asked_for("mixed_date_formats")]:
            flagged.append(odd_shapes(parsed.filter(_within(mixed) & F.col("day").isNotNull()), E.date_shape(F.col("value")), "mixed_date_formats"))
        if decimal := [n for n in spoken if kinds[n] in (C.NUMERIC_TEXT, C.CURRENCY) and asked_for("numeric_format_inconsistency")]:
            flagged.append(mixed_decimals(of_columns(decimal)))
        if flagged:
            every = flagged[0]
            for f in flagged[1:]:
                every = every.unionByName(f)
            found += flagged_findings(df, every)
    issues = found[0]
    for f in found[1:]:
        issues = issues.unionByName(f)
    issues = issues if only is None else issues.filter(F.col("issue_type").isin(*only))
    return decorate(issues, dataset, run_id, now)


def decorate(findings: DataFrame, dataset: str, run_id: str, now: str) -> DataFrame:
    """Findings with run, category, action and a stable id, so that every action sees the same rows."""
    def of(table: dict) -> Column:
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("issue_type")]

    ident = F.sha2(F.concat_ws("|", F.lit(run_id), "issue_type", F.coalesce("column_name", F.lit("")), F.coalesce(F.col("row_index").cast("string"), F.lit(""))), 256)
    return findings.select(
        ident.alias("issue_id"), F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset_name"), of({k: v[0] for k, v in C.ISSUES.items()}).alias("issue_category"), "issue_type", "severity",
        F.round("confidence", 3).alias("confidence"), "column_name", "row_index", "current_value", "suggested_value", of(ACTIONS).alias("recommended_action"), F.when(F.col("issue_type") == "possible_outlier", "possible_outlier_iqr").otherwise(F.col("issue_type")).alias("rule_name"),
        of({k: v[2] for k, v in C.ISSUES.items()}).alias("safe_to_auto_fix"), F.lit(now).alias("detected_at"),
    )


def summarize(issues: DataFrame) -> DataFrame:
    """(dimension, value, n): all issues, and by category, type and severity, in one pass."""
    sets = issues.groupingSets([[F.col("issue_category")], [F.col("issue_type")], [F.col("severity")], []], F.col("issue_category"), F.col("issue_type"), F.col("severity"))
    rows = sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return rows.select(F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "type").when(F.col("g") == 6, "severity").otherwise("total").alias("dimension"), F.coalesce("issue_category", "issue_type", "severity").alias("value"), "n")


def review_counts(issues: DataFrame) -> DataFrame:
    """Total, columns affected, High or Critical, and those that need a decision."""
    return issues.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("column_name").alias("columns_affected"), F.count_if(F.col("severity").isin("High", "Critical")).alias("high_or_critical"), F.count_if(~F.col("safe_to_auto_fix")).alias("needs_review"))
