"""Safe fixes and approved replacements with a complete audit; the input frame never changes.

Every fix is a projection or a filter of the frame before it, so any number of them is one plan; the
audit of a fix is another reading of the same plan, not of collected rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .. import config as C
from ..functions import expr as E
from .detect import repeated_rows
from .profile import ColumnProfile, data_columns, normalize_name

AUDIT = "row_index long, column_name string, original_value string, new_value string, cleaning_action string, rule_name string, reason string, user_approved boolean, confidence double"


@dataclass
class Fixed:
    """Outcome of fixes: the frame, the audit so far, ids applied and skipped, and notes."""

    df: DataFrame
    audit: DataFrame
    applied: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def _entry(action: str, reason: Column | str, column: str | None, old: Column, new: Column, confidence: float = 1.0, approved: bool = True) -> Column:
    return F.struct(
        F.col(C.ROW_ID).alias("row_index"), F.lit(column).cast("string").alias("column_name"), old.cast("string").alias("original_value"), new.cast("string").alias("new_value"),
        F.lit(action).alias("cleaning_action"), F.lit(action).alias("rule_name"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(approved).alias("user_approved"), F.lit(confidence).alias("confidence"),
    )


def _no_audit(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], AUDIT)


def change_cells(df: DataFrame, changes: dict[str, Column], action: str, reasons: dict[str, Column] | str) -> tuple[DataFrame, DataFrame]:
    """(changed frame, audit): one entry for each cell that is not what it was."""
    if not changes:
        return df, _no_audit(df)
    entries = []
    for n, new in changes.items():
        old = F.col(f"`{n}`")
        entries.append(F.when(~old.eqNullSafe(new), _entry(action, reasons if isinstance(reasons, str) else reasons[n], n, old, new)))
    audit = df.select(F.explode(F.array_compact(F.array(*entries))).alias("a")).select("a.*")
    return df.withColumns(changes), audit


def _text(df: DataFrame) -> list[str]:
    return [n for n in data_columns(df) if E.is_text(df, n)]


def trim_whitespace(df: DataFrame, _: list[ColumnProfile]):
    return *change_cells(df, {n: E.strip(F.col(f"`{n}`")) for n in _text(df)}, "trim_whitespace", "Outer white space removed."), []


def collapse_internal_spaces(df: DataFrame, _: list[ColumnProfile]):
    return *change_cells(df, {n: E.collapse(F.col(f"`{n}`")) for n in _text(df)}, "collapse_internal_spaces", "Runs of white space made one space."), []


def remove_non_printable(df: DataFrame, _: list[ColumnProfile]):
    return *change_cells(df, {n: E.printable(F.col(f"`{n}`")) for n in _text(df)}, "remove_non_printable", "Characters that cannot be shown removed."), []


def nullify_blank_and_placeholders(df: DataFrame, _: list[ColumnProfile]):
    changes, reasons = {}, {}
    for n in _text(df):
        c = F.col(f"`{n}`")
        blank = E.strip(c) == ""
        changes[n] = F.when(~(blank | E.is_placeholder(c)), c)
        reasons[n] = F.when(blank, "A blank value means missing.").otherwise("A placeholder means missing.")
    return *change_cells(df, changes, "nullify_blank_and_placeholders", reasons), []


def new_names(names: list[str]) -> dict[str, str]:
    """Normalised names; the second of a kind gets _2, the third _3, until unused."""
    out: dict[str, str] = {}
    for n in names:
        base, name, k = normalize_name(n), normalize_name(n), 1
        while name in out.values():
            k += 1
            name = f"{base}_{k}"
        out[n] = name
    return out


def _names_audit(df: DataFrame, rows: list[tuple[str, str | None]], action: str, reason: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(None, old, old, new, action, action, reason, True, 1.0) for old, new in rows], AUDIT)


def normalize_columns(df: DataFrame, _: list[ColumnProfile]):
    names = new_names(data_columns(df))
    out = df.select(*([C.ROW_ID] if C.ROW_ID in df.columns else []), *[F.col(f"`{o}`").alias(n) for o, n in names.items()])
    return out, _names_audit(df, [(o, n) for o, n in names.items() if o != n], "normalize_columns", "Name brought to one style."), []


def remove_empty_rows(df: DataFrame, _: list[ColumnProfile]):
    names = data_columns(df)
    if not names:
        return df, _no_audit(df), []
    empty = E.missing(df, names[0])
    for n in names[1:]:
        empty = empty & E.missing(df, n)
    none = F.lit(None)
    return df.filter(~empty), df.filter(empty).select(_entry("remove_empty_rows", "No column had a value.", None, none, none).alias("a")).select("a.*"), []


def remove_empty_columns(df: DataFrame, _: list[ColumnProfile]):
    names = data_columns(df)
    counts = df.agg(*[F.count_if(~E.missing(df, n)).alias(str(i)) for i, n in enumerate(names)]).first() if names else ()
    gone = [n for n, k in zip(names, counts) if not k]
    return df.select(*[F.col(f"`{n}`") for n in df.columns if n not in gone]), _names_audit(df, [(n, None) for n in gone], "remove_empty_columns", "No row had a value."), []


def _convert(df: DataFrame, profiles: list[ColumnProfile], kind: str, parse: Callable[[Column], Column], action: str):
    """Convert text columns of a type if every present value converts; a note tells which were left."""
    names = [p.original_name for p in profiles if p.effective_logical_type == kind and p.original_name in df.columns and E.is_text(df, p.original_name)]
    if not names:
        return df, _no_audit(df), []
    failed = df.agg(*[F.count_if(F.col(f"`{n}`").isNotNull() & parse(F.col(f"`{n}`")).isNull()).alias(str(i)) for i, n in enumerate(names)]).first()
    good = [n for n, k in zip(names, failed) if not k]
    notes = [f"{n} stays text: {k} values do not convert" for n, k in zip(names, failed) if k]
    if not good:
        return df, _no_audit(df), notes
    entries = [F.when(F.col(f"`{n}`").isNotNull(), _entry(action, "Every value of the column converts.", n, F.col(f"`{n}`"), parse(F.col(f"`{n}`")))) for n in good]
    audit = df.select(F.explode(F.array_compact(F.array(*entries))).alias("a")).select("a.*")
    return df.withColumns({n: parse(F.col(f"`{n}`")) for n in good}), audit, notes


def convert_dates(df: DataFrame, profiles: list[ColumnProfile]):
    return _convert(df, profiles, C.DATE_TEXT, lambda c: E.parse_date(c).cast("timestamp_ntz"), "convert_dates")


def convert_numbers(df: DataFrame, profiles: list[ColumnProfile]):
    return _convert(df, profiles, C.NUMERIC_TEXT, E.to_number, "convert_numbers")


def drop_duplicates(df: DataFrame, _: list[ColumnProfile]):
    """Keeps the first of equal rows, which dropDuplicates() does not promise."""
    repeats = repeated_rows(df)
    none = F.lit(None)
    audit = repeats.select(_entry("drop_duplicates", "The row repeats an earlier one.", None, none, none).alias("a")).select("a.*")
    return df.join(repeats, C.ROW_ID, "left_anti"), audit, []


@dataclass(frozen=True)
class Fix:
    fix_id: str
    title: str
    run: Callable
    needs_approval: bool = False


#: Fixes run in this order, whatever order they are asked for in.
FIXES = (
    Fix("trim_whitespace", "Trim white space", trim_whitespace), Fix("collapse_internal_spaces", "Collapse spaces", collapse_internal_spaces),
    Fix("remove_non_printable", "Remove non-printable characters", remove_non_printable), Fix("nullify_blank_and_placeholders", "Blank and placeholder values to null", nullify_blank_and_placeholders),
    Fix("normalize_columns", "Normalise column names", normalize_columns), Fix("remove_empty_rows", "Remove empty rows", remove_empty_rows), Fix("remove_empty_columns", "Remove empty columns", remove_empty_columns),
    Fix("convert_dates", "Text to dates", convert_dates), Fix("convert_numbers", "Text to numbers", convert_numbers), Fix("drop_duplicates", "Drop repeated rows", drop_duplicates, needs_approval=True),
)


_TEXT_FIXES = ("trim_whitespace", "collapse_internal_spaces", "remove_non_printable", "nullify_blank_and_placeholders")


def apply_fixes(df: DataFrame, profiles: list[ColumnProfile], chosen: list[str]) -> Fixed:
    """The chosen fixes in registry order; those not chosen are reported as skipped.

    Text fixes nest expressions, and what follows reads each cell many times, so their result is
    persisted once (memory, then disk; a lost part is computed again).
    """
    out = Fixed(df, _no_audit(df))
    names = {p.original_name: p.original_name for p in profiles}
    for fix in FIXES:
        if fix.fix_id not in chosen:
            out.skipped.append(fix.fix_id)
            continue
        before = data_columns(out.df)
        if out.applied and out.applied[-1] in _TEXT_FIXES and fix.fix_id not in _TEXT_FIXES:
            out.df = out.df.persist(StorageLevel.MEMORY_AND_DISK)
        out.df, audit, notes = fix.run(out.df, [_renamed(p, names) for p in profiles])
        if fix.fix_id == "normalize_columns":  # later fixes know columns by their new names
            renamed = new_names(before)
            names = {o: renamed.get(n, n) for o, n in names.items()}
        out.audit = out.audit.unionByName(audit)
        out.applied.append(fix.fix_id)
        out.notes += notes
    return out


def _renamed(p: ColumnProfile, names: dict[str, str]) -> ColumnProfile:
    from dataclasses import replace

    return replace(p, original_name=names[p.original_name])


def preview_fixes(df: DataFrame, profiles: list[ColumnProfile]) -> DataFrame:
    """(fix_id, affected) of all fixes run one after the other, counted without a change."""
    audit = apply_fixes(df, profiles, [f.fix_id for f in FIXES]).audit
    every = df.sparkSession.createDataFrame([(f.fix_id, i) for i, f in enumerate(FIXES)], "fix_id string, place int")
    counts = audit.groupBy(F.col("cleaning_action").alias("fix_id")).agg(F.count(F.lit(1)).alias("affected"))
    return every.join(counts, "fix_id", "left").orderBy("place").select("fix_id", F.coalesce("affected", F.lit(0).cast("long")).alias("affected"))


def replace_values(df: DataFrame, column: str, replacements: DataFrame, action: str, reason: str, confidence: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """New values of one column from (row_index, new_value); a null new value makes null. Every asked-for row is audited."""
    kind = df.schema[column].dataType
    asked = replacements.select(F.col("row_index").alias("_row"), F.col("new_value").cast(kind).alias("_new"), F.lit(True).alias("_asked"))
    both = df.join(asked, F.col(C.ROW_ID) == F.col("_row"), "left")
    audit = both.filter("_asked").select(_entry(action, reason, column, F.col(f"`{column}`"), F.col("_new"), confidence).alias("a")).select("a.*")
    out = both.withColumn(column, F.when(F.col("_asked"), F.col("_new")).otherwise(F.col(f"`{column}`"))).select(*[F.col(f"`{n}`") for n in df.columns])
    return out, audit


def merge(first: Fixed, second: Fixed) -> Fixed:
    """Two runs as one: audits follow each other, ids unite, the last skips and notes hold."""
    applied = first.applied + [x for x in second.applied if x not in first.applied]
    return Fixed(second.df, first.audit.unionByName(second.audit), applied, second.skipped, first.notes + second.notes)
