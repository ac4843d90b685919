"""Guided strategies: what can be done about a group of issues, and the replacements it means."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import expr as E
from . import ranks as R


def numeric_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, median, mode (the smallest on a tie), quartiles, IQR and fences, four digits; nulls if there is no number."""
    v = E.number_of(df, column)
    v = F.when(~F.isnan(v), v)
    q = [F.lit(x).cast("double") for x in R.percentiles_of(df, {column: v}).get(column, [None] * 3)]
    reach = C.IQR_FACTOR * (q[2] - q[0])
    row = df.agg(F.avg(v).alias("mean")).join(F.broadcast(R.mode(df, v)))
    figures = {"mean": F.col("mean"), "median": q[1], "mode": F.col("mode"), "q1": q[0], "q3": q[2], "iqr": q[2] - q[0], "lower_fence": q[0] - reach, "upper_fence": q[2] + reach}
    return row.select(*[F.round(c, 4).alias(n) for n, c in figures.items()])


def categorical_mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value that is not blank; the smallest on a tie."""
    c = F.col(f"`{column}`")
    return R.mode(df, F.when(E.strip(c) != "", c))


def boolean_mode(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`")
    value = E.strip(F.lower(c)).isin("true", "yes", "y", "t") if E.is_text(df, column) else c
    return df.agg(F.mode(F.when(c.isNotNull(), value), True).alias("mode"))


def converts_wholly(df: DataFrame, column: str, to_type: str) -> DataFrame:
    """One row: whether every present value converts to ``number`` or ``date``."""
    c = F.col(f"`{column}`")
    parsed = E.to_number(c) if to_type == "number" else E.parse_date(c)
    return df.agg(F.coalesce(F.bool_and(F.when(c.isNotNull(), parsed.isNotNull())), F.lit(True)).alias("converts"))


def missing_strategies(kind: str) -> list[str]:
    """Ids of what may fill a missing value of an effective type; none for types without a safe choice."""
    if kind in C.NUMERIC_TYPES:
        return ["keep_null", "mean", "median", "mode", "zero", "custom", "per_row"]
    if kind == C.CATEGORICAL:
        return ["keep_null", "mode", "unknown", "custom", "per_row"]
    if kind == C.FREE_TEXT:
        return ["keep_null", "unknown", "not_provided", "custom", "per_row"]
    if kind == C.BOOLEAN:
        return ["keep_null", "true", "false", "mode", "per_row"]
    if kind in C.DATE_TYPES:
        return ["keep_null", "custom", "per_row"]
    if kind in (C.EMAIL, C.PHONE, C.URL, C.IDENTIFIER):
        return ["keep_null", "per_row"]
    return []


def outlier_strategies(kind: str) -> list[str]:
    return ["keep", "null", "median", "cap", "custom", "do_nothing"] if kind in C.NUMERIC_TYPES else []


def negative_strategies(kind: str, invalid: bool) -> list[str]:
    """First whether negatives are valid; only then what to put in their place."""
    if kind not in C.NUMERIC_TYPES:
        return []
    return ["null", "zero", "median", "custom"] if invalid else ["valid", "invalid"]


def variant_strategies() -> list[str]:
    return ["keep", "most_frequent", "select_canonical", "custom", "do_nothing"]


def resolve(df: DataFrame, issues: DataFrame, column: str, issue_type: str, strategy: str, custom: Any = None) -> DataFrame:
    """(row_index, new_value) of the rows of a group; no rows for strategies that keep values.

    For ``per_row``, ``custom`` is a table (row_index, new_value): values that are not blank go to
    the first rows of the group, as ``per_row_values`` gives them.
    Statistics are one broadcast row; only the quartiles pass the driver.
    """
    group = issues.filter((F.col("column_name") == column) & (F.col("issue_type") == issue_type)).select("row_index", "suggested_value").distinct()
    if strategy == "per_row" and custom is not None:
        given = custom.select("row_index", F.col("new_value").cast("string").alias("new_value")).filter(F.trim("new_value") != "")
        return given.join(per_row_values(df, issues, column, issue_type), "row_index", "left_semi")
    if strategy in ("keep", "keep_null", "valid", "do_nothing", "per_row"):
        return group.limit(0).select("row_index", F.lit(None).cast("string").alias("new_value"))
    if strategy == "most_frequent":
        return group.select("row_index", F.col("suggested_value").alias("new_value"))
    fixed = {"zero": "0", "null": None, "unknown": "Unknown", "not_provided": "Not Provided", "true": "true", "false": "false", "custom": custom, "select_canonical": custom}
    if strategy in fixed:
        value = fixed[strategy]
        return group.select("row_index", F.lit(None if value is None else str(value)).cast("string").alias("new_value"))
    if strategy == "cap":
        v = E.number_of(df, column)
        values = df.select(F.col(C.ROW_ID).alias("row_index"), v.alias("v")).join(F.broadcast(numeric_stats(df, column).select("lower_fence", "upper_fence")))
        capped: Column = F.when(F.col("v") < F.col("lower_fence"), F.col("lower_fence")).when(F.col("v") > F.col("upper_fence"), F.col("upper_fence")).otherwise(F.col("v"))
        return group.join(values, "row_index").select("row_index", capped.cast("string").alias("new_value"))
    numeric = strategy in ("mean", "median") or not E.is_text(df, column)
    stats = numeric_stats(df, column).select(F.col(strategy).alias("new_value")) if numeric else categorical_mode(df, column).select(F.col("mode").alias("new_value"))
    return group.join(F.broadcast(stats)).select("row_index", F.col("new_value").cast("string").alias("new_value"))


def per_row_values(df: DataFrame, issues: DataFrame, column: str, issue_type: str, limit: int = C.MAX_SAMPLE_ROWS) -> DataFrame:
    """(row_index, current_value) of the first ``limit`` rows of a group, to be given a value each; apply and ask again for the rest."""
    group = issues.filter((F.col("column_name") == column) & (F.col("issue_type") == issue_type) & F.col("row_index").isNotNull()).select("row_index").distinct()
    few = group.orderBy("row_index").limit(limit)
    return few.join(df.select(F.col(C.ROW_ID).alias("row_index"), F.col(f"`{column}`").cast("string").alias("current_value")), "row_index", "left")


def decision(run_id: str, column: str, issue_type: str, strategy: str, rows: int, when: str, note: str = "") -> dict[str, object]:
    """Log entry of a decision, also of one to keep values as they are."""
    return {"run_id": run_id, "column_name": column, "issue_type": issue_type, "strategy": strategy, "action": f"guided_{issue_type}_{strategy}", "rows_affected": rows, "changed": rows > 0, "decided_at": when, "note": note}
