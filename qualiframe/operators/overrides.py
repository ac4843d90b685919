"""Human type overrides and issue groups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import expr as E
from .profile import ColumnProfile


def apply_overrides(profiles: list[ColumnProfile], chosen: dict[str, str]) -> list[ColumnProfile]:
    """New profiles with the chosen effective types; a label that is no option changes nothing."""
    out = []
    for p in profiles:
        kind = C.OVERRIDE_OPTIONS.get(chosen.get(p.original_name, ""))
        out.append(replace(p, effective_logical_type=kind or p.logical_type, type_overridden=kind is not None and kind != p.logical_type, user_selected_type=chosen.get(p.original_name) if kind else None))
    return out


def option(label: Column) -> Column:
    """The type that a label offers; null for one that is no option."""
    return F.create_map(*[F.lit(x) for pair in C.OVERRIDE_OPTIONS.items() for x in pair])[label]


def override_frame(profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """The same on tables: ``overrides`` (column_name, label) joined to profiles."""
    chosen = overrides.select(F.col("column_name").alias("original_name"), option(F.col("label")).alias("chosen"))
    return profiles.drop("effective_logical_type").join(chosen, "original_name", "left").withColumn("effective_logical_type", F.coalesce("chosen", "logical_type")).drop("chosen")


def override_record(run_id: str, column: str, inferred: str, label: str, when: str) -> dict[str, object]:
    """Audit record of a choice, also of one that confirms the inferred type."""
    kind = C.OVERRIDE_OPTIONS.get(label, inferred)
    return {"run_id": run_id, "column_name": column, "inferred_type": inferred, "selected_label": label, "effective_type": kind, "changed": kind != inferred, "recorded_at": when}


def override_log(choices: DataFrame, run_id: str, when: str) -> DataFrame:
    """Audit records of a table of choices (column_name, inferred_type, label), as ``override_record`` makes them one by one."""
    kind = F.coalesce(option(F.col("label")), F.col("inferred_type"))
    return choices.select(
        F.lit(run_id).alias("run_id"), "column_name", "inferred_type", F.col("label").alias("selected_label"), kind.alias("effective_type"), (~kind.eqNullSafe(F.col("inferred_type"))).alias("changed"), F.lit(when).alias("recorded_at"))


# Headings of the tables of decisions, by column of the log.
DECISION_HEADINGS = {
    "run_id": "Run ID", "decided_at": "Timestamp", "dataset_name": "Dataset", "column_name": "Column", "issue_type": "Issue type", "effective_type": "Effective type", "confidence": "Confidence",
    "strategy": "Strategy", "scope": "Scope", "rows_affected": "Affected count", "user_approved": "Approved", "result": "Decision result", "custom_value": "Custom value", "note": "Reason",
}
HISTORY_HEADINGS = {"recorded_at": "Timestamp", "inferred_type": "Original type", "confidence": "Original confidence", "effective_type": "New type", "user_approved": "User approved"}


def _headed(log: DataFrame, headings: dict[str, str]) -> DataFrame:
    return log.select(*[(F.col(c) if c in log.columns else F.lit(None).cast("string")).alias(h) for c, h in headings.items()])


def decision_table(log: DataFrame) -> DataFrame:
    """The log of cleaning decisions for show and export; columns that it lacks are null."""
    return _headed(log, DECISION_HEADINGS)


def type_history(log: DataFrame, column: str) -> DataFrame:
    """Type decisions on one column, in the order they were taken."""
    return _headed(log.filter(F.col("column_name") == column).orderBy("recorded_at"), HISTORY_HEADINGS)


def low_confidence(profiles: DataFrame, threshold: float = C.LOW_CONFIDENCE) -> DataFrame:
    return profiles.filter(F.col("confidence") < threshold)


def _guided(issues: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return issues.filter(F.col("issue_type").isin(*types) & (F.col("column_name") != ""))


def group_counts(issues: DataFrame, types: tuple[str, ...] = C.GUIDED_TYPES, profiles: DataFrame | None = None) -> DataFrame:
    """(column_name, issue_type, severity, n_issues, n_rows, first_row, last_row) of the guided types, most severe and largest first.

    With ``profiles`` (as of ``profile_frame``) a group also has issue_category, recommended_action and the
    effective_logical_type and inference_confidence of its column, Unknown and 0 for one without a profile.
    Its rows are those of ``group_rows``.
    """
    kept = ["issue_category", "recommended_action"] if profiles is not None else []
    groups = _guided(issues, types).groupBy("column_name", "issue_type")
    groups = groups.agg(F.max(E.severity_rank(F.col("severity"))).alias("rank"), F.count(F.lit(1)).alias("n_issues"), F.count_distinct("row_index").alias("n_rows"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"), *[F.min(c).alias(c) for c in kept])
    name = F.element_at(F.array(*[F.lit(s) for s in C.SEVERITIES]), F.col("rank") + 1)
    if profiles is not None:
        of = profiles.select(F.col("original_name").alias("column_name"), "effective_logical_type", F.col("confidence").alias("inference_confidence"))
        groups = groups.join(F.broadcast(of), "column_name", "left").withColumns({"effective_logical_type": F.coalesce("effective_logical_type", F.lit("Unknown")), "inference_confidence": F.coalesce("inference_confidence", F.lit(0.0))})
        kept += ["effective_logical_type", "inference_confidence"]
    return groups.orderBy(F.desc("rank"), F.desc("n_issues"), "column_name", "issue_type").select("column_name", "issue_type", name.alias("severity"), "n_issues", "n_rows", "first_row", "last_row", *kept)


def group_rows(issues: DataFrame, types: tuple[str, ...] = C.GUIDED_TYPES) -> DataFrame:
    """(column_name, issue_type, row_index): each affected row of each group once, in a table of any length."""
    return _guided(issues, types).filter("row_index is not null").select("column_name", "issue_type", "row_index").distinct()


def issue_groups(issues: DataFrame, types: tuple[str, ...] = C.GUIDED_TYPES) -> DataFrame:
    """(column_name, issue_type, severity, n_issues, row_indices), the rows of a group in one cell.

    For tables small enough to show; ``group_counts`` and ``group_rows`` hold groups of any size.
    """
    rows = group_rows(issues, types).groupBy("column_name", "issue_type").agg(F.sort_array(F.collect_list("row_index")).alias("row_indices"))
    groups = group_counts(issues, types).join(rows, ["column_name", "issue_type"], "left").withColumn("row_indices", F.coalesce("row_indices", F.array().cast("array<long>")))
    order = F.desc(E.severity_rank(F.col("severity"))), F.desc("n_issues"), F.col("column_name"), F.col("issue_type")
    return groups.orderBy(*order).select("column_name", "issue_type", "severity", "n_issues", "row_indices")


def filter_issues(issues: DataFrame, **chosen: list[str]) -> DataFrame:
    """Issues whose columns are in the given lists; an empty list does not filter."""
    for column, values in chosen.items():
        if values:
            issues = issues.filter(F.col(column).isin(*values))
    return issues


def sample_rows(df: DataFrame, issues: DataFrame, limit: int = C.MAX_SAMPLE_ROWS) -> DataFrame:
    """Rows of the first ``limit`` affected row ids, in order."""
    ids = issues.filter("row_index is not null").select(F.col("row_index").alias(C.ROW_ID)).distinct().orderBy(C.ROW_ID).limit(limit)
    return df.join(ids, C.ROW_ID, "left_semi").orderBy(C.ROW_ID)
