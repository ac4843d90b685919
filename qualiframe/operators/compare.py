"""Before and after: the aggregates of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import expr as E
from .detect import repeated_rows
from .profile import data_columns


def by_key(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts of a key before and after; a key that one side lacks counts 0."""
    a, b = (d.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n)) for d, n in ((before, "before"), (after, "after")))
    zero = F.lit(0).cast("long")
    return a.join(b, key, "full_outer").select(key, F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"))


def totals(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.agg(F.count(F.lit(1)).alias("issues")).select(F.lit("Before").alias("version"), "issues").unionByName(after.agg(F.count(F.lit(1)).alias("issues")).select(F.lit("After").alias("version"), "issues"))


def categories(before: DataFrame, after: DataFrame) -> DataFrame:
    return by_key(before, after, "issue_category").orderBy("issue_category")


def severities(before: DataFrame, after: DataFrame) -> DataFrame:
    return by_key(before, after, "severity").orderBy(F.desc(E.severity_rank(F.col("severity"))))


def top_columns(before: DataFrame, after: DataFrame, limit: int = 10) -> DataFrame:
    """Columns with the most issues before, with their counts after."""
    top = before.filter("column_name is not null").groupBy("column_name").agg(F.count(F.lit(1)).alias("before")).orderBy(F.desc("before"), "column_name").limit(limit)
    return top.join(after.groupBy("column_name").agg(F.count(F.lit(1)).alias("after")), "column_name", "left").select("column_name", "before", F.coalesce("after", F.lit(0).cast("long")).alias("after")).orderBy(F.desc("before"), "column_name")


def components(before: DataFrame, after: DataFrame) -> DataFrame:
    """Component scores side by side and their difference."""
    right = after.select("component_name", F.col("component_score").alias("after"))
    return before.select("component_name", F.col("component_score").alias("before")).join(right, "component_name", "left").withColumn("delta", F.round(F.col("after") - F.col("before"), 2))


def impact(audit: DataFrame) -> DataFrame:
    """Changes, distinct rows and distinct columns by action."""
    return audit.groupBy("cleaning_action").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("row_index").alias("rows_changed"), F.count_distinct("column_name").alias("columns_changed")).orderBy(F.desc("changes"), "cleaning_action")


def unresolved(issues: DataFrame) -> DataFrame:
    """Issues that need a decision, by type and category, with the first action recommended."""
    left = issues.filter(~F.col("safe_to_auto_fix"))
    return left.groupBy("issue_type", "issue_category").agg(F.count(F.lit(1)).alias("n"), F.min_by("recommended_action", F.struct("column_name", "row_index")).alias("recommended_action")).orderBy(F.desc("n"), "issue_type")


def split_by_decision(issues: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, still to review): whether (column, type) has a decision."""
    done = decisions.select("column_name", "issue_type").distinct()
    return issues.join(done, ["column_name", "issue_type"], "left_semi"), issues.join(done, ["column_name", "issue_type"], "left_anti")


def melt(wide: DataFrame, key: str) -> DataFrame:
    return wide.unpivot(key, ["before", "after"], "version", "value")


def kpis(rows: DataFrame, before: DataFrame, score_before: DataFrame, after: DataFrame | None = None, score_after: DataFrame | None = None) -> DataFrame:
    """Seven figures in one row; what is about the cleaned table is null unless both its inputs are given."""
    one = rows.agg(F.count(F.lit(1)).alias("total_rows")).select("total_rows", F.lit(len(data_columns(rows))).alias("total_columns"))
    one = one.join(F.broadcast(before.agg(F.count(F.lit(1)).alias("issues_before")))).join(F.broadcast(score_before.select(F.col("overall_score").alias("score_before"))))
    if after is None or score_after is None:
        return one.select("*", F.lit(None).cast("long").alias("issues_after"), F.lit(None).cast("double").alias("score_after"), F.lit(None).cast("double").alias("score_improvement"))
    one = one.join(F.broadcast(after.agg(F.count(F.lit(1)).alias("issues_after")))).join(F.broadcast(score_after.select(F.col("overall_score").alias("score_after"))))
    return one.withColumn("score_improvement", F.round(F.col("score_after") - F.col("score_before"), 2))


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and repeated rows."""
    names = data_columns(df)
    gone = sum((F.count_if(E.missing(df, n)) for n in names), F.lit(0))
    sized = df.agg(F.count(F.lit(1)).alias("n_rows"), gone.alias("missing_cells")).withColumn("n_columns", F.lit(len(names)))
    return sized.join(F.broadcast(repeated_rows(df).agg(F.count(F.lit(1)).alias("duplicate_rows"))))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    return overview(before).withColumn("version", F.lit("original")).unionByName(overview(after).withColumn("version", F.lit("cleaned")))


def changed_rows(before: DataFrame, after: DataFrame, audit: DataFrame, limit: int = 10) -> DataFrame:
    """The first changed row ids and whether each row is still there."""
    ids = audit.filter("row_index is not null").select(F.col("row_index").alias(C.ROW_ID)).distinct().orderBy(C.ROW_ID).limit(limit)
    return ids.join(after.select(C.ROW_ID, F.lit(True).alias("present")), C.ROW_ID, "left").select(C.ROW_ID, F.coalesce("present", F.lit(False)).alias("present")).orderBy(C.ROW_ID)


def fix_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("cleaning_action").agg(F.count(F.lit(1)).alias("changes")).orderBy("cleaning_action")


def frequent_values(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(limit)
