"""Weighted quality scores from issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import expr as E
from .profile import data_columns


def component_map(spark) -> DataFrame:
    """(issue_type, component_name): which component an issue type counts for; each counts once at most."""
    return spark.createDataFrame([(t, name) for name, (_, types) in C.COMPONENTS.items() for t in types], "issue_type string, component_name string")


def weights(spark) -> DataFrame:
    """(component_name, component_weight, place) of each component, in order."""
    return spark.createDataFrame([(n, w, i) for i, (n, (w, _)) in enumerate(C.COMPONENTS.items())], "component_name string, component_weight double, place int")


def table_size(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells that are not null."""
    names = data_columns(df)
    here = sum((F.count_if(~E.missing(df, n)) for n in names), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(names)).alias("n_columns"), here.alias("n_present"))


def score(df: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per component: score, issue_count, denominator, penalty, weight and weighted contribution."""
    spark = df.sparkSession
    # Rows are told apart for the one component that counts them, so other findings are added up where they are found.
    counted = issues.join(F.broadcast(component_map(spark)), "issue_type").groupBy("component_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("component_name") == "Uniqueness", F.col("row_index"))).alias("n_rows_hit"))
    # The size is a single row; the join adds it to five.
    rows = weights(spark).join(counted, "component_name", "left").join(F.broadcast(table_size(df)))
    count = F.coalesce(F.when(F.col("component_name") == "Uniqueness", F.col("n_rows_hit")).otherwise(F.col("n")), F.lit(0))
    total = (
        F.when(F.col("component_name") == "Completeness", F.col("n_rows") * F.col("n_columns")).when(F.col("component_name") == "Uniqueness", F.col("n_rows"))
        .when(F.col("component_name") == "Structural Quality", F.col("n_rows") + F.col("n_columns")).otherwise(F.col("n_present"))
    )
    rows = rows.withColumn("issue_count", count).withColumn("denominator", total)
    value, penalty = E.score_of(F.col("issue_count"), F.col("denominator"))
    rows = rows.withColumn("component_score", value).withColumn("penalty", penalty)
    explained = F.format_string("%d findings among %d", F.col("issue_count"), F.col("denominator"))
    return rows.withColumn("weighted_contribution", F.round(F.col("component_score") * F.col("component_weight") / 100, 2)).orderBy("place").select("component_name", "component_score", "issue_count", "denominator", "penalty", "component_weight", "weighted_contribution", explained.alias("calculation_explanation"))


def overall(components: DataFrame) -> DataFrame:
    return components.agg(F.round(F.sum("weighted_contribution"), 2).alias("overall_score"))
