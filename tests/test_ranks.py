"""Percentiles by rank, groups of issues."""

import random

from pyspark.sql import functions as F

from qualiframe.operators import profile, ranks, strategies


def test_percentiles_by_ranges_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SORTED", 3)
    monkeypatch.setattr(ranks, "BUCKETS", 4)
    rng = random.Random(1)
    rows = [(rng.gauss(0, 1), rng.choice([-1.0, 1.0]) * 10 ** rng.uniform(-300, 300), float(rng.randrange(5)), 1e15 + i) for i in range(400)]
    rows += [(None, float("inf"), 0.0, None), (None, float("-inf"), -0.0, None), (0.0, 5e-324, None, None), (0.0, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = ranks.percentiles_of(df, {c: F.col(c) for c in df.columns}, shares)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in df.columns]).first()
    assert {c: [str(x + 0.0) for x in v] for c, v in got.items()} == {c: [str(x + 0.0) for x in want[c]] for c in df.columns}
    assert ranks.percentiles_of(df.limit(0), {"a": F.col("a")}) == {}


def test_no_aggregate_holds_all_values(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "_row_id long, x double")
    assert "percentile" not in str(profile.plain_aggregates(df))
    plan = strategies.numeric_stats(df, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "mode(" not in plan
    ties = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 2.0), (3, 1.0), (4, None)], "_row_id long, x double")
    assert strategies.numeric_stats(ties, "x").first()["mode"] == 1.0
    assert strategies.numeric_stats(ties.limit(0), "x").collect() == [(None,) * 8]


def test_groups_of_issues_are_counted_not_collected(spark):
    from qualiframe.operators import overrides

    rows = [("a", "missing_null", "Low", 3), ("a", "missing_null", "High", 1), ("a", "missing_null", "Low", 3), ("b", "missing_null", "Low", None), (None, "missing_null", "Low", 5), ("a", "other", "Low", 1)]
    issues = spark.createDataFrame(rows, "column_name string, issue_type string, severity string, row_index long")
    counts = overrides.group_counts(issues)
    assert [tuple(r) for r in counts.collect()] == [("a", "missing_null", "High", 3, 2, 1, 3), ("b", "missing_null", "Low", 1, 0, None, None)]
    assert "collect_" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, overrides.group_rows(issues).collect())) == [("a", "missing_null", 1), ("a", "missing_null", 3)]
    assert [r["row_indices"] for r in overrides.issue_groups(issues).collect()] == [[1, 3], []]


def test_groups_have_the_profiles_of_their_columns(spark):
    """Category, action, effective type and confidence; larger groups, by issues, first."""
    from qualiframe.operators import overrides

    one, two = ("Missing Value", "Look at it."), ("Numeric", "Decide.")
    rows = [("a", "missing_null", "Low", 1, *one), ("a", "missing_null", "Low", 2, *one), ("b", "negative_value", "Low", 5, *two), ("b", "negative_value", "Low", 5, *two), ("b", "negative_value", "Low", 5, *two), ("c", "missing_null", "High", 7, *one), ("", "missing_null", "High", 7, *one)]
    issues = spark.createDataFrame(rows, "column_name string, issue_type string, severity string, row_index long, issue_category string, recommended_action string")
    profiles = spark.createDataFrame([("a", "Free text", 0.5), ("b", "Decimal", 1.0), ("z", "Empty", 1.0)], "original_name string, effective_logical_type string, confidence double")
    got = overrides.group_counts(issues, profiles=profiles)
    assert got.columns[7:] == ["issue_category", "recommended_action", "effective_logical_type", "inference_confidence"]
    assert [tuple(r) for r in got.collect()] == [
        ("c", "missing_null", "High", 1, 1, 7, 7, *one, "Unknown", 0.0), ("b", "negative_value", "Low", 3, 1, 5, 5, *two, "Decimal", 1.0), ("a", "missing_null", "Low", 2, 2, 1, 2, *one, "Free text", 0.5)]
