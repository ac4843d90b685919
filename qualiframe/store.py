"""Run store: the eight tables of a run history on Parquet behind a log of commits, and the history queries."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .sources.files import delete, names_in, put_if_absent

# Tables and columns of a stored run.
SCHEMAS = {
    "schema_info": "schema_version string, applied_at string",
    "profiling_runs": "run_id string, dataset_name string, file_type string, selected_sheet string, run_timestamp string, original_row_count long, original_column_count long, cleaned_row_count long, cleaned_column_count long, cleaning_applied boolean, schema_version string",
    "dataset_profiles": "run_id string, dataset_version string, row_count long, column_count long, total_cells long, duplicate_row_count long, empty_row_count long, empty_column_count long, total_missing_count long, missing_pct double, overall_score double",
    "column_profiles": "run_id string, dataset_version string, column_name string, normalized_name string, storage_type string, logical_type string, confidence double, non_null_count long, missing_count long, missing_pct double, unique_count long, unique_ratio double, outlier_count long",
    "data_quality_issues": "run_id string, dataset_version string, issue_id string, column_name string, row_index long, issue_category string, issue_type string, severity string, confidence double, current_value string, suggested_value string, recommended_action string, safe_to_auto_fix boolean, rule_name string, detected_at string",
    "cleaning_audit_log": "run_id string, row_index long, column_name string, original_value string, new_value string, cleaning_action string, rule_name string, reason string, user_approved boolean, confidence double",
    "applied_fixes": "run_id string, fix_id string, fix_title string, affected_count long",
    "quality_scores": "run_id string, dataset_version string, component_name string, component_score double, issue_count long, denominator long, penalty double, component_weight double, weighted_contribution double, calculation_explanation string",
}
CHECKS = {
    "dataset_profiles": "dataset_version in ('original', 'cleaned')", "column_profiles": "dataset_version in ('original', 'cleaned')",
    "data_quality_issues": "dataset_version in ('original', 'cleaned') and severity in ('Low', 'Medium', 'High', 'Critical')", "quality_scores": "dataset_version in ('original', 'cleaned')",
}
UNIQUE = {"profiling_runs": ["run_id"], "dataset_profiles": ["run_id", "dataset_version"], "quality_scores": ["run_id", "dataset_version", "component_name"]}


LOG = "version long, action string, attempt string, run_id string, schema_version string, noted_at string"

#: The ladder of schema versions after the first: version, table, added column, and what older rows have in it.
STEPS = [("1.1.0", "column_profiles", "outlier_count", None)]


class StoreError(Exception):
    pass


def violations(tables: dict[str, DataFrame]) -> list[str]:
    """Names of tables that break a check, a unique key or the reference to their run."""
    out = []
    for name, rule in CHECKS.items():
        if name in tables and not tables[name].filter(f"not ({rule}) or run_id is null").isEmpty():
            out.append(f"{name}: check")
    for name, key in UNIQUE.items():
        if name in tables and not tables[name].groupBy(*key).count().filter("count > 1").isEmpty():
            out.append(f"{name}: unique")
    runs = tables["profiling_runs"].select("run_id")
    return out + [f"{name}: run" for name, t in tables.items() if name != "profiling_runs" and "run_id" in t.columns and not t.join(runs, "run_id", "left_anti").isEmpty()]


class RunStore:
    """Runs below ``root``: ``log/`` with a numbered file a commit, and ``<table>/attempt=<id>/`` with the rows of one save.

    A save writes its rows into a folder of its own and then takes the next number of the log, which
    only one writer gets (see ``files.put_if_absent``).  Rows count if the log names their attempt, so
    one that broke off is never seen and can be repeated; a run id that another writer committed
    meanwhile is refused; taking a run out of the log takes its rows out of every table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- log

    def log(self) -> DataFrame:
        """(version, action, attempt, run_id, schema_version, noted_at), a row a commit."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.root}/log").filter("version is not null")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def _commit(self, check: Callable[[], bool], **entry: str | None) -> bool:
        """Add an entry after ``check`` has seen all before it; False if it says that there is nothing to add."""
        while True:
            version = max((int(n.split(".")[0]) for n in names_in(self.spark, f"{self.root}/log")), default=0) + 1
            if not check():
                return False
            if put_if_absent(self.spark, f"{self.root}/log/{version:012d}.json", json.dumps({"version": version, **entry}).encode()):
                return True

    # -- reading

    def _rows(self, name: str, attempt: str | None = None) -> DataFrame:
        """All rows ever written, whole saves or not; those older than a column have null in it."""
        try:
            rows = self.spark.read.schema(f"{SCHEMAS[name]}, attempt string").parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{SCHEMAS[name]}, attempt string")
        return rows.filter(F.col("attempt") == attempt) if attempt else rows

    def table(self, name: str) -> DataFrame:
        """Rows of committed runs that were not deleted since."""
        log = self.log()
        if name == "schema_info":
            return log.filter("action = 'schema'").select("schema_version", F.col("noted_at").alias("applied_at"))
        adds = log.filter("action = 'add'").select("attempt", F.col("version").alias("_added"))
        gone = log.filter("action = 'remove'").select(F.col("run_id").alias("_run"), F.col("version").alias("_gone"))
        rows = self._rows(name).join(adds, "attempt").join(gone, (F.col("run_id") == F.col("_run")) & (F.col("_gone") > F.col("_added")), "left_anti")
        filled = {column: F.coalesce(column, F.lit(value)) for _, of, column, value in STEPS if of == name and value is not None}
        return rows.drop("attempt", "_added").withColumns(filled) if filled else rows.drop("attempt", "_added")

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in SCHEMAS if n != "schema_info"}

    def detail(self, run_id: str) -> dict[str, DataFrame]:
        names = ("profiling_runs", "column_profiles", "data_quality_issues", "cleaning_audit_log", "applied_fixes", "quality_scores")
        return {n: self.table(n).filter(F.col("run_id") == run_id) for n in names}

    def known(self, ids: DataFrame) -> DataFrame:
        """``ids`` (run_id) with ``known``: whether the run is stored."""
        stored = self.table("profiling_runs").select("run_id", F.lit(True).alias("known"))
        return ids.join(stored, "run_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))

    def exists(self, run_id: str) -> bool:
        return not self.table("profiling_runs").filter(F.col("run_id") == run_id).limit(1).isEmpty()

    # -- writing

    def init(self, when: str) -> None:
        """Bring the store to the present schema: each step of the ladder is noted once, in order; nothing stored is rewritten."""
        noted = lambda: {r["schema_version"] for r in self.table("schema_info").collect()}  # noqa: E731  one row a step
        number = lambda version: [int(x) for x in version.split(".")]
        oldest = number(min(noted(), key=number, default=C.SCHEMA_VERSION))
        steps = list(dict.fromkeys([s for s, *_ in STEPS if number(s) > oldest] + [C.SCHEMA_VERSION]))
        for step in steps:
            self._commit(lambda step=step: step not in noted(), action="schema", schema_version=step, noted_at=when)

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Store rows as a new attempt that no reader sees yet."""
        attempt = f"a{uuid.uuid4().hex}"
        for name, rows in tables.items():
            # sorted, so that a run is found by the ranges of row groups
            rows.sortWithinPartitions("run_id").write.parquet(f"{self.root}/{name}/attempt={attempt}")
        return attempt

    def _drop(self, attempt: str) -> None:
        for name in SCHEMAS:
            delete(self.spark, f"{self.root}/{name}/attempt={attempt}")

    def save(self, run_id: str, tables: dict[str, DataFrame]) -> None:
        """Store one run, whole or not at all."""
        self.save_all({n: t.withColumn("run_id", F.lit(run_id)) for n, t in tables.items()})

    def save_all(self, tables: dict[str, DataFrame]) -> None:
        """Store the runs of ``profiling_runs`` and what the other tables hold of them, all or none."""
        attempt = self.write({n: self._shaped(n, t) for n, t in tables.items()})
        try:
            written = {n: self._rows(n, attempt).drop("attempt") for n in tables}
            if broken := violations(written):
                raise StoreError("; ".join(broken))

            def new() -> bool:
                again = written["profiling_runs"].join(self.table("profiling_runs"), "run_id", "left_semi").select("run_id").limit(1).collect()
                if again:
                    raise StoreError(f"run {again[0]['run_id']} is stored already")
                return True

            self._commit(new, action="add", attempt=attempt, schema_version=C.SCHEMA_VERSION)
        except StoreError:
            self._drop(attempt)
            raise

    def delete(self, run_id: str) -> None:
        """Take a run out of all tables at once; its id may be used again."""
        if not self._commit(lambda: self.exists(run_id), action="remove", run_id=run_id):
            raise StoreError(f"run {run_id} is not stored")

    def vacuum(self, older_than_s: float = 86_400) -> list[str]:
        """Delete the folders of attempts that were never committed; younger ones may still be at work."""
        kept = {r["attempt"] for r in self.log().filter("action = 'add'").collect()}
        gone = set()
        for name in SCHEMAS:
            for folder in names_in(self.spark, f"{self.root}/{name}", older_than_s):
                if folder.startswith("attempt=") and folder[8:] not in kept:
                    gone.add(folder[8:])
        for attempt in gone:
            self._drop(attempt)
        return sorted(gone)

    def _shaped(self, name: str, table: DataFrame) -> DataFrame:
        fields = [x.strip().rsplit(" ", 1) for x in SCHEMAS[name].split(",")]
        return table.select(*[(F.col(n) if n in table.columns else F.lit(None)).cast(k).alias(n) for n, k in fields])


# ---- history queries: each takes the tables by name ------------------------------------------


def scores_by_run(tables: dict[str, DataFrame]) -> DataFrame:
    """(run_id, original_score, cleaned_score): both versions of a run in one row, by one grouping."""
    of = lambda version: F.max(F.when(F.col("dataset_version") == version, F.col("overall_score")))
    return tables["dataset_profiles"].groupBy("run_id").agg(of("original").alias("original_score"), of("cleaned").alias("cleaned_score"))


def _scored(tables: dict[str, DataFrame]) -> DataFrame:
    gain = F.round(F.col("cleaned_score") - F.col("original_score"), 2)
    return tables["profiling_runs"].join(scores_by_run(tables), "run_id", "left").withColumn("score_improvement", gain)


def _improved(tables: dict[str, DataFrame]) -> DataFrame:
    return _scored(tables).filter("original_score is not null and cleaned_score is not null")


def _counted(issues: DataFrame, by: str) -> DataFrame:
    return issues.groupBy(by).agg(F.count(F.lit(1)).alias("issue_count"))


def _of_run(tables: dict[str, DataFrame], name: str, run_id: str, version: str) -> DataFrame:
    return tables[name].filter((F.col("run_id") == run_id) & (F.col("dataset_version") == version))


def latest_runs(t: dict[str, DataFrame], limit: int = 20, **_: str) -> DataFrame:
    return t["profiling_runs"].orderBy(F.desc("run_timestamp"), "run_id").limit(limit).select("run_id", "dataset_name", "run_timestamp", "cleaning_applied", "original_row_count", "original_column_count")


def score_by_run(t: dict[str, DataFrame], **_: str) -> DataFrame:
    return _scored(t).orderBy(F.desc("run_timestamp")).select("run_id", "dataset_name", "run_timestamp", "original_score", "cleaned_score")


def improvement(t: dict[str, DataFrame], **_: str) -> DataFrame:
    return _improved(t).orderBy(F.desc("score_improvement")).select("run_id", "dataset_name", "original_score", "cleaned_score", "score_improvement")


def issues_by_category(t: dict[str, DataFrame], *, run_id: str, **_: str) -> DataFrame:
    return _counted(_of_run(t, "data_quality_issues", run_id, "original"), "issue_category").orderBy(F.desc("issue_count"))


def issues_by_severity(t: dict[str, DataFrame], *, run_id: str, **_: str) -> DataFrame:
    return _counted(_of_run(t, "data_quality_issues", run_id, "original"), "severity").orderBy(F.desc(F.array_position(F.array(*[F.lit(x) for x in C.SEVERITIES]), F.col("severity"))))


def top_columns(t: dict[str, DataFrame], *, dataset_name: str, limit: int = 10, **_: str) -> DataFrame:
    runs = t["profiling_runs"].filter(F.col("dataset_name") == dataset_name).select("run_id")
    issues = t["data_quality_issues"].filter("column_name is not null").join(runs, "run_id", "left_semi")
    return _counted(issues, "column_name").orderBy(F.desc("issue_count"), "column_name").limit(limit)


def fixes_by_run(t: dict[str, DataFrame], **_: str) -> DataFrame:
    # Fixes are summed before the join, so only one row a run is shuffled for it.
    fixes = t["applied_fixes"].groupBy("run_id").agg(F.count("fix_id").alias("fixes"), F.sum("affected_count").cast("long").alias("total_changes"))
    return t["profiling_runs"].join(fixes, "run_id", "left").orderBy(F.desc("run_timestamp")).select("run_id", "dataset_name", F.coalesce("fixes", F.lit(0).cast("long")).alias("fixes_applied"), "total_changes")


def average_score(t: dict[str, DataFrame], **_: str) -> DataFrame:
    rows = t["profiling_runs"].join(t["dataset_profiles"].filter("dataset_version = 'original'").select("run_id", "overall_score"), "run_id")
    return rows.groupBy("dataset_name").agg(F.round(F.avg("overall_score"), 2).alias("avg_original_score"), F.count(F.lit(1)).alias("run_count")).orderBy(F.desc("avg_original_score"))


def best_runs(t: dict[str, DataFrame], limit: int = 10, **_: str) -> DataFrame:
    rows = _improved(t).filter("cleaning_applied").orderBy(F.desc("score_improvement"), "run_id").limit(limit)
    return rows.select("run_id", "dataset_name", "run_timestamp", "original_score", "cleaned_score", "score_improvement")


def run_components(t: dict[str, DataFrame], *, run_id: str, dataset_version: str, **_: str) -> DataFrame:
    rows = _of_run(t, "quality_scores", run_id, dataset_version).orderBy(F.desc("component_weight"))
    return rows.select("component_name", "component_score", "issue_count", "denominator", "penalty", "component_weight", "weighted_contribution")


def run_history(t: dict[str, DataFrame], **_: str) -> DataFrame:
    """One row a run with scores of both versions and numbers of issues and fixes."""
    of = lambda version: F.count_if(F.col("dataset_version") == version)
    issues = t["data_quality_issues"].groupBy("run_id").agg(of("original").alias("original_issue_count"), of("cleaned").alias("cleaned_issue_count"))
    fixes = t["applied_fixes"].groupBy("run_id").agg(F.count(F.lit(1)).alias("fixes_applied_count"))
    rows = _scored(t).join(issues, "run_id", "left").join(fixes, "run_id", "left")
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("original_issue_count", "cleaned_issue_count", "fixes_applied_count")]
    names = ("run_id", "dataset_name", "file_type", "run_timestamp", "cleaning_applied", "original_row_count", "original_column_count", "cleaned_row_count", "cleaned_column_count", "original_score", "cleaned_score", "score_improvement")
    return rows.orderBy(F.desc("run_timestamp")).select(*names, *counts)


HISTORY = {
    "q1_latest_runs": latest_runs, "q2_score_by_run": score_by_run, "q3_improvement": improvement, "q4_by_category": issues_by_category, "q5_by_severity": issues_by_severity, "q6_top_columns": top_columns,
    "q7_fixes_by_run": fixes_by_run, "q8_avg_score": average_score, "q9_best_runs": best_runs, "q10_components": run_components, "db_history": run_history,
}


def history(spark: SparkSession, query: str, tables: dict[str, DataFrame], **args: str) -> DataFrame:
    """One of ``HISTORY`` over tables by name, with named parameters."""
    return HISTORY[query](tables, **args)


def filter_history(rows: DataFrame, datasets: list[str] | None = None, since: str | None = None) -> DataFrame:
    if datasets:
        rows = rows.filter(F.col("dataset_name").isin(*datasets))
    return rows.filter(F.col("run_timestamp") >= since) if since else rows


def compare_runs(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(metric, first, second): two runs of a history side by side."""
    metrics = ["original_score", "cleaned_score", "original_issue_count", "cleaned_issue_count", "fixes_applied_count"]
    long = rows.filter(F.col("run_id").isin(first, second)).select("run_id", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot("run_id", metrics, "metric", "value")
    return long.groupBy("metric").agg(F.max(F.when(F.col("run_id") == first, F.col("value"))).alias("first"), F.max(F.when(F.col("run_id") == second, F.col("value"))).alias("second"))
