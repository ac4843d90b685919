"""The whole path: profile, gate, detect, score, clean, compare, store."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import clean, compare, detect, overrides, profile, score
from ..store import RunStore


#: Issue types that a score counts.
SCORED = frozenset(t for _, types in C.COMPONENTS.values() for t in types)


@dataclass
class Analysis:
    """Profiles, issues and scores of one table: frames are lazy, profiles small, and each is worked out when it is first asked for."""

    df: DataFrame
    dataset: str = "dataset"
    run_id: str = "run"
    now: str = "2026-01-01 00:00:00"
    chosen: dict[str, str] = field(default_factory=dict)
    header: list[str] | None = None

    @cached_property
    def _typed(self) -> profile.Typed:
        return profile.Typed(self.df)

    @cached_property
    def types(self) -> list[profile.ColumnProfile]:
        """Profiles without the figures that no rule needs."""
        return overrides.apply_overrides(self._typed.profiles, self.chosen)

    @cached_property
    def profiles(self) -> list[profile.ColumnProfile]:
        return overrides.apply_overrides(self._typed.figures(), self.chosen)

    def issues_of(self, only: Collection[str] | None) -> DataFrame:
        """Issues of some types; their plan has nothing of other rules."""
        return detect.detect(self.df, self.types, dataset=self.dataset, run_id=self.run_id, now=self.now, header=self.header, only=only, values=self._typed.values)

    @cached_property
    def issues(self) -> DataFrame:
        return self.issues_of(None)

    @cached_property
    def components(self) -> DataFrame:
        return score.score(self.df, self.issues if "issues" in self.__dict__ else self.issues_of(SCORED))

    @property
    def overall(self) -> DataFrame:
        return score.overall(self.components)

    def summary(self) -> DataFrame:
        return detect.summarize(self.issues)


def analyze(df: DataFrame, *, dataset: str = "dataset", run_id: str = "run", now: str = "2026-01-01 00:00:00", chosen: dict[str, str] | None = None, header: list[str] | None = None) -> Analysis:
    """Profile, apply chosen types, detect and score a table with ``_row_id``."""
    return Analysis(df, dataset, run_id, now, chosen or {}, header)


def dataset_run_id(name: Column, rows: Column, columns: Column, sheet: Column) -> Column:
    """Run id of a table that was not cleaned: the same as long as name, shape and sheet are, so that saving twice is noticed."""
    return F.sha2(F.concat_ws(":", name, F.concat_ws("x", rows.cast("string"), columns.cast("string")), F.coalesce(sheet, F.lit(""))), 256)


@dataclass
class Session:
    """An analysis and what was done about it."""

    before: Analysis
    after: Analysis | None = None
    fixed: clean.Fixed | None = None
    decisions: list[dict] = field(default_factory=list)

    def apply(self, fixes: list[str], **options) -> Session:
        base = self.fixed.df if self.fixed else self.before.df
        typed = {"convert_dates", "convert_numbers"} & set(fixes)  # other fixes ask for no type
        run = clean.apply_fixes(base, self.before.types if typed else [], fixes)
        self.fixed = clean.merge(self.fixed, run) if self.fixed else run
        self.fixed.df = self.fixed.df.persist()
        self.after = analyze(self.fixed.df, **options)
        return self

    def kpis(self) -> DataFrame:
        after = self.after
        return compare.kpis(self.before.df, self.before.issues, self.before.overall, after.issues if after else None, after.overall if after else None)


def bundle(session: Session, *, run_id: str, dataset: str, file_type: str, when: str) -> dict[str, DataFrame]:
    """Everything a run store keeps of a session; never rows of the data itself."""
    spark = session.before.df.sparkSession
    versions = [("original", session.before)] + ([("cleaned", session.after)] if session.after else [])
    tables: dict[str, DataFrame] = {}

    def add(name: str, table: DataFrame) -> None:
        tables[name] = tables[name].unionByName(table, allowMissingColumns=True) if name in tables else table

    for version, a in versions:
        tag = F.lit(version).alias("dataset_version")
        names = profile.data_columns(a.df)
        view = compare.overview(a.df).join(F.broadcast(a.overall))
        empty = a.issues.agg(F.count_if(F.col("issue_type") == "empty_row").alias("empty_row_count"), F.count_if(F.col("issue_type") == "empty_column").alias("empty_column_count"))
        cells = F.col("n_rows") * F.col("n_columns")
        add("dataset_profiles", view.join(F.broadcast(empty)).select(tag, F.col("n_rows").alias("row_count"), F.lit(len(names)).alias("column_count"), cells.alias("total_cells"), F.col("duplicate_rows").alias("duplicate_row_count"), "empty_row_count", "empty_column_count", F.col("missing_cells").alias("total_missing_count"), F.round(F.when(cells > 0, 100.0 * F.col("missing_cells") / cells).otherwise(0.0), 2).alias("missing_pct"), "overall_score"))
        add("column_profiles", profile.profile_frame(spark, a.profiles).select(tag, F.col("original_name").alias("column_name"), "normalized_name", "storage_type", "logical_type", "confidence", "non_null_count", "missing_count", "missing_pct", "unique_count", "unique_ratio", "outlier_count"))
        add("data_quality_issues", a.issues.select(tag, *[c for c in a.issues.columns if c not in ("run_id", "dataset_name")]))
        add("quality_scores", a.components.select(tag, "*"))
    counts = [r.df.count() if r else None for r in (session.before, session.after)]
    run = (dataset, file_type, None, when, counts[0], len(profile.data_columns(session.before.df)), counts[1], len(profile.data_columns(session.after.df)) if session.after else None, session.after is not None, C.SCHEMA_VERSION)
    tables["profiling_runs"] = spark.createDataFrame([run], "dataset_name string, file_type string, selected_sheet string, run_timestamp string, original_row_count long, original_column_count long, cleaned_row_count long, cleaned_column_count long, cleaning_applied boolean, schema_version string")
    if session.fixed:
        titles = F.create_map(*[F.lit(x) for f in clean.FIXES for x in (f.fix_id, f.title)])
        tables["cleaning_audit_log"] = session.fixed.audit
        tables["applied_fixes"] = compare.fix_counts(session.fixed.audit).select(F.col("cleaning_action").alias("fix_id"), F.coalesce(titles[F.col("cleaning_action")], F.col("cleaning_action")).alias("fix_title"), F.col("changes").alias("affected_count"))
    return tables


def store_run(store: RunStore, session: Session, *, run_id: str, dataset: str, file_type: str, when: str) -> None:
    store.init(when)
    store.save(run_id, bundle(session, run_id=run_id, dataset=dataset, file_type=file_type, when=when))
