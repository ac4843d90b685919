"""Quality rules on streams: stateless findings row by row, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, profile


def row_findings(stream: DataFrame, profiles: list[profile.ColumnProfile], now: str = "2026-01-01 00:00:00") -> DataFrame:
    """Findings that a row tells by itself, on a stream with ``_row_id``; ratio severities need a whole table, so these are Low.

    The profiles come from a bounded table of the same shape.
    """
    kinds = {p.original_name: p.effective_logical_type for p in profiles}
    text = [n for n in kinds if detect.E.is_text(stream, n)]
    days = [n for n in kinds if kinds[n] in detect.C.DATE_TYPES]
    rules = [detect.Finding(k, t, "Low", shows_value=k != "missing_null") for k, t in detect.missing_tests(text).items()]
    rules += detect.type_findings(profiles, text) + detect.text_findings([n for n in text if kinds[n] in detect.C.TEXT_TYPES])
    rules += detect.numeric_findings([n for n in kinds if kinds[n] in detect.C.NUMERIC_TYPES], {}) + detect.date_findings(days, [n for n in days if n in text], now)
    found = detect.cell_table(stream, kinds, whole=True).select("row", F.col(detect.C.ROW_ID), "column", F.explode(F.array_compact(F.array(*[r.struct() for r in rules]))).alias("f"))
    finding = F.struct("f.issue_type", "f.severity", "f.confidence", F.col("column").alias("column_name"), F.col(detect.C.ROW_ID).alias("row_index"), "f.current_value", "f.suggested_value")
    return found.select(finding.alias("finding"), "row").select("row.*", "finding")


def windowed_counts(findings: DataFrame, time: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by window and type; rows later than the watermark are dropped by Spark."""
    # Watermarks need a timestamp with time zone; one without is read in the session's.
    return findings.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), F.col("finding.issue_type").alias("issue_type")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "issue_type", "n")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Full detection on every micro-batch: ``handle`` gets each batch as a bounded table."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
