"""Exact percentiles and modes without one task that holds all distinct values.

Values are counted by (column, value).  A wanted rank is found in a histogram of the counted values
by range, and only the range that holds it is read again, until so few distinct values are left
that they are sorted.  The driver sees histograms and the values found.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS, SORTED = 1024, 20_000
QUARTILES = (0.25, 0.5, 0.75)


def few_parts(df: DataFrame) -> DataFrame:
    """Few partitions for each core, for a grouping that is stored: each reader that groups it again makes a file for each of its tasks and groups."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def value_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column, value, n) of the present values of numeric expressions."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), c.cast("double").alias("value")) for n, c in columns.items()])
    return df.select(F.explode(cells).alias("cell")).select("cell.*").filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _scale(v: Column) -> Column:
    """Sign and power of two: a range has values within a factor of two; zero, infinities and NaN have their own."""
    power = F.least(F.log2(F.abs(v)) + 1100, F.lit(2200.0))
    return F.floor(F.when(F.isnan(v), F.lit(3000.0)).when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * power))


def _at_ranks(counts: DataFrame, ranks: dict[str, set[int]], distinct: dict[str, int]) -> dict[tuple[str, int], float]:
    """Value at each rank from 0 of the sorted values of each column."""
    found: dict[tuple[str, int], float] = {}
    # (column, least value, largest value, values below, ranks, distinct values) of each range that is still open
    ranges = [(c, float("-inf"), float("nan"), 0, sorted(r), distinct[c]) for c, r in ranks.items() if r]
    first = True
    while ranges:
        few = [r for r in ranges if r[5] <= SORTED]
        many = [r for r in ranges if r[5] > SORTED]
        for group, last in ((few, True), (many, False)):
            if not group:
                continue
            table = counts.sparkSession.createDataFrame([(i, *r[:3], r[4]) for i, r in enumerate(group)], "slot int, column_ string, low double, high double, ranks array<long>")
            inside = counts.join(F.broadcast(table), (F.col("column") == F.col("column_")) & (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
            if last:
                below = F.create_map(*[F.lit(x) for i, r in enumerate(group) for x in (i, r[3])])[F.col("slot")]
                end = F.sum("n").over(W.partitionBy("slot").orderBy("value").rowsBetween(W.unboundedPreceding, 0)) + below
                hit = inside.withColumn("end", end).withColumn("hits", F.filter("ranks", lambda k: (k < F.col("end")) & (k >= F.col("end") - F.col("n"))))
                for r in hit.select("column", "value", F.explode("hits").alias("rank")).collect():
                    found[r["column"], r["rank"]] = r["value"]
                continue
            linear = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS), F.lit(BUCKETS - 1))
            hist = inside.groupBy("slot", (_scale(F.col("value")) if first else linear).alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"), F.min("value").alias("low"), F.max("value").alias("high"))
            many = []
            upto = [r[3] for r in group]
            for h in sorted(hist.collect(), key=lambda h: (h["slot"], h["bucket"])):
                c, start = group[h["slot"]][0], upto[h["slot"]]
                upto[h["slot"]] += h["n"]
                if held := [k for k in group[h["slot"]][4] if start <= k < upto[h["slot"]]]:
                    many.append((c, h["low"], h["high"], start, held, h["distinct"]))
        ranges, first = many, False
    return found


def percentiles(counts: DataFrame, shares: Sequence[float] = QUARTILES) -> dict[str, list[float]]:
    """Percentiles of each column that has values, interpolated between neighbours as Spark's ``percentile`` does."""
    sizes = {r["column"]: r for r in counts.groupBy("column").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()}
    places = {c: [(r["n"] - 1) * s for s in shares] for c, r in sizes.items()}
    at = _at_ranks(counts, {c: {k for p in ps for k in (math.floor(p), math.ceil(p))} for c, ps in places.items()}, {c: r["distinct"] for c, r in sizes.items()})

    def between(c: str, p: float) -> float:
        low, high = math.floor(p), math.ceil(p)
        a, b = at[c, low], at[c, high]
        return a if low == high or a == b else (high - p) * a + (p - low) * b

    return {c: [between(c, p) for p in ps] for c, ps in places.items()}


def percentiles_of(df: DataFrame, columns: dict[str, Column], shares: Sequence[float] = QUARTILES) -> dict[str, list[float]]:
    if not columns:
        return {}
    counts = few_parts(value_counts(df, columns)).persist()
    try:
        return percentiles(counts, shares)
    finally:
        counts.unpersist()


def mode(df: DataFrame, value: Column) -> DataFrame:
    """One row: the most frequent present value, the smallest on a tie."""
    counts = df.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("k"), "value"))["value"].alias("mode"))
