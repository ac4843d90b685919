"""Mixing sources to target weights with hash-threshold histograms.

Every row has a 60-bit hash.  Sizes are summed by source and hash bucket; a source's budget is
met by all rows with a hash below a threshold, found from the histogram and refined only inside
the one bucket that the budget falls into, twelve bits at a time.  Nothing is sorted by row, and
the chosen rows of a smaller budget are always a subset of those of a larger one.

Defined cases: a null source is a source of its own and the last one in order; a null or negative
size counts as 0; a row of size 0 follows its hash as any other; rows that share a key share a hash
and are taken or left together; a row without a key has the hash of its text, if the caller names
that column; long texts are met by their MD5 only; an empty table gives an
empty mix; other columns pass through under any name, and the three names that this operator adds
(source_size, target, copies) replace columns of the same name.  Sources are expected in at most some
millions: their targets are worked out by running sums over one row a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

BITS, STEP = 60, 12


def row_hash(key: Column, text: Column | None = None) -> Column:
    """60 bits of a key's MD5 as a long, or of its text's if it has no key; the same on every engine that has MD5."""
    unkeyed = F.lit("\x00null")
    if text is not None:
        unkeyed = F.concat(unkeyed, F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    text = F.coalesce(key.cast("string"), unkeyed)
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, weight, target): ``share`` of all sizes by repeating weights, none above ``cap`` times its source.

    The excess of capped sources goes to the rest by weight.  In order of cap / weight the capped
    ones come first, so one running sum over the sources (one row each) finds the level.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    every = W.partitionBy()
    before = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    table = (
        table.withColumn("rest", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), zero))
        .withColumn("rest_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("wish", F.col("rest") * F.col("weight") / F.col("rest_weight"))
        .withColumn("capped", F.col("wish") > F.col("limit"))
    )
    # The first source that is not capped fixes the level of all that follow it.
    free = F.when(~F.col("capped"), F.struct(F.col("limit") / F.col("weight"), F.col("rest").alias("r"), F.col("rest_weight").alias("w")))
    level = F.min(free).over(every)
    target = F.when(F.col("capped"), F.col("limit")).otherwise(F.least("limit", level["r"] * F.col("weight") / level["w"]))
    return table.select("source", "source_size", "weight", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, work: Scratch) -> DataFrame:
    """(source, threshold): rows of (source, hash, size) below the threshold come closest to the budget of (source, budget).

    One level reads only rows inside the buckets that were left open, so level 1 reads all rows
    once and each further level a 4096th of the one before.
    """
    open_ = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), "budget")
    done: DataFrame | None = None
    for left in range(BITS - STEP, -1, -STEP):
        shift = left + STEP
        inside = rows.join(open_.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")) & (F.shiftright("hash", shift) == F.col("prefix")))
        hist = inside.groupBy("source", F.shiftright("hash", left).alias("bucket"), "below", "budget").agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        hist = hist.withColumn("end", F.col("below") + upto).withColumn("start", F.col("end") - F.col("size"))
        if left:
            crossed = (F.col("start") < F.col("budget")) & (F.col("end") > F.col("budget"))
        else:
            crossed = F.lit(False)
        # At the last level a bucket is one hash: it belongs to the mix if that comes closer to the budget.
        inner = F.col("end") <= F.col("budget") if left else (F.col("start") + F.col("end") <= 2 * F.col("budget"))
        level = hist.groupBy("source").agg(
            F.max(F.when(inner, F.col("bucket") + 1)).alias("full"),
            F.min("bucket").alias("first"),
            F.min("budget").alias("budget"),
            F.min(F.when(crossed, F.struct("bucket", "start"))).alias("crossed"),
        )
        level = work.save(level, f"level{left}")
        # bitwise: full * 2 ** left without overflow, as both stay within 60 bits
        closed = level.filter(F.col("crossed").isNull()).select("source", (F.coalesce("full", "first") * F.lit(1 << left)).alias("threshold"))
        done = closed if done is None else done.unionByName(closed)
        open_ = level.filter(F.col("crossed").isNotNull()).select("source", F.col("crossed.bucket").alias("prefix"), F.col("crossed.start").alias("below"), "budget")
    return work.save(done, "thresholds")


def mix(
    docs: DataFrame, *, key: str = "doc_id", source: str = "source", size: Column | str = "size",
    text: str | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
) -> DataFrame:
    """``docs`` with source_size, target and copies (how often the mix takes a row); rows taken 0 times stay in the table.

    A budget of q whole source sizes and a rest takes every row q times and the rows below the
    threshold of the rest once more.  ``text`` tells rows apart that have no key.
    """
    work = Scratch(docs.sparkSession, "mix")
    size = F.col(size) if isinstance(size, str) else size
    rows = work.save(
        docs.select(F.col(source).alias("source"), row_hash(F.col(key), F.col(text) if text else None).alias("hash"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size")), "rows"
    )
    plan = source_targets(rows, weights, share, cap)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = work.save(plan.withColumn("times", times).withColumn("budget", F.col("target") - times * F.col("source_size")), "plan")
    limit = thresholds(rows, plan.select("source", "budget"), work)
    plan = work.save(
        plan.join(limit.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")), "left")
        .select(F.col("source").alias("_mix_source"), "source_size", "target", "times", "threshold"),
        "final",
    )
    slots = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, slots))
    out = docs.toDF(*slots).withColumn("_mix_hash", row_hash(F.col(at[key]), F.col(at[text]) if text else None))
    out = out.join(plan, F.col(at[source]).eqNullSafe(F.col("_mix_source")), "left")
    copies = (F.col("times") + (F.col("_mix_hash") < F.col("threshold")).cast("long")).alias("copies")
    kept = [F.col(s).alias(c) for c, s in zip(docs.columns, slots) if c not in ("source_size", "target", "copies")]
    return out.select(*kept, "source_size", "target", copies)
