"""Connected components by alternating large-star and small-star steps on DataFrames.

Each step is a map-side-combined minimum by node and a join back.  The minima are written before
the join, so both of its inputs are plain shuffles (or one is small enough to be broadcast by its
measured size) and adaptive execution can split a hub that holds a large part of all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected(edges: DataFrame, work: Scratch, name: str = "cc") -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node of its component.

    Null ends and loops are ignored; no edge gives an empty table.  Works for any ordered type.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u <> v").distinct()
    e, mark, step = work.save(e, f"{name}0"), None, 0
    old = [f"{name}0"]
    while True:
        new = _mark(e)
        if new[0] == 0 or new == mark:
            break
        mark, step = new, step + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}{step}a")
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.save(large, f"{name}{step}b")
        least = work.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}{step}c")
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = work.save(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}{step}")
        work.drop(*old)
        old = [f"{name}{step}", f"{name}{step}a", f"{name}{step}b", f"{name}{step}c"]
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
