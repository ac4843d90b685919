"""Clustering around centroids by delta Lloyd rounds in exact integers.

See ``lloyd``: assignments and sums are stored, a round compares vectors with changed centroids only,
those whose own centroid moved with all, and adds up signed transfers of the vectors that changed
their cluster.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are
left out; a null vec_id is carried along and hashed as the text null; with fewer than k vectors each
is a start; starts with equal hashes come in the order of their components; equal vectors always
share a cluster; a component whose integer is beyond 2^26 counts as that bound, and sums that no long
holds as the largest long; an empty table gives an empty table; other columns pass by.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lloyd import LONG_MAX, finite, integers, long_sum, rounds
from .scratch import Scratch

@dataclass
class Clusters:
    """``members`` (vec_id, cluster, distance), and for each of at most k clusters its size, inertia and components."""

    members: DataFrame
    sizes: list[int]
    inertias: list[int]
    components: list[list[int]]

    def table(self, fields: str, columns: list[list]) -> DataFrame:
        """One row a cluster: its number and the given columns."""
        return self.members.sparkSession.createDataFrame(list(zip(range(len(self.sizes)), *columns)), f"cluster int, {fields}")

    def centroids(self) -> DataFrame:
        return self.table("size bigint, inertia bigint, components array<bigint>", [self.sizes, self.inertias, self.components])


def fit(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 16, dims: int = 64, scale: int = 64, times: int = 3, seed: int = 1) -> Clusters:
    work = Scratch(vectors.sparkSession, "centroids")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter((F.size("v") == dims) & finite(F.col("v")))
    points = rows.select("vec_id", integers(F.col("v"), scale).alias("x"))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = points.orderBy(rank, "x").limit(k).collect()
    starts = np.array([r["x"] for r in first], np.int64).reshape(1, len(first), dims)
    state, entries = rounds(points, starts, times, work)
    members = state.select("vec_id", F.col("owner")[0].alias("cluster"), F.col("far")[0].alias("distance"))
    sums = {r["cluster"]: (r["n"], r["inertia"]) for r in members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), long_sum(F.col("distance")).alias("inertia")).collect()}
    sizes, inertias = ([sums.get(c, (0, 0))[i] for c in range(len(first))] for i in (0, 1))
    return Clusters(members, sizes, inertias, entries[0].tolist())


def cluster(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept; options as for ``fit``."""
    found = fit(vectors, **options)
    total = min(sum(found.inertias), LONG_MAX)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.components]
    table = found.table("cluster_inertia bigint, centroid_sha256 string", [found.inertias, digests])
    return found.members.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
