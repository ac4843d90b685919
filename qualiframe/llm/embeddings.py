"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors of a label along random directions at a random quantile of a bounded
sample of each node, with spill: vectors near a split go to both sides.  A node that is still too
large gets a sample and splits of its own in the next round, so leaves stay small at any size.  Only
a node whose vectors lie closer together than the spill is a leaf at any size; ``linkage`` deals it
into blocks.  Vectors that share a leaf in any tree are compared by cosine in double precision.

Defined cases: null or zero vectors, those with null or non-finite components and those with a null
label link with nothing; vectors of one label but of different lengths are not compared; equal
vectors of a label are one member with copies; a null vec_id is carried along; an empty table gives
an empty table; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linkage import link
from .scratch import Scratch

TREES, LEAF, SAMPLE, DEPTH, ROUNDS = 5, 384, 4096, 4, 24


def _unit(vector: np.ndarray) -> np.ndarray:
    return vector / np.sqrt((vector * vector).sum(axis=-1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    return _unit(x / np.abs(x).max())


def _read(payload: bytes, single: bool) -> np.ndarray:
    """The unit vector of a stored one: floats travel as given, in half the bytes, and are scaled where they are read."""
    return _scaled(np.frombuffer(payload, np.float32).astype(np.float64)) if single else np.frombuffer(payload, np.float64)


def _direction(node: int, dim: int) -> np.ndarray:
    return _unit(np.random.default_rng(node & 0xFFFFFFFFFFFFFFFF).standard_normal(dim))


def _child(node: int, side: int) -> int:
    mixed = ((node & 0xFFFFFFFFFFFFFFFF) * 0x9E3779B97F4A7C15 + side + 1) & 0xFFFFFFFFFFFFFFFF
    mixed = ((mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    mixed ^= mixed >> 32
    return mixed - (1 << 64) if mixed >> 63 else mixed


def _fit(threshold: float, leaf: int, depth: int, single: bool):
    """Splits of up to ``depth`` levels for one node's sample: rows (node, split), none for a tight node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = np.stack([_read(v, single) for v in pdf["vector"]])
        scale = float(pdf["n"].iloc[0]) / len(sample)
        spill = 0.8 * np.sqrt(2 * (1 - threshold)) / np.sqrt(sample.shape[1])
        nodes, splits, todo = [], [], [(int(pdf["node"].iloc[0]), np.arange(len(sample)), 0)]
        while todo:
            node, rows, level = todo.pop()
            if len(rows) * scale <= leaf or level == depth or len(rows) < 32:
                continue
            place = sample[rows] @ _direction(node, sample.shape[1])
            split = float(np.quantile(place, np.random.default_rng(node & 0xFFFFFFFF).uniform(0.4, 0.6)))
            left, right = rows[place < split + spill], rows[place >= split - spill]
            if max(len(left), len(right)) > 0.85 * len(rows):
                continue
            nodes.append(node)
            splits.append(split)
            todo += [(_child(node, 0), left, level + 1), (_child(node, 1), right, level + 1)]
        return pd.DataFrame({"root": pdf["node"].iloc[0], "nodes": [np.array(nodes, np.int64)], "splits": [np.array(splits)]})

    return run


def _descend(threshold: float, single: bool):
    """(id, node, vector, tight) for (id, node, vector, nodes, splits): where a vector falls, on both sides within the spill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, roots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = [_read(v, single) for v in batch.column(2).to_pylist()]
            out: list[tuple[int, int, bool]] = []
            _, first, inverse = np.unique(roots, return_index=True, return_inverse=True)
            for k, at in enumerate(first):
                rows = np.flatnonzero(inverse == k)
                matrix = np.stack([vectors[i] for i in rows])
                splits = dict(zip(batch.column(3)[int(at)].as_py() or (), batch.column(4)[int(at)].as_py() or ()))
                spill = 0.8 * np.sqrt(2 * (1 - threshold)) / np.sqrt(matrix.shape[1])
                todo = [(int(roots[at]), np.arange(len(rows)))]
                while todo:
                    node, inside = todo.pop()
                    if node not in splits:
                        out += [(int(rows[i]), node, not splits) for i in inside]
                        continue
                    if node not in held:
                        held = {} if len(held) > 20_000 else held
                        held[node] = _direction(node, matrix.shape[1])
                    place = matrix[inside] @ held[node]
                    todo += [(_child(node, 0), inside[place < splits[node] + spill]), (_child(node, 1), inside[place >= splits[node] - spill])]
            rows = [r[0] for r in out]
            arrays = [pa.array(ids[rows]), pa.array([r[1] for r in out], pa.int64()), batch.column(2).take(pa.array(rows, pa.int64())), pa.array([r[2] for r in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "node", "vector", "tight"])

    return run


def _units(single: bool):
    """(vec_id, label, unit, vector): the unit vector, null if there is none, and what is stored of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, kept = [], []
            for v in batch.column(2).to_pylist():
                one = two = None
                if v and None not in v:
                    x = np.array(v, np.float64)
                    with np.errstate(over="ignore", invalid="ignore"):
                        if np.isfinite(x).all() and x.any():
                            one = _scaled(x).tobytes()
                            two = x.astype(np.float32).tobytes() if single else one
                units.append(one)
                kept.append(two)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary()), pa.array(kept, pa.binary())], names=["vec_id", "label", "unit", "vector"])

    return run


def leaves(members: DataFrame, work: Scratch, threshold: float, trees: int, leaf: int, single: bool = False) -> DataFrame:
    """(id, key): the leaves of every tree that hold a member of (id, label, vector); ``single`` says that vectors are stored as floats."""
    size = F.length("vector") * (2 if single else 1)
    root = F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("label").cast("string"), size) for t in range(trees)]))
    rows = members.select("id", root.alias("node"), "vector", F.lit(False).alias("tight"))
    done, old = [], []
    for turn in range(ROUNDS + 1):
        rows = work.save(rows, f"round{turn}")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bool_or("tight").alias("tight"))
        large = work.save(sizes.filter(f"n > {leaf} and not tight").select("node", "n"), f"large{turn}")
        last = turn == ROUNDS or large.isEmpty()
        rest = rows.select("id", "node") if last else rows.select("id", "node").join(large, "node", "left_anti")
        done.append(work.save(rest, f"done{turn}"))
        if last:
            break
        again = rows.select("id", "node", "vector").join(large, "node")
        few = F.pmod(F.xxhash64("id", "node"), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n")) * F.lit(float(1 << 30))
        model = again.filter(few).groupBy("node").applyInPandas(_fit(threshold, leaf, DEPTH, single), "root long, nodes array<long>, splits array<double>")
        model = work.save(model.withColumnRenamed("root", "node"), f"model{turn}")
        placed = rows.select("id", "node", "vector").join(model, "node").select("id", "node", "vector", "nodes", "splits")
        rows = placed.mapInArrow(_descend(threshold, single), "id long, node long, vector binary, tight boolean")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.withColumnRenamed("node", "key")


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; links join vectors of one label whose cosine reaches ``threshold``."""
    work = Scratch(vectors.sparkSession, "forest")
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    single = base.schema["v"].dataType.elementType == T.FloatType()
    units = base.mapInArrow(_units(single), "vec_id long, label string, unit binary, vector binary")
    ident = F.when(F.col("unit").isNotNull() & F.col("label").isNotNull(), F.xxhash64("label", "unit"))
    units = work.save(units.withColumn("id", ident).drop("unit"), "units")
    members = units.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    members = work.save(members, "members")
    keyed = leaves(members, work, threshold, trees, leaf, single)

    size = (members.agg(F.max(F.length("vector"))).first()[0] or 0) * (2 if single else 1)  # as prepared

    def prepare(payloads: pa.Array) -> list[np.ndarray]:
        return [_read(p, single) for p in payloads.to_pylist()]

    def verify(rows: list[np.ndarray]) -> np.ndarray:
        matrix = np.stack(rows)
        links = matrix @ matrix.T >= threshold
        np.fill_diagonal(links, False)
        return links

    totals, labels = link(keyed.withColumn("size", F.lit(size)), members, lambda ids: members.select("id", F.col("vector").alias("payload")), prepare, verify, work)
    totals, labels = work.save(totals, "totals"), work.save(labels.withColumnRenamed("node", "id").withColumnRenamed("label", "root"), "labels")
    named = work.save(members.select("id", "w", "least").join(labels, "id", "left").withColumn("root", F.coalesce("root", "id")), "named")
    roots = work.save(named.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    told = work.save(named.join(roots, "root").join(totals, "id", "left").select("id", "component_id", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "told")
    out = units.select("vec_id", "id").join(told, "id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
