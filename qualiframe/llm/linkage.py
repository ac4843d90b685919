"""Links between members that share a bucket, without a row for each pair.

A member comes with its bucket keys.  Buckets with the same members are one; a bucket above
``block`` members or ``BLOCK_BYTES`` is dealt into blocks, and two blocks meet in a group of their
own, so no task holds more than two blocks.  A pair is looked at in the first bucket that its
members share.  What leaves a task is one row for each member with links: their weight, and the
smallest member of its component in this task.

Where links are counted, every two blocks of a bucket have to meet, as the count itself is of all
pairs.  Where only components are asked for, all blocks first meet the first one, as
representatives; then only members that this has not joined to the bucket's largest component meet
the others.  So a bucket whose members resemble its representatives costs rows in proportion to its
members, and pairs are left out only if they are connected already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .minhash import parts
from .scratch import Scratch

#: Most bytes of prepared members in a block (expected; a longer member is a block of its own).
BLOCK_BYTES = 4 << 20

Prepare = Callable[[pa.Array], list[np.ndarray]]
Verify = Callable[[list[np.ndarray]], np.ndarray]


def _span(links: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each place."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _group(key: int, low: int, high: int, held: list[tuple], verify: Verify) -> list[tuple[int, int, int]]:
    """held: (id, weight, block, keys, prepared payload) of each row."""
    rows = list({r[0]: r for r in held}.values())
    if len(rows) < 2:
        return []
    if len(rows) == 2:
        (i, u, a, x, p), (j, v, b, y, q) = sorted(rows, key=lambda r: r[0])
        if (low != high and a == b) or min(set(x) & set(y)) != key or not verify([p, q])[0, 1]:
            return []
        return [(i, i, v), (j, i, u)]
    rows.sort(key=lambda r: r[0])
    weight, block = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
    links = verify([r[4] for r in rows])
    if low != high:
        links &= block[:, None] != block[None, :]
    seen: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for k in r[3]:
            if k < key:
                seen.setdefault(k, []).append(i)
    for where in seen.values():
        if len(where) > 1:
            links[np.ix_(where, where)] = False
    total, label = links @ weight, _span(links)
    return [(rows[i][0], rows[label[i]][0], int(total[i])) for i in np.flatnonzero(total)]


def _groups(prepare: Prepare, verify: Verify):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at: tuple | None = None
        out: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["id", "other", "links"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "low", "high", "id", "w", "b", "keys", "payload")]
            for first, payloads in parts(columns[7]):
                ready = prepare(payloads)
                for *now, one, w, b, keys, data in zip(*(c.slice(first, len(payloads)).to_pylist() for c in columns[:7]), ready):
                    if now != at:
                        if len(held) > 1:
                            out += _group(*at, held, verify)
                        held, at = [], now
                    held.append((one, w, b, keys, data))
            if len(out) > 10_000:
                yield flush()
        if len(held) > 1:
            out += _group(*at, held, verify)
        yield flush()

    return run


def _dealt(members: DataFrame, *carried: str) -> DataFrame:
    """(id, carried columns, key, blocks, b): a row for each bucket of a member, with its block there."""
    rows = members.withColumn("keys", F.col("of.key")).select("id", *carried, F.explode("of").alias("one"))
    rows = rows.select("id", *carried, F.col("one.key").alias("key"), F.col("one.blocks").alias("blocks"))
    return rows.withColumn("b", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))


def _found(rows: DataFrame, prepare: Prepare, verify: Verify, work: Scratch, name: str) -> DataFrame:
    """Links of rows that also say which other block (o) to meet."""
    rows = rows.select("key", F.least("b", "o").alias("low"), F.greatest("b", "o").alias("high"), "b", "id", "w", "keys", "payload")
    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    work.release()
    return work.save(rows.mapInArrow(_groups(prepare, verify), "id long, other long, links long"), name)


def _edges(found: DataFrame) -> DataFrame:
    return found.filter("id <> other").selectExpr("id as a", "other as b")


def _components(rows: DataFrame, places: DataFrame, prepare: Prepare, verify: Verify, work: Scratch) -> DataFrame:
    """(node, label); ``places`` are ``rows`` without payloads: each block meets the first one, then what is not joined to the bucket's largest component meets the rest."""
    some = F.when(F.col("b") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), F.col("b")))
    first = _found(rows.withColumn("o", F.explode(some)), prepare, verify, work, "first_links")
    labels = work.save(connected(_edges(first), work, "first"), "first_labels")
    # Where no bucket has three blocks, all of them have met; places tell without a join to payloads.
    large = work.save(places.filter("blocks > 2"), "places")
    if large.isEmpty():
        return labels
    large = large.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    large = work.save(large, "large")
    main = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
    rest = large.join(work.save(main, "main"), "key").filter("label <> main")
    # The blocks that hold such members: at most as many as the bucket has.
    rest = work.save(rest.select("id", "key", "b"), "rest")
    if rest.isEmpty():
        return labels
    wanted = work.save(rest.groupBy("key").agg(F.collect_set("b").alias("wanted")), "wanted")
    again = rows.filter("blocks > 2").join(wanted, "key").join(rest.select("id", "key", F.lit(True).alias("apart")), ["id", "key"], "left")
    others = F.when(F.col("apart"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.col("wanted"))
    again = again.withColumn("o", F.explode(others)).filter("o <> b and o > 0 and b > 0")
    second = _found(again, prepare, verify, work, "second_links")
    return connected(_edges(second).unionByName(labels.selectExpr("node as a", "label as b")), work)


def link(
    flat: DataFrame, weights: DataFrame, payload: Callable[[DataFrame], DataFrame], prepare: Prepare, verify: Verify, work: Scratch, *,
    count: bool = True, block: int = 512, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame | None, DataFrame]:
    """((id, links), (node, label)): total weight of a member's links if ``count``, else None, and components by smallest id.

    ``flat`` has (id, key, size in bytes), repeats allowed, and ``weights`` (id, w) once each.
    ``payload`` gives (id, payload) for a table of ids; only members of shared buckets are asked for.
    ``prepare`` turns payloads into arrays, ``verify`` arrays into a symmetric matrix of links.
    Members without a link are in neither table; without ``count`` a label may also be a member's own.
    """
    # Most keys belong to one member; two minima by key tell which do not, before anything is joined.
    shared = flat.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key")
    shared = work.save(shared, "shared_keys")
    pairs = work.save(flat.join(work.broadcast_if_small(shared, "shared_keys"), "key").distinct(), "pairs")
    buckets = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("mark"), F.min("id").alias("least"), F.sum("size").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(float(block))), F.ceil(F.col("bytes") / F.lit(float(block_bytes)))).cast("int")
    kept = work.save(buckets.groupBy("n", "mark", "least", "bytes").agg(F.min("key").alias("key")).select("key", blocks.alias("blocks")), "buckets")
    of = pairs.join(work.broadcast_if_small(kept, "buckets"), "key").groupBy("id").agg(F.collect_list(F.struct("key", "blocks")).alias("of"))
    shared = work.save(weights.select("id", "w").join(of, "id"), "shared")
    rows = _dealt(shared.join(payload(shared.select("id")), "id"), "w", "payload", "keys")
    if not count:
        return None, _components(rows, _dealt(shared.select("id", "of")), prepare, verify, work)
    found = _found(rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), prepare, verify, work, "links")
    return found.groupBy("id").agg(F.sum("links").alias("links")), connected(_edges(found), work)
