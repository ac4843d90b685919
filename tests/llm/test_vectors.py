"""Operators 11 to 13 against plain versions: nulls, odd components and lengths, ties, repeats, empty tables, clashing names."""

import hashlib
from collections import Counter
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from qualiframe.llm import centroids, lloyd, order_minhash, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, x string, owner int, part string"
NAN, INF = float("nan"), float("inf")


def vectors(dims=8):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 2, dims).astype(np.float32).tolist(), i % 3 if i % 7 else None) for i in range(90)]
    rows += [(200, [0.25] * dims, 0), (201, [-0.0] * dims, 1), (202, [0.25] * dims, 0), (3, [1.0] * dims, 2), (3, [1.0] * dims, 2), (None, [0.5] * dims, None)]
    rows += [(300, None, 0), (301, [1.0] * (dims - 1) + [NAN], 0), (302, [INF] + [1.0] * (dims - 1), 0), (303, [None] + [1.0] * (dims - 1), 0), (304, [1.0] * (dims + 4), 0), (305, [], 0)]
    rows += [(400, [3e38] * dims, 1), (401, [-3e38] * dims, 1)]
    return [(*r, "a", 1, "b") for r in rows]


def kept(rows, dims):
    return [(i, v, label) for i, v, label, *_ in rows if v is not None and len(v) == dims and all(c is not None and isfinite(c) for c in v)]


def integer(v, scale):
    return [max(-lloyd.LIMIT, min(lloyd.LIMIT, floor(Fraction(float(np.float32(c))) * scale))) for c in v]


def plain_lloyd(xs, starts, times):
    """Every round anew, in Python integers."""
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    entries = [list(s) for s in starts]
    for turn in range(times + 1):
        owner = [min(range(len(entries)), key=lambda e: (far(x, entries[e]), e)) for x in xs]
        if turn == times:
            return owner, [far(x, entries[o]) for x, o in zip(xs, owner)], entries
        for e in range(len(entries)):
            if own := [x for x, o in zip(xs, owner) if o == e]:
                entries[e] = [sum(c) // len(own) for c in zip(*own)]


@pytest.mark.parametrize("times", [0, 1, 3, 30])
def test_clusters_equal_a_plain_version(spark, times):
    rows = vectors()
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k=6, dims=8, times=times).collect()
    have = [(i, integer(v, 64)) for i, v, _ in kept(rows, 8)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    starts = [x for _, x in sorted(have, key=lambda r: (name(r[0]), r[1]))[:6]]
    owner, far, entries = plain_lloyd([x for _, x in have], starts, times)
    cap = lambda n: min(n, (1 << 63) - 1)
    inertia = Counter()
    for o, d in zip(owner, far):
        inertia[o] += d
    digest = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in entries]
    wanted = [(i, o, d, cap(inertia[o]), cap(sum(far)), digest[o]) for (i, _), o, d in zip(have, owner, far)]
    assert Counter(map(tuple, got)) == Counter(wanted)


def test_clusters_of_few_and_no_vectors(spark):
    few = spark.createDataFrame(vectors()[:3], SCHEMA)
    assert {(r["vec_id"], r["distance"]) for r in centroids.cluster(few, k=6, dims=8).collect()} == {(0, 0), (1, 0), (2, 0)}
    assert centroids.cluster(few.limit(0), k=6, dims=8).count() == 0
    assert centroids.cluster(few, k=6, dims=9).count() == 0
    found = centroids.fit(few, k=2, dims=8)
    assert [r["size"] for r in found.centroids().orderBy("cluster").collect()] == found.sizes and sum(found.sizes) == 3


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_a_round_from_stored_state_equals_one_from_nothing(seed):
    rng = np.random.default_rng(seed)
    x, entries = rng.integers(-3, 4, (40, 3)), rng.integers(-3, 4, (5, 3))
    nothing = np.full(40, -1), np.zeros(40, np.int64)
    owner, far = lloyd.nearest(x, entries, np.ones(5, bool), *nothing)
    later = entries.copy()
    changed = rng.random(5) < 0.5
    later[changed] += rng.integers(-1, 2, (int(changed.sum()), 3))
    again, wanted = lloyd.nearest(x, later, changed, owner, far), lloyd.nearest(x, later, np.ones(5, bool), *nothing)
    assert (again[0] == wanted[0]).all() and (again[1] == wanted[1]).all()


def test_large_components_are_compared_exactly():
    x = np.array([[lloyd.LIMIT, -lloyd.LIMIT, 1]])
    entries = np.array([[-lloyd.LIMIT, lloyd.LIMIT, 0], [lloyd.LIMIT, -lloyd.LIMIT, 0]])
    assert lloyd.squared_distances(x, entries).tolist() == [[8 * lloyd.LIMIT**2 + 1, 1]]


def test_codes_equal_a_plain_version(spark):
    rows = vectors()
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=4, entries=16, times=3).collect()
    have = [(i, integer(v, 1024), label) for i, v, label in kept(rows, 8)]
    ids = sorted({i for i, *_ in have if i is not None})[:16]
    first = [min(x for i, x, _ in have if i == one) for one in ids]
    codes, errors, books = [""] * len(have), [0] * len(have), []
    for p in range(4):
        part = slice(2 * p, 2 * p + 2)
        owner, far, entries = plain_lloyd([x[part] for _, x, _ in have], [x[part] for x in first], 3)
        books += [c for e in entries for c in e]
        codes = [c + f"{o:02x}" for c, o in zip(codes, owner)]
        errors = [e + d for e, d in zip(errors, far)]
    by_label = Counter()
    for (*_, label), e in zip(have, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    assert Counter(map(tuple, got)) == Counter((i, c, e, min(by_label[label], (1 << 63) - 1), digest) for (i, _, label), c, e in zip(have, codes, errors))


def test_codes_of_few_and_no_vectors_and_decoding(spark):
    few = spark.createDataFrame(vectors()[:5], SCHEMA)
    found = vector_codes.fit(few, parts=4, entries=16, scale=1024)
    assert found.books.shape == (4, 5, 2)
    near = {r["vec_id"]: r["vector"] for r in found.decode().collect()}
    assert all(np.abs(np.array(near[i]) - v).max() <= 0.5 / 1024 + 1e-6 for i, v, *_ in vectors()[:5])
    assert vector_codes.compress(few.limit(0)).count() == 0
    assert vector_codes.compress(few, parts=3).count() == 0
    unnamed = few.selectExpr("cast(null as long) as vec_id", "embedding", "label")
    assert vector_codes.compress(unnamed, parts=4, entries=16).count() == 5


# ---- 12: order MinHash -------------------------------------------------------------------------

TEXTS = "doc_id long, text string, fingerprint string, part int, hash string"


def documents():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdeé☃"), rng.integers(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words, n))
    texts = [say(200), say(3), "", None, "ab", "abcdef", "abcdefg", "a" * 500, say(20_000), "🙂" * 9 + "x", say(80), say(81)]
    rows = list(enumerate(texts)) + [(4, say(50)), (10, texts[10]), (10, texts[10]), (None, say(40)), (None, None), (-7, say(60))]
    return [(i, t, "f", 1, "h") for i, t in rows]


def plain_fingerprint(sketch, text):
    """From all numbered k-mers of a text, by sorting them for each function."""
    points = [ord(c) for c in text]
    k = min(sketch.k, len(points))
    seen, places = Counter(), []
    found = order_minhash.kmers(order_minhash.code_points(text), sketch.k)
    for i, kmer in enumerate(tuple(points[i : i + k]) for i in range(len(points) - k + 1 if k else 0)):
        number = (int(found[i]) + seen[kmer] * int(order_minhash._GOLD)) & ((1 << 64) - 1)
        seen[kmer] += 1
        places.append(int(order_minhash.mixed(np.array([number], np.uint64))[0]) >> 32)
    out = []
    for factor in sketch.factors.tolist():
        chosen = sorted(sorted(range(len(places)), key=lambda i: (places[i] * factor & 0xFFFFFFFF, i))[: sketch.size])
        value = np.array([len(chosen)], np.uint64)
        for i in chosen:
            value = order_minhash.mixed(value * order_minhash._GOLD + found[i : i + 1])
        out.append(f"{int(value[0]) >> 48:04x}")
    return "".join(out)


def test_fingerprints_and_edits_equal_a_plain_version(spark):
    rows, sketch = documents(), order_minhash.Sketch(count=16)
    docs = spark.createDataFrame(rows, TEXTS).repartition(5)
    got = order_minhash.compare_edits(docs, count=16).collect()
    signed = lambda t: 42 if t is None else (v := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (v >> 63 << 64)
    order = sorted([(i is None, i or 0, signed(t), i, t or "") for i, t, *_ in rows], key=lambda r: r[:3])
    wanted = []
    for (*_, doc, text), (*_, following) in zip(order, order[1:] + order[:1]):
        cut = len(text) - len(text) // 4
        new = text[:cut] + following[: len(text) - cut]
        own, other, after = (plain_fingerprint(sketch, t) for t in (text, new, following))
        like = lambda a, b, x, y: float(x == y) if not x or not y else sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / 16
        wanted.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), own, other, like(own, other, text, new), like(own, after, text, following)))
    assert Counter(map(tuple, got)) == Counter(wanted)
    alone = {(r["doc_id"], r["n_chars"], r["fingerprint"]) for r in order_minhash.fingerprints(docs, count=16).collect()}
    assert alone == {(r[0], r[1], r[3]) for r in wanted}


def test_one_text_follows_itself_and_none_gives_none(spark):
    docs = spark.createDataFrame([(5, "one two three four five six")], "doc_id long, text string")
    (row,) = order_minhash.compare_edits(docs).collect()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"one two three four fione tw").hexdigest()
    assert order_minhash.compare_edits(docs.limit(0)).count() == 0


def test_order_counts_and_so_do_repeats():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(600)]
    sketch = order_minhash.Sketch(count=256)
    make = lambda w: sketch.sketched(" ".join(w))
    text = make(words)
    turned = make(words[300:] + words[:300])
    few = make(words[:-6] + [w[::-1] for w in words[-6:]])
    assert text.likeness(few) > 0.9 > 0.7 > text.likeness(turned) > 0.3  # the same k-mers, half of all pairs in another order
    assert make(["abcdefg"] * 50).likeness(make(["abcdefg"] * 400)) < 0.3 and text.likeness(make(words[:])) == 1.0
