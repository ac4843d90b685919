"""Operators on small tables against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from qualiframe.llm import binary_packing, cutting_stock, embeddings, line_dedup, matroska, media, minhash, mixing, ngram_join, quality, suffix_dedup, tokens, urls

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeéí"), rng.integers(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    base, shared = say(80), say(60)
    near = base.split()
    near[40] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, say(70) + "\n" + shared + "\n" + say(30)), (5, shared + "\n" + say(90)), (6, None), (7, ""), (8, "   \n "), (9, "one"), (10, "one two three"),
        (11, say(30) + "\n" + say(4000)), (12, "Z" * 3000), (13, "a\nb\na\nb"), (14, "the same line of text here\nthe same line of text hers\nother"), (None, base), (None, None), (2, base), (15, "\x00 nul \x1c sep"),
    ]
    return [(i, t, "en", f"src{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def components(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


# ---- 1 and 8: packing --------------------------------------------------------------------------


def test_best_fit_uses_the_tightest_row():
    rows = binary_packing.best_fit_decreasing([5, 4, 3, 3, 2, 2, 1], 8)
    assert sorted(i for r in rows for i in r) == list(range(7))
    assert all(sum([5, 4, 3, 3, 2, 2, 1][i] for i in r) <= 8 for r in rows) and len(rows) == 3
    free = binary_packing.FreeSpace(8)
    for row, space in ((0, 8), (1, 3), (2, 5)):
        free.put(row, space)
    assert free.take(4) == (2, 5) and free.take(4) == (0, 8) and free.take(4) is None and free.take(1) == (1, 3)


def test_binary_packing_round_trip(docs, none):
    made = binary_packing.pack(docs, BYTES, public_tokenizers.PATTERN, end_id=50256, length=64, window=500).collect()
    model, pieces = tokens.ByteTokens(BYTES, public_tokenizers.PATTERN), Counter()
    for r in made:
        ids, positions = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == 64 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] and r["position_resets"] == r["cu_seqlens"][:-1]
        for doc, start, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            pieces[doc, start, ids[a:b].tobytes()] += 1
            assert (positions[a:b] == np.arange(b - a)).all()
    wanted = Counter()
    for doc, text, *_ in documents():
        ids = np.append(model.encode(text or ""), 50256).astype("<u2")
        for s in range(0, len(ids), 64):
            wanted[doc, s, ids[s : s + 64].tobytes()] += 1
    assert pieces == wanted
    assert binary_packing.pack(none, BYTES, public_tokenizers.PATTERN, end_id=50256).count() == 0


def test_word_tokens_equal_the_library():
    odd = ["<|endoftext|>x <|startoftext|> a|<b", "¼½ªº ²x Ŀl ß ẞ ſ", "İx ı Σίσυφος ΟΔΥΣΣΕΥΣ", "a-'s 'll'd don't it's 'S", "­­x \x00a b\x00", "🙂🙂 a🙂b ١٢٣", "é ́x a\x1cb", "", "  "]
    odd += [t or "" for _, t, *_ in documents()]
    model = tokens.WordTokens(WORDS, remember=5)
    assert model.merge is not None
    for _ in range(2):
        assert model.encode(odd) == [np.array(e.ids, "<u4").tobytes() for e in model.model.encode_batch(odd, add_special_tokens=False)]


def test_merge_ranks_refuse_a_token_not_made_by_its_pair():
    assert tokens.merge_ranks([("a", "b"), ("b", "c"), ("ab", "c")], "</w>") is not None
    assert tokens.merge_ranks([("a", "b"), ("b", "c"), ("a", "bc")], "</w>") is None


def test_patterns_cover_the_demand():
    rng = np.random.default_rng(1)
    for n in (1, 30, 5000):
        sizes, counts = np.unique(rng.integers(1, 65, n), return_counts=True)
        demand = dict(zip(sizes.tolist(), counts.tolist()))
        plan = cutting_stock.solve_patterns(demand, 64)
        got = Counter()
        for pattern, times in plan:
            assert sum(k * v for k, v in pattern.items()) <= 64
            for k, v in pattern.items():
                got[k] += v * times
        assert got == demand
        assert sum(t for _, t in plan) <= 1.05 * sum(k * v for k, v in demand.items()) / 64 + 2
    assert cutting_stock.solve_patterns({}, 64) == []


def test_cutting_stock_round_trip(docs, none):
    rows = cutting_stock.pack(docs, WORDS, length=256, unit=8).collect()
    model, wanted, got = tokens.WordTokens(WORDS), Counter(), Counter()
    for doc, text, *_ in documents():
        ids = np.frombuffer(model.encode([text or ""])[0] + b"\2\0\0\0", "<u4")
        for s in range(0, len(ids), 256):
            wanted[doc, s, ids[s : s + 256].tobytes(), len(ids)] += 1
    by_sequence = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"]] += 1
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == wanted
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert cutting_stock.pack(none, WORDS).count() == 0


def test_cutting_stock_places_equal_rows_one_by_one(spark, monkeypatch):
    """More equal rows than a block has, and rows without a key: each has a place of its own, the same ones under any partitioning."""
    monkeypatch.setattr(cutting_stock, "SALT_ROWS", 16)
    table = spark.createDataFrame([(7, "one and the same")] * 100 + [(None, "no key"), (None, "other words without a key")] * 20 + [(8, None)], "doc_id long, text string")
    rows = [cutting_stock.pack(table.repartition(n), WORDS, length=64, unit=1, keep_ids=False).collect() for n in (1, 7)]
    assert sorted(map(str, rows[0])) == sorted(map(str, rows[1]))
    assert Counter(r["doc_id"] for r in rows[0]) == {7: 100, None: 40, 8: 1}
    by_sequence = defaultdict(list)
    for r in rows[0]:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        ends = [0, *(offset + length for offset, length in sorted(parts))]
        assert [offset for offset, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64


# ---- 2 and 7: near copies ----------------------------------------------------------------------


def grams(text, n=5):
    words = [w for w in (text or "").encode().split()]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_shingle_sets_match_words(docs):
    import pyarrow as pa

    texts = [t for _, t, *_ in documents()]
    values, number = minhash.distinct(*minhash.windows(*minhash.word_hashes(*minhash.text_bytes(pa.array(texts, pa.string()))), 5))
    assert number.tolist() == [len(grams(t)) for t in texts]
    ends = np.cumsum(number)
    assert set(values[: ends[0]]) == set(values[ends[0] : ends[1]])


def test_band_numbers_reach_the_recall():
    for recall in (0.9, 0.99, 0.998):
        bands, rows = minhash.bands_for(0.8, recall, 128)
        assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= recall


def test_jaccard_links_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.uint64) for _ in range(40)]
    links = minhash.jaccard_links(sets, 0.5)
    for i in range(40):
        for j in range(40):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert links[i, j] == (i != j and len(a & b) * 2 >= len(a | b))


def test_ngram_join(spark, docs, none):
    rows = documents()
    sets = [grams(t) for _, t, *_ in rows]
    edges = [(i, j) for j in range(len(rows)) for i in range(j) if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    label = components(len(rows), edges)
    degree = Counter(x for e in edges for x in e)
    wanted = Counter()
    for i, (doc, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        wanted[doc, min(ids) if sets[i] else doc, degree[i]] += 1
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(docs).collect())
    assert got == wanted
    kept = [r["doc_id"] for r in ngram_join.keep_one(docs).collect()]
    assert kept.count(1) == 1 and 2 not in kept and 3 not in kept and kept.count(None) == 2 and kept.count(4) == 1
    assert ngram_join.join(none).count() == 0 and ngram_join.keep_one(none).count() == 0


def test_blocks_of_a_large_bucket_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(150):
        text = list(base)
        for at in rng.choice(60, rng.integers(0, 3), replace=False):
            text[at] = f"x{rng.integers(1000)}"
        rows.append((k, " ".join(text)))
    sets = [grams(t) for _, t in rows]
    from qualiframe.llm import linkage

    found = linkage.link
    try:
        linkage_link = lambda *a, **k: found(*a, **(k | {"block": 16}))
        ngram_join.link = linkage_link
        got = {r["doc_id"]: r["n_links"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        ngram_join.link = found
    wanted = {i: sum(i != j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for j in range(150)) for i in range(150)}
    try:
        ngram_join.link = lambda *a, **k: found(*a, **(k | {"block": 16}))
        kept = {r["doc_id"] for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9999).collect()}
    finally:
        ngram_join.link = found
    label = components(150, [(i, j) for j in range(150) for i in range(j) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])])
    assert kept == set(label)
    near = sum(wanted.values())
    assert sum(got.values()) <= near and sum(got.values()) >= 0.98 * near and all(got[k] <= wanted[k] for k in got)


@pytest.mark.parametrize("block, block_bytes", [(512, 4 << 20), (4, 4 << 20), (512, 600)])
def test_components_need_no_count_of_links(spark, block, block_bytes):
    """Groups that share one bucket but are far apart, linked or not, in few and in many blocks."""
    import pyarrow as pa

    from qualiframe.llm import linkage
    from qualiframe.llm.scratch import Scratch

    rng = np.random.default_rng(31)
    places = np.concatenate([rng.normal(c, 0.4, n) for c, n in ((0, 60), (10, 25), (20, 10), (30, 1), (40, 1))] + [np.arange(50, 62, 0.9)])
    rows = [(i, 1 + i % 2 * int(x < 5), 100, float(x)) for i, x in enumerate(places)]
    flat = spark.createDataFrame([(i, k, s) for i, k, s, _ in rows] + [(i, 1, s) for i, k, s, _ in rows], "id long, key long, size long").repartition(3)
    weights = spark.createDataFrame([(i, 1) for i, *_ in rows], "id long, w long")
    payload = spark.createDataFrame([(r[0], repr(r[3])) for r in rows], "id long, payload string")
    prepare = lambda column: [np.array([float(x)]) for x in column.to_pylist()]

    def verify(members):
        x = np.concatenate(members)
        near = np.abs(x[:, None] - x[None, :]) <= 1
        np.fill_diagonal(near, False)
        return near

    edges = [(i, j) for j in range(len(rows)) for i in range(j) if abs(places[i] - places[j]) <= 1]
    label, degree = components(len(rows), edges), Counter(x for e in edges for x in e)
    for count in (True, False):
        totals, labels = linkage.link(flat, weights, lambda ids: payload.join(ids, "id", "left_semi"), prepare, verify, Scratch(spark, "t"), count=count, block=block, block_bytes=block_bytes)
        got = {r["node"]: r["label"] for r in labels.collect()}
        assert all(got.get(i, i) == label[i] for i in range(len(rows)))
        assert totals is None if not count else {r["id"]: r["links"] for r in totals.collect()} == dict(degree)


def test_rows_that_share_an_id_are_judged_each(spark):
    rng = np.random.default_rng(32)
    say = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10_000, 40))
    a, b, c = say(), say(), say()
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (1, b, "x"), (2, a, "z"), (2, c, "z"), (3, None, "n"), (3, None, "n"), (3, c, "m"), (None, a, "q"), (4, b + " ", "k")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _id string").repartition(3)
    got = Counter((r["doc_id"], r["text"], r["_id"]) for r in ngram_join.keep_one(table).collect())
    assert got == Counter([(1, a, "x"), (1, b, "x"), (2, c, "z"), (3, None, "n"), (3, None, "n"), (None, a, "q")])


def test_line_dedup(spark, docs, none):
    rows = [r for r in documents() if r[0] is not None]
    rows = sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0])
    shingles = lambda x: {x[i : i + 7] for i in range(max(1, len(x) - 6))}
    lines = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    table = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_lines string")
    sets = [shingles(x) for *_, x in lines]
    edges = [(i, j) for j in range(len(lines)) for i in range(j) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    label = components(len(lines), edges)
    gone = {(d, i) for k, (d, i, _) in enumerate(lines) if label[k] != k}
    got = {r["doc_id"]: r for r in line_dedup.dedup(table).collect()}
    for d, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for i, x in enumerate(all_) if (d, i) not in gone]
        lost = len(all_) - len(kept)
        text = t if not lost else "\n".join(kept) if any(x.strip(" \t\n\r\x0b\x0c") for x in kept) else None
        assert (got[d]["text"], got[d]["n_removed"]) == (text, lost), d
    assert line_dedup.dedup(docs).count() == len(documents())
    assert line_dedup.dedup(none).count() == 0


# ---- 3: repeated byte strings ------------------------------------------------------------------


def removed(rows, span=50):
    seen, out = {}, {}
    for d, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - span + 1):
            w = data[p : p + span]
            if d is not None:
                seen[w] = min(seen.get(w, d), d)
    for d, t in rows:
        data = (t or "").encode()
        cut = np.zeros(len(data), bool)
        for p in range(len(data) - span + 1):
            first = seen.get(data[p : p + span])
            if first is not None and (d is None or first < d):
                cut[p : p + span] = True
        out.setdefault(d, []).append((len(data), int(cut.sum()), bytes(np.frombuffer(data, np.uint8)[~cut])))
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk": 700}, {"chunk": 300, "share": 1500, "fan": 3}, {"chunk": 900, "hot": 2}, {"chunk": 500, "hot": 4, "fan": 6}])
def test_suffix_dedup(spark, docs, none, sizes):
    rows = [(r[0], r[1]) for r in documents()] + [(20, "ab" * 200), (21, "x" + "ab" * 100 + "é" * 60), (22, "é" * 80)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = defaultdict(list)
    for r in suffix_dedup.remove_repeats(table, **sizes).collect():
        got[r["doc_id"]].append((r["n_bytes"], sum(b - a for a, b in zip(r["starts"], r["ends"])), bytes(r["kept"])))
    wanted = removed(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_loser_tree_merges_and_knows_prefixes(monkeypatch):
    import random

    rng = random.Random(1)
    runs = [sorted("".join(rng.choice("ab") for _ in range(8)).encode() for _ in range(rng.randrange(0, 30))) for _ in range(7)]

    def coded(run):
        before = None
        for x in run:
            yield (next((i for i in range(8) if x[i] != before[i]), 8) if before is not None else 0), x
            before = x

    read = []
    compare = suffix_dedup.mismatch
    monkeypatch.setattr(suffix_dedup, "mismatch", lambda x, y, at, width: read.append((compare(x, y, at, width), at)) or read[-1][0])
    out = list(suffix_dedup.merge([iter(coded(r)) for r in runs], 8))
    texts = [t for _, _, t in out]
    assert texts == sorted(x for r in runs for x in r)
    for (_, _, a), (_, shared, b) in zip(out, out[1:]):
        assert shared == next((i for i in range(8) if a[i] != b[i]), 8)
    # Each comparison starts behind the known prefix; without that knowledge every one would start at 0.
    assert all(at <= to for to, at in read) and sum(at for _, at in read) > 2 * len(read)


def test_mismatch_reads_nothing_before_its_start():
    a, b = b"x" * 40 + b"a" + b"z" * 55, b"y" * 40 + b"b" + b"z" * 55
    assert suffix_dedup.mismatch(a, b, 40, 96) == 40 and suffix_dedup.mismatch(a, b, 41, 96) == 96 and suffix_dedup.mismatch(a, b, 0, 96) == 0
    assert suffix_dedup.mismatch(b"q" * 33 + b"\x01\x02", b"q" * 33 + b"\x01\x03", 3, 35) == 34


def test_scan_is_the_same_in_small_blocks(monkeypatch):
    rng = np.random.default_rng(12)
    data = rng.integers(97, 100, 9000).astype(np.uint8)
    offsets = np.array([0, 10, 3000, 3000, 3049, 8800, 9000])
    spans = lambda: {(a, w, d, h) for a, p, q, d, h, _ in zip(*suffix_dedup.scan(data, offsets, 50)) for w in range(p, q + 1)}
    whole = spans()
    monkeypatch.setattr(suffix_dedup, "BLOCK", 400)
    assert spans() == whole and len(whole) == sum(max(0, n - 49) for n in np.diff(offsets))


# ---- 4: mixing ---------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, none):
    rng = np.random.default_rng(4)
    rows = [(int(i), ["a", "b", "c", None][min(3, int(rng.exponential()))], int(rng.integers(0, 200))) for i in range(2000)] + [(5000, "d", None), (5001, "d", 0)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(table).collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(table.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got} and len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r["source"]] += r["size"] or 0
        taken[r["source"]] += (r["size"] or 0) * r["copies"]
        target[r["source"]] = r["target"]
        assert r["copies"] <= 2
    total = sum(size.values())
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    free = [s for s in size if size[s] and target[s] < 2 * size[s] - 1e-9]
    weights = {s: w for s, w in zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1])}
    assert len({round(target[s] / weights[s], 6) for s in free}) == 1
    assert all(abs(taken[s] - target[s]) <= 200 for s in size)
    assert mixing.mix(none, size="n_chars").count() == 0
    own = ("times", "threshold", "_mix_source", "_mix_hash", "hash", "budget", "_c0")
    clash = table.selectExpr("doc_id", "source", "size", *[f"doc_id + {k} as {c}" for k, c in enumerate(own)])
    rows = mixing.mix(clash).collect()
    assert {r["doc_id"]: r["copies"] for r in rows} == again and all(r[c] == r["doc_id"] + k for r in rows for k, c in enumerate(own))


def test_mixing_tells_rows_without_a_key_apart(spark):
    """A source without ids comes near a target between whole sizes once its texts are named; equal texts stay together."""
    table = spark.createDataFrame([(None, s, f"text {i // 2} of {s}", 10) for s in ("a", "b") for i in range(400)], "doc_id long, source string, text string, size long")
    rows = mixing.mix(table, text="text", weights=(3, 1), share=1.0).collect()
    taken, target = Counter(), {r["source"]: r["target"] for r in rows}
    for r in rows:
        taken[r["source"]] += r["copies"] * r["size"]
    assert target == {"a": 6000.0, "b": 2000.0} and all(abs(taken[s] - target[s]) <= 20 for s in target)
    assert len({(r["text"], r["copies"]) for r in rows}) == 400


# ---- 5: urls -----------------------------------------------------------------------------------

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "bad.org", "/")]


def test_urls_rules_and_aliases(spark):
    link = lambda u: f'<head><link href="{u}" rel="canonical"></head>'
    jump = lambda u: f'<META HTTP-EQUIV="Refresh" content="0; url={u}">'
    rows = [
        (1, "http://A.Example.COM/en/7x?q#f", None), (2, "https://x.com/en/1", ""), (3, None, "x"), (4, "no scheme", "x"), (5, "http://mirror.net/a", link("https://bad.org/a")), (6, "http://other.net/b", jump("//mirror.net/a")),
        (7, "http://third.net/c", link("/d")), (8, "http://third.net/d", link("http://bad.org/z") + link("http://example.com/en/7")), (9, "http://clean.net/", "<p>"), (10, "http://mirror.net/a", "<p>"), (11, "https://notcom/en/", None),
        (12, "http://many.net/a", '<link\n data-href="http://clean.net/"\n title="a > b"\n rel="x canonical"\n href="https://bad.org/a"\n>'), (13, "http://many.net/b", '<!-- <link rel="canonical" href="http://bad.org/"> --><script>var x = \'<link rel=canonical href=http://bad.org/>\'</script>'),
        (14, "http://many.net/c/d", '<base href="http://bad.org/x/y"><LINK REL=canonical HREF=../z/./q>'), (15, "http://many.net/c/../e", None), (16, "http://many.net/f/", '<link rel=canonical href="../e/">' + link("../e")), (17, "http://e.net/", '<meta name="refresh" content="0;url=http://bad.org/">' + link("http://many.net/e")), (18, "http://bad.org/k/..", link("http://many.net/e")),
        (19, "http://odd.net/", '<link rel="canonical" title="href=http://bad.org/" href="mailto:x@bad.org">' + link("javascript:x") + "<link rel='canonical' href='http://bad.org/'"),
    ]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    verdicts = {k: r["verdict"] for k, r in got.items()}
    assert verdicts == {1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "block", 11: "allow", 12: "block", 13: "allow", 14: "block", 15: "block", 16: "block", 17: "block", 18: "block", 19: "allow"}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("a.example.com", "/en/7x", "example.com/en/7")
    assert (got[3]["host"], got[3]["path"], got[3]["rule"]) == ("", "", None)
    redirects = spark.createDataFrame([("http://clean.net/", "http://bad.org/q")], "from_url string, to_url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES, redirects).collect()}[9] == "block"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


# ---- 6: embeddings -----------------------------------------------------------------------------


def test_embeddings_find_all_links(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.06 * rng.standard_normal(16)], i % 2) for i in range(600)]
    rows += [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [None] * 16, 1), (604, rows[0][1], None), (605, rows[0][1], 0), (606, rows[0][1], 0), (607, [1.0, 2.0], 0)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=64).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v), k) for i, v, k in rows if v and None not in v and k is not None and np.isfinite(v).all() and np.any(v)]
    edges = [(a, b) for b in range(len(good)) for a in range(b) if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.98]
    degree, label = Counter(x for e in edges for x in e), components(len(good), edges)
    assert len(edges) > 500
    for k, (i, *_) in enumerate(good):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (degree[k], good[label[k]][0], good[label[k]][0] == i)
    for i in range(600, 605):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- 9: quality --------------------------------------------------------------------------------


def test_quality_learns_and_holds_out(spark, none):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        body = " ".join(rng.choice(words, rng.integers(10, 200)))
        rows.append((i, " ".join(w.upper() + "!!" for w in body.split()) if bad else body))
        labels.append((i, 0 if bad else 1))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, told)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == (i % 4 != 0) for i in out]) > 0.95
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels], "doc_id long, quality int")
    again = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, flipped)).collect()}
    assert again == got
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "x"), (4, "w" * 50_000)], "doc_id long, text string")
    assert [r["score"] for r in quality.score(odd, model).orderBy("doc_id").collect()][1:4] == [0.0, 0.0, 0.0]
    assert quality.keep_good(none, model).count() == 0
    assert "share" in quality.fit(docs, told.limit(0))


def slow_score(model, bag):
    """The same model, one passage and one number at a time."""
    encoded, raw = [], []
    for row in bag:
        h = [math.tanh(sum(row[i] * model["enc"][i][k] for i in range(len(row))) + model["enc_b"][k]) for k in range(len(model["enc_b"]))]
        gates = [math.tanh(sum(h[k] * model["att_v"][k][g] for k in range(len(h)))) / (1 + math.exp(-sum(h[k] * model["att_u"][k][g] for k in range(len(h))))) for g in range(len(model["att_w"]))]
        encoded.append(h)
        raw.append(math.exp(sum(x * w for x, w in zip(gates, model["att_w"]))))
    z = [sum(a / sum(raw) * h[k] for a, h in zip(raw, encoded)) for k in range(len(encoded[0]))]
    return 1 / (1 + math.exp(-sum(x * w for x, w in zip(z, model["out"])) - model["out_b"][0]))


def small_model(rng, width, hidden=4, gate=3):
    shapes = {"enc": (width, hidden), "enc_b": (hidden,), "att_v": (hidden, gate), "att_u": (hidden, gate), "att_w": (gate,), "out": (hidden,), "out_b": (1,)}
    return {k: rng.standard_normal(s) for k, s in shapes.items()}


def test_attention_scores_equal_a_plain_loop():
    rng = np.random.default_rng(21)
    model, x, number = small_model(rng, 5), rng.standard_normal((9, 5)), np.array([1, 3, 5])
    got = quality._forward(model, x, number)[0]
    assert np.allclose(got, [slow_score(model, bag) for bag in np.split(x, [1, 4])], rtol=1e-12)


def test_attention_gradient_equals_finite_differences():
    rng = np.random.default_rng(22)
    model, x, number, y, weight = small_model(rng, 5), rng.standard_normal((9, 5)), np.array([1, 3, 5]), np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.2, 0.3])

    def loss():
        p = quality._forward(model, x, number)[0]
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

    for name, g in quality.gradient(model, x, number, y, weight).items():
        for at in np.ndindex(model[name].shape):
            kept = model[name][at]
            model[name][at] = kept + 1e-6
            up = loss()
            model[name][at] = kept - 1e-6
            assert abs((up - loss()) / 2e-6 - g[at]) < 1e-7, (name, at)
            model[name][at] = kept


@pytest.mark.parametrize("giant", [(0,), (1,), (0, 1)])
def test_one_giant_document_does_not_cost_its_label(spark, giant):
    rng = np.random.default_rng(4)
    kinds = {0: ["buy", "now", "$$$", "click"], 1: ["measured", "careful", "reading", "chapter"]}
    told = [(i, i % 2) for i in range(200)] + [(1000 + k, k) for k in giant] + [(2000 + k, k) for k in giant]
    rows = [(i, " ".join(rng.choice(kinds[k], 30_000 if i >= 1000 else 60))) for i, k in told]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(told, "doc_id long, quality int")
    model = quality.fit(docs, labels, class_words=20_000)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    out = [(got[i] >= 0.5) == bool(k) for i, k in told if zlib.crc32(str(i).encode()) % 4 == 2]
    print(f"held-out accuracy {sum(out) / len(out):.3f} of {len(out)}")
    assert "share" not in model and sum(out) >= 0.95 * len(out)
    lone = labels.filter("doc_id >= 1000")  # nothing but giants: the shortest of each label still teaches
    assert ("share" in quality.fit(docs, lone, class_words=20_000)) == (len({k for i, k in told if i >= 1000 and zlib.crc32(str(i).encode()) % 4 != 2}) < 2)


def test_quality_fit_reads_all_passages_within_its_bound(spark):
    rows = [(i, " ".join(f"{'Fine' if i % 2 else 'x#!'}{i * k % 7}" for k in range(64 * (1 + i % 40)))) for i in range(80)]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    seen = []
    try:
        found = quality.train
        quality.train = lambda x, number, label, ones: seen.append((number.sum(), len(label))) or found(x, number, label, ones, steps=2)
        quality.fit(docs, told)
        quality.fit(docs, told, class_words=6400)
    finally:
        quality.train = found
    teach = [i for i in range(80) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert seen[0] == (sum(1 + i % 40 for i in teach), len(teach))
    assert 100 <= seen[1][0] <= 200 and seen[1][1] < len(teach)


def test_attention_learns_bags():
    rng = np.random.default_rng(8)
    x, number, y = rng.standard_normal((12, 5)).astype(np.float64), np.array([3, 4, 5]), np.array([0.0, 1.0, 1.0])
    model = quality.train(x, number, y, steps=300)
    assert ((quality.predict(model, x, number) > 0.5) == (y == 1)).all()


# ---- 10: Matroska ------------------------------------------------------------------------------


@pytest.mark.parametrize("lacing", [matroska.XIPH, matroska.EBML_LACING, matroska.FIXED])
def test_lacing_round_trip(lacing):
    sizes = [300, 300, 300] if lacing == matroska.FIXED else [1, 254, 255, 256, 5000, 3, 0 if lacing == matroska.XIPH else 2]
    frames = [bytes([i % 256]) * n for i, n in enumerate(sizes)]
    data = matroska.lace(frames, lacing)
    assert [data[a:b] for a, b in matroska.frame_ranges(data, 0, len(data), lacing)] == frames


def test_matroska_packets_and_cues():
    payload = bytes(range(256)) * 600
    data = matroska.write(payload)
    movie = matroska.parse(data)
    assert matroska.payload_of(data, movie) == payload
    assert {p for _, _, p in movie.cues} == set(movie.clusters) and len(movie.packets) == len(payload) // 192
    assert [p[1] for p in movie.packets] == [i * matroska.FRAME_NS for i in range(len(movie.packets))]
    body = matroska.uint(matroska.TIMESTAMP, 5) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x07\x00abc") + matroska.uint(matroska.REFERENCE_BLOCK, 1))
    unknown = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + body + matroska.element(matroska.CUES, b"")
    live = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"webm")) + b"\x18\x53\x80\x67\xff" + matroska.element(0xEC, b"void") + unknown
    movie = matroska.parse(live)
    assert movie.doc_type == "webm" and [(t, ns, k) for t, ns, k, _, _ in movie.packets] == [(1, 12_000_000, False)]
    for broken in (b"", b"\x00", data[:40], data[: len(data) // 2]):
        with pytest.raises(matroska.MatroskaError):
            matroska.parse(broken)


def test_media_columns(docs, none):
    wanted = Counter()
    for d, t, *_ in documents():
        raw = (t or "").encode()
        padded = raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)
        wanted[d, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])] += 1
    got = media.describe_texts(docs).collect()
    assert Counter(tuple(r[:5]) for r in got) == wanted
    by_payload = defaultdict(set)
    for r in got:
        by_payload[r["payload_sha256"]].add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by_payload.values())
    packets = media.packet_table(media.encode_texts(docs))
    assert packets.count() == sum(n[2] // 192 * k for n, k in wanted.items())
    # The signal's figures, worked out from the text alone.
    for r in got:
        raw = next(((t or "").encode() for d, t, *_ in documents() if d == r["doc_id"] and len((t or "").encode()) == r["n_bytes"]))
        padded = raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)
        if hashlib.sha256(padded).hexdigest() != r["payload_sha256"]:
            continue
        told, n = dict(x.split("=") for x in r["feature"].split(";")), len(padded)
        mean = sum(padded) / n
        share = [padded.count(b) / n for b in set(padded)]
        assert told["packets"] == str(n // 192) and told["clusters"] == told["cues"] == str(-(-(n // 192) // 256)) and told["end_ns"] == str(n // 192 * 4_000_000)
        assert abs(float(told["mean"]) - mean) < 1e-4 and abs(float(told["std"]) - math.sqrt(sum((b - mean) ** 2 for b in padded) / n)) < 1e-4
        assert abs(float(told["entropy"]) + sum(p * math.log2(p) for p in share)) < 1e-4
    times = packets.filter("doc_id = 11").orderBy("packet").collect()
    assert [(r["packet"], r["timestamp_ns"], r["track"], r["end"] - r["start"], r["error"]) for r in times] == [(i, i * 4_000_000, 1, 192, None) for i in range(len(times))] and len(times) > 10
    assert media.describe_texts(none).count() == 0


def test_broken_media_are_told(spark):
    whole = matroska.write(b"x" * 1000)
    files = [(1, b"junk"), (2, None), (3, b""), (4, whole[: len(whole) // 2]), (5, whole), (6, b"\x1a\x45\xdf\xa3"), (None, b"\xff" * 9)]
    rng = np.random.default_rng(23)
    for k in range(200):  # whole files with a few bytes changed never raise anything else
        data = bytearray(whole)
        for at in rng.integers(0, len(data), 4):
            data[at] = rng.integers(0, 256)
        files.append((100 + k, bytes(data)))
    rows = media.packet_table(spark.createDataFrame(files, "doc_id long, media binary")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for broken in (1, 3, 4, 6, None):
        assert len(by[broken]) == 1 and by[broken][0]["error"] and by[broken][0]["packet"] is None
    assert 2 not in by and len(by[5]) == 6 and all(r["error"] is None for r in by[5])


def test_jaccard_links_in_ranges():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 300_000).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(base[rng.random(len(base)) < keep]) for keep in (0.95, 0.95, 0.5)]
    links = minhash.jaccard_links(sets, 0.8)
    assert links.tolist() == [[False, True, False], [True, False, False], [False, False, False]]


def test_inverse():
    matrix = np.random.default_rng(11).integers(0, 5, (40, 40)).astype(float) + np.eye(40) * 7
    assert np.allclose(cutting_stock.inverted(matrix) @ matrix, np.eye(40))
