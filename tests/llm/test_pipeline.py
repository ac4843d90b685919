"""The pipeline stage by stage against plain Python on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from qualiframe.llm import quality, tokens  # noqa: E402
from qualiframe.llm.queries import vocabulary  # noqa: E402
from qualiframe.llm.scratch import Scratch  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def similar(sets):
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = Counter((a, b) for ids in where.values() for k, b in enumerate(ids) for a in ids[:k])
    return [p for p, c in common.items() if 10 * c >= 8 * (len(sets[p[0]]) + len(sets[p[1]]) - c)]


def brute_lines(rows):
    lines = [(k, i, x) for k, r in enumerate(rows) for i, x in enumerate((r[1] or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    lines.sort(key=lambda t: (rows[t[0]][0], t[1]))
    distinct = {}
    for _, _, x in lines:
        distinct.setdefault(x, len(distinct))
    label = roots(len(distinct), similar([{x[i : i + 7] for i in range(max(1, len(x) - 6))} for x in distinct]))
    seen, gone = set(), set()
    for k, i, x in lines:
        c = label[distinct[x]]
        gone |= {(k, i)} if c in seen else set()
        seen.add(c)
    out = []
    for k, r in enumerate(rows):
        kept = [x for i, x in enumerate((r[1] or "").split("\n")) if (k, i) not in gone]
        if len(kept) == len((r[1] or "").split("\n")):
            out.append(r)
        elif any(x.strip(" \t\n\r\x0b\x0c") for x in kept):
            text = "\n".join(kept)
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def brute_join(rows):
    rows = sorted(rows)
    words = [r[1].encode().split() for r in rows]
    label = roots(len(rows), similar([{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]))
    return [r for i, r in enumerate(rows) if label[i] == i]


def brute_mix(rows):
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    total = Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total))}
    target, capped = {}, set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        share = sum(weight[s] for s in total if s not in capped)
        target = {s: 2.0 * total[s] if s in capped else rest * weight[s] / share for s in total}
        over = {s for s in total if s not in capped and target[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in total:
        times = math.floor(target[s] / total[s])
        budget, below = target[s] - times * total[s], 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16)):
            more = 2 * below + size[r[0]] <= 2 * budget
            below += size[r[0]]
            out += [r] * (times + more)
    return out


def test_each_stage_and_the_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    work, made = Scratch(spark, "test"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = work.save(stage(spark, docs, SF), f"s{k}")
        made.append([tuple(r) for r in docs.collect()])
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == COLUMNS, name
    raw = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).collect()]
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    from qualiframe.llm import minhash

    scores = [float(quality.predict(model, *quality.passages(*minhash.text_bytes(pa.array([r[1]]))))[0]) for r in raw]
    assert sorted(made[0]) == sorted(r for r, s in zip(raw, scores) if s >= 0.7)
    assert 0.6 * len(raw) < len(made[0]) < len(raw)
    assert sorted(made[1]) == sorted(brute_lines(made[0]))
    assert sorted(made[2]) == sorted(brute_join(made[1]))
    assert sorted(made[3]) == sorted(brute_mix(made[2]))
    encoder, wanted = tokens.WordTokens(vocabulary("word_bpe_49k.json")), Counter()
    for r in made[3]:
        ids = np.frombuffer(encoder.encode([r[1]])[0] + b"\2\0\0\0", "<u4")
        wanted.update((r[0], s, zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096))
    assert Counter((r[0], r[1], r[3], r[4]) for r in made[4]) == wanted
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r[:5]) for r in whole.collect()) == sorted(r[:5] for r in made[4])
