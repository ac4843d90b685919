"""Cases of the first review."""

import numpy as np


def test_anchors_are_spread_over_tasks():
    from qualiframe.llm import suffix_dedup

    data = np.random.default_rng(1).integers(97, 123, 400_000).astype(np.uint8)
    hashes = suffix_dedup.scan(data, np.array([0, len(data)]), 50)[4]
    sizes = np.bincount(suffix_dedup._part(hashes, 32), minlength=32)
    assert sizes.max() < 1.3 * sizes.mean()


def test_quality_sample_has_one_row_of_each_id(spark):
    from qualiframe.llm import quality

    rows = [(i, f"{'fine prose of a good kind' if i % 2 else 'buy now click here'} number {i}. " * 8, i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    once, often = quality.fit(docs, labels), quality.fit(docs.unionByName(docs.filter("doc_id < 20").crossJoin(spark.range(30)).drop("id")), labels)
    assert once.keys() == often.keys() and all(np.array_equal(once[k], often[k]) for k in once)


def test_float_vectors_travel_as_given():
    """Half the bytes of the unit vector, which is the same to the bit where it is read."""
    import numpy as np
    import pyarrow as pa

    from qualiframe.llm import embeddings

    rows = [*np.random.default_rng(3).standard_normal((20, 64)).astype(np.float32).tolist(), [3e38] * 64, [1e-45] + [0.0] * 63, [0.0] * 64, [float("nan")] * 64, None, [1.0, None]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(["0"] * len(rows)), pa.array(rows, pa.list_(pa.float32()))], names=["vec_id", "label", "v"])
    (got,) = embeddings._units(True)(iter([batch]))
    pairs = [(u, v) for u, v in zip(got.column(2).to_pylist(), got.column(3).to_pylist())]
    assert [u is None for u, _ in pairs] == [False] * 22 + [True] * 4
    assert all(len(u) == 2 * len(v) and embeddings._read(v, True).tobytes() == u for u, v in pairs if u)


def test_remembered_token_chunks_are_bounded():
    from qualiframe.llm.queries import vocabulary
    from qualiframe.llm.tokens import WordTokens

    tokens = WordTokens(vocabulary("word_bpe_49k.json"))
    first = tokens.encode(["always here word0x"])
    for at in range(0, 400_000, 40_000):
        tokens.encode(["always " + " ".join(f"word{i}x" for i in range(at, at + 40_000))])
        assert len(tokens.known) + len(getattr(tokens, "older", {})) <= 2 * (100_000 + 40_001)
    assert "always" in tokens.known or "always" in tokens.older
    assert tokens.encode(["always here word0x"]) == first


def test_tables_of_large_rows_are_read_a_few_rows_at_a_time(spark, tmp_path, monkeypatch):
    """A row group holds some megabytes, however many chunks of text a task has written."""
    import pyarrow.parquet as pq

    from qualiframe.llm import suffix_dedup
    from qualiframe.llm.scratch import Scratch

    monkeypatch.setattr("qualiframe.llm.scratch.shared_dir", lambda s: f"file://{tmp_path}")
    docs = spark.range(60).coalesce(1).selectExpr("id as doc_id", "concat_ws('', transform(sequence(1, 8000), i -> sha2(concat(id, ':', i), 256))) as text")
    kept = []
    monkeypatch.setattr(Scratch, "save", lambda self, *a, f=Scratch.save, **k: kept.append(self.root) or f(self, *a, **k))
    suffix_dedup.remove_repeats(docs, chunk=500_000)
    files = list((tmp_path / kept[0].rsplit("/", 1)[1] / "chunks").glob("*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in files for i in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(g.num_rows for g in groups) == 60 and max(g.total_byte_size for g in groups) < 24 << 20 and len(groups) > 1
