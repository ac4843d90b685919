"""Suffix runs of more shares than a run is cut into at once."""

import numpy as np
import pytest

from qualiframe.llm import suffix_dedup as S


@pytest.mark.parametrize("shares,fan", [(33, 32), (513, 512), (1500, 512), (300_000, 512), (512, 512), (1, 512)])
def test_levels_are_even(shares, fan):
    levels, step = S._levels(shares, fan)
    assert step <= fan and step**levels >= shares and (levels == 1 or fan ** (levels - 1) < shares)


def test_no_merge_holds_more_than_some_shares(spark, monkeypatch, tmp_path):
    """Of 40 shares, cut into 32 at once, a task of the first level merges about one, not a quarter of all."""
    made, kept = S._forwarded, tmp_path / "sizes"

    def watched(*args):
        run = made(*args)

        def counted(table):
            with open(kept, "a") as f:
                print(sum(table.column("n").to_pylist()), file=f)
            return run(table)

        return counted

    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, 400))) for _ in range(60)]
    rows = [(i, " ".join(words[j] for j in rng.integers(0, 60, 5))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = sorted(S.remove_repeats(docs).collect())
    monkeypatch.setattr(S, "_forwarded", watched)
    assert sorted(S.remove_repeats(docs, chunk=2000, share=2000, fan=32).collect()) == whole
    sizes = [int(x) for x in kept.read_text().split()]
    assert len(sizes) > 20 and max(sizes) < sum(sizes) / 8
