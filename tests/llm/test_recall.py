"""Recall of the forest at its production parameters, on a label large enough for many splits."""

import numpy as np

from qualiframe.llm import embeddings


def test_forest_recall_on_fifty_thousand_vectors(spark):
    import pandas as pd

    rng = np.random.default_rng(41)
    dim, groups, each = 64, 4000, 5
    base = rng.standard_normal((50_000 - groups * (each - 1), dim))
    # Copies at cosines from about 0.97 to 1, so many pairs are just above the threshold of 0.98.
    noise = rng.uniform(0.02, 0.18, (groups, each - 1, 1)) * rng.standard_normal((groups, each - 1, dim))
    x = np.concatenate([base, (base[:groups, None, :] + noise).reshape(-1, dim)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = set()
    for at in range(0, len(unit), 2000):
        close = unit[at : at + 2000] @ unit.T >= 0.98
        a, b = np.nonzero(close)
        true |= {(int(i) + at, int(j)) for i, j in zip(a, b) if i + at < j}
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": 1}), "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(table.repartition(8)).collect()}
    degree = np.zeros(len(x), int)
    for i, j in true:
        degree[i] += 1
        degree[j] += 1
    found = sum(got.values()) / 2
    print(f"forest: {len(true)} true pairs, {found:.0f} found, recall {found / len(true):.4f}")
    # Every link found is a true one, as each is verified.
    assert len(true) > 5000 and all(got[i] <= degree[i] for i in range(len(x)))
    assert found >= 0.9 * len(true)
