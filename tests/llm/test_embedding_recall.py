"""Links of large labels whose pairs straddle the threshold, against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from larkspan.llm import embedding_dedup


def noisy_copies(rng, groups, mean_cosine, n, width=64):
    """Unit vectors around ``groups`` centres; two of a group have this cosine on average."""
    centre = rng.normal(size=(groups, width))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    noise = rng.normal(size=(n, width)) * np.sqrt((1 - mean_cosine) / mean_cosine / width)
    return (centre[np.arange(n) % groups] + noise).astype(np.float32)


def links(x, threshold=0.93):
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([(x[i : i + 1000] @ x.T >= threshold).sum(1) - 1 for i in range(0, len(x), 1000)])


@pytest.mark.parametrize("groups, mean_cosine, share", [(1, 0.922, (0.2, 0.4)), (1, 0.91, (0.05, 0.2)), (3, 0.93, (0.1, 0.25)), (40, 0.93, (0.005, 0.02))])
def test_links_of_a_large_label(spark, groups, mean_cosine, share):
    n = 20_000
    x = noisy_copies(np.random.default_rng(groups), groups, mean_cosine, n)
    want = links(x)
    assert share[0] <= want.sum() / n / (n - 1) <= share[1]
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist(), "label": 1}), "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.find_links(rows).toPandas().set_index("vec_id")["n_links"].reindex(range(n)).to_numpy()
    assert (got <= want).all()
    assert got.sum() >= 0.9 * want.sum(), got.sum() / want.sum()
