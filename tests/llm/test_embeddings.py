"""Recall of lattice cells at the threshold, and what a cell holds by chance."""

import numpy as np
import pytest

from meterflow.llm import embeddings
from pyspark.sql import functions as F


def pairs_at(cosine: float, n: int, d: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(seed)
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    x = unit(rng.standard_normal((n, d)))
    y = rng.standard_normal((n, d))
    y = unit(y - (x * y).sum(1, keepdims=True) * x)
    return x, cosine * x + np.sqrt(1 - cosine * cosine) * y


@pytest.mark.parametrize("rows", [300, 5_000, 1_000_000])
def test_recall_at_the_threshold(rows):
    """Pairs of exactly the threshold's cosine meet, with the cells of a small and of a large table; unlike ones seldom do."""
    blocks = embeddings.blocks_for(rows)
    tables = embeddings.tables_for(blocks, 0.93)
    x, y = pairs_at(0.93, 2000, 64, rows)
    none = np.zeros(len(x), np.int64)
    a, b = embeddings.cells(x, none, tables, blocks), embeddings.cells(y, none, tables, blocks)
    met = np.zeros(len(x), bool)
    for k in range(a.shape[1]):
        met |= (b == a[:, [k]]).any(1)
    assert met.mean() >= 0.93
    values, n = np.unique(a, return_counts=True)
    assert (n * (n - 1)).sum() / len(x) / tables * rows / len(x) < 6 * embeddings.MOST_CHANCE


@pytest.mark.parametrize("n", [400, 4000])
def test_links_at_the_threshold(spark, n):
    """The operator finds at least nine of ten links that lie just above the threshold, at two sizes, and none below."""
    x, y = pairs_at(0.932, n // 4, 32, n)
    z = pairs_at(0.928, n // 4, 32, n + 1)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((x, y, *z)))]
    got = {r["vec_id"]: r for r in embeddings.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))).collect()}
    q = n // 4
    assert np.mean([got[i]["n_links"] == 1 and got[q + i]["component_id"] == i for i in range(q)]) >= 0.9
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(2 * q, 4 * q))
