"""Embedding near-duplicates: magnitudes, and recall on planted near copies."""

import numpy as np
import pytest

from retrospect.llm import embedding_dedup


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_vectors_of_any_magnitude_link_by_direction(spark, kind):
    big, small = (1e200, 1e-200) if kind == "array<double>" else (1e30, 1e-30)
    rows = [(1, [big, big]), (2, [big, 1.01 * big]), (3, [small, small]), (4, [-small, small]), (5, [1.0, -1.0]), (6, [-2.0, 2.0]), (7, [-0.0, 3.0]), (8, [0.0, 3.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_links(spark.createDataFrame(rows, f"vec_id long, embedding {kind}")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (0, 5), 6: (1, 4), 7: (1, 7), 8: (1, 7)}


@pytest.mark.parametrize("n, dims, tile", [(4000, 64, 2048), (3000, 256, 16)])
def test_recall_on_planted_near_copies(spark, monkeypatch, n, dims, tile):
    """Pairs at cosine 0.951 to 0.99, each of its own direction, and one cluster around one vector."""
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(dims)
    one = embedding_dedup.unit(rng.standard_normal((n // 2, dims)))
    side = rng.standard_normal(one.shape)
    side = embedding_dedup.unit(side - (side * one).sum(axis=1)[:, None] * one)
    cosine = rng.uniform(0.951, 0.99, n // 2)[:, None]
    two = cosine * one + np.sqrt(1 - cosine**2) * side
    cluster = one[0] + 0.02 * rng.standard_normal((60, dims)) / np.sqrt(dims)
    v = np.concatenate([one, two, cluster])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(rows).collect()}
    u = embedding_dedup.unit(v)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    want, found = close.sum(axis=1), np.array([got[i]["n_links"] for i in range(len(v))])
    assert (found <= want).all() and found.sum() >= 0.995 * want.sum()
    hit = sum(got[i]["component_id"] == got[i + n // 2]["component_id"] for i in range(n // 2))
    assert hit >= 0.995 * (n // 2)
