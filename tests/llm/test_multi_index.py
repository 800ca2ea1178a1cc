"""The inverted multi-index over many shards and chunks, its fitted share, and recall on clustered and random vectors."""

import numpy as np
import pytest
from test_quality import nearest, ranked

from maskloom.llm import multi_index as mi


def clustered(n, d=16, groups=60, spread=0.25, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, d))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))
    return [(i, [float(a) for a in v]) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]


def test_shards_and_chunks_change_nothing(spark, monkeypatch):
    rows = [*clustered(1500), *((i, [1.0] * 16) for i in range(2000, 2060))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = ranked(mi.search(df, share=0.3))
    monkeypatch.setattr(mi, "SHARD", 100)
    monkeypatch.setattr(mi, "CHUNK", 9)
    assert ranked(mi.search(df, share=0.3)) == whole
    exact = ranked(mi.search(df, share=1.0))
    want = nearest(rows, 20)
    assert set(exact) == set(want)
    for q, found in want.items():
        assert [s for _, s in exact[q]] == pytest.approx([s for _, s in found])
        assert len({v for v, _ in exact[q]} & {v for v, _ in found}) == 20


def test_share_is_fitted_on_the_sample():
    rng = np.random.default_rng(2)
    shares = []
    for x in (np.array([v for _, v in clustered(4000)]), rng.normal(size=(4000, 16))):
        books = [mi.centroids(x[:, :8], 40), mi.centroids(x[:, 8:], 40)]
        shares.append(mi.fitted_share(x, books, 20))
    assert 0 < shares[0] < 0.2 and shares[0] < shares[1] <= 1
    assert mi.fitted_share(np.ones((1, 16)), books, 20) == 1.0


def test_recall_on_many_vectors(spark):
    rows = clustered(50_000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    found = ranked(mi.search(df, every=200))
    x = np.array([v for _, v in rows])
    assert set(found) == set(range(0, 50_000, 200))
    hits = 0
    for q, got in found.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len({v for v, _ in got} & set(np.argpartition(scores, -20)[-20:].tolist()))
    assert hits / (20 * len(found)) >= 0.9
