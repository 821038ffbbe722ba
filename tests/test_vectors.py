"""The inverted file of vectors against all pairs, and its recall."""

from __future__ import annotations

import numpy as np
import pytest

from vellum.operators import embed, vectors

SCHEMA = "k long, v array<double>"


def clustered(n: int, dims: int = 16, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    return r.normal(size=(12, dims))[r.integers(0, 12, n)] + 0.4 * r.normal(size=(n, dims))


def truth(x: np.ndarray, asked: list[int], k: int) -> set:
    u = vectors.unit(x)
    out = set()
    for q in asked:
        s = np.round(u @ u[q], 12)
        out |= {(q, int(i), p + 1) for p, i in enumerate([i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k])}
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_exact_route(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    x = clustered(150)
    x[10:40] = x[9]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    asked = list(range(0, 150, 7))
    got = vectors.near(rows.where("k % 7 = 0"), vectors.exact(rows), 4).collect()
    assert {(r["query"], r["k"], r["rank"]) for r in got} == truth(x, asked, 4)


def test_index_recall_and_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    x = clustered(1200)
    x[:400] = x[0]  # a third of all rows are copies
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(3)
    coarse = vectors.fit(rows)
    filed = vectors.index(rows, coarse)
    assert filed.count() == 1200 and filed.groupBy("cell", "block").count().agg({"count": "max"}).first()[0] <= 128
    asked = rows.where("k % 20 = 0")
    exact = vectors.near(asked, vectors.exact(rows), 1)
    assert vectors.recall(vectors.near(asked, filed, 1, coarse), exact) >= 0.9
    assert vectors.recall(vectors.near(asked, filed, 1, coarse, len(coarse.centres)), exact) == 1.0


def test_probes_are_measured():
    """One cell is enough where clusters lie far apart, and nearly all are needed where there are none."""
    r = np.random.default_rng(2)
    centres = vectors.unit(np.eye(16)[:8])
    apart = vectors.unit(np.repeat(centres, 20, 0) + 0.01 * r.normal(size=(160, 16)))
    assert vectors.probes_for(apart, centres, 0.95) == 1
    assert vectors.probes_for(vectors.unit(r.normal(size=(300, 16))), vectors.unit(r.normal(size=(8, 16))), 0.95) > 2


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (None, [1.0, 0.0]), (4, []), (5, [1.0, 0.0, 0.0]), (6, [0.0, 0.0])], SCHEMA)
    ready = vectors.ready(rows, "k", "v")
    got = {(r["query"], r["k"]) for r in vectors.near(ready, vectors.exact(ready), 1).collect()}
    assert got == {(1, 2), (2, 1), (6, 1)}
    nothing = ready.limit(0)
    coarse = vectors.fit(nothing)
    assert vectors.near(nothing, vectors.index(nothing, coarse), 3, coarse).count() == 0
    assert {(r["fact"], r["note"]) for r in embed.nearest_each(rows, rows, "k", "v", by_index=True).collect()} >= {(1, 2), (2, 1)}
