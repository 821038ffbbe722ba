"""Registry and directory index give one order, also for notes with equal paths."""

from __future__ import annotations

import random

from vellum.operators import registry


def notes(spark, seed):
    rows = [(f"docs/adr/{i // 4:04}-x.md", f"Document {i}", "{}") for i in range(40)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "path string, title string, frontmatter string").repartition(seed + 1)


def test_equal_paths_have_one_registry_order(spark):
    got = [sorted((r["place"], r["title"]) for r in registry.registry(notes(spark, seed)).collect()) for seed in range(4)]
    assert got[0][:5] == [(i + 1, f"Document {t}") for i, t in enumerate([0, 1, 2, 3, 4])] and all(g == got[0] for g in got)


def test_equal_names_have_one_place_in_the_index(spark):
    frames = [registry.directory_index(notes(spark, seed)) for seed in range(4)]
    got = [sorted((r["place"], r["title"]) for r in f.collect()) for f in frames]
    assert got[0][:3] == [(1, "Document 0"), (2, "Document 1"), (3, "Document 2")] and all(g == got[0] for g in got)
    assert len({registry.index_text(f).first()["block"] for f in frames}) == 1
