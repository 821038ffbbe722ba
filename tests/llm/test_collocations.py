"""Collocations against plain counting, the perfect hash, and small blocks, parts and shards."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from vellum.llm import collocations
from vellum.llm.perfect_hash import PerfectHash

SCHEMA = "doc_id long, text string, lang string, key long, level int, shard string, a int, phrase string"


def expected(rows: list[tuple], least: int, top: int) -> list[tuple]:
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in (1, 2, 3):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    found = {}
    for (lang, *w), a in f.items():
        if len(w) > 1 and a >= least:
            cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
            s, k = min(cuts)
            found[lang, *w] = (a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], s)
    gone = {(lang, *w[i : i + 2]) for lang, *w in found if len(w) == 3 for i in (0, 1) if 100 * found[lang, *w][0] >= 50 * f[lang, *w[i : i + 2]]}
    by = collections.defaultdict(list)
    for (lang, *w), v in found.items():
        if (lang, *w) not in gone:
            by[lang].append((-v[4], -v[0], " ".join(w).encode(), v))
    return sorted((lang, i + 1, p.decode(), *v) for lang, own in by.items() for i, (_, _, p, v) in enumerate(sorted(own)[:top]))


def table(seed: int, n: int = 120) -> list[tuple]:
    r = random.Random(seed)
    words = "a b c Dd dd É é ż new york city ünï  x 中文".split(" ")
    say = lambda k: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(k))
    texts = [None, "", " ", "...", "New York City", "a", *[say(r.randint(1, 60)) for _ in range(n)], say(4000), "word" * 30_000]
    rows = [(i, t, r.choice(["en", "en", "de", None, "und", ""]), 1, 2, "s", 3, "p") for i, t in enumerate(texts)]
    return rows + [rows[8]] * 20 + [(None, rows[9][1], "en", 1, 2, "s", 3, "p")]


@pytest.mark.parametrize(("least", "top", "held", "block", "part"), [(10, 2000, 1 << 21, 1 << 22, 8 << 30), (3, 15, 50, 20, 1)])
def test_collocations(spark, monkeypatch, least, top, held, block, part):
    for name, value in (("HELD", held), ("BLOCK", block), ("SALTS", 3)):
        monkeypatch.setattr(collocations, name, value)
    if part == 1:
        monkeypatch.setattr(collocations, "_shards", lambda docs: (4, 3))
    rows = table(least)
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least, top).collect()
    assert sorted(map(tuple, got)) == expected(rows, least, top)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scores_are_exact_beyond_64_bits():
    a, l, r = (np.array([10**11 + k, 20], np.int64) for k in (7, 9, 8))  # noqa: E741
    got = collocations.scores(a, [(l * 2, r), (l, r * 2)])
    assert got[2].tolist() == [10**6 * (10**11 + 7) ** 2 // (2 * (10**11 + 9) * (10**11 + 8)), 500_000]
    assert got[0].tolist() == (l * 2).tolist()


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 30_000])
def test_perfect_hash(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
    h = PerfectHash.load(*PerfectHash.build(keys).dump())
    slot, known = h.find(keys)
    assert known.all() and sorted(slot.tolist()) == list(range(len(keys))) and (h.keys[slot] == keys).all()
    others = r.integers(1 << 63, (1 << 64) - 1, 500, dtype=np.uint64)
    assert not h.find(others)[1].any()
