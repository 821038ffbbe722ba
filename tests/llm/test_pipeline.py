"""The pipeline's stages against brute force on a small table."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_operators import brute_components
from vellum.llm import scratch


def test_stages(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage = say(90)
    rows = [(i, say(r.randint(60, 150))) for i in range(120)]
    rows += [(200 + i, say(70) + " " + passage + " " + say(70)) for i in range(5)]
    rows += [(300, rows[0][1]), (301, rows[1][1] + " extra"), (400, " ".join(word() + "$$$" for _ in range(90))), (401, "too short"), (402, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark_docs = docs
    good = scratch.settle(corpus_pipeline.quality_stage(spark, spark_docs, ""), "t")
    kept = {x["doc_id"] for x in good.collect()}
    assert kept == {i for i, _ in rows} - {400, 401, 402}
    left = [x for x in rows if x[0] in kept]
    _, group = brute_components(left)
    one = scratch.settle(corpus_pipeline.near_duplicate_stage(spark, good, ""), "t")
    assert {x["doc_id"] for x in one.collect()} == {min(left[j][0] for j in g) for g in group.values()}
    cut = scratch.settle(corpus_pipeline.repeat_stage(spark, one, ""), "t")
    assert cut.columns == corpus_pipeline.COLUMNS
    texts = {x["doc_id"]: x["text"] for x in cut.collect()}
    whole = {x["doc_id"]: x["text"] for x in one.collect()}
    for i, t in texts.items():
        assert (passage[5:-5] not in t) if 200 <= i < 205 else t == whole[i]
    packed = corpus_pipeline.packing_stage(spark, cut, "").collect()
    assert {x["doc_id"] for x in packed} == set(texts)


def test_repeated_words(spark):
    """Passages of 51 words go whatever their bytes, those of 50 stay; against brute force over words."""
    r = random.Random(8)
    word = lambda lo, hi: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(lo, hi)))
    say = lambda n, lo=2, hi=8: " ".join(word(lo, hi) for _ in range(n))
    short, exact, under, long = say(51, 1, 2), say(51), say(50, 9, 15), say(200)
    plant = lambda *x: " ".join(y for p in x for y in (say(r.randint(3, 90)), p)) + " " + say(40)
    rows = [(i, plant(p)) for i, p in enumerate([short, short, exact, exact, under, under, long, long])]
    rows += [(8, plant(exact.replace(" ", "\n"))), (9, plant(short, under)), (10, exact), (11, None), (12, " "), (13, "na " * 120), (14, plant(" ".join(long.split()[40:95])))]
    rows += [(20 + i, say(r.randint(1, 150))) for i in range(30)]
    count: dict = {}
    for _, t in rows:
        w = (t or "").split()
        for i in range(len(w) - 50):
            count[tuple(w[i : i + 51])] = count.get(tuple(w[i : i + 51]), 0) + 1
    want = {}
    for i, t in rows:
        w = (t or "").split()
        gone = {j + x for j in range(len(w) - 50) if count[tuple(w[j : j + 51])] > 1 for x in range(51)}
        want[i] = [x for j, x in enumerate(w) if j not in gone]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.repeat_stage(spark, docs, "").collect()}
    assert {i: t.split() for i, t in got.items()} == want
    assert len(short.encode()) < 200 and len(under.encode()) > 400
    assert all(short not in got[i] for i in (0, 1, 9)) and all(under in got[i] for i in (4, 5, 9))
