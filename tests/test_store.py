"""The stored index: versions against a rebuild, repeated batches, pruned reads, compaction, failed runs, streams."""

from __future__ import annotations

import random

import pytest

from vellum.operators import store as ST
from vellum.operators.store import Store
from vellum.streaming.ingest import run_index

SCHEMA = "path string, title string, tags array<string>, body string"
WORDS = "red green blue cat dog tree river stone postgres index".split()


def note(r: random.Random, path: str):
    text = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 40)))
    return (path, f"Note {path}", ["t"], f"# {r.choice(WORDS)}\n{text}\nSee [[{r.choice('abcd')}]] and `[[code]]`.\n## Part\n{r.choice(WORDS)}")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(s: Store, table: str):
    return sorted((str(r) for r in s.table(table).collect()))


def found(s: Store, query: str, limit=None):
    return sorted((r["path"], r["ord"], round(r["score"], 9)) for r in s.search(query, limit).collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """(the index after three batches, one built at once from what is left)."""
    r = random.Random(4)
    root = tmp_path_factory.mktemp("store")
    first = [note(r, f"n{i}.md") for i in range(30)]
    second = [note(r, f"n{i}.md") for i in range(10)] + [first[15]] + [note(r, f"new{i}.md") for i in range(5)]
    gone = [(f"n{i}.md",) for i in (2, 20, 21)] + [("never.md",)]
    a = Store(spark, f"file://{root}/a")
    a.apply(0, frame(spark, first), frame(spark, []))
    a.apply(1, frame(spark, second), frame(spark, []))
    a.apply(2, frame(spark, []), spark.createDataFrame(gone, "path string"))
    left = {x[0]: x for x in first + second if (x[0],) not in gone}
    b = Store(spark, f"file://{root}/b")
    b.apply(0, frame(spark, list(left.values())), frame(spark, []))
    return a, b


def test_three_runs_equal_a_rebuild(built):
    a, b = built
    for t in ("notes", "chunks", "links"):
        assert rows_of(a, t) == rows_of(b, t)
    for q in ("red cat", "postgres postgres index", "note", "nothing-here", "", "Part tree river"):
        assert found(a, q) == found(b, q)


@pytest.mark.parametrize("limit", [1, 3, 10, 1000])
def test_the_best_are_those_of_all(built, limit):
    for s in built:
        for q in ("red cat", "postgres note index part", "stone"):
            every = sorted(s.search(q).collect(), key=lambda r: (-round(r["score"], 9), r["path"], r["ord"]))[:limit]
            assert [(r["path"], r["ord"]) for r in s.search(q, limit).collect()] == [(r["path"], r["ord"]) for r in every]


def test_scores_equal_the_search_without_an_index(spark, built):
    from vellum.operators import search

    s = built[0]
    plain = search.bm25(s.table("chunks"), "red cat note", ["path", "ord"], {k: search.WEIGHTS[k] for k in ST.COLUMNS})
    assert found(s, "red cat note") == sorted((r["path"], r["ord"], round(r["score"], 9)) for r in plain.collect())


def test_a_search_reads_only_the_folders_of_its_terms(built):
    s = built[0]
    files = s.blocks(["red", "cat"]).inputFiles()
    folders = {f.split("bucket=")[1].split("/")[0] for f in files}
    assert 1 <= len(folders) <= 2 and len(files) <= 2 * 2 * len(s.versions())
    assert len(s._segments("postings", 99).inputFiles()) > 2 * len(files)


def test_a_batch_that_runs_twice_changes_nothing(spark, built):
    s = built[0]
    before = s.versions(), found(s, "red cat")
    assert s.apply(1, frame(spark, [("n3.md", "x", [], "red red red")]), frame(spark, [])) is False
    assert (s.versions(), found(s, "red cat")) == before


def test_a_run_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/f")
    s.apply(0, frame(spark, [("a.md", "A", [], "red cat")]), frame(spark, []))
    before = found(s, "red cat dog")

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", fail)
        with pytest.raises(RuntimeError):
            s.apply(1, frame(spark, [("b.md", "B", [], "red dog dog")]), frame(spark, [("a.md", "A", [], "")]))
    assert found(s, "red cat dog") == before
    s.apply(1, frame(spark, [("c.md", "C", [], "dog")]), frame(spark, []))
    assert [p for p, _, _ in found(s, "dog red")] == ["a.md", "c.md"]


def test_two_writers_of_one_version(spark, tmp_path):
    a = Store(spark, f"file://{tmp_path}/w")
    a._commit(1, 0, 0, 0)
    with pytest.raises(RuntimeError):
        a._commit(1, 5, 0, 0)


def test_compaction_keeps_all_rows_and_reads_one_segment(spark, tmp_path):
    r = random.Random(9)
    s = Store(spark, f"file://{tmp_path}/c")
    for k in range(3):
        s.apply(k, frame(spark, [note(r, f"n{i}.md") for i in range(k, 12, k + 1)]), spark.createDataFrame([("n5.md",)] if k == 2 else [], "path string"))
    before = [rows_of(s, t) for t in ("notes", "chunks", "links")], found(s, "red cat part")
    s.compact()
    assert ([rows_of(s, t) for t in ("notes", "chunks", "links")], found(s, "red cat part")) == before
    assert s._segments("chunks", 99).select("seg").distinct().count() == 1
    s.apply(7, frame(spark, [note(r, "z.md")]), frame(spark, []))
    assert "z.md" in {x["path"] for x in s.table("notes").collect()}


def test_null_and_empty_notes(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/e")
    assert s.search("red").collect() == [] and s.table("notes").collect() == []
    s.apply(0, frame(spark, [("a.md", None, None, None), ("b.md", "", [], ""), ("c.md", "C", None, "red " * 5000)]), frame(spark, []))
    assert {r["path"] for r in s.table("notes").collect()} == {"a.md", "b.md", "c.md"}
    assert {p for p, _, _ in found(s, "red")} == {"c.md"}


def test_stream_runs(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    schema = SCHEMA + ", deleted boolean, seq long"
    steps = [
        [("a.md", "A", [], "red", False, 1), ("b.md", "B", [], "cat", False, 2), ("a.md", "A", [], "blue", False, 3)],
        [("b.md", "B", [], "cat dog", False, 4)],
        [("a.md", None, None, None, True, 5), ("c.md", "C", [], "red", True, 6), ("c.md", "C", [], "tree", False, 7)],
    ]
    sizes = []
    for k, rows in enumerate([*steps, []]):
        df = spark.createDataFrame(rows, schema)
        if rows:
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_index(spark, f"{tmp_path}/in", df.schema, s, f"{tmp_path}/check")
        sizes.append(len(s.versions()))
    assert sizes == [1, 2, 3, 3]
    assert {r["path"] for r in s.table("notes").collect()} == {"b.md", "c.md"}
    assert [p for p, _, _ in found(s, "dog")] == ["b.md"] and found(s, "red") == [] and found(s, "blue") == []


def test_no_posting_is_a_row_in_a_shuffle(spark, tmp_path):
    """Postings hold chunk numbers in blocks that the reading tasks make; a block is a run of one term of at most BLOCK."""
    s = Store(spark, f"file://{tmp_path}/b")
    s.apply(0, frame(spark, [(f"n{i}.md", "A", [], f"red word{i % 7} red") for i in range(1500)]), frame(spark, []))
    s.apply(1, frame(spark, []), spark.createDataFrame([(f"n{i}.md",) for i in range(0, 1500, 3)], "path string"))
    blocks = s.blocks(["red"]).collect()
    assert sum(len(b["ids"]) for b in blocks) == 1500 and max(len(b["ids"]) for b in blocks) <= ST.BLOCK
    assert {f for b in blocks for f in b["tfs"]} == {2.0} and len(blocks) < 100
    # one bit for each chunk that went, 64 a row
    dead = s._segments("dead", 99).collect()
    assert sum(bin(r["bits"] & (1 << 64) - 1).count("1") for r in dead) == 500 and len(dead) <= 1500 / 64 + 8
    assert len(found(s, "red")) == 1000 and s.table("chunks").count() == 1000
    assert {r["t"]: r["n"] for r in s._segments("frequencies", 99).groupBy("t").agg({"delta": "sum"}).toDF("t", "n").collect()}["red"] == 1000


def test_blocks_count_columns_with_their_weights_and_are_flushed(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ST, "HELD", 5)
    rows = pa.RecordBatch.from_pydict({"id": [1, 2, 9], "len": [4, 3, 1], "title": ["a b", "a", ""], "heading": ["b", "", ""], "body": ["c", "a c", "c"]})
    got = sorted((r["t"], i, tf) for b in ST._blocks(iter([rows])) for r in b.to_pylist() for i, tf in zip(r["ids"], r["tfs"]))
    assert got == [("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 3.5), ("c", 1, 1.0), ("c", 2, 1.0), ("c", 9, 1.0)]


def test_terms_are_counted_as_they_are_split(spark):
    from pyspark.sql import functions as F

    from vellum.functions import text as X

    texts = ["", "  ", "Ärger, élan x2!", "\u0130stanbul \u00df \u00c9", "a_b-c..d", "\u6f22\u5b57 9\u00b2", "-x"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(F.size(X.terms(F.col("x"))).alias("a"), X.count_terms(F.col("x")).alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())


def test_a_stream_batch_reads_its_texts_once(spark, tmp_path, monkeypatch):
    """The notes of a batch are one plan that runs once; of equal numbers the result is fixed, and a removal wins."""
    from pyspark.sql import functions as F

    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        reads.add(1)
        return x

    kept = Store.apply
    monkeypatch.setattr(Store, "apply", lambda self, number, fresh, gone, **k: kept(self, number, fresh.withColumn("body", counted("body")).withColumn("path", F.concat("path", F.substring("body", 1, 0))), gone, **k))
    s = Store(spark, f"file://{tmp_path}/o")
    rows = [("a.md", "A", [], "red", False, 1), ("b.md", "B", [], "cat", False, 2), ("b.md", None, None, None, True, 2), ("c.md", "C", [], "dog", False, 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", deleted boolean, seq long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    run_index(spark, f"{tmp_path}/in", df.schema, s, f"{tmp_path}/check")
    assert {r["path"] for r in s.table("notes").collect()} == {"a.md", "c.md"}
    assert reads.value == 2
