"""Globs against matching every pair, and snapshot changes against plain pairing."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest

from vellum.operators import globs, snapshots


def fits(pattern: str, path: str) -> bool:
    one = lambda g: re.sub(r"\\\*", "[^/]*", re.sub(r"\\\?", "[^/]", re.escape(g))).replace("\\[", "[").replace("\\]", "]").replace("\\-", "-")
    a, b = pattern.split("/"), path.split("/")
    return len(a) == len(b) and all(re.fullmatch(one(x), y) for x, y in zip(a, b))


def test_walk_equals_all_pairs(spark):
    r = random.Random(6)
    seg = ["a", "b", "ab", "b1.md", "c2.py", "x.y"]
    paths = sorted({"/".join(r.choice(seg) for _ in range(r.randint(1, 4))) for _ in range(200)})
    parts = ["*", "a", "?", "b*", "*.md", "[a-c]*", "x.y", "ab", "c?.py"]
    patterns = sorted({"/".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(120)}) + [""]
    got = globs.matches(spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(p,) for p in paths + paths[:9]], "file string")).collect()
    want = {(p, f) for p in patterns if p for f in paths if fits(p, f)}
    assert len(want) > 100 and sorted((x["pattern"], x["file"]) for x in got) == sorted(want)


def test_local_matches_come_first(spark):
    docs = spark.createDataFrame([("d1", ["src/*.go", "lib/a.py", ""]), ("d2", ["lib/*.py", "none/*"]), ("d3", [])], "path string, governs array<string>")
    local, source = (spark.createDataFrame([(f,) for f in x], "file string") for x in (["src/a.go", "src/x/b.go"], ["src/z.go", "lib/a.py", "lib/b.py"]))
    got = {tuple(x) for x in globs.governed(docs, local, source).collect()}
    assert got == {("d1", "src/*.go", "src/a.go", "local"), ("d1", "lib/a.py", "lib/a.py", "source"), ("d2", "lib/*.py", "lib/a.py", "source"), ("d2", "lib/*.py", "lib/b.py", "source")}
    assert globs.governed(docs.limit(0), local, source).count() == 0 and globs.governed(docs, local.limit(0)).count() == 0


def sketch(body: str) -> set:
    return set(sorted({hashlib.md5(s.strip(" ").encode()).hexdigest() for s in body.split("\n") if s.strip(" ")})[: snapshots.LINES])


@pytest.mark.parametrize("seed", [1, 2])
def test_changes(spark, seed):
    r = random.Random(seed)
    line = lambda: r.choice(["common line", "  ", "another", f"rare {r.randint(0, 10**6)}", f"some {r.randint(0, 40)}"])
    bodies = ["\n".join(line() for _ in range(r.randint(1, 12))) for _ in range(60)] + ["", "same"]
    old = {f"{r.choice('abc')}/{i}.md": b for i, b in enumerate(bodies)} | {f"a/same{i}.md": "same" for i in range(7)}
    new = {}
    for p, b in old.items():
        kind = r.randrange(6)
        if kind == 0:
            continue
        q = p if kind in (1, 2) else f"z/{p.split('/')[1]}" if kind == 3 else f"y/n{p.split('/')[1]}"
        new[q] = b + "\nedit" if kind in (2, 5) else b
        if r.random() < 0.15:
            new["copy/" + q.replace("/", "-")] = b
    new |= {"fresh.md": "nothing like it\nat all"}
    frame = lambda d: spark.createDataFrame([*d.items()], "path string, body string").repartition(3)
    got = [tuple(x) for x in snapshots.changes(frame(old), frame(new)).collect()]
    kinds = collections.Counter(x[0] for x in got)
    assert kinds["M"] == sum(p in old and old[p] != b for p, b in new.items())
    gone, fresh = set(old) - set(new), set(new) - set(old)
    renamed = [(o, p, s) for k, p, o, s in got if k == "R"]
    assert len({o for o, _, _ in renamed}) == len(renamed) == len({p for _, p, _ in renamed})
    # as many exact renames as each content allows, base names first
    for b in set(old.values()):
        g, f = {p for p in gone if old[p] == b}, {p for p in fresh if new[p] == b}
        exact = [(o, p) for o, p, s in renamed if s == 1.0 and o in g and p in f]
        assert len(exact) == min(len(g), len(f))
        kept = sum(o.split("/")[-1] == p.split("/")[-1] for o, p in exact)
        assert kept == sum((collections.Counter(x.split("/")[-1] for x in g) & collections.Counter(x.split("/")[-1] for x in f)).values())
    exact_old, exact_new = {o for o, _, s in renamed if old[o] == new[_]}, {p for o, p, s in renamed if old[o] == new[p]}
    copies = {p for p in fresh - exact_new if new[p] in old.values()}
    assert {(p, o) for k, p, o, _ in got if k == "C"} == {(p, min(q for q, b in old.items() if b == new[p])) for p in copies}
    left, rest = gone - exact_old, fresh - exact_new - copies
    share = lambda x, y: len(x & y) / max(len(x), len(y), 1)
    pairs = sorted(((-share(sketch(old[o]), sketch(new[p])), o, p) for o in left for p in rest if share(sketch(old[o]), sketch(new[p])) >= 0.5))
    want = []
    for s, o, p in pairs:
        if o in left and p in rest:
            want.append((o, p, -s))
            left, rest = left - {o}, rest - {p}
    assert sorted(x for x in renamed if old[x[0]] != new[x[1]]) == sorted(want)
    assert {p for k, p, *_ in got if k == "D"} == left and {p for k, p, *_ in got if k == "A"} == rest


def test_empty_and_null_snapshots(spark):
    none = spark.createDataFrame([], "path string, body string")
    some = spark.createDataFrame([("a", None), ("b", "x")], "path string, body string")
    assert {(x["status"], x["path"]) for x in snapshots.changes(none, some).collect()} == {("A", "a"), ("A", "b")}
    assert {(x["status"], x["path"]) for x in snapshots.changes(some, none).collect()} == {("D", "a"), ("D", "b")}
    assert snapshots.changes(some, some).collect() == []


def test_only_equal_ends_meet_the_regular_expression(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(globs.X, "glob_pattern", lambda c: F.lit(".*"))
    n = 60
    patterns = spark.createDataFrame([(p,) for i in range(n) for p in (f"a/{i}.*", f"a/x?{i}.py")], "pattern string")
    files = spark.createDataFrame([(f,) for i in range(n) for f in (f"a/{i}.md", f"a/x-{i:02}.py")], "file string")
    got = {tuple(x) for x in globs.matches(patterns, files).collect()}
    assert {(f"a/{i}.*", f"a/{i}.md") for i in range(n)} <= got and len(got) < 4 * n


def test_a_chain_of_similar_pairs_takes_few_rounds(spark, monkeypatch):
    """Each pair waits for the one before it; rounds alone would take one for each link, and give the same pairs."""
    from vellum.operators import snapshots as SN

    chain = [x for i in range(7) for x in ((f"o{i}", f"n{i}", 0.99 - i / 50), (f"o{i + 1}", f"n{i}", 0.98 - i / 50))]
    pairs = spark.createDataFrame([*chain, ("p", "q", 0.7), ("p", "r", 0.7), ("P", "q", 0.7)], "old_path string, path string, share double")
    made, kept = [], SN.written
    monkeypatch.setattr(SN, "written", lambda df, name: made.append(name) or kept(df, name))
    got = sorted(map(tuple, SN.matched(pairs).collect()))
    assert len(made) <= 3
    assert [x[:2] for x in got] == [("P", "q"), *[(f"o{i}", f"n{i}") for i in range(7)], ("p", "r")]
    monkeypatch.setattr(SN, "FEW", 0)
    assert sorted(map(tuple, SN.matched(pairs).collect())) == got


def test_snapshots_keep_no_bodies(spark, monkeypatch):
    from vellum.operators import snapshots as SN

    made, kept = [], SN.written
    monkeypatch.setattr(SN, "written", lambda df, name: made.append(df.columns) or kept(df, name))
    old = spark.createDataFrame([("a", "x\ny"), ("b", "1\n2\n3"), ("c", None)], "path string, body string")
    new = spark.createDataFrame([("a", "x\nz"), ("d", "1\n2\n3\n4"), ("e", "")], "path string, body string")
    got = sorted((r["status"], r["path"], r["old_path"], r["share"]) for r in SN.changes(old, new).collect())
    assert got == [("M", "a", None, None), ("R", "d", "b", 0.75), ("R", "e", "c", 1.0)]
    assert made and not any("body" in columns for columns in made)


def test_a_group_of_equal_pairs_takes_no_round_for_each_member(spark, monkeypatch):
    made, kept = [], snapshots.written
    monkeypatch.setattr(snapshots, "written", lambda df, name: made.append(name) or kept(df, name))
    monkeypatch.setattr(snapshots, "FEW", 0)
    rows = [(f"o{i:02}", f"n{j:02}", 0.75) for i in range(12) for j in range(12)] + [("o03", "x", 0.8), ("y", "n05", 0.9), ("y", "x", 0.7)]
    random.Random(2).shuffle(rows)
    got = sorted(map(tuple, snapshots.matched(spark.createDataFrame(rows, "old_path string, path string, share double").repartition(5)).collect()))
    old, new, want = set(), set(), []
    for a, b, share in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if a not in old and b not in new:
            old.add(a)
            new.add(b)
            want.append((a, b, share))
    assert got == sorted(want) and made.count("won") <= 2
