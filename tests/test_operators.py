"""Fixtures with known results, invariants, and determinism under repartitioning."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vellum.engine import Engine
from vellum.functions import markup
from vellum.functions import text as X
from vellum.operators import bundle, chunks, embed, federation, graph, incremental, links, lint, records, registry, reports, search, temporal
from vellum.operators.memory import Memory
from vellum.operators.records import Field, Predicate, ValidationError
from vellum.sources import config


def test_rrf(spark):
    lists = [spark.createDataFrame([(k, i + 1) for i, k in enumerate(x)], "k string, rank int") for x in ("abc", "bda")]
    s = {r["k"]: r["score"] for r in search.rrf(lists, ["k"], 60).collect()}
    assert max(s, key=s.get) == "b" and s["a"] > s["c"]
    assert s == {r["k"]: r["score"] for r in search.rrf(lists, ["k"], 0).collect()}


def test_query_terms():
    assert X.query_terms("hello, world!") == ["hello", "world"] and X.query_terms("  !!! ??? ") == []


def test_window_counts(spark):
    rows = [(str(n), "é" * n) for n in (3200, 3201, 5920, 5921)]
    n = spark.createDataFrame(rows, "path string, body string").select("path", F.lit("t").alias("title"), F.lit("").alias("heading"), F.lit(0).alias("ord"), "body")
    got = {r["path"]: r["count"] for r in chunks.windows(n).groupBy("path").count().collect()}
    assert got == {"3200": 1, "3201": 2, "5920": 2, "5921": 3}


def test_sections(spark):
    n = spark.createDataFrame([("p", "T", "intro\n## Section A\ntext a\n## Section B\ntext b"), ("e", "Empty", " \n ")], "path string, title string, body string")
    got = [(r["path"], r["ord"], r["heading"], r["body"]) for r in chunks.sections(n).orderBy("path", "ord").collect()]
    assert got == [("e", 0, "", "Empty"), ("p", 0, "", "intro"), ("p", 1, "Section A", "text a"), ("p", 2, "Section B", "text b")]


@pytest.mark.parametrize("step", [temporal.STEP, 4])
def test_drift_and_staleness(spark, monkeypatch, step):
    """Against counts by hand, also where a file's commits fall into many steps, with repeated commits and bindings."""
    monkeypatch.setattr(temporal, "STEP", step)
    r = random.Random(2)
    docs = [(f"d{r.randrange(8)}", r.randrange(60)) for _ in range(25)]
    files = [(f"f{r.randrange(5)}", r.randrange(60)) for _ in range(150)]
    bind = [(f"d{r.randrange(9)}", f"f{r.randrange(6)}") for _ in range(30)]
    status = {f"d{i}": "Implemented" if i % 2 else "Draft" for i in range(9)}
    last = {d: max(s for x, s in docs if x == d) for d, _ in docs}
    after = lambda d, fs: len({s for f, s in files if f in fs and s > last[d]})
    drifted = {(d, f, after(d, {f})) for d, f in bind if d in last and after(d, {f})}
    sets = {d: {f for x, f in bind if x == d} for d, _ in bind if d in last}
    stale = {(d, after(d, fs)) for d, fs in sets.items() if status[d] == "Implemented" and after(d, fs)}
    feed = lambda x: spark.createDataFrame(x, "path string, seq long")
    b = spark.createDataFrame(bind, "doc string, file string")
    assert {tuple(x) for x in temporal.drift(feed(docs), b, feed(files)).collect()} == drifted
    assert {tuple(x) for x in temporal.stale(feed(docs), b, feed(files), spark.createDataFrame(list(status.items()), "doc string, status string")).collect()} == stale


def test_pagerank_mass_and_hub(spark):
    nodes = spark.createDataFrame([(k,) for k in ("hub", "a", "b", "c", "alone")], "key string")
    edges = spark.createDataFrame([("hub", "a"), ("a", "hub"), ("b", "hub"), ("c", "hub"), ("b", "missing")], "src string, dst string")
    s = {r["key"]: r["score"] for r in graph.pagerank(nodes, edges).collect()}
    assert max(s, key=s.get) == "hub" and abs(sum(s.values()) - 1) < 1e-9
    seeded = {r["key"]: r["score"] for r in graph.pagerank(nodes, edges, spark.createDataFrame([("a",)], "key string")).collect()}
    assert seeded["a"] > s["a"] and seeded["alone"] == 0 and abs(sum(seeded.values()) - 1) < 1e-9


def test_links(spark):
    n = spark.createDataFrame([("d/home.md", "[[Foo Bar]] [[notes/Baz|alias]] [[Qux#part]] [[Foo Bar]] ![i](x.md) [t](../a%20b.md) [u](https://x.md) [v](f.png)")], "path string, body string")
    assert {r["target"] for r in links.edges(n).collect()} == {"foo bar", "baz", "qux", "../a b"}


def test_records_errors():
    j = F.lit("{}")
    with pytest.raises(ValidationError):
        records.predicate(j, Predicate("a", "regex", "x"))
    with pytest.raises(ValidationError):
        records.predicate(j, Predicate("", "eq", "x"))
    with pytest.raises(ValidationError):
        Predicate.parse("a:b")
    assert Predicate.parse("a:eq:b:c") == Predicate("a", "eq", "b:c")


def test_records_pages(spark):
    n = spark.createDataFrame([(f"jobs/{k}.md", f'{{"score":{i}}}') for i, k in enumerate("dcba")], "path string, frontmatter string").repartition(4)
    assert [r["path"] for r in records.list_records(n, "jobs", [], "", 2, 1).collect()] == ["jobs/b.md", "jobs/c.md"]
    assert [r["path"] for r in records.list_records(n, "", [Predicate("score", "gte", "1")], "-score", 2).collect()] == ["jobs/a.md", "jobs/b.md"]


def test_validation(spark):
    n = spark.createDataFrame([("a", '{"d":"2024-02-30","t":["x"],"n":"7"}'), ("b", '{"d":"2024-02-29","t":"x","n":7,"e":"no"}')], "path string, frontmatter string")
    schema = [Field("d", "date"), Field("t", "tags"), Field("n", "number"), Field("e", "enum", True, ("yes",))]
    assert {(r["path"], r["field"]) for r in records.validate(n, schema).collect()} == {("a", "d"), ("a", "n"), ("a", "e"), ("b", "e")}


def test_cursors_are_independent(spark, tmp_path):
    c = incremental.Cursors(spark, f"file://{tmp_path}/meta")
    assert c.get("digest") is None
    c.set("digest", 5)
    c.set("contradictions", 2)
    c.set("digest", 9)
    assert (c.get("digest"), c.get("contradictions")) == (9, 2)


def test_memory_verbs(tmp_path):
    m = Memory(str(tmp_path))
    m.create("a/b.md", "one\ntwo")
    m.append("a/b.md", "three")
    m.insert("a/b.md", 1, "and")
    m.str_replace("a/b.md", "two", "2")
    assert m.view("a/b.md") == "one\nand\n2\nthree" and m.view("a") == "b.md"
    m.rename("a/b.md", "c.md")
    for bad in (lambda: m.view("../x"), lambda: m.str_replace("c.md", "zzz", ""), lambda: m.insert("c.md", 99, "x"), lambda: m.rename("c.md", "c.md")):
        with pytest.raises(ValidationError):
            bad()
    m.delete("c.md")
    assert not (tmp_path / "c.md").exists()


def test_routing_ladder():
    m = [federation.Mount("Alpha", None, "red things"), federation.Mount("Beta", None, "blue things", (), (1.0, 0.0)), federation.Mount("Bare", None)]
    assert federation.route(m[:1], "x").mode == "all"
    assert federation.route(m, "x", ["alpha"]).search == ["Alpha"]
    assert federation.route(m, "x", ["alpha", "BETA", "bare"]).mode == "fallback"
    with pytest.raises(ValidationError):
        federation.route(m, "x", ["nope"])
    assert federation.route(m, "ask alpha now").search == ["Alpha", "Bare"]
    assert federation.route(m, "red one").search == ["Alpha", "Bare"]
    assert federation.route(m, "x", (), (0.0, 1.0)).search == ["Alpha", "Bare"]
    assert federation.route([federation.Mount("A", None), federation.Mount("B", None)], "x").mode == "all"


def test_failing_mount_is_named(spark):
    def down(q, n):
        raise OSError("down")

    found, meta = federation.query(spark.createDataFrame([(1, "t", "r", "s")], federation.HIT), [federation.Mount("A", down), federation.Mount("B", down)], "x", 5)
    assert found.count() == 1 and len(meta["failed"]) == 2
    with pytest.raises(ValidationError):
        federation.query(None, [], "x", 0)


def test_packing_stops_at_the_first_overflow(spark):
    lines = spark.createDataFrame([(1, "x" * 400), (2, "y" * 4000), (3, "z")], "rank int, line string")
    assert [r["rank"] for r in bundle.packed(lines, 1000).collect()] == [1]
    assert "No related notes" in bundle.markdown("t", [], "", 10)


def test_fingerprint_outlives_numbers(spark):
    rows = spark.createDataFrame([("k", "p", "line 12  is bad"), ("k", "p", "line 7 is bad"), ("k", "q", "line 7 is bad")], "k string, p string, d string")
    f = [r[0] for r in rows.select(X.fingerprint(F.col("k"), F.col("p"), F.col("d"))).collect()]
    assert f[0] == f[1] != f[2]


def test_cron_fields(spark):
    with pytest.raises(ValueError):
        registry.cron_due(F.lit(None), "61 * * * *")


def test_engine(spark, tmp_path):
    files = {
        "Home.md": "---\ntitle: Home\n---\nSee [[Install]] and [[gone]].\n", "Install.rst": "Install\n=======\n\n[[Nothing]] here about pods\n", "notes/pods.md": "# Pods\n\nkubernetes pods run. `[[gone]]`\n",
        "notes/alone.md": "# Alone\nquiet\n", ".git/x.md": "no", "bad.md": "---\n: [x\n---\n[[Home]]\n", ".collections/jobs/config.toml": 'path = "jobs"\n[[fields]]\nname = "status"\ntype = "enum"\nrequired = true\nenum = ["open", "closed"]\n',
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    e = Engine(spark, str(tmp_path))
    assert {r["path"] for r in e.notes().collect()} == {"Home.md", "Install.rst", "notes/pods.md", "notes/alone.md", "bad.md"}
    hits, meta = e.query("kubernetes pods", 5)
    assert meta["mode"] == "fts-only" and hits.first()["path"] == "notes/pods.md"
    kinds = {(r["kind"], r["path"]) for r in e.check().collect()}
    assert {("broken-link", "Home.md"), ("bad-frontmatter", "bad.md"), ("orphan", "notes/alone.md")} <= kinds
    path = e.create_record("jobs", "Acme Inc", {"status": "open", "score": 8})
    assert e.create_record("jobs", "Acme Inc", {"status": "closed"}) == "jobs/acme-inc-2.md"
    e.patch_record(path, {"score": 3, "status": None, "extra": "x"})
    assert [r["path"] for r in e.records("jobs", ["score:eq:3"]).collect()] == [path]
    with pytest.raises(ValidationError):
        e.create_record("jobs", "Bad", {"status": "nope"})
    with pytest.raises(ValidationError):
        e.delete_record("../outside.md")
    e.delete_record(path)
    assert e.records("jobs").count() == 1
    assert e.changes(e.notes().select("path", "content_hash")).where("status <> 'unchanged'").count() == 0


def test_ranking_is_deterministic(spark, sf):
    from vellum.plans import catalog

    one = [tuple(r) for r in catalog.QUERIES["fts_bm25"](spark, sf).collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert [tuple(r) for r in catalog.QUERIES["fts_bm25"](spark, sf).collect()] == one
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_inline_tags_of_the_whole_text(spark, tmp_path):
    from vellum.plans import catalog

    rows = [(1, "word " * 100 + "#late/tag more #late/tag\n#last", "en", "web"), (2, "plain " * 90, "de", "web"), (3, "#first " + "x" * 300 + "#no", "fr", "book"), (4, None, "es", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["tags"] for r in catalog.QUERIES["inline_tags"](spark, str(tmp_path)).collect()}
    assert got == {1: "en,late/tag,last,web/x", 2: "de,web/x", 3: "fr,first,book/x", 4: None}


def test_anchors_of_the_whole_text(spark, tmp_path):
    from vellum.plans import catalog

    rows = [(1, 0, "plain words " * 9 + "and we decided on it"), (1, 2, "word " * 40), (2, 3, "some more words\nof talk that are no longer true"), (2, 4, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in catalog.QUERIES["anchors_classify"](spark, str(tmp_path)).collect()}
    assert got == {("talk/1-0.md", 1, "decided", False), ("talk/1-2.md", 1, "no longer", True), ("talk/2-3.md", 1, "no longer", True)}


def test_graph_report_and_export(spark):
    nodes = spark.createDataFrame([(k,) for k in ("hub", "a", "b", "alone")], "key string")
    resolved = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("b", None)], "src string, dst string")
    scores = graph.pagerank(nodes, resolved.where("dst is not null"))
    got = lint.graph_report(nodes, resolved, nodes.where("key = 'alone'"), scores, 2).collect()
    assert [x.asDict() for x in got] == [{"notes": 4, "links": 2, "broken": 1, "orphans": 1, "top": "hub,a"}]
    lines = {x["json"] for x in lint.graph_json(nodes, resolved.where("dst is not null")).collect()}
    assert '{"key":"hub"}' in lines and '{"src":"a","dst":"hub"}' in lines and len(lines) == 6
    docs = spark.createDataFrame([("note", "c"), ("adr", "b"), ("spec", "a"), (None, "d"), ("adr", "a")], "type string, path string")
    assert [tuple(x) for x in lint.by_type(docs, ["adr", "spec"]).collect()] == [("adr", "a"), ("adr", "b"), ("spec", "a"), ("note", "c"), (None, "d")]
    assert [x["path"] for x in lint.merged_paths(docs, spark.createDataFrame([("e",)], "path string")).collect()] == list("abcde")
    words = spark.createDataFrame([("0123456789abc", 1, "", "p", ["x", "y"])], "sha string, n int, title string, path string, prov array<string>")
    row = words.select(lint.short_sha(F.col("sha")), lint.commits(F.col("n")), lint.title_or(F.col("title"), F.col("path")), lint.tag(F.col("prov"))).first()
    assert tuple(row) == ("0123456789", "1 commit", "p", " [x, y]")


def test_embedders_and_reuse(spark):
    e = embed.hashing(8)
    assert e.available() and not embed.Embedder("bad", lambda t: 1 / 0).available()
    chunks = spark.createDataFrame([("h1", "one two"), ("h2", "three"), ("h2", "three"), ("h3", None)], "chunk_hash string, text string")
    stored = spark.createDataFrame([("h1", e.model, [1.0]), ("h2", "other", [2.0])], "chunk_hash string, model string, vec array<double>")
    got = {r["chunk_hash"]: r["vec"] for r in embed.refreshed(chunks, stored, e).collect()}
    assert got == {"h1": [1.0], "h2": e.call(["three"])[0], "h3": [0.0] * 8}
    cache: dict = {}
    first = embed.description_vectors(["a b", "", "a b", "c"], cache, e)
    assert set(first) == {"a b", "c"} and len(cache) == 2
    assert embed.description_vectors(["a b"], cache, embed.Embedder(e.model, lambda t: 1 / 0)) == {"a b": first["a b"]}


def test_reranker_choice():
    def score(url, query, documents):
        if url == "down":
            raise OSError("down")
        return {"odd": [None, 1.0], "none": []}.get(url, [0.1, 0.2])

    assert embed.choose(" http://x ", ["y"], score) == ("http://x", "configured", "")
    assert embed.choose("OFF", ["y"], score) == ("", "off", "disabled")
    assert embed.choose("", ["down", "odd", "none", "good", "y"], score) == ("good", "discovered", "")
    assert embed.choose("", ["down"], score) == ("", "off", "no runtime")


def test_nearest_of_each_in_blocks(spark, monkeypatch):
    import random

    from vellum.operators import vectors

    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(120)] + [(200, None), (None, [1.0, 1.0, 1.0]), (201, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    facts = v.where("id % 5 = 0 or id is null")
    known = {i: x for i, x in rows if i is not None and x is not None}
    unit = {i: [a / max(sum(b * b for b in x) ** 0.5, 1e-300) for a in x] for i, x in known.items()}
    for block in (7, 1000):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = {r["fact"]: (r["note"], round(r["score"], 9)) for r in embed.nearest_each(facts, v, "id", "v").collect()}
        want = {f: max(((round(sum(a * b for a, b in zip(unit[f], unit[i])), 9), -i) for i in known if i != f)) for f in known if f % 5 == 0}
        assert {f: s for f, (_, s) in got.items()} == {f: s for f, (s, _) in want.items()}
    assert embed.nearest_each(facts.limit(0), v, "id", "v").count() == 0


def test_a_scorer_that_fails_while_it_runs_changes_nothing(spark):
    hits = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "path string, score double")
    assert search.rerank(hits, lambda h: h.select("path", F.raise_error(F.lit("down")).cast("double").alias("rerank_score"))).collect() == hits.collect()


def test_sections_of_a_long_note(spark):
    body = "before\n" + "\n".join(f"## H{i}\ntext {i}\n\n" for i in range(2000)) + "# empty\n#none\n###### \n"
    n = spark.createDataFrame([("a", "A", body), ("b", "B", ""), ("c", "C", "# only"), ("d", "D", None)], "path string, title string, body string")
    got = {(r["path"], r["ord"]): (r["heading"], r["body"]) for r in chunks.sections(n).collect()}
    assert got[("a", 0)] == ("", "before") and got[("a", 5)] == ("H4", "text 4") and got[("a", 2001)] == ("empty", "#none\n######")
    assert got[("b", 0)] == ("", "B") and got[("c", 0)] == ("", "C") and len([k for k in got if k[0] == "a"]) == 2002


def test_markup_edges(spark):
    rows = [
        ("a.adoc", "// c\n== Sub\n= Doc _T_ \n:toc: x\n:a b: keep\n====\n*b* `c` _em_ x_y_z (_q_).\n--\n|===\n|=x\n***", "Doc _T_", "Sub\nDoc T \n:a b: keep\nb c em x_y_z (q).\n|=x"),
        ("b.rst", "=====\nTi tle\n======\n.. note:: x\n  ..\n..nope\n`t <u>`_ :ref:`x` *e*\n---\n", "Ti tle", "Ti tle\n..nope\nt x e"),
        ("b2.rst", "longer title\n===", "b2", "longer title"),
        ("c.textile", 'p. para\nh2. Head _x_\nbq. q "l":http://x.y z\n*b* @c@ v1. x\nh1.no', "Head _x_", "para\nHead x\nq l z\nb c v1. x\nh1.no"),
        ("d.org", "* H one\n#+TITLE:  My T\n  :PROPERTIES:\n** Sub /it/ a/b =v= [[u][d]] [[w]] ~c~\n:9a: keep\n**bold** t", "My T", "H one\nSub it a/b v d w c\n:9a: keep\nbold t"),
        ("e.org", "x\r\n** Deep\r\nz", "Deep", "x\r\nDeep\r\nz"),
        ("f.wiki", "= x =", "f", "= x ="),
        ("g.rst", "", "g", ""),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "path string, content string")
    title, body = markup.plain(F.col("path"), F.col("content"))
    got = {r[0]: (r[1], r[2]) for r in df.select("path", title, body).collect()}
    assert got == {r[0]: r[2:] for r in rows}


def test_files_of_configuration(tmp_path):
    root = str(tmp_path / "c")
    c = config.Collection("tasks", "work/tasks", 'a "b"', [Field("state", "enum", True, ("open", "done")), Field("due", "date")])
    config.save_collection(root, c)
    assert config.collections(root) == [c]
    for bad in ("../x", "", "a/b"):
        with pytest.raises(ValidationError):
            config.save_collection(root, config.Collection(bad, "p"))
    config.remove_collection(root, "tasks")
    assert config.collections(root) == []
    with pytest.raises(ValidationError):
        config.remove_collection(root, "tasks")
    for name, text in {"a": '[run]\nkind = "exec"\nexec = "ls"\n[trigger]\nschedule = "* * * * *"\n', "b": '[run]\nkind = "agent"\n', "c": "not toml"}.items():
        (tmp_path / "jobs" / name).mkdir(parents=True)
        (tmp_path / "jobs" / name / "config.toml").write_text(text)
    good, bad = config.jobs(str(tmp_path / "jobs"))
    assert [j.name for j in good] == ["a"] and [b[0] for b in bad] == ["b", "c"]
    (tmp_path / "m" / "x").mkdir(parents=True)
    (tmp_path / "m" / "x" / "config.toml").write_text('command = "run"\nkeywords = ["k"]\n')
    assert config.mounts(str(tmp_path / "m")) == [config.MountFile("x", "run", keywords=["k"])] and config.mounts(str(tmp_path / "none")) == []
    (tmp_path / "s.toml").write_text('source_root = "../src"\nagents_dir = " "\n[directory_indexes]\nenabled = true\n')
    s = config.settings(str(tmp_path / "s.toml"))
    assert s["source_root"] == "../src" and s["agents_dir"] == "docs/agents" and s["directory_indexes"] == {"filename": "INDEX.md", "mode": "managed-block", "enabled": True}


def test_memory_dispatch_and_reports(spark, tmp_path):
    import datetime

    m, seen = Memory(str(tmp_path)), []
    assert m.run("create", seen.append, path="a.md", text="x") == "created a.md" and m.run("view", path="a.md") == "x"
    assert m.run("rename", seen.append, path="a.md", to="b.md") == "renamed a.md -> b.md" and seen == ["a.md", "a.md", "b.md"]
    with pytest.raises(ValidationError):
        m.run("chmod", path="b.md")
    at = datetime.datetime(2024, 3, 5, 7, 9)
    path, text = reports.new_doc("adr", ' Use "it" ', "use-it", 12, at, governs=["a/*.py"])
    assert path == "docs/adr/0012-use-it.md" and 'status: "Proposed"\ncreated: "2024-03-05"' in text and 'governs: ["a/*.py"]\n---\n\n# Use "it"\n' in text
    assert reports.new_doc("spec", "T", "t", 0, at)[0] == "docs/specs/2024-03-05-0709-t.md"
    with pytest.raises(ValidationError):
        reports.new_doc("memo", "T", "t", 0, at)
    stale = spark.createDataFrame([("spec", "T", "Implemented", "d.md", 3, ["a", "b"])], "type string, title string, status string, doc string, commits long, matched array<string>")
    page = reports.report("Stale Docs", ["Type", "Title"], reports.stale_rows(stale), "No stale docs found.")
    assert page == "# Stale Docs\n\n| Type | Title |\n|---|---|\n| spec | T | Implemented | `d.md` | 3 | `a, b` |\n"
    assert reports.report("Stale Docs", [], reports.stale_rows(stale.limit(0)), "No stale docs found.") == "# Stale Docs\n\nNo stale docs found.\n"
