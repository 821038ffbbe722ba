"""Queries over bundles, checks, registry, assets, schedules, parsing and streams (milestones 7 and 8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import bundle as BU
from vellum.operators import checks as CH
from vellum.operators import graph as G
from vellum.operators import registry as RG
from vellum.operators import search as S
from vellum.operators.search import top
from vellum.sources import parse as P
from vellum.sources import tables as T
from vellum.streaming import ingest

from . import structure
from .base import ENTITIES, NOTES, bm25, query

TASK = "nation_3 nation_11 region"
TASK_WORDS = ["nation", "3", "nation", "11", "region"]
HITS = bm25("entities", {"title": 2.0, "body": 1.0}, TASK_WORDS, "path")
SEED_SQL = "CASE WHEN k.path IN (SELECT path FROM hits WHERE r <= 5) THEN 1.0 / (SELECT count(*) FROM hits WHERE r <= 5) ELSE 0 END::DOUBLE"
BUNDLE = rf"""WITH RECURSIVE {structure.RESOLVED}, hits AS (SELECT path, row_number() OVER (ORDER BY round(score, 9) DESC, path) AS r FROM {HITS} QUALIFY r <= 20),
 e AS (SELECT regexp_replace(path, '\.md$', '') AS src, dst FROM resolved WHERE dst IS NOT NULL), both_ AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), deg AS (SELECT src, count(*) AS deg FROM both_ GROUP BY 1),
 base AS (SELECT key, path, {SEED_SQL} AS r, coalesce(deg, 0) AS deg FROM keys k LEFT JOIN deg ON key = src),
 pr(i, key, p) AS (SELECT 0, key, r FROM base UNION ALL SELECT * FROM (WITH cur AS (SELECT * FROM pr), got AS (SELECT b.dst AS key, sum(c.p / d.deg) AS g FROM cur c JOIN both_ b ON b.src = c.key JOIN deg d ON d.src = c.key GROUP BY 1),
 loose AS (SELECT coalesce(sum(c.p), 0) AS d FROM cur c JOIN base ON base.key = c.key WHERE base.deg = 0)
 SELECT (SELECT max(i) FROM cur) + 1, base.key, 0.85 * coalesce(g, 0) + (0.15 + 0.85 * (SELECT d FROM loose)) * base.r FROM base LEFT JOIN got ON got.key = base.key WHERE (SELECT max(i) FROM cur) < 30)),
 ranks AS (SELECT base.path, row_number() OVER (ORDER BY round(p, 9) DESC, base.path) AS rk FROM pr JOIN base ON base.key = pr.key WHERE i = 30 QUALIFY rk <= 20),
 fused AS (SELECT path, sum(1.0 / (60 + r))::DOUBLE AS score FROM (SELECT * FROM hits UNION ALL SELECT * FROM ranks) GROUP BY 1),
 kinds AS (SELECT dst, list_sort(list(DISTINCT kind)) AS k FROM resolved GROUP BY 1),
 items AS (SELECT f.path, f.score, list_filter([CASE WHEN f.path IN (SELECT path FROM hits) THEN 'keyword' END, CASE WHEN list_contains(k, 'wikilink') THEN 'link-expansion' END, CASE WHEN list_contains(k, 'markdown-link') THEN 'link-expansion' END], lambda x: x IS NOT NULL) AS provenance FROM fused f LEFT JOIN kinds ON dst = regexp_replace(f.path, '\.md$', ''))"""


def _items(spark, d):
    n = T.entity_notes(spark, d)
    scored = S.bm25(n, TASK, ["path"], {"title": 2.0, "body": 1.0}).select("path", F.round("score", 9).alias("score"))
    hits = top(scored, BU.HITS, ["path"])
    resolved = structure.resolved(spark, d)
    keys = n.select("path", X.page_key(F.col("path")).alias("key"))
    seeds = top(hits, BU.SEEDS, ["path"]).join(keys, "path").select("key")
    edges = resolved.where("dst is not null").select("src", "dst")
    ranks = G.pagerank(keys.select("key"), edges, seeds).join(keys, "key").select("path", F.round("score", 9).alias("score"))
    kinds = resolved.where("dst is not null").groupBy(F.col("dst").alias("key")).agg(F.collect_set("kind").alias("kinds")).join(keys, "key").select("path", "kinds")
    return BU.items(hits, ranks, kinds, hits, hits.limit(0))


@query("bundle_items", f"{BUNDLE} SELECT path, round(score, 9) AS score FROM items")
def bundle_items(spark, d):
    return _items(spark, d).select("path", F.round("score", 9).alias("score"))


@query("bundle_provenance", f"{BUNDLE} SELECT path, array_to_string(provenance, ',') AS provenance FROM items")
def bundle_provenance(spark, d):
    return _items(spark, d).select("path", F.array_join("provenance", ",").alias("provenance"))


@query("bundle_pack", f"WITH {NOTES}, l AS (SELECT row_number() OVER (ORDER BY path) AS rank, path, '- '||coalesce(body, '') AS line FROM notes), t AS (SELECT *, sum(floor(strlen(line) / 4)) OVER (ORDER BY rank) AS tokens FROM l) SELECT CAST(rank AS INT) AS rank, path, CAST(tokens AS BIGINT) AS tokens FROM t WHERE tokens <= 28000")
def bundle_pack(spark, d):
    """Whole bodies of all notes by path. A line has a token or more in all but texts of two bytes, so what can fit is cut by the budget first."""
    n = T.document_notes(spark, d).select("path", F.concat(F.lit("- "), F.coalesce("body", F.lit(""))).alias("line"))
    return BU.packed(BU.within(n, ["path"], 40_000), 40_000).select("rank", "path", "tokens")


@query("check_duplicate_names", f"WITH {NOTES}, p AS (SELECT 'a/'||lang||'/'||(doc_id % 400)||'.md' AS path FROM notes) SELECT 'warn' AS severity, 'duplicate-name' AS kind, min(path) AS path, count(*)||' notes named '||split_part(path, '/', 3) AS detail FROM p GROUP BY split_part(path, '/', 3) HAVING count(*) > 1")
def check_duplicate_names(spark, d):
    n = T.document_notes(spark, d)
    p = F.concat(F.lit("a/"), F.get_json_object("frontmatter", "$.lang"), F.lit("/"), (F.col("doc_id") % 400).cast("string"), F.lit(".md"))
    return CH.duplicate_names(n.select(p.alias("path")))


def _dashed(spark, d):
    n = T.document_notes(spark, d)
    return n.withColumn("body", F.when(F.col("doc_id") % 9 == 0, F.concat("body", F.lit(" — x"))).otherwise(F.col("body")))


@query("check_forbidden_dash", f"WITH {NOTES} SELECT 'error' AS severity, 'forbidden-dash' AS kind, path, '' AS detail FROM notes WHERE doc_id % 9 = 0 OR contains(body, '—') OR contains(body, '–')")
def check_forbidden_dash(spark, d):
    return CH.forbidden_dashes(_dashed(spark, d))


@query("check_doc_names", f"WITH {NOTES} SELECT 'error' AS severity, 'bad-doc-name' AS kind, path, doc_id||'.md' AS detail FROM notes")
def check_doc_names(spark, d):
    return CH.bad_doc_names(T.document_notes(spark, d))


@query("check_broken_refs", f"WITH {NOTES} SELECT 'error' AS severity, 'broken-doc-ref' AS kind, path, 'docs/'||source||'/'||lang||'/'||(doc_id + 1)||'.md' AS detail FROM notes n WHERE NOT EXISTS (SELECT 1 FROM notes m WHERE m.path = 'docs/'||n.source||'/'||n.lang||'/'||(n.doc_id + 1)||'.md')")
def check_broken_refs(spark, d):
    n = T.document_notes(spark, d)
    ref = F.concat_ws("/", X.dir_name(F.col("path")), F.concat((F.col("doc_id") + 1).cast("string"), F.lit(".md")))
    return CH.broken_refs(n.select("path", ref.alias("ref")), n)


REPORT = f"WITH {structure.RESOLVED}, {NOTES}, i AS (SELECT 'error' AS severity, 'broken-link' AS kind, path, kind||' '||target AS detail FROM resolved WHERE dst IS NULL UNION ALL SELECT 'error', 'forbidden-dash', path, '' FROM notes WHERE doc_id % 9 = 0 OR contains(body, '—') OR contains(body, '–') UNION ALL SELECT 'warn', 'orphan', path, '' FROM entities WHERE path NOT IN (SELECT path FROM lk) AND regexp_replace(path, '\\.md$', '') NOT IN (SELECT dst FROM resolved WHERE dst IS NOT NULL))"


def _report(spark, d):
    n, r = T.entity_notes(spark, d), structure.resolved(spark, d)
    from vellum.operators import links as L

    return CH.report([CH.broken_links(L.broken(r)), CH.orphans(L.orphans(n, r)), CH.forbidden_dashes(_dashed(spark, d))])


@query("check_report", f"{REPORT} SELECT severity, kind, path, detail FROM i")
def check_report(spark, d):
    return _report(spark, d)


@query("check_counts", f"{REPORT} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings FROM i")
def check_counts(spark, d):
    return CH.counts(_report(spark, d))


@query("issue_fingerprint", f"{REPORT} SELECT kind, path, sha256(kind||chr(0)||path||chr(0)||regexp_replace(trim(regexp_replace(detail, '\\s+', ' ', 'g')), '[0-9]+', 'N', 'g')) AS fingerprint FROM i")
def issue_fingerprint(spark, d):
    return CH.fingerprints(_report(spark, d)).select("kind", "path", "fingerprint")


@query("baseline_ratchet", f"{REPORT} SELECT kind, path, detail FROM i WHERE kind <> 'broken-link'")
def baseline_ratchet(spark, d):
    r = _report(spark, d)
    return CH.newcomers(r, CH.fingerprints(r.where("kind = 'broken-link'"))).select("kind", "path", "detail")


@query("proposed_fixes", f"WITH {NOTES}, b AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN body||' — x' ELSE body END AS t FROM notes) SELECT path, 'dashes' AS fix, sha256(translate(t, '—–', '--')) AS detail FROM b WHERE contains(t, '—') OR contains(t, '–') UNION ALL SELECT path, 'rename', 'document-'||doc_id||'.md' FROM b")
def proposed_fixes(spark, d):
    return CH.proposed_fixes(_dashed(spark, d))


DOCS = "docs AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'docs/adr/'||lpad(CAST(doc_id AS VARCHAR), 4, '0')||'-'||source||'.md' ELSE 'docs/plans/2024-01-'||lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')||'-'||doc_id||'.md' END AS path, 'Document '||doc_id AS title FROM documents)"


def docs_tree(spark, d):
    t = T.table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    adr = F.concat(F.lit("docs/adr/"), F.lpad(i, 4, "0"), F.lit("-"), "source", F.lit(".md"))
    plan = F.concat(F.lit("docs/plans/2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("-"), i, F.lit(".md"))
    return t.select(F.when(F.col("doc_id") % 2 == 0, adr).otherwise(plan).alias("path"), F.concat(F.lit("Document "), i).alias("title"), F.lit("{}").alias("frontmatter"))


@query("registry_table", f"WITH {DOCS} SELECT split_part(path, '/', 2) AS collection, path, title, regexp_extract(split_part(path, '/', 3), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS date, regexp_extract(split_part(path, '/', 3), '^(\\d+)', 1) AS number, CAST(row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY CASE WHEN path LIKE 'docs/adr/%' THEN path END ASC NULLS LAST, path DESC) AS INT) AS place FROM docs")
def registry_table(spark, d):
    return RG.registry(docs_tree(spark, d))


@query("registry_stale_index", f"""WITH {NOTES} SELECT path, CASE WHEN doc_id % 50 = 0 THEN 'only on disk' ELSE 'only indexed' END AS "where" FROM notes WHERE (doc_id % 50 = 0) <> (doc_id % 70 = 0)""")
def registry_stale_index(spark, d):
    n = T.document_notes(spark, d)
    return RG.stale_index(n.where("doc_id % 70 <> 0"), n.where("doc_id % 50 <> 0"))


@query("next_adr_number", f"WITH {DOCS} SELECT CAST(max(CAST(regexp_extract(split_part(path, '/', 3), '^(\\d+)', 1) AS INT)) + 1 AS INT) AS next_number FROM docs WHERE path LIKE 'docs/adr/%'")
def next_adr_number(spark, d):
    return RG.next_number(docs_tree(spark, d))


INDEX = f"WITH {DOCS}, x AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, split_part(path, '/', 3) AS file, title, CASE WHEN regexp_matches(split_part(path, '/', 3), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substring(split_part(path, '/', 3), 1, 10) ELSE '-' END AS date FROM docs), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY dir ORDER BY CASE WHEN date = '-' THEN 1 ELSE 0 END, date DESC, lower(file), file) AS INT) AS place FROM x)"


@query("directory_index", f"{INDEX} SELECT dir, file, title, date, place FROM o")
def directory_index(spark, d):
    return RG.directory_index(docs_tree(spark, d))


@query("directory_index_text", f"{INDEX} SELECT dir, sha256(string_agg('| ['||title||']('||file||') | '||date||' |', chr(10) ORDER BY place)) AS block_hash FROM o GROUP BY 1")
def directory_index_text(spark, d):
    return RG.index_text(RG.directory_index(docs_tree(spark, d))).select("dir", F.sha2("block", 256).alias("block_hash"))


def _assets(spark):
    rows = [
        ("skill", "lint", "user", 2, 0, None, False, ["t1", "t2"], "h1"), ("skill", "lint", "repo", 1, 1, None, False, ["t1"], "h2"), ("skill", "lint", "other", 1, 2, None, False, ["t2"], "h3"),
        ("rule", "style", "repo", 1, 0, "project", False, ["t1", "t3"], "h4"), ("agent", "old", "repo", 1, 0, None, True, ["t1"], "h5"),
    ]
    return spark.createDataFrame(rows, "kind string, name string, source string, priority int, source_pos int, scope string, import_only boolean, targets array<string>, hash string")


@query("asset_winner", "SELECT * FROM (VALUES ('skill', 'lint', 'repo'), ('rule', 'style', 'repo'), ('agent', 'old', 'repo')) t(kind, name, source)")
def asset_winner(spark, d):
    return RG.winners(_assets(spark)).select("kind", "name", "source")


@query("sync_plan", "SELECT * FROM (VALUES ('t1', 'user', 'skill', 'lint', 'ok'), ('t1', 'project', 'skill', 'lint', 'create'), ('t1', 'project', 'rule', 'style', 'drift')) t(tool, scope, kind, name, status)")
def sync_plan(spark, d):
    targets = spark.createDataFrame([("t1", "user", None, None, None), ("t1", "project", None, None, None), ("t1", "user", "skill", "lint", "h2"), ("t1", "project", "rule", "style", "zz")], "tool string, scope string, kind string, name string, hash string")
    a = _assets(spark).where("source = 'repo'")
    return RG.sync_plan(a, targets)


@query("cron_due", "SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 9 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5")
def cron_due(spark, d):
    return T.table(spark, d, "events").where(RG.cron_due(F.col("ts"), "*/15 9-17 * * 1-5")).select("event_id")


@query("detect_kind", "SELECT * FROM (VALUES ('a', 'repo', CAST(2 AS BIGINT), CAST(1 AS BIGINT)), ('b.wiki', 'wiki', 0, 1), ('c', 'vault', 1, 1), ('d', 'wiki', 0, 1)) t(root, kind, code, pages)")
def detect_kind(spark, d):
    rows = [("a", "x.go"), ("a", "y.py"), ("a", "README.md"), ("b.wiki", "Page.md"), ("c", ".obsidian/x"), ("c", "a.md"), ("c", "a.py"), ("d", "Home.md")]
    return RG.tree_kind(spark.createDataFrame(rows, "root string, path string"))


FILES = [
    ("Guide.adoc", "= Hand Book\n:toc:\n// note\n== Start\n\nUse *the* `tool` _now_.\n----\nx_y\n----\n"),
    ("Install.rst", "======\nTitled\n======\n\n.. note::\n\nSee `the docs <https://e.com>`_ in ``code``.\n"),
    ("Style.textile", 'h1. Page\n\nh2. Over\n\nA *b* _c_ @d@ "link":https://e.com end.\n'),
    ("Notes.org", "#+TITLE: Org Notes\n* One\n:PROPERTIES:\n:ID: 1\n:END:\nSome /it/ and =v= and [[https://e.com][desc]].\n"),
    ("Raw.creole", "= Heading =\nsome **text**\n"),
    ("a.md", "---\ntitle: From front\ntags: [x, y]\nscore: 7\n---\n# Other\nbody #z and `code`\n"),
    ("b.md", "---\ntags: p, q r\n---\n# From heading\n\n#p #q2\n"),
    ("c.md", "---\n: [bad\n---\nno title\n"),
]


@query("parse_notes", "SELECT * FROM (VALUES ('Guide.adoc', 'Hand Book', '', 'Hand Book'||chr(10)||'Start'||chr(10)||chr(10)||'Use the tool now.'||chr(10)||'x_y', false), ('Install.rst', 'Titled', '', 'Titled'||chr(10)||chr(10)||chr(10)||'See the docs in code.', false), ('Style.textile', 'Page', '', 'Page'||chr(10)||chr(10)||'Over'||chr(10)||chr(10)||'A b c d link end.', false), ('Notes.org', 'Org Notes', '', 'One'||chr(10)||'Some it and v and desc.', false), ('Raw.creole', 'Raw', '', '= Heading ='||chr(10)||'some **text**', false), ('a.md', 'From front', 'x,y', '# Other'||chr(10)||'body #z and `code`', false), ('b.md', 'From heading', 'p,q,r,q2', '# From heading'||chr(10)||chr(10)||'#p #q2', false), ('c.md', 'c', '', 'no title', true)) t(path, title, tags, body, bad_frontmatter)")
def parse_notes(spark, d):
    n = P.notes(spark.createDataFrame(FILES, "path string, content string"))
    return n.select("path", "title", F.array_join("tags", ",").alias("tags"), X.strip(F.col("body")).alias("body"), "bad_frontmatter")


@query("stream_index_available_now", "SELECT 'first' AS run, count(*) AS n FROM documents UNION ALL SELECT 'second', 0")
def stream_index_available_now(spark, d):
    """Two runs over the documents: the first takes all, the second finds nothing new."""
    root = G.shared_folder(spark, "stream")
    schema = T.table(spark, d, "documents").schema
    docs = T.table(spark, d, "documents")
    docs.write.parquet(f"{root}/in")  # as many files as the table has parts, so that no task's share grows
    counts = []
    for _ in range(2):
        ingest.run_available(spark, f"{root}/in", schema, f"{root}/out", f"{root}/checkpoint", lambda b: b.select("doc_id", X.content_hash(F.col("text")).alias("content_hash")))
        counts.append(spark.read.parquet(f"{root}/out").count())
    return spark.createDataFrame([("first", counts[0]), ("second", counts[1] - counts[0])], "run string, n long")


@query("windowed_event_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, d):
    return ingest.windowed_counts(T.table(spark, d, "events"))


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    """The same counts by a stream with a watermark, whose windows all close in the end; updates of a window replace earlier ones."""
    root = G.shared_folder(spark, "windows")
    e = T.table(spark, d, "events")
    e.write.parquet(f"{root}/in")
    stream = ingest.windowed_counts(spark.readStream.schema(e.schema).parquet(f"{root}/in"))
    write = lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{root}/out")
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
