"""Registered queries of document lint, ownership and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import graph as G
from vellum.operators import incremental as I
from vellum.operators import links as L
from vellum.operators import lint as LI
from vellum.operators import reports as RP
from vellum.operators import schema as SC
from vellum.operators import temporal as TP
from vellum.sources import tables as T

from . import changes, structure
from .base import NOTES, query


@query("owning_collection", f"WITH {NOTES}, c AS (SELECT DISTINCT source AS name, 'docs/'||source AS folder FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT 'z-'||lang, 'docs/'||source||'/'||lang FROM documents), o AS (SELECT n.path, min(name) AS name FROM notes n JOIN c ON starts_with(n.path, folder||'/') GROUP BY 1) SELECT path, name FROM o")
def owning_collection(spark, d):
    docs = T.table(spark, d, "documents")
    broad = docs.where("source is not null").select(F.col("source").alias("name"), F.concat(F.lit("docs/"), "source").alias("path")).distinct()
    narrow = docs.where("lang is not null and source is not null").select(F.concat(F.lit("z-"), "lang").alias("name"), F.concat(F.lit("docs/"), "source", F.lit("/"), "lang", F.lit("/")).alias("path")).distinct()
    return LI.owners(T.document_notes(spark, d), broad.unionByName(narrow))


@query("check_stray_docs", f"WITH {NOTES} SELECT 'error' AS severity, 'stray-doc' AS kind, path, 'markdown file under docs is outside registered collection folders' AS detail FROM notes WHERE NOT starts_with(path, 'docs/src1/') AND NOT starts_with(path, 'docs/src2/en/')")
def check_stray_docs(spark, d):
    return LI.stray(T.document_notes(spark, d), ["docs/src1", "docs/src2/en"])


@query("check_ambiguous_names", f"WITH {NOTES}, n AS (SELECT path, CASE WHEN lang = 'en' THEN 'docs/'||(n_chars % 500) ELSE CAST(n_chars % 500 AS VARCHAR) END AS name FROM notes), t AS (SELECT DISTINCT CAST(length(text) % 500 AS VARCHAR) AS name FROM benchmark) SELECT 'warn' AS severity, 'duplicate-name' AS kind, min(path) AS path, 'note name '||name||' is shared by '||count(*)||' files; wikilinks to it are ambiguous' AS detail FROM n WHERE contains(name, '/') OR name IN (SELECT name FROM t) GROUP BY name HAVING count(*) > 1")
def check_ambiguous_names(spark, d):
    docs = T.table(spark, d, "documents").select(F.concat_ws("/", F.lit("docs"), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), "lang", (F.col("n_chars") % 500).cast("string").alias("k"))
    named = docs.select("path", F.when(F.col("lang") == "en", F.concat(F.lit("docs/"), "k")).otherwise(F.col("k")).alias("name"))
    linked = T.table(spark, d, "benchmark").select((F.char_length("text") % 500).cast("string").alias("name"))
    return LI.ambiguous_names(named, linked)


#: Edges of the users to files, code and pages, made of the events.
EDGES = "e AS (SELECT 'user-'||user_id AS src, event_id AS pos, CASE event_id % 4 WHEN 0 THEN 'related' WHEN 1 THEN 'wikilink' WHEN 2 THEN 'markdown-link' ELSE 'related' END AS kind, CASE event_id % 4 WHEN 1 THEN 'page'||(event_id % 7) WHEN 2 THEN 'page'||(event_id % 5) ELSE event_type||(user_id % 9)||CASE WHEN event_id % 3 = 0 THEN '.md' ELSE '.py' END END AS target FROM events), files AS (SELECT DISTINCT event_type||(user_id % 6)||x AS path FROM events, (VALUES ('.md'), ('.py')) v(x))"


def _edges(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    kind = F.when(i % 4 == 1, "wikilink").when(i % 4 == 2, "markdown-link").otherwise("related")
    file = F.concat("event_type", (u % 9).cast("string"), F.when(i % 3 == 0, ".md").otherwise(".py"))
    target = F.when(i % 4 == 1, F.concat(F.lit("page"), (i % 7).cast("string"))).when(i % 4 == 2, F.concat(F.lit("page"), (i % 5).cast("string"))).otherwise(file)
    e = T.table(spark, d, "events")
    files = e.select(F.concat("event_type", (u % 6).cast("string")).alias("p")).distinct().select(F.explode(F.array(F.concat("p", F.lit(".md")), F.concat("p", F.lit(".py")))).alias("path"))
    return e.select(F.concat(F.lit("user-"), u.cast("string")).alias("src"), i.alias("pos"), target.alias("target"), kind.alias("kind")), files


@query("classified_links", f"WITH {EDGES}, l AS (SELECT src, pos, target, kind FROM e WHERE kind <> 'related' UNION ALL SELECT src, pos, left(target, length(target) - 3), kind FROM e WHERE kind = 'related' AND target LIKE '%.md' AND target IN (SELECT path FROM files)) SELECT src, target, min_by(kind, pos) AS kind FROM l GROUP BY 1, 2")
def classified_links(spark, d):
    return LI.classified(*_edges(spark, d))[0]


@query("classified_code", f"WITH {EDGES} SELECT src, target, kind FROM e WHERE kind = 'related' AND target NOT LIKE '%.md' AND target IN (SELECT path FROM files)")
def classified_code(spark, d):
    return LI.classified(*_edges(spark, d))[1]


@query("code_refs", f"WITH {EDGES} SELECT DISTINCT src AS path, target AS ref FROM e WHERE target NOT LIKE '%.md' AND target IN (SELECT path FROM files)")
def code_refs(spark, d):
    e, files = _edges(spark, d)
    return LI.code_refs(e.select(F.col("src").alias("path"), F.col("target").alias("ref")), files)


@query("page_links", f"WITH {EDGES} SELECT src, target, pos FROM e WHERE target NOT IN (SELECT path FROM files WHERE path NOT LIKE '%.md')")
def page_links(spark, d):
    e, files = _edges(spark, d)
    return LI.page_links(e.select("src", "target", "pos"), files.where("path like '%.md'"), files)


@query("check_stale_governed", f"WITH {changes.BOUND}, {changes.STATUS} SELECT 'warn' AS severity, 'stale-governed-doc' AS kind, doc AS path, count(DISTINCT f.seq)||' governed code commit(s) since doc update' AS detail FROM bind JOIN last ON last.path = doc JOIN status USING (doc) JOIN files f ON f.path = file WHERE f.seq > last_seq AND status = 'Implemented' GROUP BY doc")
def check_stale_governed(spark, d):
    return LI.stale_docs(changes.stale_docs(spark, d))


@query("check_drift", f"WITH {changes.BOUND}, x AS (SELECT doc, file, count(DISTINCT f.seq) AS n FROM bind JOIN last ON last.path = doc JOIN files f ON f.path = file WHERE f.seq > last_seq GROUP BY 1, 2) SELECT 'warn' AS severity, 'drift' AS kind, doc AS path, 'references `'||file||'`, which moved '||n||CASE n WHEN 1 THEN ' commit' ELSE ' commits' END||' since this doc was last touched; review' AS detail FROM x")
def check_drift(spark, d):
    return LI.drifted(changes.commit_distance_drift(spark, d))


@query("check_directory_indexes", f"WITH {NOTES}, x AS (SELECT 'docs/'||source||'/'||lang||'/INDEX.md' AS path, lang, count(*) AS n FROM notes GROUP BY 1, 2) SELECT 'warn' AS severity, CASE lang WHEN 'en' THEN 'directory-index-missing' ELSE 'directory-index-stale' END AS kind, path, CASE lang WHEN 'en' THEN 'configured directory is missing its index file' ELSE 'generated directory index block is stale' END AS detail FROM x WHERE lang = 'en' OR n % 2 = 1")
def check_directory_indexes(spark, d):
    """Index files that hold their folder's number of notes: absent in English, rounded down to even elsewhere."""
    n = T.document_notes(spark, d).groupBy(F.concat(X.dir_name(F.col("path")), F.lit("/INDEX.md")).alias("path")).agg(F.count("*").alias("n"))
    disk = n.where(~F.col("path").like("%/en/INDEX.md")).select("path", (F.col("n") - F.col("n") % 2).cast("string").alias("block"))
    return LI.index_issues(n.select("path", F.col("n").cast("string").alias("block")), disk)


@query("field_fixes", "WITH docs AS (SELECT 'user-'||user_id AS path, CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'adr' ELSE 'spec' END AS type, min(event_id) AS f, max(event_id) AS l, user_id FROM events GROUP BY user_id) SELECT path, 'missing-doc-field' AS kind, 'set type to spec' AS detail FROM docs WHERE type = '' UNION ALL SELECT path, 'bad-doc-type', 'rewrote type from \"adr\" to \"spec\"' FROM docs WHERE type = 'adr' UNION ALL SELECT path, 'missing-doc-field', 'set created to '||f FROM docs WHERE user_id % 2 = 0")
def field_fixes(spark, d):
    u = F.col("user_id")
    e = T.table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").cast("string").alias("first"), F.max("event_id").cast("string").alias("last"))
    path = F.concat(F.lit("user-"), u.cast("string")).alias("path")
    docs = e.select(path, F.lit("spec").alias("doc_type"), F.when(u % 3 == 0, "").when(u % 3 == 1, "adr").otherwise("spec").alias("type"), F.when(u % 2 == 0, "").otherwise("x").alias("created"), F.lit(None).cast("string").alias("updated"), F.array(F.lit("type"), F.lit("created"), F.lit("status")).alias("required"))
    return LI.field_fixes(docs, e.select(path, "first", "last", F.lit("2000-01-01").alias("changed")))


@query("graph_report")
def graph_report(spark, d):
    n, r = T.entity_notes(spark, d), structure.resolved(spark, d)
    keys = n.select(X.page_key(F.col("path")).alias("key"))
    return LI.graph_report(n, r, L.orphans(n, r), G.pagerank(keys, r.where("dst is not null").select("src", "dst")))


@query("list_field_cases", "SELECT * FROM (VALUES ('{\"tags\": [\"a\", \"b\"]}', NULL), ('{\"tags\": []}', NULL), ('{}', NULL), ('{\"tags\": null}', NULL), ('{\"tags\": \"a\"}', 'tags must be a list of strings'), ('{\"tags\": 3}', 'tags must be a list of strings'), ('{\"tags\": [\"a\", 1]}', 'tags holds an item that is no string')) t(frontmatter, problem)")
def list_field_cases(spark, d):
    rows = ['{"tags": ["a", "b"]}', '{"tags": []}', "{}", '{"tags": null}', '{"tags": "a"}', '{"tags": 3}', '{"tags": ["a", 1]}']
    return spark.createDataFrame([(x,) for x in rows], "frontmatter string").withColumn("problem", LI.list_problem(F.col("frontmatter"), "tags"))


@query("ignored_paths", f"WITH {NOTES} SELECT path, (list_contains(string_split(path, '/'), 'fr') OR starts_with(path, 'docs/src2/')) AS ignored FROM notes")
def ignored_paths(spark, d):
    return T.document_notes(spark, d).select("path", LI.ignored(F.col("path"), ["fr"], ["docs/src2"]).alias("ignored"))


@query("collection_keys", "SELECT path, k FROM (VALUES ('docs/Specs/a/My Note.md', 'specs/my note'), ('docs/x.md', 'x'), ('notes/Y.MD', 'y'), ('docs/adr/0001-z.md', 'adr/0001-z')) t(path, k)")
def collection_keys(spark, d):
    rows = ["docs/Specs/a/My Note.md", "docs/x.md", "notes/Y.MD", "docs/adr/0001-z.md"]
    return spark.createDataFrame([(x,) for x in rows], "path string").select("path", X.collection_key(F.col("path")).alias("k"))


@query("convention_names", """WITH t AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY user_id % 2 ORDER BY 'docs/'||CASE WHEN user_id % 2 = 0 THEN 'adr' ELSE 'specs' END||'/U '||user_id||'.md') AS k FROM t)
 SELECT 'docs/'||CASE WHEN user_id % 2 = 0 THEN 'adr' ELSE 'specs' END||'/U '||user_id||'.md' AS path, CASE WHEN user_id % 2 = 0 THEN 'docs/adr/'||lpad(CAST(6 + k AS VARCHAR), CAST(greatest(4, length(CAST(6 + k AS VARCHAR))) AS INT), '0') ELSE 'docs/specs/day'||first||'-0000' END||CASE WHEN user_id % 3 = 0 THEN '-note' ELSE '-the-title' END||'.md' AS name FROM r""")
def convention_names(spark, d):
    u = F.col("user_id")
    e = T.table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").cast("string").alias("first"))
    folder = F.when(u % 2 == 0, "adr").otherwise("specs")
    path = F.concat(F.lit("docs/"), folder, F.lit("/U "), u.cast("string"), F.lit(".md"))
    docs = e.select(path.alias("path"), F.when(u % 2 == 0, "adr").otherwise("spec").alias("doc_type"), F.when(u % 3 == 0, "").otherwise("The Title").alias("title"), F.concat(F.lit("day"), "first").alias("first_date"))
    return RP.convention_name(docs, spark.createDataFrame([("docs/adr", 7)], "dir string, next_number int"))


@query("drift_report", f"WITH {changes.BOUND} SELECT doc, file, '| spec | T '||doc||' | `'||doc||'` | `'||file||CASE WHEN file LIKE '%3' THEN ' (source repo)' ELSE '' END||'` | '||count(DISTINCT f.seq)||' |' AS line FROM bind JOIN last ON last.path = doc JOIN files f ON f.path = file WHERE f.seq > last_seq GROUP BY 1, 2")
def drift_report(spark, d):
    found = TP.drift(*changes._bound(spark, d))
    source = F.when(F.col("file").endswith("3"), "repo")
    return RP.drift_rows(found.withColumn("type", F.lit("spec")).withColumn("title", F.concat(F.lit("T "), "doc")).withColumn("source", source))


@query("refreshed_path", f"WITH {NOTES} SELECT path, sha256(body) AS chunk_hash FROM notes WHERE doc_id NOT IN (1, 2) UNION ALL SELECT path, sha256('new text') FROM notes WHERE doc_id = 1")
def refreshed_path(spark, d):
    """One note has a new text, another's file is gone."""
    n = T.document_notes(spark, d).select("doc_id", "path", X.content_hash(F.col("body")).alias("chunk_hash"))
    one, two = (n.where(F.col("doc_id") == k).first()["path"] for k in (1, 2))
    chunks = n.select("path", "chunk_hash")
    new = spark.createDataFrame([(one, "new text")], "path string, t string").select("path", X.content_hash(F.col("t")).alias("chunk_hash"))
    return I.refreshed(I.refreshed(chunks, one, new), two)


@query("schema_problems", f"""WITH {NOTES}, t AS (SELECT path, (doc_id % 50) % 10 = 0 AS own, lang, n_chars, quality, 'docs/'||source||'/'||lang||'/'||(doc_id + doc_id % 3)||'.md' AS next, doc_id % 4 AS k FROM notes)
 SELECT path, 'lang' AS field, CASE WHEN coalesce(trim(lang), '') = '' THEN 'required' ELSE 'value not in enum' END AS problem FROM t WHERE NOT own AND coalesce(lang, '') NOT IN ('en', 'de')
 UNION ALL SELECT path, 'quality', 'required' FROM t WHERE NOT own AND quality IS NULL UNION ALL SELECT path, 'n_chars', 'not a string' FROM t WHERE NOT own AND n_chars IS NOT NULL
 UNION ALL SELECT path, 'day', CASE k WHEN 0 THEN 'not a date' ELSE 'required' END FROM t WHERE NOT own AND k <> 1
 UNION ALL SELECT path, 'next', 'missing reference '||next FROM t WHERE NOT own AND next NOT IN (SELECT path FROM notes)
 UNION ALL SELECT path, 'n_chars', 'required' FROM t WHERE own AND n_chars IS NULL UNION ALL SELECT path, 'extra', 'required' FROM t WHERE own""")
def schema_problems(spark, d):
    """Documents of a type for each source and number, most under built-in rules, some types under committed ones."""
    n, i = T.document_notes(spark, d), F.col("doc_id")
    fm = lambda k: F.get_json_object("frontmatter", f"$.{k}")
    source, lang = F.element_at(F.split("path", "/"), 2), F.element_at(F.split("path", "/"), 3)
    nxt = F.concat(F.lit("docs/"), source, F.lit("/"), lang, F.lit("/"), (i + i % 3).cast("string"), F.lit(".md"))
    day = F.when(i % 4 == 0, "2024-02-30").when(i % 4 == 1, "2024-02-28").when(i % 4 == 2, " ")
    front = F.to_json(F.struct(fm("lang").alias("lang"), fm("n_chars").cast("long").alias("n_chars"), fm("quality").cast("int").alias("quality"), nxt.alias("next"), day.alias("day")))
    docs = n.select("path", F.concat(source, F.lit("-"), (i % 50).cast("string")).alias("doc_type"), front.alias("frontmatter"))
    rule = lambda f, required, kind, allowed=(): F.struct(F.lit(f).alias("field"), F.lit(required).alias("required"), F.lit(kind).alias("kind"), F.array(*[F.lit(x) for x in allowed]).cast("array<string>").alias("allowed"))
    types = docs.select("doc_type").distinct()
    table = lambda df, *rules: df.select("doc_type", F.inline(F.array(*rules)))
    built_in = table(types, rule("lang", True, "enum", ["en", "de"]), rule("quality", True, "number"), rule("n_chars", False, "string"), rule("day", True, "date"), rule("next", False, "ref"))
    committed = table(types.where("cast(substring_index(doc_type, '-', -1) AS int) % 10 = 0"), rule("n_chars", True, "number"), rule("extra", True, "string"))
    return SC.problems(docs, SC.effective(built_in, committed), n.select("path"))
