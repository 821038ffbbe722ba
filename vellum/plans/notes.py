"""Queries over notes: projections, hashes, chunks, text functions (milestone 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import chunks as C
from vellum.sources import tables as T

from .base import BLANK, CHUNKS, NOTES, TALKS, ENTITIES, query, squeeze


@query("note_projection", f"WITH {NOTES} SELECT path, title, 2 AS n_tags, lang||' '||source AS tag_text, length(body) AS n_chars FROM notes")
def note_projection(spark, d):
    n = T.document_notes(spark, d)
    return n.select("path", "title", F.size("tags").alias("n_tags"), F.array_join("tags", " ").alias("tag_text"), F.char_length("body").alias("n_chars"))


@query("title_extract", rf"WITH {ENTITIES} SELECT path, regexp_extract(body, '(?m)^# +([^\n]+)$', 1) AS title FROM entities")
def title_extract(spark, d):
    n = T.entity_notes(spark, d)
    h1 = F.nullif(F.regexp_extract("body", r"(?md)^# +([^\n]+)$", 1), F.lit(""))
    return n.select("path", F.coalesce(h1, F.regexp_replace(X.base_name(F.col("path")), r"\.md$", "")).alias("title"))


@query("inline_tags", r"WITH b AS (SELECT doc_id, '#'||lang||' '||text||chr(10)||'#'||source||'/x #1no' AS body FROM documents) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS tags FROM (SELECT doc_id, regexp_extract_all(body, '(?:^|\s)#([a-zA-Z][\w/-]+)', 1) AS l FROM b)")
def inline_tags(spark, d):
    b = T.table(spark, d, "documents").select("doc_id", F.concat(F.lit("#"), "lang", F.lit(" "), "text", F.lit("\n#"), "source", F.lit("/x #1no")).alias("body"))
    return b.select("doc_id", F.array_join(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?:^|\s)#([a-zA-Z][\w/-]+)"), F.lit(1))), ",").alias("tags"))


@query("frontmatter_json", f"WITH {NOTES} SELECT path, lang, CAST(n_chars AS VARCHAR) AS n_chars, CAST(quality AS VARCHAR) AS quality FROM notes")
def frontmatter_json(spark, d):
    j = lambda k: F.get_json_object("frontmatter", f"$.{k}").alias(k)
    return T.document_notes(spark, d).select("path", j("lang"), j("n_chars"), j("quality"))


@query("content_hash_catalog", f"WITH {NOTES} SELECT path, sha256(body) AS content_hash FROM notes")
def content_hash_catalog(spark, d):
    return T.document_notes(spark, d).select("path", X.content_hash(F.col("body")).alias("content_hash"))


@query("exact_duplicates", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    h = T.table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("count_notes_chunks", f"WITH {CHUNKS} SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM chunks) AS chunks")
def count_notes_chunks(spark, d):
    n = T.document_notes(spark, d)
    c = C.document_windows(n)
    return n.agg(F.count("*").alias("notes")).select("notes", c.agg(F.count("*").alias("c")).scalar().alias("chunks"))


SECTIONS = (
    TALKS
    + r""", lines AS (SELECT path, title, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM talks),
 marked AS (SELECT *, regexp_matches(line, '^#{1,6}[\t\f\r ]+\S') AS is_h FROM lines),
 numbered AS (SELECT *, sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS sec FROM marked),
 grouped AS (SELECT path, title, sec, coalesce(max(CASE WHEN is_h THEN trim(regexp_replace(line, '^#{1,6}', '')) END), '') AS heading, coalesce(string_agg(CASE WHEN NOT is_h THEN line END, chr(10) ORDER BY pos), '') AS raw FROM numbered GROUP BY 1, 2, 3),
 trimmed AS (SELECT path, title, sec, heading, regexp_replace(raw, '\A"""
    + BLANK
    + r"+|"
    + BLANK
    + r"""+\z', '', 'g') AS body FROM grouped),
 sections AS (SELECT path, title, heading, CAST(row_number() OVER (PARTITION BY path ORDER BY sec) - 1 AS INT) AS ord, body FROM trimmed WHERE body <> '')"""
)


@query("section_chunks", f"WITH {SECTIONS} SELECT path, ord, heading, sha256(body) AS body_hash FROM sections")
def section_chunks(spark, d):
    return C.sections(T.conversation_notes(spark, d)).select("path", "ord", "heading", F.sha2("body", 256).alias("body_hash"))


@query("window_chunks", f"WITH {CHUNKS} SELECT path, ord, length(body) AS n_chars, sha256(body) AS body_hash FROM chunks")
def window_chunks(spark, d):
    return C.document_windows(T.document_notes(spark, d)).select("path", "ord", F.char_length("body").alias("n_chars"), F.sha2("body", 256).alias("body_hash"))


@query("chunk_hashes", f"WITH {SECTIONS} SELECT path, ord, CAST(floor(strlen(body) / 4) AS INT) AS token_est, sha256(regexp_replace(title||chr(10)||heading||chr(10)||body, '\\A{BLANK}+|{BLANK}+\\z', '', 'g')) AS chunk_hash FROM sections")
def chunk_hashes(spark, d):
    return C.with_hashes(C.sections(T.conversation_notes(spark, d))).select("path", "ord", "token_est", "chunk_hash")


@query("title_only_chunk", "SELECT 'empty/'||n_nationkey||'.md' AS path, CAST(0 AS INT) AS ord, '' AS heading, n_name AS body FROM nation")
def title_only_chunk(spark, d):
    n = T.table(spark, d, "nation").select(F.concat(F.lit("empty/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("path"), F.col("n_name").alias("title"), F.lit(" \n\t").alias("body"))
    return C.sections(n).select("path", "ord", "heading", "body")


def _cut(n: int) -> str:
    s = squeeze("text")
    return f"CASE WHEN length({s}) > {n} THEN substring({s}, 1, {n})||'...' ELSE {s} END"


@query("snippets", f"SELECT doc_id, {_cut(280)} AS snippet FROM documents")
def snippets(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("one_line", f"SELECT doc_id, {_cut(100)} AS line FROM documents")
def one_line(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.one_line(F.col("text"), 100).alias("line"))


@query("truncate_tokens", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200)||chr(10)||'...' ELSE text END AS head FROM documents")
def truncate_tokens(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.truncate_tokens(F.col("text"), 50).alias("head"))


@query("slugify", r"WITH s AS (SELECT doc_id, regexp_replace(substring(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') AS s FROM documents) SELECT doc_id, CASE WHEN s = '' THEN 'note' ELSE s END AS slug FROM s")
def slugify(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query("first_words", f"SELECT doc_id, array_to_string(string_split({squeeze('text')}, ' ')[1:6], ' ') AS words FROM documents")
def first_words(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.first_words(F.col("text"), 6).alias("words"))


@query("top_area", f"WITH {ENTITIES} SELECT string_split(path, '/')[1] AS area, count(*) AS n FROM entities GROUP BY 1")
def top_area(spark, d):
    return T.entity_notes(spark, d).groupBy(X.top_area(F.col("path")).alias("area")).agg(F.count("*").alias("n"))


@query("path_normalise", "SELECT doc_id, source||'/'||doc_id AS path FROM documents")
def path_normalise(spark, d):
    raw = F.concat_ws("/", F.lit("./x"), F.lit(".."), "lang", F.lit(".."), F.lit(""), "source", F.lit("."), F.col("doc_id").cast("string"))
    return T.table(spark, d, "documents").select("doc_id", X.clean_path(raw).alias("path"))


@query("url_identity", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '^[a-z][a-z0-9+.-]*://', ''), '/+$', '') AS identity FROM pages")
def url_identity(spark, d):
    return T.table(spark, d, "pages").select("page_id", X.url_identity(F.col("url")).alias("identity"))


@query("list_notes", f"WITH {CHUNKS} SELECT n.path, n.title, {squeeze('substring(c.body, 1, 140)')} AS first_text FROM notes n LEFT JOIN chunks c ON c.path = n.path AND c.ord = 0")
def list_notes(spark, d):
    """Each note with the start of its first chunk."""
    n = T.document_notes(spark, d)
    first = C.document_windows(n).groupBy("path").agg(F.min_by(F.substring("body", 1, 140), "ord").alias("b"))
    return n.select("path", "title").join(first, "path", "left").select("path", "title", X.squeeze(F.col("b")).alias("first_text"))


@query("node_keys", f"WITH {NOTES} SELECT path, regexp_replace(lower(path), '\\.md$', '') AS key FROM notes")
def node_keys(spark, d):
    return T.document_notes(spark, d).select("path", X.page_key(F.col("path")).alias("key"))
