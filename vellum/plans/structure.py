"""Queries over records, links and graphs (milestones 3 and 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import graph as G
from vellum.operators import links as L
from vellum.operators import records as R
from vellum.operators.records import Field, Predicate
from vellum.sources import tables as T

from .base import ENTITIES, NOTES, query


def _filter(name: str, p: Predicate, condition: str):
    @query(f"records_filter_{name}", f"WITH {NOTES} SELECT path FROM notes WHERE {condition}")
    def run(spark, d):
        return R.list_records(T.document_notes(spark, d), "", [p]).select("path")

    return run


for _name, _p, _c in [
    ("eq", Predicate("lang", "eq", "de"), "lang = 'de'"),
    ("ne", Predicate("quality", "ne", "1"), "quality <> 1"),
    ("gt", Predicate("n_chars", "gt", "2000"), "n_chars > 2000"),
    ("gte", Predicate("quality", "gte", "1"), "quality >= 1"),
    ("lt", Predicate("n_chars", "lt", "500.5"), "n_chars < 500.5"),
    ("lte", Predicate("source", "lte", "src15"), "source <= 'src15'"),
    ("contains", Predicate("source", "contains", "RC1"), "lower(source) LIKE '%rc1%'"),
    ("number_against_text", Predicate("n_chars", "lt", "abc"), "n_chars IS NOT NULL"),
    ("text_as_number", Predicate("lang", "eq", "0"), "lang IS NOT NULL"),
]:
    _filter(_name, _p, _c)


@query("records_nested_field", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
def records_nested_field(spark, d):
    e = T.table(spark, d, "events").select("event_id", F.concat(F.lit('{"props":'), "props", F.lit("}")).alias("j"))
    return e.where(R.predicate(F.col("j"), Predicate.parse("props.k:gte:50"))).select("event_id")


@query("records_types", "SELECT * FROM (VALUES ('number', true), ('text number', true), ('text prefix', true), ('text', false), ('true', false), ('list', false), ('null', NULL), ('missing', NULL)) t(name, eq7)")
def records_types(spark, d):
    rows = [("number", '{"v":7}'), ("text number", '{"v":"7"}'), ("text prefix", '{"v":"7abc"}'), ("text", '{"v":"abc"}'), ("true", '{"v":true}'), ("list", '{"v":[7]}'), ("null", '{"v":null}'), ("missing", "{}")]
    j = spark.createDataFrame(rows, "name string, j string")
    return j.select("name", R.predicate(F.col("j"), Predicate("v", "eq", "7")).alias("eq7"))


@query("records_folder_scope", f"WITH {NOTES} SELECT path FROM notes WHERE path LIKE 'docs/src1/%'")
def records_folder_scope(spark, d):
    return R.list_records(T.document_notes(spark, d), "docs/src1/").select("path")


@query("records_sort_field", f"WITH {NOTES}, o AS (SELECT path, row_number() OVER (ORDER BY quality DESC NULLS LAST, path) AS place FROM notes) SELECT path, CAST(place AS INT) AS place FROM o WHERE place <= 40")
def records_sort_field(spark, d):
    from pyspark.sql import Window

    top = R.list_records(T.document_notes(spark, d), "", [], "-quality", 40)
    return top.select("path", F.row_number().over(Window.orderBy(*R.order(F.col("frontmatter"), "-quality"))).alias("place"))


@query("records_sort_path_desc", f"WITH {NOTES} SELECT path FROM notes ORDER BY path DESC LIMIT 15")
def records_sort_path_desc(spark, d):
    return R.list_records(T.document_notes(spark, d), "", [], "-path", 15).select("path")


@query("records_limit_offset", f"WITH {NOTES} SELECT path FROM notes WHERE lang = 'en' ORDER BY n_chars, path LIMIT 20 OFFSET 10")
def records_limit_offset(spark, d):
    return R.list_records(T.document_notes(spark, d), "docs", [Predicate("lang", "eq", "en")], "n_chars", 20, 10).select("path")


@query("collection_counts", f"WITH {NOTES} SELECT c AS collection, (SELECT count(*) FROM notes WHERE path LIKE f||'/%') AS n FROM (VALUES ('first', 'docs/src1'), ('second', 'docs/src2'), ('none', 'docs/nothing')) t(c, f)")
def collection_counts(spark, d):
    return R.collection_counts(T.document_notes(spark, d), {"first": "docs/src1", "second": "docs/src2", "none": "docs/nothing"})


@query("validate_required", f"WITH {NOTES} SELECT path, 'quality' AS field, 'required' AS problem FROM notes WHERE quality IS NULL")
def validate_required(spark, d):
    return R.validate(T.document_notes(spark, d), [Field("quality", "number", True), Field("toxic", "number")])


@query("validate_enum", f"WITH {NOTES} SELECT path, 'lang' AS field, 'value not in enum' AS problem FROM notes WHERE lang NOT IN ('en', 'de')")
def validate_enum(spark, d):
    return R.validate(T.document_notes(spark, d), [Field("lang", "enum", True, ("en", "de"))])


@query("validate_types", f"WITH {NOTES} SELECT path, unnest(['lang', 'source', 'n_chars']) AS field, unnest(['not a number', 'not a date', 'not a tags']) AS problem FROM notes")
def validate_types(spark, d):
    return R.validate(T.document_notes(spark, d), [Field("lang", "number"), Field("source", "date"), Field("n_chars", "tags"), Field("toxic", "number")])


@query("patch_fields", f"WITH {NOTES} SELECT path, source, 'done' AS status, CAST(NULL AS VARCHAR) AS lang FROM notes")
def patch_fields(spark, d):
    p = R.patched(F.col("frontmatter"), F.lit('{"status":"done","lang":null}'))
    return T.document_notes(spark, d).select("path", p.alias("j")).select("path", *[F.get_json_object("j", f"$.{k}").alias(k) for k in ("source", "status", "lang")])


WIKI = rf"""{ENTITIES}, w AS (SELECT path, unnest(regexp_extract_all(body, '\[\[([^\]\[]+)\]\]', 1)) AS raw FROM entities)"""
MD = rf"""{ENTITIES}, m AS (SELECT path, unnest(regexp_extract_all(body, '\[[^\]]*\]\(([^()\s]+)\)', 1)) AS raw FROM entities)"""


@query("wikilinks_extract", f"WITH {WIKI} SELECT path, split_part(raw, '|', 1) AS target, CASE WHEN raw LIKE '%|%' THEN lower(split_part(raw, '|', 1))||','||lower(split_part(raw, '|', 2)) ELSE lower(raw) END AS candidates FROM w")
def wikilinks_extract(spark, d):
    return L.wikilinks(T.entity_notes(spark, d)).select("path", "target", F.array_join("candidates", ",").alias("candidates"))


@query("markdown_links_extract", f"WITH {MD} SELECT path, regexp_replace(raw, '\\.\\./|\\.md', '', 'g') AS resolved FROM m")
def markdown_links_extract(spark, d):
    return L.markdown_links(T.entity_notes(spark, d)).select("path", F.get("candidates", F.lit(0)).alias("resolved"))


RESOLVED = rf"""{ENTITIES}, keys AS (SELECT path, regexp_replace(path, '\.md$', '') AS key FROM entities),
 lk AS (SELECT path, 'wikilink' AS kind, split_part(raw, '|', 1) AS target FROM (SELECT path, unnest(regexp_extract_all(body, '\[\[([^\]\[]+)\]\]', 1)) AS raw FROM entities)
 UNION ALL SELECT path, 'markdown-link', regexp_extract(regexp_replace(raw, '\.\./|\.md', '', 'g'), '[^/]+$') FROM (SELECT path, unnest(regexp_extract_all(body, '\[[^\]]*\]\(([^()\s]+)\)', 1)) AS raw FROM entities)),
 resolved AS (SELECT lk.path, lk.kind, lk.target, k.key AS dst FROM lk LEFT JOIN keys k ON regexp_extract(k.key, '[^/]+$') = lk.target)"""


def resolved(spark, d):
    n = T.entity_notes(spark, d)
    return L.resolve(L.edges(n), n)


@query("link_resolution", f"WITH {RESOLVED} SELECT path, kind, dst FROM resolved")
def link_resolution(spark, d):
    return resolved(spark, d).select("path", "kind", "dst")


@query("link_ambiguous_basename", "SELECT 'x/a.md' AS path, 'b/same-name' AS asked, CAST(NULL AS VARCHAR) AS dst WHERE false UNION ALL SELECT * FROM (VALUES ('x/a.md', 'same-name', NULL), ('b/c.md', 'same-name', 'b/same-name'), ('x/a.md', 'only here', 'z/only-here'), ('x/a.md', 'z/only here', 'z/only-here'), ('x/a.md', 'sub', 'x/sub')) t(path, asked, dst)")
def link_ambiguous_basename(spark, d):
    rows = [("x/a.md", "[[same-name]] [[only here]] [[z/only here]] [[./sub]]"), ("b/c.md", "[[same-name]]"), ("b/same-name.md", ""), ("d/same-name.md", ""), ("z/only-here.md", ""), ("x/sub.md", "")]
    n = spark.createDataFrame(rows, "path string, body string")
    # a link's target is its base name; the candidates keep the folder
    w = L.wikilinks(n)
    out = L.resolve(w.withColumn("kind", F.element_at("candidates", -1)), n)
    return out.select("path", F.regexp_replace("kind", r"^\./", "").alias("asked"), "dst")


@query("broken_links", f"""WITH {RESOLVED}, p AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS target FROM pages)
 SELECT path AS "from", target, kind FROM resolved WHERE dst IS NULL UNION ALL SELECT DISTINCT 'page-'||page_id, target, 'href' FROM p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.url = p.target)""")
def broken_links(spark, d):
    pages = T.table(spark, d, "pages")
    href = pages.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("from"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("target")).distinct()
    lost = href.join(pages.select(F.col("url").alias("target")), "target", "left_anti").select("from", "target", F.lit("href").alias("kind"))
    return L.broken(resolved(spark, d)).unionByName(lost)


@query("orphans", f"WITH {RESOLVED} SELECT path FROM entities e WHERE path NOT IN (SELECT path FROM lk) AND regexp_replace(path, '\\.md$', '') NOT IN (SELECT dst FROM resolved WHERE dst IS NOT NULL)")
def orphans(spark, d):
    return L.orphans(T.entity_notes(spark, d), resolved(spark, d))


@query("in_degree", f"WITH {RESOLVED} SELECT dst, count(*) AS n FROM resolved WHERE dst IS NOT NULL GROUP BY 1")
def in_degree(spark, d):
    return resolved(spark, d).where("dst is not null").groupBy("dst").agg(F.count("*").alias("n"))


@query("edge_count", f"WITH {RESOLVED} SELECT count(*) AS edges, count(dst) AS resolved FROM resolved")
def edge_count(spark, d):
    return resolved(spark, d).agg(F.count("*").alias("edges"), F.count("dst").alias("resolved"))


FK = """nodes AS (SELECT 'region-'||r_regionkey AS key FROM region UNION ALL SELECT 'nation-'||n_nationkey FROM nation UNION ALL SELECT 'supplier-'||s_suppkey FROM supplier UNION ALL SELECT 'customer-'||c_custkey FROM customer),
 edges AS (SELECT 'nation-'||n_nationkey AS src, 'region-'||n_regionkey AS dst FROM nation UNION ALL SELECT 'supplier-'||s_suppkey, 'nation-'||s_nationkey FROM supplier UNION ALL SELECT 'customer-'||c_custkey, 'nation-'||c_nationkey FROM customer WHERE c_custkey % 5 <> 0),
 both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), deg AS (SELECT src, count(*) AS deg FROM both_ GROUP BY 1)"""


def foreign_keys(spark, d):
    """Nodes and edges of the key tree; every fifth customer is left without an edge."""
    t = lambda n: T.table(spark, d, n)
    name = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
    nodes = t("region").select(name("region", "r_regionkey").alias("key"))
    for kind, table, c in (("nation", "nation", "n_nationkey"), ("supplier", "supplier", "s_suppkey"), ("customer", "customer", "c_custkey")):
        nodes = nodes.unionByName(t(table).select(name(kind, c).alias("key")))
    edges = t("nation").select(name("nation", "n_nationkey").alias("src"), name("region", "n_regionkey").alias("dst"))
    edges = edges.unionByName(t("supplier").select(name("supplier", "s_suppkey").alias("src"), name("nation", "s_nationkey").alias("dst")))
    return nodes, edges.unionByName(t("customer").where("c_custkey % 5 <> 0").select(name("customer", "c_custkey").alias("src"), name("nation", "c_nationkey").alias("dst")))


def _pagerank_sql(restart: str, out: str) -> str:
    return f"""WITH RECURSIVE {FK}, base AS (SELECT key, {restart} AS r, coalesce(deg, 0) AS deg FROM nodes LEFT JOIN deg ON key = src),
 pr(i, key, p) AS (SELECT 0, key, r FROM base UNION ALL SELECT * FROM (WITH cur AS (SELECT * FROM pr), got AS (SELECT b.dst AS key, sum(c.p / d.deg) AS g FROM cur c JOIN both_ b ON b.src = c.key JOIN deg d ON d.src = c.key GROUP BY 1),
 loose AS (SELECT coalesce(sum(c.p), 0) AS d FROM cur c JOIN base ON base.key = c.key WHERE base.deg = 0)
 SELECT (SELECT max(i) FROM cur) + 1, base.key, 0.85 * coalesce(g, 0) + (0.15 + 0.85 * (SELECT d FROM loose)) * base.r FROM base LEFT JOIN got ON got.key = base.key WHERE (SELECT max(i) FROM cur) < 30))
 {out}"""


@query("pagerank_top", _pagerank_sql("1.0::DOUBLE / (SELECT count(*) FROM nodes)", "SELECT key, round(p, 9) AS score FROM pr WHERE i = 30 ORDER BY round(p, 12) DESC, key LIMIT 30"))
def pagerank_top(spark, d):
    return G.top_pagerank(G.pagerank(*foreign_keys(spark, d)), 30).select("key", F.round("score", 9).alias("score"))


@query("pagerank_personalized", _pagerank_sql("CASE key WHEN 'nation-3' THEN 2.0 / 3 WHEN 'customer-7' THEN 1.0 / 3 ELSE 0.0 END::DOUBLE", "SELECT key, round(p, 9) AS score FROM pr WHERE i = 30 ORDER BY round(p, 12) DESC, key LIMIT 30"))
def pagerank_personalized(spark, d):
    seeds = spark.createDataFrame([("nation-3",), ("customer-7",), ("nation-3",), ("no such note",)], "key string")
    return G.top_pagerank(G.pagerank(*foreign_keys(spark, d), seeds=seeds), 30).select("key", F.round("score", 9).alias("score"))


@query("neighbors_2hop", f"WITH {FK}, one AS (SELECT dst AS key FROM both_ WHERE src = 'nation-1'), two AS (SELECT DISTINCT dst AS key FROM both_ WHERE src IN (SELECT key FROM one)) SELECT key, CAST(1 AS INT) AS hop FROM one UNION ALL SELECT key, CAST(2 AS INT) FROM two WHERE key <> 'nation-1' AND key NOT IN (SELECT key FROM one)")
def neighbors_2hop(spark, d):
    nodes, edges = foreign_keys(spark, d)
    return G.neighbors(nodes, edges, "nation-1", 2).select("key", "hop")


@query("code_mask", "SELECT * FROM (VALUES ('inline', 'b'), ('fence', 'b'), ('tilde', 'b'), ('escaped', 'b'), ('open', 'b')) t(path, links)")
def code_mask(spark, d):
    rows = [("inline", "see `[[a]]` and [[b]]"), ("fence", "```\n[[a]]\n```\n[[b]]"), ("tilde", "~~~ x\n[[a]]\n~~~\n[[b]]"), ("escaped", "\\`[[b]]\\`"), ("open", "`` [[b]] `")]
    n = spark.createDataFrame(rows, "path string, raw string").withColumn("body", L.prose(F.col("raw")))
    return n.select("path", F.array_join(F.regexp_extract_all("body", F.lit(L.WIKI), F.lit(1)), ",").alias("links"))
