"""Document lint, ownership and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import issue

#: Fields that can be derived for a document; characters of a short commit id.
DERIVED, SHORT = ["type", "created", "updated"], 10


def commits(n: Column) -> Column:
    """A number of commits in words."""
    return F.concat(n.cast("string"), F.when(n == 1, " commit").otherwise(" commits"))


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, SHORT)


def title_or(title: Column, path: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", path).otherwise(title)


def tag(provenance: Column) -> Column:
    """An inline tag of the sources, nothing without them."""
    return F.when(F.size(provenance) > 0, F.concat(F.lit(" ["), F.array_join(provenance, ", "), F.lit("]"))).otherwise("")


def list_problem(frontmatter: Column, key: str) -> Column:
    """What is wrong with a value that must be a list of strings; null where it is one or is absent."""
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(frontmatter), f"$.{key}", "variant"))
    wrong = F.when(kind.startswith("ARRAY"), F.lit(f"{key} holds an item that is no string")).otherwise(F.lit(f"{key} must be a list of strings"))
    return F.when(kind.isNull() | kind.isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>"), F.lit(None).cast("string")).otherwise(wrong)


def ignored(path: Column, names: list[str], paths: list[str]) -> Column:
    """Dot names, ignored names anywhere in the path, ignored paths and what is below them."""
    parts = F.split(path, "/")
    out = F.element_at(parts, -1).startswith(".") | F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    for p in paths:
        out = out | (path == p) | path.startswith(p + "/")
    return out


def folders(path: Column) -> Column:
    """All folders above a path, the outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))


def owners(paths: DataFrame, collections: DataFrame) -> DataFrame:
    """(path, name): of the collections (name, path) whose folder holds the path the first by name. An equi-join on the path's folders."""
    above = paths.select("path", F.explode(folders(F.col("path"))).alias("folder"))
    homes = collections.where("path <> ''").select("name", F.rtrim(F.col("path"), F.lit("/")).alias("folder"))
    return above.join(homes, "folder").groupBy("path").agg(F.min("name").alias("name"))


def stray(notes: DataFrame, registered: list[str], agents: str = "docs/agents") -> DataFrame:
    """Notes under docs/ outside the registered folders, templates and the agents' folder."""
    path = F.col("path")
    known = (path == "docs/INDEX.md") | path.startswith("docs/templates/") | path.startswith(agents + "/")
    for f in registered:
        known = known | path.startswith(f + "/")
    return issue(notes.where(path.startswith("docs/") & ~known), "error", "stray-doc", detail=F.lit("markdown file under docs is outside registered collection folders"))


def ambiguous_names(named: DataFrame, linked: DataFrame) -> DataFrame:
    """Names (path, name) of several notes; bare ones only where a link (name) targets them, qualified ones always."""
    twice = named.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")
    bare = ~F.col("name").contains("/")
    shown = twice.where(~bare).unionByName(twice.where(bare).join(linked.select("name").distinct(), "name", "left_semi"))
    return issue(shown, "warn", "duplicate-name", detail=F.concat(F.lit("note name "), "name", F.lit(" is shared by "), F.col("n").cast("string"), F.lit(" files; wikilinks to it are ambiguous")))


def classified(edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, pos, target, kind) -> (links between notes, each target once with its first kind; code references).

    Links are taken as they are; of the others those to an existing Markdown file are links and those to another
    existing file code references, the rest goes.
    """
    is_link = F.col("kind").isin("wikilink", "markdown-link")
    there = edges.where(~is_link).join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi").select(*edges.columns)
    markdown = F.lower("target").endswith(".md")
    links = edges.where(is_link & (F.col("target") != "")).unionByName(there.where(markdown).withColumn("target", F.expr("substring(target, 1, length(target) - 3)")))
    first = links.groupBy("src", "target").agg(F.min_by("kind", "pos").alias("kind"))
    return first, there.where(~markdown).select("src", "target", "kind")


def code_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (path, ref) to existing files that are no notes."""
    return refs.where(~F.lower("ref").endswith(".md")).join(files.select(F.col("path").alias("ref")), "ref", "left_semi").select("path", "ref").distinct()


def page_links(links: DataFrame, pages: DataFrame, others: DataFrame) -> DataFrame:
    """Links (src, target) without those that hit a folder or another file and no page."""
    hit = others.select(F.col("path").alias("target")).distinct().join(pages.select(F.col("path").alias("target")), "target", "left_anti")
    return links.join(hit, "target", "left_anti").select(*links.columns)


def index_issues(expected: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Expected blocks (path, block) that are missing or differ on disk."""
    both = expected.join(on_disk.select("path", F.col("block").alias("has"), F.lit(True).alias("there")), "path", "left")
    missing = issue(both.where("there is null"), "warn", "directory-index-missing", detail=F.lit("configured directory is missing its index file"))
    old = both.where("there and not (has <=> block)")
    return missing.unionByName(issue(old, "warn", "directory-index-stale", detail=F.lit("generated directory index block is stale")))


def stale_docs(stale: DataFrame) -> DataFrame:
    """Issues of (doc, commits)."""
    return issue(stale, "warn", "stale-governed-doc", "doc", F.concat(F.col("commits").cast("string"), F.lit(" governed code commit(s) since doc update")))


def drifted(drift: DataFrame) -> DataFrame:
    """Issues of (doc, file, commits)."""
    said = F.concat(F.lit("references `"), "file", F.lit("`, which moved "), commits(F.col("commits")), F.lit(" since this doc was last touched; review"))
    return issue(drift, "warn", "drift", "doc", said)


def fixable(required: Column) -> Column:
    """Required fields that can be derived."""
    return F.array_intersect(required, F.array(*[F.lit(x) for x in DERIVED]))


def field_fixes(docs: DataFrame, dates: DataFrame) -> DataFrame:
    """(path, kind, detail) that would settle documents (path, doc_type, type, created, updated, required); dates: (path, first, last, changed), the file's date where it has no commits."""
    known = docs.join(dates, "path", "left").withColumn("can", fixable(F.col("required")))
    lacks = lambda c: F.array_contains("can", c) & (F.coalesce(F.col(c), F.lit("")) == "")
    wrong = F.array_contains("can", "type") & (F.col("type") != "") & (F.col("type") != F.col("doc_type"))
    fix = lambda when, kind, *said: F.when(when, F.struct(F.lit(kind).alias("kind"), F.concat(*said).alias("detail")))
    all_ = F.array(
        fix(lacks("type"), "missing-doc-field", F.lit("set type to "), "doc_type"),
        fix(wrong, "bad-doc-type", F.lit('rewrote type from "'), "type", F.lit('" to "'), "doc_type", F.lit('"')),
        fix(lacks("created"), "missing-doc-field", F.lit("set created to "), F.coalesce("first", "changed")),
        fix(lacks("updated"), "missing-doc-field", F.lit("set updated to "), F.coalesce("last", "changed")),
    )
    return known.select("path", F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("x")).select("path", "x.kind", "x.detail")


def merged_paths(*tables: DataFrame) -> DataFrame:
    """H3: the distinct paths of all tables, in order."""
    out = tables[0].select("path")
    for t in tables[1:]:
        out = out.unionByName(t.select("path"))
    return out.distinct().orderBy("path")


def by_type(docs: DataFrame, ranks: list[str]) -> DataFrame:
    """Documents (type, path) by the place of their type in the list, others last, then by path."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ranks]), F.coalesce("type", F.lit("")))
    return docs.orderBy(F.when(rank > 0, rank).otherwise(len(ranks) + 1), "path")


def graph_report(nodes: DataFrame, resolved: DataFrame, orphans: DataFrame, scores: DataFrame, top: int = 10) -> DataFrame:
    """One row: notes, links, orphans, broken links and the keys of best rank; only the top ones meet in a list."""
    best = scores.orderBy(F.desc(F.round("score", 12)), "key").limit(top)
    ranked = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.round("score", 12)).alias("s"), "key"))), lambda x: x["key"]), ",").alias("top"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    links = resolved.agg(F.count("dst").alias("links"), F.count_if(F.col("dst").isNull()).alias("broken"))
    parts = [count(nodes, "notes"), links, count(orphans, "orphans"), ranked]
    keyed = [p.withColumn("one", F.lit(1)) for p in parts]
    out = keyed[0]
    for p in keyed[1:]:
        out = out.join(p, "one")
    return out.drop("one")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as JSON lines: nodes (key), then edges (src, dst)."""
    n = nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("key")).alias("json"))
    return n.unionByName(edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("src", "dst")).alias("json")))
