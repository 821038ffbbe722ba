"""Change feed: digests, commitments, contradictions, staleness and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as X

from . import globs, recall
from .search import POOL, RRF_K

#: Folder names of templates (fixed values).
TEMPLATES = ["template", "templates", "_templates"]
JACCARD_FLOOR, PER_ANCHOR, TOTAL, LEAST_TOKENS, SCORE_FLOOR, RECALL = 0.12, 3, 20, 2, 0.012, 8
#: Consecutive commit numbers that one task sorts at most.
STEP = 1 << 16


def since(feed: DataFrame, cursor: int | None, seq: str = "seq") -> DataFrame:
    """Changes after the cursor; all without one."""
    return feed if cursor is None else feed.where(F.col(seq) > cursor)


def lag(feed: DataFrame, cursor: int, seq: str = "seq") -> DataFrame:
    """K4: commits behind the head."""
    return feed.agg(F.count_if(F.col(seq) > cursor).alias("behind"))


def commitments(notes: DataFrame) -> DataFrame:
    """(path, line_no, line) of action items."""
    lines = notes.select("path", F.posexplode(F.split("body", "\n")).alias("line_no", "raw"))
    return lines.where(X.is_commitment(F.col("raw"))).select("path", "line_no", X.strip(F.col("raw")).alias("line"))


def digest(changes: DataFrame) -> DataFrame:
    """Changed paths by area: how many, how many deleted, and the sorted paths. The lists group by area and path first, so a hot area sends each path once."""
    paths = changes.groupBy(X.top_area(F.col("path")).alias("area"), "path").agg(F.max_by("status", "seq").alias("status"))
    return paths.groupBy("area").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "D").alias("deleted"), F.array_join(F.slice(F.sort_array(F.collect_list("path")), 1, 3), ",").alias("first_paths"))


def anchors(notes: DataFrame) -> DataFrame:
    """(path, line_no, line, cue, reversal, tokens) of lines with a cue; headings have none."""
    lines = notes.select("path", F.posexplode(F.split("body", "\n")).alias("line_no", "raw")).where(F.col("raw").rlike(X.ANY_CUE))
    stripped = lines.select("path", "line_no", X.strip(F.col("raw")).alias("line")).where(~F.col("line").startswith("#"))
    found = stripped.select("*", F.inline(F.filter(F.array(X.anchor(F.col("line"))), lambda a: a.isNotNull())))
    return found.select("path", "line_no", "line", "cue", "reversal", X.content_tokens(F.col("line")).alias("tokens"))


def recalled(anchor_lines: DataFrame, chunks: DataFrame, terms: dict[str, float], limit: int = RECALL) -> DataFrame:
    """(path_a, line_no_a, path_b, hit, place): for each anchor line the first `limit` notes that full-text search gives for it."""
    asked = anchor_lines.where(F.size("tokens") >= LEAST_TOKENS).select(F.col("path").alias("path_a"), F.col("line_no").alias("line_no_a"), X.terms(F.col("line")).alias("terms"))
    q = ["path_a", "line_no_a"]
    hits = recall.best(asked, recall.postings(chunks, ["path", "ord"], terms), q, ["path", "ord"], limit * POOL)
    return recall.notes(hits, q, limit, RRF_K).withColumnRenamed("path", "path_b")


def opposed(a_side: DataFrame, b_side: DataFrame, found: DataFrame, floor: float = JACCARD_FLOOR, least: float = SCORE_FLOOR) -> DataFrame:
    """For each anchor and recalled note the line of the other polarity that shares most words, the first of equal ones.

    Notes with the anchor's collection key are other versions of one record and take no part.
    """
    side = lambda df, s, more: df.select(F.col("path").alias(f"path_{s}"), F.col("line_no").alias(f"line_no_{s}"), F.col("line").alias(f"line_{s}"), F.col("cue").alias(f"cue_{s}"), F.col("reversal").alias(f"rev_{s}"), F.col("tokens").alias(f"tokens_{s}"), *more)
    some = found.where((F.col("path_a") != F.col("path_b")) & (F.col("hit") >= least) & (X.collection_key(F.col("path_a")) != X.collection_key(F.col("path_b"))))
    both = side(a_side, "a", []).join(some, ["path_a", "line_no_a"]).join(side(b_side, "b", []), "path_b").where("rev_a <> rev_b")
    both = both.withColumn("shared", F.sort_array(F.array_intersect("tokens_a", "tokens_b")))
    both = both.withColumn("jaccard", F.size("shared") / (F.size("tokens_a") + F.size("tokens_b") - F.size("shared"))).where((F.size("shared") > 0) & (F.col("jaccard") >= floor)).drop("tokens_a", "tokens_b")
    best = F.max_by(F.struct(*both.columns), F.struct("jaccard", F.negate("line_no_b")))
    return both.groupBy("path_a", "line_no_a", "path_b").agg(best.alias("b")).select("b.*").withColumn("cue", F.when(F.col("rev_a"), F.col("cue_a")).otherwise(F.col("cue_b")))


def excluded(path: Column, frontmatter: Column) -> Column:
    """Notes that say which note replaced them or until when they held, and templates, take no part."""
    given = lambda k: F.coalesce(X.strip(F.get_json_object(frontmatter, f"$.{k}")), F.lit("")) != ""
    folders = F.split(F.lower(path), "/")
    return given("superseded_by") | given("valid_to") | F.arrays_overlap(folders, F.array(*[F.lit(x) for x in TEMPLATES]))


def sources(notes: DataFrame, indexes: DataFrame | None = None) -> DataFrame:
    """Notes that may contradict others; `indexes` (path) are directory indexes, which take no part."""
    some = notes.where(~excluded(F.col("path"), F.col("frontmatter")))
    return some if indexes is None else some.join(indexes.select("path"), "path", "left_anti")


def governing(docs: DataFrame, path: str) -> DataFrame:
    """M4: documents with a glob that matches one path."""
    patterns = docs.select("path", F.explode("governs").alias("pattern"))
    return patterns.where(F.rlike(F.lit(path), X.glob_pattern(F.col("pattern")))).groupBy("path").agg(F.sort_array(F.collect_set("pattern")).alias("matched"))


def contradictions(pairs: DataFrame, per_anchor: int = PER_ANCHOR, total: int = TOTAL) -> DataFrame:
    """the first `per_anchor` notes of a line, the best pair of two notes, `total` in all by similarity and hit."""
    some = pairs.withColumn("k", F.row_number().over(Window.partitionBy("path_a", "line_no_a").orderBy("place"))).where(F.col("k") <= per_anchor)
    keyed = some.withColumn("pair", X.pair_key(F.col("path_a"), F.col("path_b"))).withColumn("score", F.col("jaccard") + F.col("hit"))
    order = [F.desc(F.round("score", 9)), "path_a", "path_b", "line_a", "line_no_a", "line_b"]
    first = keyed.withColumn("p", F.row_number().over(Window.partitionBy("pair").orderBy(*order))).where("p = 1")
    return first.orderBy(*order).limit(total).drop("k", "p", "pair")


def last_changes(feed: DataFrame) -> DataFrame:
    """First and last change of each path."""
    return feed.groupBy("path").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


def _commits_after(points: DataFrame, commits: DataFrame) -> DataFrame:
    """points (k, at) with commits: how many distinct numbers seq of (k, seq) are above at. No point meets a commit.

    Numbers fall into steps of STEP. The commits of later steps come from running totals over a key's steps, those of
    the point's own step from one sort of at most STEP numbers and the points there; a hot key spreads over its steps.
    """
    step = lambda c: F.floor(F.col(c) / STEP)
    seen = commits.select("k", "seq").distinct().withColumn("step", step("seq"))
    asked = points.select("k", F.col("at").alias("seq")).distinct().withColumn("step", step("seq"))
    lone = asked.groupBy("k", "step").agg(F.lit(0).cast("long").alias("n"))
    totals = seen.groupBy("k", "step").agg(F.count("*").alias("n")).unionByName(lone).groupBy("k", "step").agg(F.sum("n").alias("n"))
    later = totals.withColumn("later", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("k", "step", "later")
    both = seen.withColumn("own", F.lit(1)).unionByName(asked.withColumn("own", F.lit(0)))
    above = F.coalesce(F.sum("own").over(Window.partitionBy("k", "step").orderBy(F.desc("seq"), "own").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = both.withColumn("above", above).where("own = 0").select("k", "seq", "step", "above")
    counted = within.join(later, ["k", "step"]).select("k", F.col("seq").alias("at"), (F.col("above") + F.col("later")).alias("commits"))
    return points.join(counted, ["k", "at"]).where("commits > 0")


def drift(doc_feed: DataFrame, bindings: DataFrame, file_feed: DataFrame) -> DataFrame:
    """(doc, file, commits): distinct commits to a bound file after the document's last one; a document without commits never drifts."""
    last = doc_feed.groupBy(F.col("path").alias("doc")).agg(F.max("seq").alias("at"))
    points = bindings.select("doc", F.col("file").alias("k")).distinct().join(last, "doc")
    return _commits_after(points, file_feed.select(F.col("path").alias("k"), "seq")).select("doc", F.col("k").alias("file"), "commits")


def stale(doc_feed: DataFrame, bindings: DataFrame, file_feed: DataFrame, status: DataFrame) -> DataFrame:
    """K5: (doc, commits): distinct commits to any bound file after the last one of a document of status Implemented.

    Documents with the same set of files share its commits, so each set meets its files' commits once.
    """
    last = doc_feed.groupBy(F.col("path").alias("doc")).agg(F.max("seq").alias("at"))
    live = bindings.join(status.where("status = 'Implemented'").select("doc"), "doc", "left_semi").join(last, "doc")
    files = live.groupBy("doc", "at").agg(F.sort_array(F.collect_set("file")).alias("files"))
    points = files.select("doc", "at", "files", F.sha2(F.to_json("files"), 256).alias("k"))
    sets = points.groupBy("k").agg(F.first("files").alias("files")).select("k", F.explode("files").alias("file"))
    commits = sets.join(file_feed.select(F.col("path").alias("file"), "seq").distinct(), "file")
    return _commits_after(points.select("doc", "at", "k"), commits).select("doc", "commits")


def governed(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, pattern, file) of files (path) that a document's globs match, by a walk of both trees."""
    return globs.governed(docs, files.select(F.col("path").alias("file"))).select("path", "pattern", "file")
