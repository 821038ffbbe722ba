"""Path patterns against file trees: a trie of pattern segments walked along the folders.

Patterns become edges (node, segment, child), a node being the segments so far, so that patterns with the same beginning
share its nodes. Paths become edges (folder, segment, child) in the same way, so that files of a folder share its walk.
One step joins the reached (folder, node) pairs with the folders' children, and these with the node's edges: literal
segments by equality of node and segment, segments with wildcards by node and by equality of what stands before their
first wildcard and after their last, then by a regular expression. No pattern meets a path that its beginning does not
match, and nothing joins on depth alone. There are as many steps as the longest
pattern has segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X

from .graph import written

WILD = r"[*?\[\\]"
#: What stands before the first wildcard of a segment and after the last.
BEFORE, AFTER = r"^([^*?\[\\]*)", r"([^*?\[\]\\]*)$"


def _edges(texts: DataFrame, name: str) -> DataFrame:
    """Distinct (level, head, seg, tail): each path's beginnings, tail being head and the segment after it."""
    parts = texts.select(F.split(name, "/").alias("s"))
    at = parts.select("s", F.posexplode("s").alias("level", "seg"))
    joined = lambda n: F.array_join(F.slice("s", 1, n), "/")
    return at.select("level", joined(F.col("level")).alias("head"), "seg", joined(F.col("level") + 1).alias("tail")).distinct()


def matches(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (pattern, file) for patterns (pattern) and files (file): * and ? stay within a segment, [..] are classes."""
    wanted = patterns.select("pattern").where("pattern <> ''").distinct()
    trie, tree = written(_edges(wanted, "pattern"), "trie"), written(_edges(files.select("file").distinct(), "file"), "tree")
    wild = F.col("seg").rlike(WILD)
    literal, loose = trie.where(~wild), trie.where(wild).select("level", F.col("head").alias("node"), F.col("tail").alias("next"), X.glob_pattern(F.col("seg")).alias("re"), F.regexp_extract("seg", BEFORE, 1).alias("before"), F.regexp_extract("seg", AFTER, 1).alias("after"))
    exact = literal.select("level", F.col("head").alias("node"), "seg", F.col("tail").alias("next"))
    depth = (trie.agg(F.max("level")).first()[0] or 0) if not wanted.isEmpty() else -1
    reached = wanted.sparkSession.createDataFrame([("", "")], "head string, node string")
    out = None
    for level in range(depth + 1):
        here = F.col("level") == level
        step = reached.join(tree.where(here).select("head", "seg", "tail"), "head")
        plain = step.join(exact.where(here).drop("level"), ["node", "seg"]).select("tail", "next")
        some = loose.where(here).drop("level").withColumns({"b": F.char_length("before"), "a": F.char_length("after")})
        cut = step.join(some.select("node", "b", "a").distinct(), "node").withColumns({"before": F.left("seg", F.col("b")), "after": F.right("seg", F.col("a"))})
        fits = cut.join(some, ["node", "b", "a", "before", "after"]).where(F.rlike("seg", F.col("re"))).select("tail", "next")
        reached = written(plain.unionByName(fits).select(F.col("tail").alias("head"), F.col("next").alias("node")), "reached")
        # a pair is unique, as its folder and its node each have one way from the root
        ends = reached.select(F.col("node").alias("pattern"), F.col("head").alias("file"), F.lit(level + 1).alias("size"))
        out = ends if out is None else out.unionByName(ends)
    if out is None:
        return wanted.select("pattern", F.lit("").alias("file")).limit(0)
    deep = lambda c: F.size(F.split(c, "/"))
    whole = out.join(wanted.withColumn("size", deep("pattern")), ["pattern", "size"], "left_semi")
    return whole.join(files.select("file").distinct().withColumn("size", deep("file")), ["file", "size"], "left_semi").select("pattern", "file")


def governed(docs: DataFrame, local: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """(path, pattern, file, tree) of documents (path, governs): a pattern's files in the notes' own tree, else in the source tree."""
    globs = docs.select("path", F.explode("governs").alias("pattern")).where("pattern <> ''").distinct()
    own = matches(globs, local).withColumn("tree", F.lit("local"))
    if source is not None:
        own = written(own, "matched")
        rest = globs.join(own, "pattern", "left_anti")
        own = own.unionByName(matches(rest, source).withColumn("tree", F.lit("source")))
    return globs.join(own, "pattern").select("path", "pattern", "file", "tree")
