"""The change feed between two snapshots of a tree, with kinds (A10): added, copied, modified, renamed, deleted.

A path of both snapshots is modified or unchanged. Of the others, a deleted and an added path with one content are a
rename, first those that keep their base name, then by order of paths, one to one. Added and deleted paths that are left
are compared by sketches: the LINES least hashes of their distinct lines. Two whose sketches share at least SIMILAR of
the larger one's hashes are a rename with edits; the most similar pairs come first, one to one. Of an order in which
rare hashes come first, such pairs share one among the first ones, so only these meet, and common lines make no pairs.
An added path that is left but has the content of an old one is a copy of the least such path.

Bodies are read once, for hashes and sketches; only these meet afterwards. Ranks in a group of equal contents come from salted parts and their running totals, so many copies make no large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as X

from .graph import written

LINES, SIMILAR, SALTS = 32, 0.5, 64
#: Rounds go on while more pairs are left and the last round settled at least this share of them.
FEW, WORTH = 1 << 17, 0.25


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with `place` from 0 in their group, in an order of their paths; no window holds more than a salt's share."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    sizes = salted.groupBy(*by, "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy(*by).orderBy("salt")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy(*by, "salt").orderBy("path"))
    return salted.withColumn("own", own).join(before, [*by, "salt"]).withColumn("place", F.col("before") + F.col("own") - 1).drop("salt", "own", "before")


def _paired(gone: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """(old_path, path): the rows of both sides with the same values, one to one."""
    left = _ranked(gone, by).withColumnRenamed("path", "old_path").select("old_path", *by, "place")
    return left.join(_ranked(new, by).select("path", *by, "place"), [*by, "place"]).select("old_path", "path")


def _without(rows: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    return rows.join(pairs.select(F.col(name).alias("path")), "path", "left_anti")


def sketch(body):
    """The LINES least hashes of the distinct lines of a body; blank lines don't count."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.slice(F.sort_array(F.array_distinct(F.transform(lines, lambda s: F.md5(s)))), 1, LINES)


def sketches(rows: DataFrame) -> DataFrame:
    """(path, h) of bodies that have a line."""
    return rows.select("path", sketch(F.col("body")).alias("h")).where("size(h) > 0")


def similar(gone: DataFrame, new: DataFrame) -> DataFrame:
    """(old_path, path, share) of sketches (path, h) that share at least SIMILAR of the larger one."""
    a, b = gone.select("path", "h").where("size(h) > 0"), new.select("path", "h").where("size(h) > 0")
    each = a.select(F.lit(0).alias("side"), "path", F.explode("h").alias("x")).unionByName(b.select(F.lit(1).alias("side"), "path", F.explode("h").alias("x")))
    often = each.groupBy("x").agg(F.count("*").alias("often"))
    ordered = each.join(often, "x").groupBy("side", "path").agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("o"))
    # of n hashes all but ceil(SIMILAR * n) - 1 stand in front: two sketches that share enough share one of these
    front = F.size("o") - F.ceil(F.size("o") * SIMILAR).cast("int") + 1
    keys = ordered.select("side", "path", F.explode(F.slice("o", 1, front)).alias("k")).select("side", "path", F.col("k.x").alias("x"))
    met = keys.where("side = 0").select("x", F.col("path").alias("old_path")).join(keys.where("side = 1").select("x", "path"), "x").select("old_path", "path").distinct()
    both = met.join(a.select(F.col("path").alias("old_path"), F.col("h").alias("ha")), "old_path").join(b.select("path", F.col("h").alias("hb")), "path")
    share = F.size(F.array_intersect("ha", "hb")) / F.greatest(F.size("ha"), F.size("hb"))
    return both.select("old_path", "path", share.alias("share")).where(F.col("share") >= SIMILAR)


def matched(pairs: DataFrame) -> DataFrame:
    """(old_path, path, share): the most similar pairs first, one to one. Each round takes the pairs that are the best of both sides.

    A chain of pairs that wait for each other takes a round a link, as does each member of a group of equal pairs. So
    once rounds settle little, the pairs that are left are sorted and settled in their order by one task, which holds
    the paths that are taken, not the pairs.
    """
    best = lambda by, ties: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("share"), *ties))
    left, out = written(pairs, "pairs"), None
    before, n = None, left.count()
    while n > FEW and (before is None or n <= (1 - WORTH) * before):
        ranked = left.withColumn("a", best("old_path", ["old_path", "path"])).withColumn("b", best("path", ["old_path", "path"]))
        won = written(ranked.where("a = 1 AND b = 1").drop("a", "b"), "won")
        out = won if out is None else out.unionByName(won)
        left = written(left.join(won.select("old_path"), "old_path", "left_anti").join(won.select("path"), "path", "left_anti"), "pairs")
        before, n = n, left.count()
    in_order = left.select("old_path", "path", "share").repartition(1).sortWithinPartitions(F.desc("share"), "old_path", "path")
    rest = in_order.mapInPandas(_in_order, "old_path string, path string, share double")
    return rest if out is None else out.select(*rest.columns).unionByName(rest)


def _in_order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted pairs each whose sides no earlier one took."""
    old, new = set(), set()
    for p in parts:
        kept = []
        for i, (x, y) in enumerate(zip(p["old_path"], p["path"])):
            if x not in old and y not in new:
                old.add(x)
                new.add(y)
                kept.append(i)
        if kept:
            yield p.iloc[kept]


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(status, path, old_path, share) between two snapshots (path, body): A, C, M, R or D; null bodies are empty ones."""
    text = F.coalesce("body", F.lit(""))
    side = lambda df: df.select("path", X.content_hash(text).alias("hash"), sketch(text).alias("h"))
    a, b = written(side(old), "old"), written(side(new), "new")
    row = lambda df, status, old_path=None, share=None: df.select(F.lit(status).alias("status"), "path", (F.col(old_path) if old_path else F.lit(None).cast("string")).alias("old_path"), (F.col(share) if share else F.lit(None).cast("double")).alias("share"))
    modified = b.select("path", F.col("hash").alias("now")).join(a.select("path", "hash"), "path").where("now <> hash")
    # what stands on one side only, with its sketch, is written once
    alone = lambda x, y, name: written(x.join(y.select("path"), "path", "left_anti").withColumn("base", X.base_name(F.col("path"))), name)
    old_alone, new_alone = alone(a, b, "gone"), alone(b, a, "fresh")
    gone, fresh = old_alone, new_alone
    same_name = written(_paired(gone, fresh, ["hash", "base"]), "renamed")
    gone, fresh = _without(gone, same_name, "old_path"), _without(fresh, same_name, "path")
    moved = written(_paired(gone, fresh, ["hash"]), "renamed")
    gone, fresh = _without(gone, moved, "old_path"), _without(fresh, moved, "path")
    copies = fresh.join(a.groupBy("hash").agg(F.min("path").alias("old_path")), "hash")
    fresh = fresh.join(a.select("hash").distinct(), "hash", "left_anti")
    edited = written(matched(similar(gone, fresh)), "edited")
    whole = same_name.unionByName(moved).withColumn("share", F.lit(1.0))
    parts = [row(modified, "M"), row(whole.unionByName(edited), "R", "old_path", "share"), row(copies, "C", "old_path"), row(_without(gone, edited, "old_path"), "D"), row(_without(fresh, edited, "path"), "A")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
