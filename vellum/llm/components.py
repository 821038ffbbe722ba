"""Connected components of an edge table by alternating star contractions, all in DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _forest(batches):
    """A spanning forest of a partition's edges: every node under the smallest node of its tree."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > 500_000:
            yield _rows(up, root)
            up.clear()
    if up:
        yield _rows(up, root)


def _rows(up, root):
    pairs = [(x, r) for x in up if (r := root(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (u, v) reaches. Isolated nodes are absent."""
    e = scratch.settle(edges.select("u", "v").where("u <> v").mapInArrow(_forest, "u long, v long").distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        new = scratch.settle(_small_star(_large_star(e)).where("u <> v").distinct(), "edges")
        scratch.drop(e.sparkSession, e)
        e = new
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
