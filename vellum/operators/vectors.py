"""Batch neighbours by vectors: an inverted file of cells around coarse centres, and an exact route.

The centres are fitted on a sample of bounded size; every row is assigned to its nearest centre and dealt into blocks of
about BLOCK rows of its cell. A query meets only the blocks of the cells whose centres are nearest to it, and the
similarities there are computed exactly, block by block, as matrix products inside tasks. How many cells a query needs
is measured on the sample: the least number with which TARGET of its rows find their nearest one; in the whole table a
nearest row is nearer still, so that the share there is higher rather than lower. On the exact route a query
meets the blocks of all rows of its length. Blocks of rows and blocks of queries are the groups of the join, so neither
a crowded cell nor a cell that very many queries ask makes a large group.

Null keys and null or empty vectors take no part; a vector of length zero has similarity 0 with every other. Vectors of
another number of dimensions than the centres' take no part in an index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

VECTOR = "array<double>"
#: Rows of the sample that the centres are fitted on, centres at most, passes over the sample; rows or queries of a block.
SAMPLE, CENTRES, PASSES, BLOCK = 1 << 14, 1 << 10, 8, 1 << 12
#: Share of the sample's rows that must find their nearest one, and how many of them are asked.
TARGET, TRIED = 0.95, 1 << 9


def ready(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v) of the rows that take part."""
    return df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast(VECTOR).alias("v")).where("k IS NOT NULL AND size(v) > 0")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclass(frozen=True)
class Coarse:
    """Unit centres of the cells, and how many cells a query reads."""

    centres: np.ndarray
    probes: int


def fit(rows: DataFrame, centres: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> Coarse:
    """Centres by k-means on at most `sample` rows, chosen by a hash of key and vector; the square root of the rows by default."""
    n = rows.count()
    share = max(1, n // sample)
    some = rows.where(F.pmod(F.xxhash64("k", "v"), F.lit(share)) == 0).select("v").limit(sample).toArrow()["v"].to_pylist()
    if not some:
        return Coarse(np.zeros((0, 1)), 1)
    lengths = [len(v) for v in some]
    x = unit(np.array([v for v in some if len(v) == max(set(lengths), key=lengths.count)], np.float64))
    c = min(centres or int(np.ceil(np.sqrt(n))), CENTRES, len(x))
    out = x[np.random.default_rng(7).choice(len(x), c, replace=False)]
    for _ in range(PASSES):
        own = (x @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        full = np.linalg.norm(sums, axis=1) > 0
        out = np.where(full[:, None], unit(sums), out)
    return Coarse(out, probes_for(x, out, target))


def probes_for(x: np.ndarray, centres: np.ndarray, target: float) -> int:
    """The least number of cells with which `target` of some rows of x find their nearest other row."""
    own, asked = (x @ centres.T).argmax(1), np.random.default_rng(8).permutation(len(x))[:TRIED]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -2
    to = x[asked] @ centres.T
    of_nearest = to[np.arange(len(asked)), own[s.argmax(1)]]
    place = np.sort((to > of_nearest[:, None]).sum(1))
    return int(place[min(len(place) - 1, int(np.ceil(target * len(place))) - 1)]) + 1


def _cells(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(k, v, cell) with the `probes` nearest cells of each row; the centres, at most CENTRES, go to all tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                part = part.filter(pa.array([len(v) == c.shape[1] for v in part.column("v")], pa.bool_()))
                if not part.num_rows or not len(c):
                    continue
                s = unit(np.array(part.column("v").to_pylist(), np.float64)) @ c.T
                p = min(probes, len(c))
                near = np.argpartition(-s, p - 1, axis=1)[:, :p] if p < len(c) else np.tile(np.arange(len(c)), (len(s), 1))
                rows_ = pa.array(np.repeat(np.arange(part.num_rows), p))
                yield pa.RecordBatch.from_arrays([part.column("k").take(rows_), part.column("v").take(rows_), pa.array(near.reshape(-1).astype(np.int32))], names=["k", "v", "cell"])

    return rows.select("k", "v").mapInArrow(run, f"k long, v {VECTOR}, cell int")


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """rows (k, v, cell) with the number of their block in the cell and of the cell's blocks."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"{name}_blocks"))
    return rows.join(sizes, "cell").withColumn(name, F.pmod(F.xxhash64("k", "v"), F.col(f"{name}_blocks")).cast("int"))


def index(rows: DataFrame, coarse: Coarse) -> DataFrame:
    """The inverted file of rows (k, v), written: every row with its cell and block."""
    return written(_dealt(written(_cells(rows, coarse.centres, 1), "assigned"), "block"), "cells")


def near(queries: DataFrame, filed: DataFrame, k: int, coarse: Coarse | None = None, probes: int | None = None) -> DataFrame:
    """(query, k, score, rank): of each query (k, v) the k most similar rows with another key, the least key among equals.

    With centres, among the rows of the cells that it probes (`coarse.probes` by default); else `filed` comes from `exact` and all rows count.
    """
    asked = _cells(queries, coarse.centres, probes or coarse.probes) if coarse is not None else queries.withColumn("cell", F.size("v"))
    asked = _dealt(written(asked, "asked"), "turn")
    of_cell = filed.groupBy("cell").agg(F.first("block_blocks").alias("blocks"))
    turns = asked.groupBy("cell").agg(F.first("turn_blocks").alias("turns"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(of_cell, "cell").select("cell", "turn", every("blocks").alias("block"), "k", "v")
    right = filed.join(turns, "cell").select("cell", "block", every("turns").alias("turn"), "k", "v")

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("k", pa.int64()), ("score", pa.float64())])
        if not len(queries) or not len(rows):
            return schema.empty_table()
        ids, keys = queries["k"].to_numpy(), rows["k"].to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, x = keys[order], unit(np.array(rows["v"].to_pylist(), np.float64))[order]
        out: list[list[np.ndarray]] = [[], [], []]
        q = unit(np.array(queries["v"].to_pylist(), np.float64))
        for at in range(0, len(q), 512):
            s = q[at : at + 512] @ x.T
            own = ids[at : at + 512]
            s[own[:, None] == keys[None, :]] = -2
            n = min(k, len(keys))
            # rows that tie with the n-th stay, so that the least keys win in the end
            least = -np.partition(-np.round(s, 12), n - 1, axis=1)[:, n - 1]
            i, j = np.nonzero((np.round(s, 12) >= least[:, None]) & (s > -2))
            first = np.lexsort((keys[j], -np.round(s[i, j], 12), i))
            i, j = i[first], j[first]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[place < k], j[place < k]
            for o, v in zip(out, (own[i], keys[j], s[i, j])):
                o.append(v)
        return pa.table([pa.array(np.concatenate(o), t.type) for o, t in zip(out, schema)], schema=schema)

    met = left.groupBy("cell", "turn", "block").cogroup(right.groupBy("cell", "turn", "block")).applyInArrow(best, "query long, k long, score double")
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "k")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(rows: DataFrame) -> DataFrame:
    """rows (k, v) for the route over all rows: a cell is a number of dimensions."""
    return written(_dealt(rows.withColumn("cell", F.size("v")), "block"), "rows")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours that were found; 1 where there are none."""
    n = truth.count()
    return truth.join(found.select("query", "k"), ["query", "k"], "left_semi").count() / n if n else 1.0
