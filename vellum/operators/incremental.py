"""Incremental maintenance: snapshot difference, pruning, vector reuse, cursors."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """(path, status): added, changed, unchanged or deleted by content hash. One full outer join on the path."""
    a, b = new.select("path", F.col("content_hash").alias("new_hash")), old.select("path", F.col("content_hash").alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def pruned(stored: DataFrame, present: DataFrame) -> DataFrame:
    """Stored rows whose path is gone."""
    return stored.join(present.select("path"), "path", "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored rows of other paths, and the fresh rows."""
    touched = fresh.select("path").unionByName(gone.select("path")).distinct()
    return stored.join(touched, "path", "left_anti").unionByName(fresh)


def embed_plan(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks with the stored vector of their hash and model, or null: these must be embedded."""
    have = vectors.where(F.col("model") == model).dropDuplicates(["chunk_hash"]).select("chunk_hash", "vec")
    return chunks.join(have, "chunk_hash", "left").withColumn("reused", F.col("vec").isNotNull())


def refreshed(chunks: DataFrame, path: str, new: DataFrame | None = None) -> DataFrame:
    """The chunks after an index run of one path: its rows are those of `new`, none where its file is gone. Other pages than .md stay as they are."""
    if not path.lower().endswith(".md"):
        return chunks
    others = chunks.where(F.col("path") != path)
    return others if new is None else others.unionByName(new.where(F.col("path") == path).select(*chunks.columns))


class Cursors:
    """Named cursors in a small Parquet table; consumers move independently.

    Each move appends a row and the latest one of a key counts, so a reader never sees half a table and a move never
    loses another key. Only a table that does not exist yet is empty; any other error is raised.
    """

    SCHEMA = "key string, value long, at long"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def all(self) -> dict[str, int]:
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r["key"]: r["value"] for r in rows.groupBy("key").agg(F.max_by("value", "at").alias("value")).collect()}

    def get(self, key: str) -> int | None:
        return self.all().get(key)

    def set(self, key: str, value: int) -> None:
        self.spark.createDataFrame([(key, value, time.time_ns())], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
