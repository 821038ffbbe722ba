"""Incremental runs as Structured Streaming over arriving Parquet files: each run takes what is new, then ends (K1, K2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.operators.store import Store


def run_available(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, transform) -> None:
    """One run: new files through `transform` into Parquet at sink. The checkpoint is the cursor; a second run adds nothing."""
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        # the batch number makes a repeated batch overwrite its own rows
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_index(spark: SparkSession, source: str, schema: StructType, store: Store, checkpoint: str) -> None:
    """One run of the index over arriving changes (path, title, tags, body, deleted, seq): each batch is one version of the store.

    Of a path's changes in a batch the last one counts; of equal numbers the greatest row, a removal first. The batch number goes into the version, so a batch that is run
    again after a failure changes nothing if it had been committed, and starts over if it had not.
    """

    def apply(batch: DataFrame, number: int) -> None:
        # texts are shuffled once, for the fresh notes; the paths that go come from narrow rows in the same order
        last = lambda *cs: batch.groupBy("path").agg(F.max(F.struct("seq", "deleted", *cs)).alias("c")).select("path", "c.*")
        texts = [F.when(~F.col("deleted"), F.col(c)).alias(c) for c in batch.columns if c not in ("path", "seq", "deleted")]
        store.apply(number, last(*texts).where("NOT deleted").drop("deleted", "seq"), last().where("deleted").select("path"), apart=True)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type with a watermark; works on batch and streaming tables alike."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
