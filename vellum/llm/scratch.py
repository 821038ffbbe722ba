"""Where intermediate tables go: the shared folder named in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A column of placed(): a hash of the row's file and its number there.
PLACE = "__place"


def folder(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only where none is configured and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, each: int) -> int:
    """Partitions so that each has about `each` bytes of df as the optimizer estimates them, the session's number at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60  # rows that no file holds have no estimate
    return max(least, -(-size // each)) if known else least


def placed(df: DataFrame) -> DataFrame:
    """df with PLACE, the same for a row whenever the plan runs; rows that are not read from files are settled first."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(PLACE)
    try:
        return df.select("*", place)
    except AnalysisException:
        return settle(df, "rows").select("*", place)


def drop(spark: SparkSession, df_or_path) -> None:
    """Remove a settled table that is no longer read."""
    jvm = spark._jvm
    paths = [df_or_path] if isinstance(df_or_path, str) else sorted({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of finished queries that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
