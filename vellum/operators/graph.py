"""Graph operators: neighbours, PageRank, personalised PageRank."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITERATIONS, DAMPING = 30, 0.85
#: Iterations after which the ranks are written, so that neither lineage nor plan grows without bound.
CUT = 10


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir (a temporary one only where none is set and the master is local)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) in both directions."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(key, score). Undirected, neighbours distinct, a fixed number of iterations; the mass of nodes without neighbours
    and the damping go to the restart vector: uniform, or the seeds (key, with multiplicity) that are nodes.

    Nodes and adjacency with its degrees are kept once, dealt by key; an iteration joins them with the ranks where they
    are and shuffles only what each part of the adjacency gives to a node, added up there. The mass D
    of nodes without neighbours needs none: they get restart mass only, so D' = (1 - d + d * D) * (their share of the
    restart).
    """
    iterations = iterations if iterations > 0 else ITERATIONS
    damping = damping if 0 < damping < 1 else DAMPING
    nodes = nodes.select("key").distinct()
    both = undirected(edges.join(nodes.withColumnRenamed("key", "src"), "src", "left_semi").join(nodes.withColumnRenamed("key", "dst"), "dst", "left_semi"))
    degree = both.groupBy("src").agg(F.count("*").alias("deg"))
    if seeds is not None:
        valid = seeds.join(nodes, "key", "left_semi")
        total = valid.count()
    if seeds is None or not total:
        count = nodes.count()
        restart = nodes.withColumn("r", F.lit(1.0 / max(count, 1)))
    else:
        restart = nodes.join(valid.groupBy("key").agg((F.count("*") / F.lit(total)).alias("r")), "key", "left").na.fill({"r": 0.0})
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kept(df: DataFrame, by: str) -> DataFrame:
        out = df.repartition(parts, by).sortWithinPartitions(by).persist()
        out.count()  # how rows are dealt is known to the plans of the iterations only once they are there
        return out

    base = written(restart.join(degree.withColumnRenamed("src", "key"), "key", "left").select("key", "r", F.coalesce("deg", F.lit(0)).alias("deg")), "nodes")
    adjacency = kept(written(both.join(degree, "src"), "adjacency"), "src")
    alone = base.where("deg = 0").agg(F.sum("r")).first()[0] or 0.0
    base = kept(base.select("key", "r"), "key")
    rank, loose = base.select("key", F.col("r").alias("p")), alone
    for i in range(iterations):
        given = adjacency.join(rank.withColumnRenamed("key", "src"), "src").select(F.col("dst").alias("key"), (damping * F.col("p") / F.col("deg")).alias("x"))
        got = given.groupBy("key").agg(F.sum("x").alias("got"))
        restarted = ((1 - damping) + damping * loose) * F.col("r")
        rank = base.join(got, "key", "left").select("key", (F.coalesce("got", F.lit(0.0)) + restarted).alias("p"))
        loose = ((1 - damping) + damping * loose) * alone
        if (i + 1) % CUT == 0 and i + 1 < iterations:
            rank = written(rank, "rank")
    return rank.select("key", F.col("p").alias("score"))


def neighbors(nodes: DataFrame, edges: DataFrame, start: str, hops: int) -> DataFrame:
    """Keys at most `hops` steps from start, without start."""
    both = undirected(edges)
    seen = nodes.where(F.col("key") == start).select("key", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        front = both.join(front.select(F.col("key").alias("src")), "src").select(F.col("dst").alias("key")).distinct().join(seen.select("key"), "key", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def top_pagerank(scores: DataFrame, n: int = 10) -> DataFrame:
    """I8: best first, ties by key; n <= 0: all."""
    ordered = scores.orderBy(F.desc(F.round("score", 12)), "key")
    return ordered.limit(n) if n > 0 else ordered
