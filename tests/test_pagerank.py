"""An iteration of PageRank shuffles only what nodes are given."""

from __future__ import annotations

from vellum.operators import graph


def exchanges(df) -> int:
    """Exchanges of the first plan, without those that filled kept tables."""
    n, inside = 0, None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth > inside:
            continue
        inside = depth if "InMemoryRelation" in line else None
        n += "Exchange " in line
    return n


def test_one_exchange_an_iteration(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(20)], "key string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i % 3}") for i in range(15)], "src string, dst string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, more = (graph.pagerank(nodes, edges, iterations=i) for i in (3, 5))
        assert exchanges(more) - exchanges(few) <= 2
        assert abs(sum(r["score"] for r in more.collect()) - 1) < 1e-9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
