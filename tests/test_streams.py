"""The registered streams over larger tables."""

from __future__ import annotations

from pathlib import Path


def test_no_part_of_the_arriving_documents_grows_with_the_table(spark, sf, tmp_path, monkeypatch):
    """A table of twelve parts arrives in twelve files, not in a fixed number."""
    from vellum.plans import catalog, composite

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(12).write.parquet(f"{tmp_path}/sf/documents.parquet")
    monkeypatch.setattr(composite.G, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = catalog.QUERIES["stream_index_available_now"](spark, f"{tmp_path}/sf").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(map(tuple, got)) == [("first", docs.count()), ("second", 0)]
    assert len(list(Path(tmp_path, "stream/in").glob("part-*"))) >= 12
