"""Sources: Parquet tables, files of a note tree, and notes rendered from tables (inventory A, 7.1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as X

IGNORED_DIRS = [".git", ".obsidian", ".trash", "node_modules"]
PAGE_EXTENSIONS = "md markdown adoc asciidoc rst rest textile org mediawiki wiki creole pod pod6 rdoc".split()
INDEX_MARKER = "generated: directory index"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ignored(path: Column, names: list[str] = IGNORED_DIRS) -> Column:
    """Does a segment of the path have one of the names?"""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def note_files(spark: SparkSession, root: str, ignore: list[str] = IGNORED_DIRS) -> DataFrame:
    """A1, A2: (path, content) of the pages under root, without ignored folders and generated indexes. One task reads many files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = raw.select(F.regexp_replace(F.col("path"), rf"^.*?{root.rstrip('/')}/", "").alias("path"), F.decode("content", "UTF-8").alias("content"))
    page = F.lower(F.substring_index("path", ".", -1)).isin(PAGE_EXTENSIONS)
    generated = (F.lower(X.base_name(F.col("path"))) == "index.md") & (F.instr(F.substring("content", 1, 256), INDEX_MARKER) > 0)
    return base.where(page & ~ignored(F.col("path"), ignore) & ~generated)


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each document: path, title, tags, frontmatter (JSON; quality and toxic only where labelled), body."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    both = docs.join(labels, "doc_id", "left")
    return both.select(
        "doc_id",
        F.concat_ws("/", F.lit("docs"), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.array("lang", "source").alias("tags"),
        F.to_json(F.struct("lang", "source", "n_chars", "quality", "toxic")).alias("frontmatter"),
        F.col("text").alias("body"),
    )


def conversation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each conversation: a `## role` section for each turn."""
    turns = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.coalesce("text", F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("turn", part.alias("part"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n").alias("body")).select(
        "conv_id", F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), "body"
    )


def entity_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of regions, nations, suppliers and customers that link to what they belong to; every seventh also to a missing page."""
    def note(kind: str, key: str, name: str, links: list[Column], of: DataFrame) -> DataFrame:
        body = F.concat_ws("\n", F.concat(F.lit("# "), F.col(name)), *links)
        return of.select(F.concat(F.lit(f"{kind}/{kind}-"), F.col(key).cast("string"), F.lit(".md")).alias("path"), F.col(name).alias("title"), body.alias("body"))

    to = lambda kind, key: F.concat(F.lit(f"See [[{kind}-"), F.col(key).cast("string"), F.lit("]]."))
    md = lambda kind, key: F.concat(F.lit(f"In [the {kind}](../{kind}/{kind}-"), F.col(key).cast("string"), F.lit(".md)."))
    lost = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("Also [[order-"), F.col("c_custkey").cast("string"), F.lit("|Last order]].")))
    t = lambda name: table(spark, sf_dir, name)
    notes = note("region", "r_regionkey", "r_name", [], t("region"))
    notes = notes.unionByName(note("nation", "n_nationkey", "n_name", [to("region", "n_regionkey")], t("nation")))
    notes = notes.unionByName(note("supplier", "s_suppkey", "s_name", [md("nation", "s_nationkey")], t("supplier")))
    return notes.unionByName(note("customer", "c_custkey", "c_name", [to("nation", "c_nationkey"), lost], t("customer")))
