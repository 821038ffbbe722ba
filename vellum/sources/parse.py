"""Parsing of note files: frontmatter, title, tags, body, hash."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum.functions import markup
from vellum.functions import text as X

FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)"


def yaml_json(raw: str | None) -> str | None:
    """A YAML map as JSON; None if it is no valid map."""
    if raw is None:
        return None
    import yaml

    try:
        value = yaml.safe_load(raw)
    except yaml.YAMLError:
        return None
    if value is None:
        return "{}"
    return json.dumps(value, default=str, ensure_ascii=False) if isinstance(value, dict) else None


@F.pandas_udf(StringType())
def yaml_to_json(raw: pd.Series) -> pd.Series:
    """YAML has no counterpart among the built-in functions; only the frontmatter block goes to Python, in Arrow batches."""
    return raw.map(yaml_json)


def frontmatter_tags(json_text: Column) -> Column:
    """Tags as a list, or as a text parted by commas and spaces."""
    raw = F.get_json_object(json_text, "$.tags")
    listed = F.from_json(raw, "array<string>")
    split = F.split(F.coalesce(raw, F.lit("")), r"[,\s]+")
    return F.filter(F.when(F.coalesce(raw, F.lit("")).startswith("["), listed).otherwise(split), lambda t: F.trim(t) != "")


def notes(files: DataFrame) -> DataFrame:
    """(path, title, tags, frontmatter, bad_frontmatter, body, content_hash) of (path, content) files."""
    md = F.lower(F.substring_index("path", ".", -1)).isin("md", "markdown")
    block = F.nullif(F.regexp_extract("content", FRONT, 1), F.lit(""))
    raw = files.select("path", "content", md.alias("md"), F.when(md, block).alias("yaml"))
    parsed = raw.withColumn("json", yaml_to_json("yaml"))
    front = F.coalesce("json", F.lit("{}"))
    body = F.regexp_replace("content", FRONT, "")
    h1 = F.nullif(X.strip(F.regexp_extract("__body", r"(?md)^#[ \t]+(\S.*)$", 1)), F.lit(""))
    title, plain_body = markup.plain(F.col("path"), F.col("content"))
    rows = parsed.select("path", "content", "md", "yaml", "json", front.alias("frontmatter"), F.when(F.col("md"), body).otherwise(plain_body).alias("__body"), title.alias("__title"))
    inline = F.regexp_extract_all("__body", F.lit(r"(?:^|\s)#([a-zA-Z][\w/-]+)"), F.lit(1))
    own_title = F.coalesce(F.nullif(F.trim(F.get_json_object("frontmatter", "$.title")), F.lit("")), h1, F.col("__title"))
    return rows.select(
        "path",
        F.when(F.col("md"), own_title).otherwise(F.col("__title")).alias("title"),
        F.when(F.col("md"), F.array_distinct(F.concat(F.coalesce(frontmatter_tags(F.col("frontmatter")), F.array().cast("array<string>")), inline))).otherwise(F.array().cast("array<string>")).alias("tags"),
        "frontmatter",
        (F.col("yaml").isNotNull() & F.col("json").isNull()).alias("bad_frontmatter"),
        F.col("__body").alias("body"),
        X.content_hash(F.col("content")).alias("content_hash"),
    )
