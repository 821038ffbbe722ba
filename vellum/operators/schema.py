"""Schemas as rows: documents of thousands of types checked in one plan.

A rule is a row (doc_type, field, required, kind, allowed, target). The committed rules of a type replace the built-in
ones as a whole. Frontmatter is unpivoted into one row a field with its JSON kind and text, joined with the rules on
type and field; required fields are the rules that no row meets. References are checked by an anti-join with the
files. Types, fields and values are data, so a further type costs rows and no plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import DATE

RULES = "doc_type string, field string, required boolean, kind string, allowed array<string>"
#: Kinds that a rule may name; an unknown one is a problem of every value.
KINDS = ["string", "number", "bool", "date", "enum", "tags", "ref"]


def effective(built_in: DataFrame, committed: DataFrame) -> DataFrame:
    """The committed rules, and the built-in ones of types without any."""
    return committed.unionByName(built_in.join(committed.select("doc_type").distinct(), "doc_type", "left_anti"))


def fields(docs: DataFrame) -> DataFrame:
    """(path, doc_type, field, json_kind, value) of documents (path, doc_type, frontmatter); a text that is no JSON map has none."""
    each = docs.select("path", "doc_type", F.explode(F.from_json("frontmatter", "map<string,variant>")).alias("field", "v"))
    text = F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))
    return each.select("path", "doc_type", "field", F.schema_of_variant("v").alias("json_kind"), text.alias("value"), F.try_variant_get("v", "$", "array<string>").alias("items"))


def problems(docs: DataFrame, rules: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(path, field, problem): required, not a <kind>, value not in enum, or missing reference <file>.

    A blank text counts as absent. `files` (path) are what references (kind ref, one or a list) may name; without it
    they are not looked up.
    """
    rows = fields(docs).where("json_kind <> 'VOID' AND NOT (json_kind = 'STRING' AND trim(value) = '')")
    is_text, listed = F.col("json_kind") == "STRING", (F.col("json_kind") == "ARRAY<STRING>") | ((F.col("json_kind") == "ARRAY<VOID>") & (F.size("items") == 0))
    good = (
        F.when(F.col("kind") == "string", is_text)
        .when(F.col("kind") == "number", F.col("json_kind").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"))
        .when(F.col("kind") == "bool", F.col("json_kind") == "BOOLEAN")
        .when(F.col("kind") == "date", is_text & F.col("value").rlike(DATE) & F.try_to_date("value", "yyyy-MM-dd").isNotNull())
        .when(F.col("kind") == "enum", is_text & (F.coalesce(F.size("allowed"), F.lit(0)).isin(0, -1) | F.coalesce(F.array_contains("allowed", F.col("value")), F.lit(False))))
        .when(F.col("kind").isin("tags", "ref"), is_text | listed)
        .otherwise(F.lit(False))
    )
    met = rows.join(rules, ["doc_type", "field"])
    said = F.when(F.col("kind") == "enum", "value not in enum").otherwise(F.concat(F.lit("not a "), "kind"))
    wrong = met.where(~F.coalesce(good, F.lit(False))).select("path", "field", said.alias("problem"))
    needed = docs.select("path", "doc_type").join(rules.where("required").select("doc_type", "field"), "doc_type")
    out = wrong.unionByName(needed.join(rows.select("path", "field"), ["path", "field"], "left_anti").select("path", "field", F.lit("required").alias("problem")))
    if files is None:
        return out
    named = met.where((F.col("kind") == "ref") & F.coalesce(good, F.lit(False))).select("path", "field", F.explode(F.when(is_text, F.array("value")).otherwise(F.col("items"))).alias("file"))
    lost = named.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_anti")
    return out.unionByName(lost.select("path", "field", F.concat(F.lit("missing reference "), "file").alias("problem")))
