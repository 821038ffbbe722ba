"""Schemas as rows against the check of one schema, and cases of each kind."""

from __future__ import annotations

import json

from vellum.operators import records, schema
from vellum.operators.records import Field

DOCS = "path string, doc_type string, frontmatter string"
VALUES = [[None], "x", "", "  ", 5, 1.5, True, None, [], ["a"], ["a", 1], {"k": 1}, "2024-02-29", "2023-02-29", "2024-2-9", "red", "a.md"]


def test_each_kind_as_one_schema_does(spark):
    docs = [(f"{k}-{i}-{r}", f"{k}-{r}", json.dumps({"f": v, "other": 1})) for k in schema.KINDS for i, v in enumerate(VALUES) for r in (0, 1)]
    docs += [(f"{k}-none-{r}", f"{k}-{r}", text) for k in schema.KINDS for r in (0, 1) for text in ["{}"]]
    df = spark.createDataFrame(docs, DOCS)
    rules = spark.createDataFrame([(f"{k}-{r}", "f", bool(r), k, ["red", "a"] if k == "enum" else None) for k in schema.KINDS for r in (0, 1)], schema.RULES)
    got = {(x["path"], x["field"], x["problem"]) for x in schema.problems(df, rules).collect()}
    want = set()
    for k in schema.KINDS:
        for r in (0, 1):
            one = [Field("f", k, bool(r), ("red", "a") if k == "enum" else ())]
            want |= {tuple(x) for x in records.validate(df.where(df.doc_type == f"{k}-{r}"), one).collect()}
    assert got == want and len(want) > 60


def test_committed_rules_replace_built_in_ones(spark):
    rule = lambda t, f: (t, f, True, "string", None)
    built = spark.createDataFrame([rule("spec", "a"), rule("spec", "b"), rule("plan", "a")], schema.RULES)
    own = spark.createDataFrame([rule("spec", "c")], schema.RULES)
    assert {(x["doc_type"], x["field"]) for x in schema.effective(built, own).collect()} == {("spec", "c"), ("plan", "a")}
    docs = spark.createDataFrame([("s", "spec", "{}"), ("p", "plan", None), ("q", "plan", "not json"), ("o", "other", "{}"), ("n", None, "{}")], DOCS)
    got = {(x["path"], x["field"]) for x in schema.problems(docs, schema.effective(built, own)).collect()}
    assert got == {("s", "c"), ("p", "a"), ("q", "a")}


def test_references(spark):
    docs = spark.createDataFrame([("1", "t", '{"r":"a.md"}'), ("2", "t", '{"r":["a.md","gone.md"]}'), ("3", "t", '{"r":"gone.md"}'), ("4", "t", '{"r":5}'), ("5", "t", "{}")], DOCS)
    rules = spark.createDataFrame([("t", "r", False, "ref", None)], schema.RULES)
    files = spark.createDataFrame([("a.md",), ("a.md",)], "path string")
    got = {(x["path"], x["problem"]) for x in schema.problems(docs, rules, files).collect()}
    assert got == {("2", "missing reference gone.md"), ("3", "missing reference gone.md"), ("4", "not a ref")}
    assert schema.problems(docs.limit(0), rules, files).count() == 0
