"""Integrity checks as issue tables (severity, kind, path, detail), baselines and proposed fixes (2.L)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X

DATED_NAME = r"^\d{4}-\d{2}-\d{2}-\d{4}-[a-z0-9]+(-[a-z0-9]+)*\.md$"
NUMBERED_NAME = r"^\d{4}-[a-z0-9]+(-[a-z0-9]+)*\.md$"
DASHES = "—–"


def issue(df: DataFrame, severity: str, kind: str, path="path", detail=None) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.col(path).alias("path"), (detail if detail is not None else F.lit("")).alias("detail"))


def broken_links(broken: DataFrame) -> DataFrame:
    return issue(broken, "error", "broken-link", "from", F.concat_ws(" ", "kind", "target"))


def orphans(paths: DataFrame) -> DataFrame:
    skip = X.base_name(F.col("path")).isin("CLAUDE.md", "AGENTS.md", "GEMINI.md", "INDEX.md")
    return issue(paths.where(~skip), "warn", "orphan")


def duplicate_names(notes: DataFrame) -> DataFrame:
    """Paths that share a base name with others, at most three of them named."""
    named = notes.select("path", F.lower(X.base_name(F.col("path"))).alias("name"))
    twice = named.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")
    return issue(twice, "warn", "duplicate-name", "first", F.concat(F.col("n").cast("string"), F.lit(" notes named "), F.col("name")))


def forbidden_dashes(notes: DataFrame) -> DataFrame:
    return issue(notes.where(F.col("body").rlike(f"[{DASHES}]")), "error", "forbidden-dash")


def bad_doc_names(notes: DataFrame) -> DataFrame:
    """Names in docs/<folder>/ that fit neither the dated nor, under adr, the numbered form."""
    base, parts = X.base_name(F.col("path")), F.split("path", "/")
    docs = notes.where((F.get(parts, F.lit(0)) == "docs") & (F.size(parts) >= 3))
    good = F.when(F.get(parts, F.lit(1)) == "adr", base.rlike(NUMBERED_NAME)).otherwise(base.rlike(DATED_NAME))
    return issue(docs.where(~good), "error", "bad-doc-name", detail=base)


def missing_titles(notes: DataFrame) -> DataFrame:
    return issue(notes.where((F.coalesce(F.trim("title"), F.lit("")) == "") & ~F.col("body").rlike(r"(?md)^# +\S")), "warn", "missing-title")


def broken_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ref) whose file is missing."""
    return issue(refs.join(files.select(F.col("path").alias("ref")), "ref", "left_anti"), "error", "broken-doc-ref", detail=F.col("ref"))


def governs_no_match(docs: DataFrame, matched: DataFrame) -> DataFrame:
    globs = docs.select("path", F.explode("governs").alias("pattern"))
    return issue(globs.join(matched.select("path", "pattern").distinct(), ["path", "pattern"], "left_anti"), "error", "governs-no-match", detail=F.col("pattern"))


def field_problems(problems: DataFrame) -> DataFrame:
    kind = F.when(F.col("problem") == "required", "missing-doc-field").when(F.col("field") == "status", "bad-doc-status").when(F.col("field") == "type", "bad-doc-type").otherwise("bad-doc-field")
    return problems.select(F.lit("error").alias("severity"), kind.alias("kind"), "path", F.concat_ws(": ", "field", "problem").alias("detail"))


def report(parts: list[DataFrame]) -> DataFrame:
    """All issues, errors first, then by path."""
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "path", "kind", "detail")


def counts(issues: DataFrame) -> DataFrame:
    """Numbers of errors and warnings."""
    return issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))


def fingerprints(issues: DataFrame) -> DataFrame:
    return issues.withColumn("fingerprint", X.fingerprint(F.col("kind"), F.col("path"), F.col("detail")))


def newcomers(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """Issues whose fingerprint the baseline doesn't hold."""
    return fingerprints(issues).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def proposed_fixes(notes: DataFrame) -> DataFrame:
    """(path, fix, detail) that would settle fixable issues; inputs are never rewritten."""
    dashes = notes.where(F.col("body").rlike(f"[{DASHES}]")).select("path", F.lit("dashes").alias("fix"), F.sha2(F.translate("body", DASHES, "--"), 256).alias("detail"))
    names = bad_doc_names(notes).join(notes.select("path", "title"), "path")
    renamed = names.select("path", F.lit("rename").alias("fix"), F.concat(X.slugify(F.col("title")), F.lit(".md")).alias("detail"))
    return dashes.unionByName(renamed)
