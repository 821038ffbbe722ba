"""New documents, names by convention and reports as Markdown."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators.records import ValidationError

#: Folder and first status of each kind of document.
KINDS = {"spec": ("docs/specs", "Draft"), "plan": ("docs/plans", "Draft"), "adr": ("docs/adr", "Proposed")}


def convention_name(docs: DataFrame, numbers: DataFrame) -> DataFrame:
    """(path, name) of documents (path, doc_type, title, first_date), numbers: (dir, next_number).

    An adr is <number>-<slug>, in a folder the numbers go on by path; others are <first date>-0000-<slug>. The slug is the
    title's; a blank title gives the slug of a blank text.
    """
    from pyspark.sql import Window

    slug = X.slugify(F.coalesce("title", F.lit("")))
    rows = docs.select("path", "doc_type", "first_date", X.dir_name(F.col("path")).alias("dir"), slug.alias("slug")).join(numbers, "dir", "left")
    is_adr = F.col("doc_type") == "adr"
    place = F.row_number().over(Window.partitionBy("dir", is_adr).orderBy("path")) - 1
    number = F.format_string("%04d", F.coalesce("next_number", F.lit(1)) + place)
    name = F.when(is_adr, F.concat(number, F.lit("-"), "slug")).otherwise(F.concat("first_date", F.lit("-0000-"), "slug"))
    return rows.select("path", F.concat("dir", F.lit("/"), name, F.lit(".md")).alias("name"))


def new_doc(kind: str, title: str, slug: str, number: int, now: datetime.datetime, status: str = "", related: list[str] = (), governs: list[str] = (), folder: str = "") -> tuple[str, str]:
    """M6: (path, text) of a new document; number is the next one, for an adr."""
    if kind not in KINDS:
        raise ValidationError(f"unsupported kind of document {kind!r}")
    title = title.strip()
    if not title:
        raise ValidationError("a document needs a title")
    place, first = KINDS[kind]
    name = f"{number:04d}-{slug}" if kind == "adr" else f"{now:%Y-%m-%d-%H%M}-{slug}"
    quoted = lambda s: json.dumps(s, ensure_ascii=False)
    day = f"{now:%Y-%m-%d}"
    front = [("title", quoted(title)), ("type", quoted(kind)), ("status", quoted(status or first)), ("created", quoted(day)), ("updated", quoted(day))]
    front += [(k, "[" + ", ".join(map(quoted, v)) + "]") for k, v in (("governs", governs), ("related", related)) if v]
    text = "---\n" + "".join(f"{k}: {v}\n" for k, v in front) + f"---\n\n# {title}\n\n## Summary\n\n## Details\n"
    return f"{folder.strip('/') or place}/{name}.md", text


def row(*cells: Column) -> Column:
    """One row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def code(c: Column) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def drift_rows(drift: DataFrame) -> DataFrame:
    """M9: a line for each drifted binding (type, title, doc, file, commits); source 'repo' marks a file of the source repository."""
    file = F.when(F.col("source") == "repo", F.concat("file", F.lit(" (source repo)"))).otherwise(F.col("file"))
    return drift.select("doc", "file", row(F.col("type"), F.col("title"), code(F.col("doc")), code(file), F.col("commits")).alias("line"))


def stale_rows(stale: DataFrame) -> DataFrame:
    """M9: a line for each stale document (type, title, status, doc, commits, matched)."""
    return stale.select("doc", row(F.col("type"), F.col("title"), F.col("status"), code(F.col("doc")), F.col("commits"), code(F.array_join("matched", ", "))).alias("line"))


def governing_rows(docs: DataFrame) -> DataFrame:
    """M9: a line for each governing document (type, title, status, doc, matched, stale)."""
    stale = F.when(F.col("stale"), "yes").otherwise("")
    return docs.select("doc", row(F.col("type"), F.col("title"), F.col("status"), code(F.col("doc")), code(F.array_join("matched", ", ")), stale).alias("line"))


def report(title: str, columns: list[str], lines: DataFrame, empty: str) -> str:
    """Lines (in the order given) as a Markdown page, read row by row."""
    found = [r["line"] for r in lines.select("line").toLocalIterator()]
    if not found:
        return f"# {title}\n\n{empty}\n"
    return "\n".join([f"# {title}\n", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *found, ""])


def slices(registry: DataFrame, stale: DataFrame, drift: DataFrame, limit: int = 5) -> dict[str, DataFrame]:
    """M5: what a manifest shows: the first active plans, stale documents and drifted documents, `limit` each."""
    plans = registry.where("collection = 'plans' and status = 'Active'").orderBy("place").limit(limit)
    return {"active plans": plans, "stale": stale.orderBy("doc").limit(limit), "drift": drift.orderBy("doc", "file").limit(limit)}
