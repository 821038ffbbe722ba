"""Chunking: heading sections, oversize windows, chunk hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X

SIZE, OVERLAP = 3200, 480
HEADING = r"^#{1,6}[\t\f\r ]+\S"


def sections(notes: DataFrame) -> DataFrame:
    """(path, title, heading, ord, body): the text under each heading line; sections without text vanish.

    A section is a slice of its note's lines from one heading to the next, so a note costs its lines once and nothing is
    shuffled. Lines and places are bound as lambda variables, as an expression inside a lambda is evaluated anew for each element.
    """
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def of(lines):
        """Line 0 is a blank one before the text, for what stands before the first heading."""
        heads = F.filter(F.transform(lines, lambda s, i: F.when(s.rlike(HEADING) | (i == 0), i)), lambda i: i.isNotNull())
        return bound(heads, lambda at: F.transform(at, lambda i, k: part(lines, i, F.coalesce(F.get(at, k + 1), F.size(lines)))))

    def part(lines, i, end):
        heading = X.strip(F.regexp_replace(F.get(lines, i), r"^#{1,6}", ""))
        return F.struct(heading.alias("heading"), X.strip(F.array_join(F.slice(lines, i + 2, end - i - 1), "\n")).alias("body"))

    parts = bound(F.split(F.concat(F.lit("\n"), F.col("body")), "\n"), of)
    kept = F.filter(parts, lambda p: p["body"] != "")
    whole = F.when(F.size(kept) == 0, F.array(F.struct(F.lit("").alias("heading"), F.col("title").alias("body")))).otherwise(kept)
    at = notes.select("path", "title", F.posexplode(whole).alias("ord", "part"))
    return at.select("path", "title", F.col("part.heading").alias("heading"), "ord", F.col("part.body").alias("body"))


def windows(chunks: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """bodies over `size` characters as windows that overlap; ord is renumbered within each note."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("body") - overlap - 1, F.lit(0)), F.lit(step))
    cut = F.when(F.char_length("body") <= size, F.array("body")).otherwise(F.transform(starts, lambda s: F.substring(F.col("body"), s + 1, F.lit(size))))
    out = chunks.select("path", "title", "heading", F.col("ord").alias("section"), F.posexplode(cut).alias("window", "body"))
    from pyspark.sql import Window

    return out.withColumn("ord", F.row_number().over(Window.partitionBy("path").orderBy("section", "window")) - 1)


def document_windows(notes: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of notes without headings: the window number is the ord, so no sort is needed."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("body") - overlap - 1, F.lit(0)), F.lit(step))
    cut = F.when(F.char_length("body") <= size, F.array("body")).otherwise(F.transform(starts, lambda s: F.substring(F.col("body"), s + 1, F.lit(size))))
    return notes.select("doc_id", "path", "title", "tags", F.posexplode(cut).alias("ord", "body"))


def chunk_text(title, heading, body):
    """B2: what is embedded and hashed: title, heading and body, without blank ends."""
    return X.strip(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(heading, F.lit("")), F.coalesce(body, F.lit(""))))


def with_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.select("*", X.token_estimate(F.col("body")).alias("token_est"), F.sha2(chunk_text(F.col("title"), F.col("heading"), F.col("body")), 256).alias("chunk_hash"))
