"""Document registry, directory indexes, governance, asset planning, schedules (2.M, A24, E11, E14, D11, D17, B36, C12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as X

GROUPS = ("specs", "plans", "adr", "research")


def registry(notes: DataFrame) -> DataFrame:
    """M1, M2: (collection, place, path, title, date, number) of notes under docs/; adr ascends by path, the others descend; equal paths by title."""
    parts = F.split("path", "/")
    base = X.base_name(F.col("path"))
    date = F.coalesce(F.nullif(X.leading_date(F.get_json_object("frontmatter", "$.date")), F.lit("")), F.get_json_object("frontmatter", "$.date"), X.leading_date(base))
    rows = notes.where(F.get(parts, F.lit(0)) == "docs").select(F.get(parts, F.lit(1)).alias("collection"), "path", "title", date.alias("date"), X.leading_number(base).alias("number"))
    up = F.when(F.col("collection") == "adr", F.col("path"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("collection").orderBy(up.asc_nulls_last(), F.desc("path"), "title")))


def stale_index(on_disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """Paths on one side only."""
    a, b = on_disk.select("path").distinct().withColumn("d", F.lit(1)), indexed.select("path").distinct().withColumn("i", F.lit(1))
    return a.join(b, "path", "full").where("d is null or i is null").select("path", F.when(F.col("d").isNull(), "only indexed").otherwise("only on disk").alias("where"))


def next_number(notes: DataFrame, folder: str = "docs/adr/") -> DataFrame:
    """One more than the largest leading number, 1 without any."""
    n = X.leading_number(X.base_name(F.col("path"))).try_cast("int")
    return notes.agg((F.coalesce(F.max(F.when(F.col("path").startswith(folder), n)), F.lit(0)) + 1).alias("next_number"))


def directory_index(notes: DataFrame) -> DataFrame:
    """Per folder its rows of a table: date (descending, '-' last), then file name, then title."""
    base = X.base_name(F.col("path"))
    date = F.coalesce(F.nullif(X.leading_date(base), F.lit("")), F.lit("-"))
    rows = notes.select(X.dir_name(F.col("path")).alias("dir"), base.alias("file"), X.escape_cell(F.col("title")).alias("title"), date.alias("date"))
    w = Window.partitionBy("dir").orderBy((F.col("date") == "-").cast("int"), F.desc("date"), F.lower("file"), "file", "title")
    return rows.withColumn("place", F.row_number().over(w))


def index_text(rows: DataFrame) -> DataFrame:
    """The managed block of each folder."""
    line = F.concat(F.lit("| ["), "title", F.lit("]("), "file", F.lit(") | "), "date", F.lit(" |"))
    ordered = F.sort_array(F.collect_list(F.struct("place", line.alias("line"))))
    return rows.groupBy("dir").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("block"))


def winners(assets: DataFrame) -> DataFrame:
    """Of each kind and name the asset of least priority number, the first source among equals."""
    best = F.min_by(F.struct("source", "priority", "scope", "import_only", "targets"), F.struct("priority", "source_pos"))
    return assets.groupBy("kind", "name").agg(best.alias("b")).select("kind", "name", "b.*")


def sync_plan(assets: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target lacks: (tool, scope, kind, name, status). Joined on the tool that an asset names, not crossed.

    targets: (tool, scope, kind, name, hash) of what is there, and rows with null kind for targets as such.
    """
    wanted = assets.where(~F.col("import_only")).select("kind", "name", "scope", "hash", F.explode("targets").alias("tool"))
    places = targets.select("tool", F.col("scope").alias("target_scope")).distinct()
    due = wanted.join(places, "tool").where("scope is null or scope = target_scope")
    there = targets.where("kind is not null").select("tool", F.col("scope").alias("target_scope"), "kind", "name", F.col("hash").alias("there"))
    status = F.when(F.col("there").isNull(), "create").when(F.col("there") == F.col("hash"), "ok").otherwise("drift")
    return due.join(there, ["tool", "target_scope", "kind", "name"], "left").select("tool", F.col("target_scope").alias("scope"), "kind", "name", status.alias("status"))


def cron_field(value: Column, spec: str, least: int, most: int) -> Column:
    """One field of a cron expression as a condition: *, lists, ranges and steps."""
    conditions = []
    for part in spec.split(","):
        body, _, step = part.partition("/")
        lo, hi = (least, most) if body == "*" else tuple(map(int, body.split("-"))) if "-" in body else (int(body), most if step else int(body))
        if not least <= lo <= hi <= most:
            raise ValueError(f"cron field {spec!r} is out of range")
        conditions.append(value.between(lo, hi) & ((value - lo) % int(step or 1) == 0))
    return X.any_of(conditions)


def cron_due(ts: Column, expression: str) -> Column:
    """Does the minute match? If day of month and day of week are both set, either may match."""
    minute, hour, day, month, week = expression.split()
    dow = (F.dayofweek(ts) - 1).cast("int")
    days = cron_field(F.dayofmonth(ts), day, 1, 31)
    weeks = cron_field(dow, week.replace("7", "0"), 0, 6)
    date = days | weeks if day != "*" and week != "*" else days & weeks
    return cron_field(F.minute(ts), minute, 0, 59) & cron_field(F.hour(ts), hour, 0, 23) & cron_field(F.month(ts), month, 1, 12) & date


def tree_kind(files: DataFrame) -> DataFrame:
    """Repo, wiki or vault from counts over a file listing (root, path)."""
    ext = F.lower(F.substring_index("path", ".", -1))
    facts = files.groupBy("root").agg(
        F.count_if(ext.isin("go", "py", "rs", "ts", "java", "c")).alias("code"),
        F.count_if(ext.isin("md", "markdown")).alias("pages"),
        F.count_if(F.col("path").isin("Home.md", "_Sidebar.md", "_Footer.md")).alias("wiki"),
        F.count_if(F.col("path").startswith(".obsidian/")).alias("vault"),
    )
    kind = F.when(F.col("vault") > 0, "vault").when((F.col("wiki") > 0) | F.col("root").rlike(r"(?i)\.wiki(\.git)?/*$"), "wiki").when(F.col("code") > 0, "repo").otherwise("vault")
    return facts.select("root", kind.alias("kind"), "code", "pages")
