"""Links: extraction from prose, resolution with ordered fallbacks, broken links, orphans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum.functions import text as X

EXTERNAL = r"(?i)^([a-z][a-z0-9+.-]*:|//|#)"
WIKI = r"\[\[([^\]\[]+)\]\]"
MARKDOWN = r"(?:^|[^!\\])\[[^\]]*\]\(([^()\s]+)(?:\s+\"[^\"]*\")?\)"


def masked(text: str) -> str:
    """The text with code blanked out: fenced blocks (back ticks or tildes) and inline spans of equal back-tick runs."""
    if not text or ("`" not in text and "~~~" not in text):
        return text or ""
    lines, fence = [], ""
    for line in text.split("\n"):
        body = line.lstrip(" ")
        mark = body[:1]
        run = len(body) - len(body.lstrip(mark)) if mark in ("`", "~") and mark else 0
        indent = len(line) - len(body)
        if fence:
            lines.append(" " * len(line))
            if mark == fence[0] and run >= len(fence) and not body[run:].strip() and indent <= 3:
                fence = ""
        elif run >= 3 and indent <= 3 and not (mark == "`" and "`" in body[run:]):
            fence = mark * run
            lines.append(" " * len(line))
        else:
            lines.append(line)
    s, out, i = "\n".join(lines), [], 0
    while i < len(s):
        if s[i] != "`" or _escaped(s, i):
            out.append(s[i])
            i += 1
            continue
        run = len(s) - i - len(s[i:].lstrip("`"))
        j, close = i + run, -1
        while (j := s.find("`", j)) >= 0:
            n = len(s) - j - len(s[j:].lstrip("`"))
            if n == run:
                close = j + n
                break
            j += n
        if close < 0:
            out.append(s[i : i + run])
            i += run
        else:
            out.append("".join("\n" if c == "\n" else " " for c in s[i:close]))
            i = close
    return "".join(out)


def _escaped(s: str, i: int) -> bool:
    n = 0
    while i > n and s[i - n - 1] == "\\":
        n += 1
    return n % 2 == 1


@F.pandas_udf(StringType())
def mask_code(body: pd.Series) -> pd.Series:
    """A scanner with state, so Arrow batches rather than expressions."""
    return body.map(masked, na_action="ignore")


def prose(body: Column) -> Column:
    """The body without code. Only the bodies with a code mark go to Python's scanner."""
    marked = F.when(body.contains("`") | body.contains("~~~"), body)
    return F.coalesce(mask_code(marked), body, F.lit(""))


def relative(source: Column, target: Column) -> Column:
    """The target's key seen from the source's folder."""
    joined = F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", F.nullif(X.dir_name(source), F.lit("")), target))
    return F.regexp_replace(X.clean_path(F.lower(joined)), X.PAGE_SUFFIX, "")


def _anchorless(t: Column) -> Column:
    return X.strip(F.regexp_replace(t, r"#.*$", ""))


def wikilinks(notes: DataFrame, body: str = "body") -> DataFrame:
    """(path, pos, kind, target, candidates) of [[a|b]] links: a's forms, then b's; anchors and external ones drop."""
    at = notes.select("path", F.posexplode(F.regexp_extract_all(F.col(body), F.lit(WIKI), F.lit(1))).alias("pos", "raw"))
    parts = F.filter(F.transform(F.split("raw", r"\|", 2), _anchorless), lambda t: (t != "") & ~t.rlike(EXTERNAL))
    both = at.select("path", "pos", F.col("raw"), parts.alias("parts")).where("size(parts) > 0")
    spelled = lambda t: F.regexp_replace(F.lower(t), r"^(spec|plan|research):", "$1s/")

    def forms(t: Column) -> Column:
        path_like = (F.instr(t, "/") > 0) | t.startswith(".")
        flat = F.regexp_replace(spelled(t), X.PAGE_SUFFIX, "")
        return F.array_compact(F.array(F.when(path_like, relative(F.col("path"), t)), flat))

    cand = F.array_distinct(F.flatten(F.transform("parts", forms)))
    return both.select("path", "pos", F.lit("wikilink").alias("kind"), X.normal_link(F.get("parts", F.lit(0))).alias("target"), cand.alias("candidates"))


def markdown_links(notes: DataFrame, body: str = "body") -> DataFrame:
    """(path, pos, kind, target, candidates) of [text](page) links to pages; images, external and other files drop."""
    at = notes.select("path", F.posexplode(F.regexp_extract_all(F.col(body), F.lit(MARKDOWN), F.lit(1))).alias("pos", "raw"))
    bare = F.regexp_replace("raw", r"[?#].*$", "")
    page = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    ok = (page != "") & ~F.col("raw").rlike(EXTERNAL) & (~X.base_name(page).contains(".") | page.rlike(r"(?i)\.(md|markdown)$"))
    flat = F.regexp_replace(X.clean_path(F.lower(page)), X.PAGE_SUFFIX, "")
    return at.where(ok).select("path", "pos", F.lit("markdown-link").alias("kind"), flat.alias("target"), F.array_distinct(F.array(relative(F.col("path"), page), flat)).alias("candidates"))


def edges(notes: DataFrame, body: str = "body") -> DataFrame:
    """Links of both kinds, the first of each kind and target of a note."""
    both = wikilinks(notes, body).unionByName(markdown_links(notes, body))
    first = F.min_by(F.struct("pos", "candidates"), "pos")
    return both.groupBy("path", "kind", "target").agg(first.alias("f")).select("path", "kind", "target", F.col("f.pos").alias("pos"), F.col("f.candidates").alias("candidates"))


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Each link with dst, the key of the note that its first resolvable candidate means, or null.

    A candidate with a slash: exact key, then unique alias. Without: the same two in the source's folder, then exact
    key, unique alias, unique base name. All lookups are equi-joins on (kind of lookup, text), put into one table.
    """
    keys = notes.select(X.page_key(F.col("path")).alias("key")).distinct()
    base = X.base_name(F.col("key"))
    alias = keys.select("key", F.explode(F.array_compact(F.array(X.spaced_alias(F.col("key")), X.spaced_alias(base)))).alias("name")).distinct()
    unique = alias.groupBy("name").agg(F.min("key").alias("key"), F.count("*").alias("n")).where("n = 1")
    bases = keys.groupBy(base.alias("name")).agg(F.min("key").alias("key"), F.count("*").alias("n")).where("n = 1")
    book = keys.select(F.lit("k").alias("how"), F.col("key").alias("name"), "key")
    book = book.unionByName(unique.select(F.lit("a").alias("how"), "name", "key")).unionByName(bases.select(F.lit("b").alias("how"), "name", "key"))
    cand = links.select("path", "kind", "target", X.dir_name(X.page_key(F.col("path"))).alias("dir"), F.posexplode("candidates").alias("c", "cand"))
    here = F.concat_ws("/", F.nullif(F.col("dir"), F.lit("")), "cand")
    step = lambda n, how, name: F.struct(F.lit(n).alias("n"), F.lit(how).alias("how"), name.alias("name"))
    tries = F.when(F.instr("cand", "/") > 0, F.array(step(1, "k", F.col("cand")), step(2, "a", F.col("cand")))).otherwise(F.array(step(1, "k", here), step(2, "a", here), step(3, "k", F.col("cand")), step(4, "a", F.col("cand")), step(5, "b", F.col("cand"))))
    asked = cand.select("path", "kind", "target", "c", F.explode(tries).alias("t")).select("path", "kind", "target", (F.col("c") * 10 + F.col("t.n")).alias("order"), F.col("t.how").alias("how"), F.col("t.name").alias("name"))
    found = asked.join(book, ["how", "name"]).groupBy("path", "kind", "target").agg(F.min_by("key", "order").alias("dst"))
    return links.join(found, ["path", "kind", "target"], "left").select("path", "kind", "target", X.page_key(F.col("path")).alias("src"), "dst")


def broken(resolved: DataFrame) -> DataFrame:
    """Links without a note behind them."""
    return resolved.where("dst is null").select(F.col("path").alias("from"), "target", "kind")


def orphans(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Notes with neither links out (broken ones count) nor links in."""
    keyed = notes.select("path", X.page_key(F.col("path")).alias("key"))
    return keyed.join(resolved.select("path").distinct(), "path", "left_anti").join(resolved.where("dst is not null").select(F.col("dst").alias("key")).distinct(), "key", "left_anti").select("path")
