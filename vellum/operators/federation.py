"""Federated search: mounts as callables that give ranked rows, routing, fusion."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import search
from vellum.operators.records import ValidationError

COSINE_FLOOR = 0.35
HIT = "rank int, title string, ref string, snippet string"


@dataclass
class Mount:
    """A source of ranked hits: call(query, limit) gives a DataFrame of HIT."""

    name: str
    call: Callable[[str, int], DataFrame]
    description: str = ""
    keywords: tuple[str, ...] = ()
    vector: tuple[float, ...] | None = None


@dataclass
class Plan:
    """Which mounts a query goes to, and why."""

    search: list[str]
    skipped: list[str] = field(default_factory=list)
    mode: str = "all"


def words(text: str) -> set[str]:
    """Lower-case tokens of letters and digits."""
    return {w for w in re.split(r"[\W_]+", text.lower()) if w}


def cosine(a, b) -> float:
    """B9 on the driver, for the handful of mount descriptions."""
    if a is None or b is None or len(a) != len(b):
        return 0.0
    na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


def route(mounts: list[Mount], query: str, scope: list[str] = (), vector=None, floor: float = COSINE_FLOOR) -> Plan:
    """The decision ladder, first match wins; the order of the mounts is kept."""
    names = [m.name for m in mounts]

    def gate(chosen: set[str]) -> Plan:
        if not chosen or len(chosen) == len(names):
            return Plan(names, [], "fallback")
        return Plan([n for n in names if n in chosen], [n for n in names if n not in chosen], "routed")

    if len(mounts) <= 1:
        return Plan(names)
    if scope:
        wanted = {s.lower() for s in scope}
        unknown = wanted - {n.lower() for n in names}
        if unknown:
            raise ValidationError(f"unknown mounts: {', '.join(sorted(unknown))}")
        return gate({n for n in names if n.lower() in wanted})
    tokens = words(query)
    bare = {m.name for m in mounts if not m.description and not m.keywords}
    named = {m.name for m in mounts if m.name.lower() in tokens}
    if named:
        return gate(named | bare)
    if len(bare) == len(mounts):
        return Plan(names)
    if vector is not None:
        near = {m.name for m in mounts if m.name not in bare and (m.vector is None or cosine(vector, m.vector) >= floor)}
    else:
        near = {m.name for m in mounts if m.name not in bare and tokens & words(" ".join([m.description, *m.keywords]))}
    return gate(near | bare)


def query(local: DataFrame | None, mounts: list[Mount], text: str, limit: int, scope: list[str] = (), vector=None) -> tuple[DataFrame, dict]:
    """Local hits and those of the routed mounts, fused by rank. A mount that fails is left out and named."""
    if limit <= 0:
        raise ValidationError("limit must be positive")
    plan = route(mounts, text, scope, vector)
    lists, failed = [], []
    if local is not None:
        lists.append(local.select(F.lit("local").alias("source"), "title", "ref", "snippet", "rank"))
    for m in mounts:
        if m.name in plan.search:
            try:
                lists.append(m.call(text, limit).select(F.lit(m.name).alias("source"), "title", "ref", "snippet", "rank"))
            except Exception as e:  # noqa: BLE001 - a mount is foreign code
                failed.append(f"{m.name}: {e}")
    return fuse(lists, limit), {"mode": plan.mode, "searched": plan.search, "skipped": plan.skipped, "failed": failed}


def fuse(lists: list[DataFrame], limit: int) -> DataFrame:
    """Hits of different sources never merge: the key holds source and place."""
    keys = ["source", "ref", "title", "snippet"]
    return search.top(search.rrf(lists, keys), limit, ["source", "ref"])


def parsed_hits(result: Column) -> Column:
    """Hits of a mount's JSON answer: its `hits` or `results` list, else the whole text as one hit."""
    item = "array<struct<title:string,name:string,ref:string,url:string,path:string,snippet:string,text:string>>"
    parsed = F.from_json(result, f"struct<hits:{item},results:{item}>")
    listed = F.coalesce(parsed["hits"], parsed["results"])
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    one = lambda h: F.struct(F.coalesce(blank(h["title"]), blank(h["name"]), blank(h["ref"])).alias("title"), F.coalesce(blank(h["ref"]), blank(h["url"]), blank(h["path"])).alias("ref"), F.coalesce(blank(h["snippet"]), blank(h["text"]), F.lit("")).alias("snippet"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("ref"), X.one_line(result, 400).alias("snippet")))
    return F.when(listed.isNotNull(), F.transform(listed, one)).otherwise(whole)
