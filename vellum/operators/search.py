"""Retrieval: BM25, exhaustive cosine, reciprocal rank fusion, hybrid search, reranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as X

from .graph import written

K1, B, RRF_K, POOL = 1.2, 0.75, 60, 5
WEIGHTS = {"title": 2.0, "tags": 1.0, "heading": 1.5, "body": 1.0}
LEAST_IDF = 1e-6


def _words_and_hits(text: Column, asked: list[str]) -> Column:
    """(n, hits): number of words and those that are asked; the words are made once a row."""
    return F.transform(F.array(X.terms(text)), lambda w: F.struct(F.size(w).alias("n"), F.filter(w, lambda x: x.isin(asked)).alias("hits")))[0]


def bm25(chunks: DataFrame, query: str, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Chunks that hold a query term, with their BM25 score; repeated terms score repeatedly.

    Postings are never exploded: each row counts its own hits. Texts are read and split once; the narrow rows (keys,
    length, counts) are written, document frequencies and the mean length come from one aggregation over them to a
    single row, used as a scalar subquery, and only rows with a hit are scored.
    """
    weights = weights or {c: w for c, w in WEIGHTS.items() if c in chunks.columns}
    asked = X.query_terms(query)
    if not asked:
        return chunks.select(*keys, F.lit(0.0).alias("score")).limit(0)
    distinct = list(dict.fromkeys(asked))
    whole = lambda c: F.coalesce(F.col(c) if dict(chunks.dtypes)[c] == "string" else F.array_join(c, " "), F.lit(""))
    counted = chunks.select(*keys, *[_words_and_hits(whole(c), distinct).alias(f"__{c}") for c in weights])
    times = lambda c, t: F.size(F.filter(F.col(f"__{c}.hits"), lambda x: x == t))
    hits = [reduce(lambda a, b: a + b, [times(c, t) * F.lit(w) for c, w in weights.items()]) for t in distinct]
    length = reduce(lambda a, b: a + b, [F.col(f"__{c}.n") for c in weights])
    rows = written(counted.select(*keys, length.alias("__len"), *[h.alias(f"__tf{i}") for i, h in enumerate(hits)]), "terms")
    stats = rows.agg(F.count("*").alias("n"), F.avg("__len").alias("mean"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))])
    idf = [F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF)) for i in range(len(distinct))]
    one = stats.select(F.struct(F.col("mean"), *[x.alias(f"idf{i}") for i, x in enumerate(idf)]).alias("s")).scalar()
    found = rows.where(X.any_of([F.col(f"__tf{i}") > 0 for i in range(len(distinct))])).withColumn("__s", one)
    norm = K1 * (1 - B + B * F.col("__len") / F.col("__s.mean"))
    part = [F.col(f"__s.idf{i}") * F.col(f"__tf{i}") * (K1 + 1) / (F.col(f"__tf{i}") + norm) * asked.count(t) for i, t in enumerate(distinct)]
    return found.select(*keys, reduce(lambda a, b: a + b, part).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length or zero length."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def vector_scores(vectors: DataFrame, query: list[float] | Column, keys: list[str], vec: str = "embedding") -> DataFrame:
    """Similarity of every vector to the query (a literal array or a scalar subquery)."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(*keys, F.col(vec).alias("__v"), q.alias("__q")).select(*keys, cosine(F.col("__v"), F.col("__q")).alias("score"))


def top(scored: DataFrame, n: int, ties: list[str]) -> DataFrame:
    """The n best; ties are settled by further columns."""
    return scored.orderBy(F.desc("score"), *ties).limit(n)


def ranked(scored: DataFrame, ties: list[str], n: int | None = None) -> DataFrame:
    """rank from 1, best first. The cut comes first, so that only n rows meet in the ranking window."""
    some = scored if n is None else top(scored, n, ties)
    return some.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *ties)))


def rrf(lists: list[DataFrame], keys: list[str], k: int = RRF_K) -> DataFrame:
    """Sum over the lists of 1 / (k + rank)."""
    k = k if k > 0 else RRF_K
    union = reduce(lambda a, b: a.unionByName(b), [x.select(*keys, "rank") for x in lists])
    return union.groupBy(*keys).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def collapse(scored: DataFrame, note: str = "path", ties: list[str] = ("ord",)) -> DataFrame:
    """The best chunk of each note."""
    least = [F.negate(F.col(t)).alias(f"__{t}") for t in ties]
    best = F.max_by(F.struct(*scored.columns), F.struct("score", *least))
    return scored.groupBy(note).agg(best.alias("best")).select("best.*")


def hybrid(fts: DataFrame, vec: DataFrame | None, limit: int = 10) -> DataFrame:
    """Each channel gives limit * 5 chunks; fuse, collapse to notes, cut. Without vectors one channel alone."""
    limit = limit if limit > 0 else 10
    keys = ["path", "ord"]
    lists = [ranked(x, keys, limit * POOL) for x in (fts, vec) if x is not None]
    return top(collapse(rrf(lists, keys)), limit, ["path"])


def search(fts: DataFrame, vec: DataFrame | None, limit: int = 10, reason: str = "") -> tuple[DataFrame, dict]:
    """The hits and how they were found: mode hybrid, or fts-only with its reason."""
    mode = {"mode": "hybrid", "reason": ""} if vec is not None else {"mode": "fts-only", "reason": reason or "no vectors"}
    return hybrid(fts, vec, limit), mode


def rerank(hits: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Order by the scorer's (path, rerank_score); hits that it leaves out go; equal scores keep their order; a failing or missing scorer changes nothing."""
    if scorer is None:
        return hits
    try:
        scored = written(scorer(hits).select("path", "rerank_score"), "reranked")  # a few rows; a scorer that fails does so here
    except Exception:  # noqa: BLE001 - a scorer is foreign code; search must not fail with it
        return hits
    old = hits.withColumn("old_rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
    return old.join(scored, "path").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "old_rank"))).drop("old_rank")


def rerank_text(title: Column, heading: Column, snippet: Column) -> Column:
    """The non-blank parts joined by a dash."""
    return F.array_join(F.filter(F.array(title, heading, snippet), lambda x: F.trim(x) != ""), " - ")


def nearest(vectors: DataFrame, query: list[float] | Column, n: int) -> DataFrame:
    """Best chunk of each note by similarity."""
    return top(collapse(vector_scores(vectors, query, ["path", "ord"])), n, ["path"])
