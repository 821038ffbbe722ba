"""Queries over retrieval: BM25, cosine, fusion, hybrid, reranking (milestones 0 and 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import chunks as C
from vellum.operators import embed as E
from vellum.operators import search as S
from vellum.operators import vectors as V
from vellum.operators.graph import shared_folder
from vellum.operators.store import Store
from vellum.sources import tables as T
from vellum.streaming.ingest import run_index

from .base import CHUNKS, NOTES, bm25, cosine, query

TEXT = "that with from"
WORDS = TEXT.split()


def _chunks(spark, d):
    return C.document_windows(T.document_notes(spark, d))


def _probe(spark, d):
    """The vector of vec_id 0 as a scalar subquery."""
    return T.table(spark, d, "embeddings").where("vec_id = 0").select("embedding").scalar()


def _vectors(spark, d):
    """Vectors as those of the first chunk of the document with the same number."""
    v = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return T.document_notes(spark, d).select("doc_id", "path").join(v, "doc_id").select("path", F.lit(0).alias("ord"), "embedding")


FTS = bm25("chunks", {"body": 1.0}, WORDS, "path, ord")
VEC = f"(SELECT 'docs/'||source||'/'||lang||'/'||doc_id||'.md' AS path, CAST(0 AS INT) AS ord, {cosine('e.embedding', 'q.embedding')} AS score FROM documents JOIN embeddings e ON vec_id = doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
HYBRID = f"""{CHUNKS}, f AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, ord) AS r FROM {FTS} QUALIFY r <= 50), v AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, ord) AS r FROM {VEC} QUALIFY r <= 50),
 u AS (SELECT path, ord, 1.0 / (60 + r) AS s FROM f UNION ALL SELECT path, ord, 1.0 / (60 + r) FROM v), g AS (SELECT path, ord, sum(CAST(s AS DOUBLE)) AS score FROM u GROUP BY 1, 2),
 best AS (SELECT path, ord, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, ord) AS k FROM g), hits AS (SELECT path, ord, score FROM best WHERE k = 1 ORDER BY score DESC, path LIMIT 10)"""


def hits(spark, d, limit: int = 10):
    keys = ["path", "ord"]
    return S.hybrid(S.bm25(_chunks(spark, d), TEXT, keys, {"body": 1.0}), S.vector_scores(_vectors(spark, d), _probe(spark, d), keys), limit)


@query("hybrid_search", f"WITH {HYBRID} SELECT path, ord, round(score, 9) AS score FROM hits")
def hybrid_search(spark, d):
    return hits(spark, d).select("path", "ord", F.round("score", 9).alias("score"))


@query("fts_bm25", f"WITH {CHUNKS} SELECT path, ord, round(score, 6) AS score FROM {FTS} ORDER BY round(score, 9) DESC, path, ord LIMIT 25")
def fts_bm25(spark, d):
    s = S.bm25(_chunks(spark, d), TEXT, ["path", "ord"], {"body": 1.0})
    return s.orderBy(F.desc(F.round("score", 9)), "path", "ord").limit(25).select("path", "ord", F.round("score", 6).alias("score"))


@query("fts_bm25_weighted", f"WITH {NOTES} SELECT path, round(score, 6) AS score FROM {bm25('notes', {'title': 2.0, chr(39) + 'x ' + chr(39) + '||lang||' + chr(39) + ' ' + chr(39) + '||source': 1.0, 'body': 1.0}, ['de', 'src1', 'document', 'die'], 'path')}".replace("'x '||", ""))
def fts_bm25_weighted(spark, d):
    s = S.bm25(T.document_notes(spark, d), "de src1 Document die", ["path"], {"title": 2.0, "tags": 1.0, "body": 1.0})
    return s.select("path", F.round("score", 6).alias("score"))


@query("fts_repeated_term", f"WITH {CHUNKS} SELECT path, ord, round(score, 6) AS score FROM {bm25('chunks', {'body': 1.0}, ['that', 'that', 'with'], 'path, ord')}")
def fts_repeated_term(spark, d):
    return S.bm25(_chunks(spark, d), "that that with", ["path", "ord"], {"body": 1.0}).select("path", "ord", F.round("score", 6).alias("score"))


LIVE = f"WITH {CHUNKS}, live AS (SELECT *, '' AS heading FROM chunks WHERE doc_id % 7 <> 0)"


def change_batches(spark, d):
    """Document notes as three batches of changes: some with an older text, then all others and the new texts, then some that go."""
    n = T.document_notes(spark, d).select("doc_id", "path", "title", "tags", F.coalesce("body", F.lit("")).alias("body"))
    old = n.where("doc_id % 5 <> 0").withColumn("body", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("that older text "), "body")).otherwise(F.col("body")))
    new = n.where("doc_id % 5 = 0 OR doc_id % 4 = 0 OR doc_id % 3 = 0")
    return [(old, n.limit(0)), (new, n.limit(0)), (n.limit(0), n.where("doc_id % 7 = 0"))]


def stored_index(spark, d):
    """The store after these three versions."""
    store = Store(spark, shared_folder(spark, "index"), pieces=lambda notes: C.document_windows(notes.withColumn("doc_id", F.lit(0))).withColumn("heading", F.lit("")))
    for number, (fresh, gone) in enumerate(change_batches(spark, d)):
        store.apply(number, fresh.drop("doc_id"), gone)
    return store


@query("fts_stored", f"{LIVE} SELECT path, ord, round(score, 6) AS score FROM {bm25('live', {'title': 2.0, 'heading': 1.5, 'body': 1.0}, WORDS, 'path, ord')}")
def fts_stored(spark, d):
    return stored_index(spark, d).search(TEXT).select("path", "ord", F.round("score", 6).alias("score"))


@query("fts_stored_top", f"{LIVE} SELECT path, ord, round(score, 6) AS score FROM {bm25('live', {'title': 2.0, 'heading': 1.5, 'body': 1.0}, WORDS, 'path, ord')} ORDER BY round(score, 9) DESC, path, ord LIMIT 25")
def fts_stored_top(spark, d):
    return stored_index(spark, d).search(TEXT, 25).select("path", "ord", F.round("score", 6).alias("score"))


@query("stored_chunks", f"{LIVE} SELECT path, ord, sha256(body) AS body_hash FROM live")
def stored_chunks(spark, d):
    return stored_index(spark, d).table("chunks").select("path", "ord", F.sha2("body", 256).alias("body_hash"))


@query("stream_index_changes", f"{LIVE} SELECT path, count(*) AS n_chunks, sum(length(body)) AS n_chars FROM live GROUP BY 1")
def stream_index_changes(spark, d):
    """The same changes by a stream: three runs, each over what arrived, and one that finds nothing."""
    root = shared_folder(spark, "changes")
    store = Store(spark, f"{root}/index", pieces=lambda notes: C.document_windows(notes.withColumn("doc_id", F.lit(0))).withColumn("heading", F.lit("")))
    for number, (fresh, gone) in enumerate(change_batches(spark, d)):
        rows = fresh.withColumn("deleted", F.lit(False)).unionByName(gone.withColumn("deleted", F.lit(True))).drop("doc_id").withColumn("seq", F.lit(number))
        rows.write.mode("append").parquet(f"{root}/in")
        run_index(spark, f"{root}/in", rows.schema, store, f"{root}/checkpoint")
    run_index(spark, f"{root}/in", rows.schema, store, f"{root}/checkpoint")
    return store.table("chunks").groupBy("path").agg(F.count("*").alias("n_chunks"), F.sum(F.char_length("body")).alias("n_chars"))


@query("vector_topk", f"SELECT vec_id, round({cosine('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round({cosine('e.embedding', 'q.embedding')}, 9) DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    s = S.vector_scores(T.table(spark, d, "embeddings"), _probe(spark, d), ["vec_id"])
    return s.orderBy(F.desc(F.round("score", 9)), "vec_id").limit(10).select("vec_id", F.round("score", 6).alias("score"))


@query("nearest_notes", f"WITH s AS {VEC} SELECT path, ord, round(score, 6) AS score FROM s ORDER BY score DESC, path LIMIT 8")
def nearest_notes(spark, d):
    return S.nearest(_vectors(spark, d), _probe(spark, d), 8).select("path", "ord", F.round("score", 6).alias("score"))


@query("cosine_edge_cases", "SELECT * FROM (VALUES ('same', 1.0::DOUBLE), ('right angle', 0.0::DOUBLE), ('opposite', -1.0::DOUBLE), ('zero', 0.0::DOUBLE), ('longer', 0.0::DOUBLE)) t(name, score)")
def cosine_edge_cases(spark, d):
    rows = [("same", [1.0, 0.0]), ("right angle", [0.0, 1.0]), ("opposite", [-1.0, 0.0]), ("zero", [0.0, 0.0]), ("longer", [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "name string, embedding array<double>")
    return S.vector_scores(v, [1.0, 0.0], ["name"])


@query("rrf_fusion", f"WITH {HYBRID} SELECT path, ord, round(score, 9) AS score FROM g")
def rrf_fusion(spark, d):
    keys = ["path", "ord"]
    lists = [S.ranked(S.bm25(_chunks(spark, d), TEXT, keys, {"body": 1.0}), keys, 50), S.ranked(S.vector_scores(_vectors(spark, d), _probe(spark, d), keys), keys, 50)]
    return S.rrf(lists, keys, 0).select(*keys, F.round("score", 9).alias("score"))


@query("fts_only_degraded", f"WITH {CHUNKS}, f AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, ord) AS r FROM {FTS} QUALIFY r <= 50), best AS (SELECT path, ord, 1.0 / (60 + r) AS score, row_number() OVER (PARTITION BY path ORDER BY r) AS k FROM f) SELECT path, ord, round(CAST(score AS DOUBLE), 9) AS score, 'fts-only' AS mode FROM best WHERE k = 1 ORDER BY best.score DESC, path LIMIT 10")
def fts_only_degraded(spark, d):
    found, meta = S.search(S.bm25(_chunks(spark, d), TEXT, ["path", "ord"], {"body": 1.0}), None, 10, "no embedder")
    return found.select("path", "ord", F.round("score", 9).alias("score"), F.lit(meta["mode"]).alias("mode"))


@query("rerank_identity", f"WITH {HYBRID} SELECT path, ord, round(score, 9) AS score FROM hits")
def rerank_identity(spark, d):
    def failing(_):
        raise RuntimeError("no scorer")

    return S.rerank(hits(spark, d), failing).select("path", "ord", F.round("score", 9).alias("score"))


@query("rerank_stable", f"WITH {HYBRID}, o AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS old FROM hits) SELECT path, CAST(row_number() OVER (ORDER BY length(path) % 2 DESC, old) AS INT) AS rank FROM o WHERE path NOT LIKE '%7.md'")
def rerank_stable(spark, d):
    def scorer(h):
        return h.where(~F.col("path").endswith("7.md")).select("path", (F.char_length("path") % 2).cast("double").alias("rerank_score"))

    return S.rerank(hits(spark, d), scorer).select("path", F.col("rank").cast("int").alias("rank"))


@query("rerank_text", f"WITH {NOTES} SELECT path, title||' - '||substring(trim(regexp_replace(body, '[\\s\\x0B\\x{{0085}}\\p{{Z}}]+', ' ', 'g')), 1, 20) AS text FROM notes WHERE substring(trim(regexp_replace(body, '[\\s\\x0B\\x{{0085}}\\p{{Z}}]+', ' ', 'g')), 1, 20) <> ''")
def rerank_text(spark, d):
    n = T.document_notes(spark, d).select("path", "title", F.substring(X.squeeze(F.col("body")), 1, 20).alias("s")).where("s <> ''")
    return n.select("path", S.rerank_text(F.col("title"), F.lit(" "), F.col("s")).alias("text"))


@query("remember_dedup", f"""WITH p AS (SELECT a.vec_id AS fact, b.vec_id AS note, {cosine('a.embedding', 'b.embedding')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY score DESC, note) AS r FROM p) SELECT fact, note, round(score, 6) AS score, CASE WHEN score >= 0.6 THEN 'append' ELSE 'create' END AS decision FROM k WHERE r = 1""")
def remember_dedup(spark, d):
    v = T.table(spark, d, "embeddings").select("vec_id", "embedding")
    top = E.nearest_each(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding")  # the stated query set
    return top.select("fact", "note", F.round("score", 6).alias("score"), F.when(F.col("score") >= 0.6, "append").otherwise("create").alias("decision"))


@query("remember_dedup_index", "SELECT count(*) FILTER (vec_id % 20 = 0) AS facts, true AS recall_is_enough FROM embeddings")
def remember_dedup_index(spark, d):
    """How many facts the inverted file answers, and whether 0.9 of them and more are those of the exact route."""
    v = T.table(spark, d, "embeddings").select("vec_id", "embedding")
    rows, facts = V.ready(v, "vec_id", "embedding"), V.ready(v.where("vec_id % 20 = 0"), "vec_id", "embedding")
    coarse = V.fit(rows)
    found, truth = V.near(facts, V.index(rows, coarse), 1, coarse), V.near(facts, V.exact(rows), 1)
    both = truth.select("query", "k").join(found.select("query", F.col("k").alias("got")), "query", "left")
    return both.agg(F.count("*").alias("facts"), (F.avg((F.col("got") == F.col("k")).cast("int")) >= 0.9).alias("recall_is_enough"))


@query("vector_topk_each", f"SELECT a.vec_id AS query, b.vec_id AS k, round({cosine('a.embedding', 'b.embedding')}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({cosine('a.embedding', 'b.embedding')}, 12) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10")
def vector_topk_each(spark, d):
    """The ten nearest rows of each stated query, by the exact route."""
    rows = V.ready(T.table(spark, d, "embeddings"), "vec_id", "embedding")
    return V.near(rows.where("k % 20 = 0"), V.exact(rows), 10).select("query", "k", F.round("score", 6).alias("score"), "rank")


@query("embedded_chunks", "SELECT DISTINCT sha256(text) AS chunk_hash, h.doc_id IS NOT NULL AS reused, CASE WHEN h.doc_id IS NULL THEN CAST(length(text) AS DOUBLE) ELSE -1.0 END AS v0, CASE WHEN h.doc_id IS NULL THEN CAST(octet_length(encode(text)) AS DOUBLE) ELSE -1.0 END AS v1 FROM documents d LEFT JOIN (SELECT sha256(text) AS k, min(doc_id) AS doc_id FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL GROUP BY 1) h ON h.k = sha256(d.text) WHERE text IS NOT NULL")
def embedded_chunks(spark, d):
    """Documents of every third id have stored vectors; the others' texts are embedded, each distinct one once."""
    chunks = T.table(spark, d, "documents").where("text is not null").select("doc_id", X.content_hash(F.col("text")).alias("chunk_hash"), "text")
    stored = chunks.where("doc_id % 3 = 0").select("chunk_hash", F.lit("sizes").alias("model"), F.array(F.lit(-1.0), F.lit(-1.0)).alias("vec"))
    sizes = E.Embedder("sizes", lambda texts: [[float(len(t)), float(len(t.encode()))] for t in texts])
    got = E.refreshed(chunks, stored, sizes)
    return got.select("chunk_hash", (F.col("vec")[0] == -1).alias("reused"), F.col("vec")[0].alias("v0"), F.col("vec")[1].alias("v1"))
