"""Vectors from text: a pluggable embedder, reuse of stored vectors, batch neighbours, reranker choice."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators import incremental, vectors

VECTOR = "array<double>"


@dataclass(frozen=True)
class Embedder:
    """A model's name and a function of texts to vectors, called on executors with one Arrow batch's texts."""

    model: str
    call: Callable[[list[str]], list[list[float]]]

    def available(self) -> bool:
        """Does it answer a text with a vector?"""
        try:
            return len(self.call(["probe"])[0]) > 0
        except Exception:  # noqa: BLE001 - foreign code; without vectors search goes on by words
            return False


def hashing(dims: int = 64) -> Embedder:
    """An embedder without a model: signed counts of hashed words, of length one."""

    def call(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dims
            for w in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % dims] += 1.0 if h >> 31 else -1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out

    return Embedder(f"hashing-{dims}", call)


def embed(texts: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """texts with the column vec."""
    import pyarrow as pa

    schema = texts.drop("vec").schema.add("vec", T.ArrayType(T.DoubleType()))
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            vecs = embedder.call(batch.column(text).to_pylist())
            cols = [pa.array(vecs, pa.list_(pa.float64())) if n == "vec" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return texts.drop("vec").mapInArrow(run, schema)


def refreshed(chunks: DataFrame, stored: DataFrame, embedder: Embedder) -> DataFrame:
    """(chunk_hash, model, vec) of all chunks (chunk_hash, text): stored vectors of the model, the others embedded once a hash."""
    plan = incremental.embed_plan(chunks.select("chunk_hash", "text").dropDuplicates(["chunk_hash"]), stored, embedder.model)
    model = F.lit(embedder.model).alias("model")
    kept = plan.where("reused").select("chunk_hash", model, F.col("vec").cast(VECTOR).alias("vec"))
    new = embed(plan.where(~F.col("reused")).select("chunk_hash", "text"), embedder)
    return kept.unionByName(new.select("chunk_hash", model, "vec"))


def description_vectors(descriptions: Iterable[str], cache: dict[str, list[float]], embedder: Embedder) -> dict[str, list[float]]:
    """Description -> vector of the handful of mounts; the cache, keyed by model and text, takes the new ones."""
    key = lambda d: hashlib.sha256(f"{embedder.model}\n{d}".encode()).hexdigest()
    wanted = [d for d in dict.fromkeys(descriptions) if d]
    new = [d for d in wanted if key(d) not in cache]
    if new and embedder.available():
        cache.update(zip(map(key, new), embedder.call(new)))
    return {d: cache[key(d)] for d in wanted if key(d) in cache}


def choose(configured: str, candidates: Iterable[str], score: Callable[[str, str, list[str]], list[float | None]]) -> tuple[str, str, str]:
    """(endpoint, source, reason). Configured goes first, `off` switches reranking off, else the first candidate that scores a probe.

    score(endpoint, query, documents) gives a number for each document; anything else is no answer.
    """
    url = configured.strip()
    if url.lower() == "off":
        return "", "off", "disabled"
    if url:
        return url, "configured", ""
    for c in candidates:
        try:
            said = score(c, "a", ["a", "b"])
        except Exception:  # noqa: BLE001 - no answer is a miss
            continue
        if said and all(isinstance(x, int | float) for x in said):
            return c, "discovered", ""
    return "", "off", "no runtime"


def nearest_each(facts: DataFrame, notes: DataFrame, key: str, vector: str, by_index: bool = False, probes: int | None = None) -> DataFrame:
    """J14 in a batch: (fact, note, score): of each fact the most similar other row, the least key among equals.

    The exact route compares each fact with all rows of its length, in blocks; the index compares it with the rows of
    the cells that it probes. Null vectors and null keys take no part.
    """
    asked, rows = vectors.ready(facts, key, vector), vectors.ready(notes, key, vector)
    if by_index:
        coarse = vectors.fit(rows)
        found = vectors.near(asked, vectors.index(rows, coarse), 1, coarse, probes)
    else:
        found = vectors.near(asked, vectors.exact(rows), 1)
    return found.select(F.col("query").alias("fact"), F.col("k").alias("note"), "score")
