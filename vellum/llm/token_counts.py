"""Token counts by a map-side two-tier lookup.

Tier 1 is a broadcast hash table of fixed size with the token numbers of frequent units (white space and the
word after it). Tier 2 is each worker's bounded cache in front of the tokenizers library. No unit is shuffled;
the table is drawn from a bounded sample of documents and only steers speed, never the counts.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows give one row
each; an empty table gives an empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import units

#: Documents in the sample that fills tier 1, and entries of tier 1.
SAMPLE_DOCS, ENTRIES = 4096, 1 << 16
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Frequent:
    """A compact read-only hash table: unit hash -> number of tokens (1 to 255)."""

    BITS = 18

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        self.key = np.zeros(1 << self.BITS, np.uint64)
        self.size = np.zeros(1 << self.BITS, np.uint8)
        for h, n in zip(hashes.tolist(), sizes.tolist()):
            slot = h >> (64 - self.BITS)
            while self.key[slot]:
                slot = (slot + 1) & ((1 << self.BITS) - 1)
            self.key[slot], self.size[slot] = h, n

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, known) of the hashes; an unknown one has size 0."""
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        at = self.key[slot]
        open_ = np.flatnonzero((at != h) & (at != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
            at = self.key[slot[open_]]
            open_ = open_[(at != h[open_]) & (at != 0)]
        known = (self.key[slot] == h) & (h != 0)
        return np.where(known, self.size[slot], 0).astype(np.int64), known


def frequent(docs: DataFrame, path: str, sample: int = SAMPLE_DOCS, entries: int = ENTRIES) -> Frequent:
    """Tier 1 from about `sample` documents chosen by a hash of their ids; at most `entries` rows reach the driver."""
    n = docs.count()
    some = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // sample))) == 0)

    def count(batches):
        for batch in batches:
            for _, buf, offs in K.pieces(batch):
                borders, _ = units.split(buf, offs)
                if len(borders) < 2:
                    continue
                a, b = borders[:-1], borders[1:]
                h, one, times = np.unique(K.spans_hash(K.rolling(buf), a, b), return_index=True, return_counts=True)
                _, size = units.table(path).find(buf, a[one], b[one], h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times), pa.array(size)], names=["h", "n", "size"])

    top = some.mapInArrow(count, "h long, n long, size long").groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    rows = top.where("size between 1 and 255 and h <> 0").orderBy(F.desc("n"), "h").limit(entries).select("h", "size").toArrow()
    return Frequent(np.asarray(rows["h"]).view(np.uint64) if len(rows) else np.zeros(0, np.uint64), np.asarray(rows["size"]))


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, as the tokenizers file at `path` counts them."""
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))

    def count(batches):
        tier1 = known.value
        for batch in batches:
            for rows, buf, offs in K.pieces(batch):
                borders, first = units.split(buf, offs)
                a, b = borders[:-1], borders[1:]
                h = K.spans_hash(K.rolling(buf), a, b)
                size, hit = tier1.look(h)
                miss = np.flatnonzero(~hit)
                if len(miss):
                    size[miss] = units.table(path).find(buf, a[miss], b[miss], h[miss])[1]
                n = np.diff(np.concatenate([[0], np.cumsum(size)])[first])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
