"""Best-fit packing of token pieces into sequences: bounded-space, online.

Each task keeps a fixed number of open sequences. A bitset has a bit for every amount of free space that some
open sequence has, so the tightest fit is one shift and one lowest-bit search. When a new sequence is needed
and all places are taken, the fullest closes.

Edge cases: a null or empty text is the end id alone (one piece of length 1); repeated rows are packed each for
itself; a null doc_id stays null; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import scratch, units

#: Open sequences of a task, and tokens that a packing task gets (about).
OPEN, TASK_TOKENS = 1024, 1 << 25


def pieces(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as little-endian uint32 if keep_ids).

    A document's ids are its tokens and end_id. A longer document than `limit` is cut into pieces of `limit`;
    only its first piece may be shorter.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def cut(batches):
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for rows, buf, offs in K.pieces(batch):
                ids, borders = units.encode(buf, offs, path)
                doc_ids, at = rows.column("doc_id").to_pylist(), borders.tolist()
                out = [[] for _ in names]
                for d, a, b in zip(doc_ids, at, at[1:]):
                    own, n = np.append(ids[a:b], end), b - a + 1
                    raw = own.tobytes()
                    to = n % limit or limit
                    start = k = 0
                    while start < n:
                        part = raw[4 * start : 4 * to]
                        for x, v in zip(out, (d, k, start, to - start, zlib.crc32(part), part)):
                            x.append(v)
                        start, to, k = to, to + limit, k + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


class Packer:
    """Places lengths into sequences of `limit`, one after the other."""

    def __init__(self, limit: int, places: int):
        self.limit, self.places = limit, places
        self.mask, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(limit + 1)]

    def _put(self, seq: int, free: int) -> None:
        if free:
            self.by_free[free].append(seq)
            self.mask |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        seq = own.pop()
        if not own:
            self.mask ^= 1 << free
        self.open -= 1
        return seq

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset in it) of a piece."""
        fit = self.mask >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            seq = self._take(free)
        else:
            if self.open >= self.places:
                self._take((self.mask & -self.mask).bit_length() - 1)
            seq, free = self.made, self.limit
            self.made += 1
        self._put(seq, free - length)
        return seq, self.limit - free


def assign(parts: DataFrame, limit: int = 2048, places: int = OPEN, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """`parts` (any columns, with length from 1 to limit) with sequence_id and offset."""
    total = parts.agg(F.sum("length")).first()[0] or 0
    names = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    schema = parts.select(names).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        first, packer = TaskContext.get().partitionId() << 40, Packer(limit, places)
        for batch in batches:
            got = [packer.place(n) for n in batch.column("length").to_pylist()]
            arrays = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([first + s for s, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())], names=[*names, "sequence_id", "offset"])

    return parts.select(names).repartition(max(1, -(-int(total) // task_tokens))).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most `limit` tokens: a row for each piece, with its place."""
    return assign(scratch.settle(pieces(docs, path, limit, end_id, keep_ids), "pieces"), limit)
