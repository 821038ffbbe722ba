"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A block is what one task reads. Its pre-tokens are exploded with their positions: the block's distinct words are
rows (block, slot, word), and each document keeps its words' slots in order. Words are shuffled, so that each
distinct word of the whole table is encoded once; ids go back to (block, slot), and the block's documents are put
together by position. Decoding looks ids up in the broadcast token-byte table (as many rows as the vocabulary).

`docs` must be a plan that gives the same rows in each partition when it runs again (a table scan is), as words and
positions come from two runs over it; each run gives a digest of each block's words in their order, and where the
two differ, or a block is in one run only, it is an error.

Edge cases: a null or empty text has 0 tokens and the hash of no bytes; repeated rows give a row each; a null
doc_id stays null; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, scratch, units
from . import kernels as K

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: A block takes no further text beyond so many words or bytes; the task then begins another.
BLOCK_WORDS, BLOCK_BYTES = 1 << 20, 64 << 20
#: Table bytes for each partition of the word shuffle.
SHUFFLE_BYTES = 32 << 20
#: Distinct words whose ids a task keeps at most; beyond, it forgets them and encodes again what comes again.
KNOWN_WORDS = 1 << 20
TEXT_BYTES = 2_000_000
IDS = ["block", "slots", "sizes", "ids", "digest"]
_state: dict[str, object] = {}


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a ranks file, loaded once per worker."""
    if path not in _state:
        import tiktoken

        _state[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    return _state[path]


def pretokens(buf: np.ndarray, offs: np.ndarray, pattern: str) -> np.ndarray:
    """Borders of the pre-tokens, which cover the bytes without gaps."""
    import regex

    borders, _ = units.split(buf, offs)
    if len(borders) < 2:
        return borders
    a, b = borders[:-1], borders[1:]
    kind = bpe.CLASS[buf]
    lead = np.flatnonzero((buf == 0xC2) | (buf == 0xC3))
    lead = lead[lead + 1 < len(buf)]
    kind[lead] = kind[lead + 1] = bpe.CLASS[((buf[lead] & 3) << 6) | (buf[lead + 1] & 0x3F)]
    start = np.empty(len(buf) + 1, bool)
    start[0] = start[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:-1])
    start[borders] = True
    inner = np.ones(len(buf), bool)
    inner[a] = False
    before = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & inner[1:])
    start[before] = True
    start[before[buf[before] == 0x20] + 1] = False
    ok = bpe.plain(buf, a, b)
    find = regex.compile(pattern)
    for x, y in zip(a[~ok].tolist(), b[~ok].tolist()):
        start[x:y] = False
        raw = buf[x:y].tobytes()
        if raw.isascii():
            start[[x + m.start() for m in find.finditer(raw.decode())]] = True
        else:
            at = x
            for m in find.findall(raw.decode()):
                start[at] = True
                at += len(m.encode())
    return np.flatnonzero(start)


class Slots:
    """The words of a block: 64-bit hash -> slot, in order of first appearance. The table doubles when half full."""

    BITS = 22

    def __init__(self):
        self.bits = self.BITS
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.zeros(1 << self.bits, np.uint32)
        self.n, self.sum = 0, 0

    def add(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots of the words, places of the words that are new)."""
        h = np.where(h == 0, np.uint64(1), h)
        at = self._at(h)
        miss = np.flatnonzero(self.key[at] != h)
        new = np.zeros(0, np.int64)
        if len(miss):
            _, one = np.unique(h[miss], return_index=True)
            new = np.sort(miss[one])
            self._make_room(self.n + len(new))
            place = np.arange(self.n, self.n + len(new), dtype=np.uint64)
            self._insert(h[new], place)
            self.sum = (self.sum + int(np.sum(K.mix(h[new] + K.mix(place + np.uint64(1))), dtype=np.uint64))) & K.MASK
            self.n += len(new)
            at = self._at(h)
        return self.slot[at], new

    def _make_room(self, words: int) -> None:
        if 2 * words <= len(self.key):
            return
        full = np.flatnonzero(self.key)
        h, slots = self.key[full], self.slot[full]
        self.bits = (2 * words - 1).bit_length()
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.zeros(1 << self.bits, np.uint32)
        self._insert(h, slots)

    def _insert(self, h: np.ndarray, slots: np.ndarray) -> None:
        """Different hashes that are not in the table; those that ask for the same free place take turns."""
        while len(h):
            where = self._at(h)
            self.key[where] = h
            won = self.key[where] == h
            self.slot[where[won]] = slots[won]
            h, slots = h[~won], slots[~won]

    def digest(self) -> bytes:
        """Of the words in their order."""
        return b"%d %d" % (self.n, self.sum)

    def _at(self, h: np.ndarray) -> np.ndarray:
        last = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.key[at]
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & last
            got = self.key[at[open_]]
            open_ = open_[(got != h[open_]) & (got != 0)]
        return at


def _planes(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unplanes(raw: bytes) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def _walk(batches, pattern: str):
    """For each slice of a task's texts: (block, slots of the block, rows, texts, borders, slot of each word, new words)."""
    part, block, slots, size = TaskContext.get().partitionId(), 0, Slots(), 0
    for batch in batches:
        for rows, buf, offs in K.pieces(batch, limit=TEXT_BYTES):
            if slots.n > BLOCK_WORDS or size > BLOCK_BYTES:
                block, slots, size = block + 1, Slots(), 0
            size += len(buf)
            borders = pretokens(buf, offs, pattern)
            h = K.spans_hash(K.rolling(buf), borders[:-1], borders[1:]) if len(borders) > 1 else np.zeros(0, np.uint64)
            slot, new = slots.add(h)
            yield (part << 24) | block, slots, rows, buf, offs, borders, slot, new


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    spark, texts = docs.sparkSession, docs.select("doc_id", "text")

    def to_words(batches):
        """New words of each slice; after each block a row without a word, its digest in its place."""

        def end(block: int, slots: Slots) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), pa.array([slots.digest()], pa.binary())], names=["block", "slot", "word"])

        last = None
        for block, slots, _, buf, _, borders, _, new in _walk(batches, pattern):
            if last and last[0] != block:
                yield end(*last)
            last = block, slots
            lens = (borders[1:] - borders[:-1])[new] if len(new) else np.zeros(0, np.int64)
            words = K.blobs(buf[K.gather(borders[:-1][new], lens)], np.concatenate([[0], np.cumsum(lens)]))
            first = slots.n - len(new)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), block)), pa.array(np.arange(first, slots.n, dtype=np.int32)), words], names=["block", "slot", "word"])
        if last:
            yield end(*last)

    def to_docs(batches):
        for block, slots, rows, _, offs, borders, slot, _ in _walk(batches, pattern):
            n = np.diff(np.searchsorted(borders, offs, "left")).astype("<u4")
            col = rows.column("doc_id").combine_chunks()
            ids, null = col.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), col.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            vals = [block, ids.tobytes(), null.tobytes(), n.tobytes(), _planes(slot), slots.n, slots.digest()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(vals, [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()])], names=["block", "doc_ids", "null_ids", "counts", "slots", "n_words", "digest"])

    def to_ids(batches):
        """A partition has all rows of its words: each is encoded once, and its ids go back to every (block, slot)."""
        enc, known = encoding(path, pattern), {}
        for batch in batches:
            is_end = pc.less(batch.column("slot"), 0)
            ends, batch = batch.filter(is_end), batch.filter(pc.invert(is_end))
            if len(ends):
                none = pa.nulls(len(ends), pa.binary())
                yield pa.RecordBatch.from_arrays([ends.column("block"), none, none, none, ends.column("word").cast(pa.binary())], names=IDS)
            if not len(batch):
                continue
            if len(known) > KNOWN_WORDS:
                known.clear()
            coded = batch.column("word").dictionary_encode()
            got = []
            for w in coded.dictionary.to_pylist():
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = np.array(enc._encode_single_piece(w) if w not in enc._mergeable_ranks else [enc._mergeable_ranks[w]], "<u4").tobytes()
                got.append(ids)
            code, blocks, slots = coded.indices.to_numpy(), batch.column("block").to_numpy(), batch.column("slot").to_numpy()
            size = np.fromiter(map(len, got), np.int64, len(got)) >> 2
            flat = np.frombuffer(b"".join(got), "<u4")
            start = np.cumsum(size) - size
            order = np.lexsort((slots, blocks))
            code, blocks, slots = code[order], blocks[order], slots[order]
            cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])).tolist() + [len(blocks)]
            out = [[], [], [], []]
            for x, y in zip(cuts, cuts[1:]):
                c = code[x:y]
                for o, v in zip(out, (int(blocks[x]), _planes(slots[x:y]), _planes(size[c]), _planes(flat[K.gather(start[c], size[c])]))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(o, pa.binary()) for o in out[1:]], pa.nulls(len(out[0]), pa.binary())], names=IDS)

    vocabulary = ranks(path)
    table: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
    for token, rank in vocabulary.items():
        table[rank] = token
    shared = spark.sparkContext.broadcast(table)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens = shared.value
        n = max(pc.max(left["n_words"]).as_py() or 0, 0) if len(left) else 0
        here = {d for k, d in zip(left["n_words"].to_pylist(), left["digest"].to_pylist()) if k == n}
        there = set(right["digest"].drop_null().to_pylist())
        if len(here) != 1 or here != there:
            raise ValueError("the table gave other rows when it was read again")
        right = right.filter(pc.is_null(right["digest"]))
        size, texts_, raws = np.zeros(n, np.int64), [b""] * n, [b""] * n
        for s, z, i in zip(right["slots"], right["sizes"], right["ids"]):
            slots, sizes, ids = _unplanes(s.as_py()), _unplanes(z.as_py()), _unplanes(i.as_py()).tolist()
            size[slots] = sizes
            at = 0
            for slot, k in zip(slots.tolist(), sizes.tolist()):
                own = ids[at : at + k]
                at += k
                texts_[slot] = b"%d," % own[0] if k == 1 else (",".join(map(str, own)) + ",").encode()
                raws[slot] = tokens[own[0]] if k == 1 else b"".join([tokens[t] for t in own])
        if n and not size.all():
            raise ValueError("the table gave other rows when it was read again")
        out = [[], [], [], []]
        for row in left.to_pylist():
            slots = _unplanes(row["slots"])
            counts = np.frombuffer(row["counts"], "<u4")
            ends = np.cumsum(counts).tolist()
            totals = np.concatenate([[0], np.cumsum(size[slots])])
            as_list, begin = slots.tolist(), 0
            null = row["null_ids"]
            for j, (d, end) in enumerate(zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), ends)):
                own = as_list[begin:end]
                out[0].append(None if null[j] else d)
                out[1].append(int(totals[end] - totals[begin]))
                out[2].append(hashlib.sha256(b"".join([texts_[s] for s in own])[:-1]).hexdigest())
                out[3].append(hashlib.sha256(b"".join([raws[s] for s in own])).hexdigest())
                begin = end
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    words = texts.mapInArrow(to_words, "block long, slot int, word binary")
    ids = words.repartition(scratch.parts(docs, SHUFFLE_BYTES), "word").mapInArrow(to_ids, "block long, slots binary, sizes binary, ids binary, digest binary")
    positions = texts.mapInArrow(to_docs, "block long, doc_ids binary, null_ids binary, counts binary, slots binary, n_words long, digest binary")
    return positions.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(together, SCHEMA)
