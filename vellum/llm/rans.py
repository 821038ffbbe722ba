"""Token-id files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all ids, serves every block. A block holds whole consecutive documents; its ids
are dealt over interleaved lanes that are coded together in numpy. Each block carries, every STEP_ROWS rows of lanes,
a checkpoint (lane states and place in the words), from which `read_ids` starts to decode a range, and a checksum of
all its fields that begins with the table's own, so that no block is read with another table.

The files: `codebook`, a Parquet row with format version, table, coding parameters and checksum, and `blocks`, a
Parquet dataset in directories shard=N; shards, and blocks in a shard, ascend in doc_id order (null first; equal ids
by the hash of their text). Nothing else is needed to decode them.

Edge cases: a null or empty text is the end id alone; repeated rows are written each for itself; an empty table
gives an empty dataset; other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import scratch, units

SCALE_BITS = 22
LOW = np.uint64(1 << 31)
LANES = 512
STEP_ROWS = 512
BLOCK_IDS = 1 << 20
SHARD_BYTES = 48 << 20

VERSION = 1
CODEBOOK = "version int, scale_bits int, lanes int, step_rows int, ids binary, freqs binary, crc long"
TOKENS = "shard int, block int, doc_ids binary, null_ids binary, lengths binary, ids binary"
BLOCKS = "shard int, block int, n_docs long, n_ids long, doc_ids binary, null_ids binary, lengths binary, states binary, marks binary, words binary, crc long"


class Codebook:
    """Quantised frequencies of the ids: every id that occurs has at least one of the 2**SCALE_BITS slots."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        total, size = int(counts.sum()), 1 << SCALE_BITS
        freq = np.maximum(1, (counts.astype(np.float64) / max(total, 1) * size).astype(np.int64))
        over = int(freq.sum()) - size
        if len(freq):
            for i in np.argsort(-freq):
                if not over:
                    break
                step = min(over, int(freq[i]) - 1) if over > 0 else over
                freq[i] -= step
                over -= step
        self._lay(ids, freq)

    def _lay(self, ids: np.ndarray, freq: np.ndarray) -> None:
        self.ids = np.asarray(ids, np.uint32)
        self.freq = freq.astype(np.uint64)
        self.base = (np.cumsum(freq) - freq).astype(np.uint64)
        self.rank = np.full(int(self.ids.max()) + 1 if len(self.ids) else 0, -1, np.int64)
        self.rank[self.ids] = np.arange(len(self.ids))
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def __getstate__(self):
        return self.__dict__ | {"_slots": None}

    def row(self) -> tuple:
        """As a row of CODEBOOK."""
        head = (VERSION, SCALE_BITS, LANES, STEP_ROWS)
        ids, freq = self.ids.astype("<u4").tobytes(), self.freq.astype("<u4").tobytes()
        return *head, bytearray(ids), bytearray(freq), zlib.crc32(freq, zlib.crc32(ids, zlib.crc32(np.array(head, "<u4").tobytes())))

    @property
    def crc(self) -> int:
        return self.row()[-1]

    @classmethod
    def of_row(cls, row) -> Codebook:
        """The table of a row of CODEBOOK; an error where it is damaged or of another format."""
        if (row["version"], row["scale_bits"], row["lanes"], row["step_rows"]) != (VERSION, SCALE_BITS, LANES, STEP_ROWS):
            raise ValueError("token files of another format")
        book = cls.__new__(cls)
        book._lay(np.frombuffer(bytes(row["ids"]), "<u4"), np.frombuffer(bytes(row["freqs"]), "<u4").astype(np.int64))
        if book.crc != row["crc"]:
            raise ValueError("codebook checksum differs")
        return book


def encode_block(ids: np.ndarray, book: Codebook, lanes: int = LANES, step: int = STEP_ROWS) -> tuple[bytes, bytes, bytes]:
    """(lane states, checkpoints, words). Decoding starts with the states and reads the words forwards."""
    sym = book.rank[ids]
    rows = -(-len(sym) // lanes)
    x = np.full(lanes, LOW, np.uint64)
    out: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    written = 0
    for r in range(rows - 1, -1, -1):
        s = sym[r * lanes : (r + 1) * lanes]
        n = len(s)
        f, b, y = book.freq[s], book.base[s], x[:n]
        full = y >= (f << np.uint64(63 - SCALE_BITS))
        if full.any():
            w = y[full]
            out.append((w & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            written += len(w)
            y[full] = w >> np.uint64(32)
        q = y // f
        x[:n] = (q << np.uint64(SCALE_BITS)) + (y - q * f) + b
        if r and r % step == 0:
            marks.append(np.append(x, np.uint64(written)))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    if marks:  # places count from the front of the words
        m = np.array(marks[::-1])
        m[:, -1] = np.uint64(written) - m[:, -1]
    return x.tobytes(), (m.tobytes() if marks else b""), words.tobytes()


def decode_rows(states: np.ndarray, words: np.ndarray, at: int, n: int, book: Codebook, lanes: int = LANES) -> np.ndarray:
    """The next n ids from lane states and a place in the words."""
    x, out = states.copy(), np.empty(n, np.uint32)
    slots, freq, base = book.slots, book.freq, book.base
    low = np.uint64((1 << SCALE_BITS) - 1)
    for r in range(0, n, lanes):
        y = x[: min(lanes, n - r)]
        slot = y & low
        s = slots[slot.astype(np.int64)]
        out[r : r + len(y)] = s
        y[:] = freq[s] * (y >> np.uint64(SCALE_BITS)) + slot - base[s]
        short = np.flatnonzero(y < LOW)
        if len(short):
            y[short] = (y[short] << np.uint64(32)) | words[at : at + len(short)]
            at += len(short)
    return book.ids[out]


def checksum(row: dict, book_crc: int) -> int:
    """CRC-32 over the codebook's checksum and every field of a block."""
    crc = zlib.crc32(np.array([row[c] for c in ("shard", "block", "n_docs", "n_ids")], "<i8").tobytes(), book_crc)
    for c in ("doc_ids", "null_ids", "lengths", "states", "marks", "words"):
        crc = zlib.crc32(row[c], zlib.crc32(len(row[c]).to_bytes(8, "little"), crc))
    return crc


def checked(batch: pa.RecordBatch, book_crc: int):
    """The blocks of a batch as dicts; an error where a checksum differs."""
    for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
        if checksum(row, book_crc) != row["crc"]:
            raise ValueError(f"checksum of block {row['block']} in shard {row['shard']} differs")
        yield row


def decode_block(states: bytes, marks: bytes, words: bytes, n: int, book: Codebook, first: int = 0, last: int | None = None, lanes: int = LANES, step: int = STEP_ROWS) -> tuple[int, np.ndarray]:
    """(place of the first id returned, ids): those of a block from the last checkpoint at or before place `first`, up to place `last`."""
    w, x, at, row = np.frombuffer(words, np.uint32), np.frombuffer(states, np.uint64), 0, 0
    m = np.frombuffer(marks, np.uint64).reshape(-1, lanes + 1)
    k = min(first // lanes // step, len(m))
    if k:
        x, at, row = m[k - 1, :-1], int(m[k - 1, -1]), k * step
    return row * lanes, decode_rows(x, w, at, (n if last is None else min(n, last)) - row * lanes, book, lanes)


def _tokenise(path: str, end_id: int):
    """Sorted (doc_id, text) rows of a range -> rows of whole documents, of about BLOCK_IDS ids."""

    def run(batches):
        shard, block = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal block, size
            d, z, n, i = (np.concatenate(x) for x in zip(*held))
            row = [[shard], [block], [d.tobytes()], [z.tobytes()], [n.tobytes()], [i.tobytes()]]
            held.clear()
            block, size = block + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "block", "doc_ids", "null_ids", "lengths", "ids"])

        for batch in batches:
            for rows, buf, offs in K.pieces(batch):
                ids, borders = units.encode(buf, offs, path)
                n = np.diff(borders) + 1
                ends = np.cumsum(n) - 1
                all_ids = np.full(len(ids) + len(n), end_id, np.uint32)
                keep = np.ones(len(all_ids), bool)
                keep[ends] = False
                all_ids[keep] = ids
                col = rows.column("doc_id").combine_chunks()
                held.append((col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), col.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), n.astype(np.int64), all_ids.astype(np.uint16) if narrow(path) else all_ids))
                size += len(all_ids)
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


def narrow(path: str) -> bool:
    return units.tokenizer(path).get_vocab_size() <= 1 << 16


def _wide(raw: bytes, path_narrow: bool) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if path_narrow else np.uint32)


def write(docs: DataFrame, path: str, out: str, end_id: int = 2) -> Codebook:
    """Write the ids of all documents, each with end_id after it, to the files at `out`; returns the table, which they hold too."""
    spark = docs.sparkSession
    small = narrow(path)
    texts = docs.select("doc_id", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = texts.withColumn("tie", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), "tie"]
    ranged = keyed.repartitionByRange(max(1, -(-int(total) // SHARD_BYTES)), *order).sortWithinPartitions(*order)
    tokens = scratch.settle(ranged.drop("tie").mapInArrow(_tokenise(path, end_id), TOKENS), "tokens")
    scratch.release(spark)

    def count(batches):
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                c = np.bincount(_wide(raw.as_py(), small))
                if len(c) > len(n):
                    n = np.concatenate([n, np.zeros(len(c) - len(n), np.int64)])
                n[: len(c)] += c
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    book = Codebook(np.asarray(counts["id"]), np.asarray(counts["n"]))
    spark.createDataFrame([book.row()], CODEBOOK).coalesce(1).write.parquet(f"{out}/codebook")
    shared, book_crc = spark.sparkContext.broadcast(book), book.crc

    def code(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                ids = _wide(row["ids"], small)
                states, marks, words = encode_block(ids, shared.value)
                vals = [row["shard"], row["block"], len(row["lengths"]) // 8, len(ids), row["doc_ids"], row["null_ids"], row["lengths"], states, marks, words]
                vals.append(checksum(dict(zip(BLOCK_NAMES, vals)), book_crc))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(vals, [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.binary()] * 6 + [pa.int64()])], names=BLOCK_NAMES)

    tokens.mapInArrow(code, BLOCKS).write.partitionBy("shard").option("compression", "zstd").parquet(f"{out}/blocks")
    scratch.drop(spark, tokens)
    return book


BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def codebook(spark: SparkSession, out: str) -> Codebook:
    """The table of the files at `out`."""
    return Codebook.of_row(spark.read.schema(CODEBOOK).parquet(f"{out}/codebook").first())


def _blocks(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, first place of each shard's blocks): one window over the shards, a row per SHARD_BYTES of text."""
    rows = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    sums = rows.groupBy("shard", "block").agg(F.sum("n_ids").alias("n_ids"))
    shards = sums.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    in_shard = sums.select("shard", "block", "n_ids", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("block_start"))
    return rows, in_shard.join(before, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("first"), "n_ids")


def read_ids(spark: SparkSession, out: str, first: int, last: int) -> DataFrame:
    """start, ids (little-endian unsigned 32-bit): the ids at places first to last - 1 of all, in runs; only their blocks are decoded, from checkpoints."""
    rows, starts = _blocks(spark, out)
    wanted = starts.where((F.col("first") < last) & (F.col("first") + F.col("n_ids") > first)).select("shard", "block", "first")
    shared, book_crc = (b := spark.sparkContext.broadcast(codebook(spark, out))), b.value.crc
    schema = "start long, ids binary"

    def decode(batches):
        for batch in batches:
            for row in checked(batch, book_crc):
                lo, hi = max(0, first - row["first"]), min(row["n_ids"], last - row["first"])
                at, ids = decode_block(row["states"], row["marks"], row["words"], row["n_ids"], shared.value, lo, hi)
                yield pa.RecordBatch.from_arrays([pa.array([row["first"] + lo]), pa.array([ids[lo - at :].astype("<u4").tobytes()])], names=["start", "ids"])

    return rows.join(wanted, ["shard", "block"]).mapInArrow(decode, schema)


def read(spark: SparkSession, out: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids if keep_ids) of each document in the files at `out`."""
    rows, starts = _blocks(spark, out)
    starts = starts.drop("n_ids")
    book = codebook(spark, out)
    book_crc = book.crc
    shared = spark.sparkContext.broadcast(book)
    names = ["shard", "block", "doc_id", "place", "n_tokens", "ids_crc32", *["ids"] * keep_ids]

    def decode(batches):
        for batch in batches:
            for row in checked(batch, book_crc):
                raw = decode_block(row["states"], row["marks"], row["words"], row["n_ids"], shared.value)[1].astype("<u4").tobytes()
                n = np.frombuffer(row["lengths"], np.int64)
                place = np.cumsum(n) - n
                parts = [raw[4 * a : 4 * (a + m)] for a, m in zip(place.tolist(), n.tolist())]
                ids = pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["null_ids"], np.uint8).astype(bool))
                cols = [pa.array([row["shard"]] * len(n), pa.int32()), pa.array([row["block"]] * len(n), pa.int32()), ids, pa.array(place), pa.array(n), pa.array([zlib.crc32(p) for p in parts], pa.int64()), *[pa.array(parts, pa.binary())] * keep_ids]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    got = rows.mapInArrow(decode, "shard int, block int, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
    return got.join(starts, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)
