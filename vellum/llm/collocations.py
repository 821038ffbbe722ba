"""Collocations: phrases of two and three words that stand together more often than their parts suggest.

Level by level (words, pairs, triples) a phrase is a candidate only if all shorter phrases inside it may be frequent:
that is a lookup in a bit array of fixed size, BITS bits, where the frequent keys of the level before have their bits,
so it lets some others through and holds none back. Mappers reduce the keys of a block of text to distinct ones with
counts, in one row of arrays a shard. A shard is a range of 64-bit keys. Its candidates get a minimal perfect hash that
stores them; for each part of the blocks one task turns keys into slots, compares the stored keys, and adds the counts
by numpy.bincount; the parts' arrays are summed shard by shard. One more scan brings the words' keys of the phrases that
are frequent, also in arrays. The counts of a phrase's parts are read by slot: each shard asks for each part once, in one array a shard that it asks, however many
of its phrases share it, so a frequent word makes no hot group. Only phrases that may be among a language's best (with
all that tie) become rows; a last scan brings their words, again by bit array and then by key.

Counts and products are exact: scores are computed with integers of any size. Phrases, and language totals, are
identified by 64-bit hashes.

Edge cases: a null or empty text has no words; null lang is `und`; repeated rows count each; an empty table gives an
empty result; phrases never cross documents or punctuation; other columns of the input, whatever their names, are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import scratch
from .perfect_hash import PerfectHash

#: Places of the bit arrays (8 MB); table bytes of a shard, shards at most, bits of their number at least; table bytes of a part's blocks.
BITS, SHARD_BYTES, SHARDS, LEAST_BITS, PART_BYTES = 26, 16 << 20, 1 << 14, 7, 8 << 30
#: Keys that a mapper holds before it reduces them, and distinct ones of a block.
HELD, BLOCK = 1 << 21, 1 << 22
#: First windows of the ranking, a language.
SALTS = 64
BREAKS = ".,;:!?\n\x0b\x0c\r"
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in BREAKS]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of a phrase that goes on with the word b."""
    return K.mix(a * np.uint64(0x9FB21C651E98DF25) + b * np.uint64(3) + np.uint64(0xD6E8FEB86659FD93))


def _lang_keys(langs: list[str]) -> np.ndarray:
    """One key a language: the number of all its words is counted under it."""
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


class Bits:
    """A fixed array of bits at the upper bits of keys."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - BITS)
        return (self.packed[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0


def _sentences(batches) -> Iterator[tuple]:
    """Of each slice: (langs, buffer, starts, ends, keys of the words, does word i + 1 follow word i in a piece?, key of the language, words of each document)."""
    for batch in batches:
        for rows, buf, offs in K.pieces(batch):
            langs = ["und" if x is None else x for x in rows.column("lang").to_pylist()]
            of_lang = _lang_keys(langs)
            starts, ends, borders = K.words(buf, offs, _WORD)
            counts = np.diff(borders)
            doc = np.repeat(np.arange(len(langs)), counts)
            key = K.mix(K.spans_hash(K.rolling(buf, lower=True), starts, ends) ^ of_lang[doc]) if len(starts) else np.zeros(0, np.uint64)
            breaks = np.concatenate([[0], np.cumsum(_BREAK[buf])])
            follows = (doc[1:] == doc[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
            yield langs, buf, starts, ends, key, follows, of_lang, counts, doc


def _phrases(key: np.ndarray, follows: np.ndarray, level: int, bits: list[Bits]) -> tuple[np.ndarray, np.ndarray]:
    """(first words, keys) of the candidates of a level of two or more words."""
    first = np.flatnonzero(follows)
    if level == 3:
        first = first[:-1][first[1:] == first[:-1] + 1]
    common = bits[0].has(key)
    for k in range(level):
        first = first[common[first + k]]
    pair = _join(key[first], key[first + 1])
    if level == 2:
        return first, pair
    ok = bits[1].has(pair)
    first, pair = first[ok], pair[ok]
    ok = bits[1].has(_join(key[first + 1], key[first + 2]))
    first, pair = first[ok], pair[ok]
    return first, _join(pair, key[first + 2])


def _reduce(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    every, number = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, number = every[order], number[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(number, first) if len(first) else np.zeros(0, np.int64)


def _cut(keys: np.ndarray, shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards of ascending keys, borders of their stretches)."""
    shard = (keys >> np.uint64(64 - shard_bits)).astype(np.int32)
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(keys) else np.zeros(0, np.int64)
    return shard[cut], np.append(cut, len(keys))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all rows of a binary column, without a copy of each row."""
    out = [np.zeros(0, "<u8")]
    for chunk in column.chunks:
        if len(chunk):
            offs = np.frombuffer(chunk.buffers()[1], "<i8" if pa.types.is_large_binary(chunk.type) else "<i4")[chunk.offset : chunk.offset + len(chunk) + 1]
            out.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offs[0] : offs[-1]].view("<u8"))
    return np.concatenate(out)


def _shards(docs: DataFrame) -> tuple[int, int]:
    """(bits of a shard's number, parts of the blocks), by the size of the table."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = size if size < 1 << 60 else 0
    bits = (-(-size // SHARD_BYTES) - 1).bit_length() if size > SHARD_BYTES else 0
    return min(max(bits, LEAST_BITS), SHARDS.bit_length() - 1), max(1, -(-size // PART_BYTES))


def count_level(docs: DataFrame, level: int, given: list, shard_bits: int, parts: int, name: str) -> DataFrame:
    """The level's store, written: for each shard the perfect hash of its candidates and their counts by slot."""

    def scan(batches):
        part = TaskContext.get().partitionId() % parts
        bits = [Bits(b.value) for b in given]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            k, n = held[0]
            shards, borders = _cut(k, shard_bits)
            kinds = [pa.array(shards), pa.array(np.full(len(shards), part, np.int32)), K.blobs(k, borders), K.blobs(n.astype("<u4"), borders)]
            return pa.RecordBatch.from_arrays(kinds, names=["shard", "part", "keys", "counts"])

        for _, _, _, _, key, follows, of_lang, n_words, _ in _sentences(batches):
            if level == 1:
                held.append((np.concatenate([key, of_lang]), np.concatenate([np.ones(len(key), np.int64), n_words.astype(np.int64)])))
            elif len(key) >= level:
                found = _phrases(key, follows, level, bits)[1]
                held.append((found, np.ones(len(found), np.int64)))
            else:
                continue
            size += len(held[-1][0])
            if size > HELD:
                held, size = [_reduce(*zip(*held))], 0
                if len(held[0][0]) > BLOCK:
                    yield rows()
                    held = []
        if held:
            held = [_reduce(*zip(*held))]
            if len(held[0][0]):
                yield rows()

    def union(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Distinct keys of a shard's part."""
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([np.unique(_flat(table["keys"])).tobytes()], pa.binary())})

    def hashed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sizes, bits, keys = PerfectHash.build(np.unique(_flat(table["keys"]))).dump()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([bits], pa.list_(pa.binary())), "keys": pa.array([keys], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], hashes: pa.Table, blocks: pa.Table) -> pa.Table:
        """A part's counts by slot."""
        h = hashes.to_pylist()[0]
        table, total = PerfectHash.load(h["sizes"], h["bits"], h["keys"]), None
        for k, n in zip(blocks["keys"].to_pylist(), blocks["counts"].to_pylist()):
            slot, known = table.find(np.frombuffer(k, "<u8"))
            n = np.frombuffer(n, "<u4")  # a block's words are far fewer than 2**32
            # weights are floats: exact below 2**53, and a block's counts lie far below
            got = np.bincount(slot[known], weights=n[known], minlength=len(table.keys)).astype(np.int64)
            total = got if total is None else total + got
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    def tree_sum(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, "<i8") for x in table["counts"].to_pylist()], axis=0, dtype=np.int64)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    blocks = scratch.settle(docs.select("lang", "text").mapInArrow(scan, "shard int, part int, keys binary, counts binary"), f"{name}-{level}-blocks")
    distinct = blocks.select("shard", "part", "keys")
    if parts > 1:
        distinct = distinct.groupBy("shard", "part").applyInArrow(union, "shard int, keys binary")
    hashes = scratch.settle(distinct.groupBy("shard").applyInArrow(hashed, "shard int, sizes array<int>, bits array<binary>, keys binary"), f"{name}-{level}-hashes")
    for_parts = hashes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    summed = for_parts.groupBy("shard", "part").cogroup(blocks.groupBy("shard", "part")).applyInArrow(add, "shard int, counts binary")
    totals = summed.groupBy("shard").applyInArrow(tree_sum, "shard int, counts binary")
    store = scratch.settle(hashes.join(totals, "shard").withColumn("level", F.lit(level)), f"{name}-{level}-store")
    for t in (blocks, hashes):
        scratch.drop(docs.sparkSession, t)
    scratch.release(docs.sparkSession)
    return store


def frequent_bits(store: DataFrame, least: int, shard_bits: int) -> np.ndarray:
    """The packed bits of all keys with `least` and more; each shard has its own stretch of the array, 2**BITS bits in all."""

    def stretch(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.frombuffer(r["keys"], "<u8")[np.frombuffer(r["counts"], "<i8") >= least]
                if len(keys):
                    flags = np.zeros(1 << (BITS - shard_bits), bool)
                    flags[(keys >> np.uint64(64 - BITS)) & np.uint64(len(flags) - 1)] = True
                    yield pa.RecordBatch.from_arrays([pa.array([r["shard"]], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["shard", "flags"])

    out = np.zeros(1 << (BITS - 3), np.uint8)
    width = len(out) >> shard_bits
    for r in store.select("shard", "keys", "counts").mapInArrow(stretch, "shard int, flags binary").toLocalIterator():
        out[r["shard"] * width : (r["shard"] + 1) * width] = np.frombuffer(r["flags"], np.uint8)
    return out


def phrases(docs: DataFrame, bits: list, store: DataFrame, least: int, shard_bits: int, parts: int) -> DataFrame:
    """Arrays (level, shard, keys, counts, words) of the pairs and triples with `least` and more; words: their keys and their language's."""

    def scan(batches):
        part = TaskContext.get().partitionId() % parts
        filters = [Bits(b.value) for b in bits]
        held = {2: [], 3: []}

        def rows(level: int) -> pa.RecordBatch:
            keys, one = np.unique(np.concatenate([k for k, _ in held[level]]), return_index=True)
            words = np.concatenate([w for _, w in held[level]])[one]
            held[level] = [(keys, words)]
            shards, borders = _cut(keys, shard_bits)
            n = len(shards)
            kinds = [pa.array(np.full(n, level, np.int32)), pa.array(shards), pa.array(np.full(n, part, np.int32)), K.blobs(keys, borders), K.blobs(words.reshape(-1), borders * (level + 1))]
            return pa.RecordBatch.from_arrays(kinds, names=["level", "shard", "part", "keys", "words"])

        for _, _, _, _, key, follows, of_lang, _, doc in _sentences(batches):
            for level in (2, 3):
                if len(key) < level:
                    continue
                first, found = _phrases(key, follows, level, filters)
                ok = filters[level - 1].has(found)
                found, one = np.unique(found[ok], return_index=True)
                first = first[ok][one]
                held[level].append((found, np.stack([*[key[first + k] for k in range(level)], of_lang[doc[first]]], 1)))
                if sum(len(k) for k, _ in held[level]) > HELD // 4:  # with their words these take more room
                    made = rows(level)
                    if len(held[level][0][0]) > HELD // 8:
                        yield made
                        held[level] = []
        for level in (2, 3):
            if held[level]:
                yield rows(level)

    def distinct(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        level = key[0].as_py()
        keys, one = np.unique(_flat(table["keys"]), return_index=True)
        words = _flat(table["words"]).reshape(-1, level + 1)[one]
        return pa.table({"level": pa.array([level], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()), "words": pa.array([words.tobytes()], pa.binary())})

    def count(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("words", pa.binary())])
        if not len(left) or not len(right):
            return schema.empty_table()
        mine = distinct(key, left).to_pylist()[0]
        s = right.to_pylist()[0]
        keys = np.frombuffer(mine["keys"], "<u8")
        slot, known = PerfectHash.load(s["sizes"], s["bits"], s["keys"]).find(keys)
        n = np.where(known, np.frombuffer(s["counts"], "<i8")[slot], 0)
        ok = n >= least  # a key that only shares its bit with a frequent one goes
        words = np.frombuffer(mine["words"], "<u8").reshape(len(keys), -1)[ok]
        return pa.table([pa.array([v], t.type) for v, t in zip([mine["level"], mine["shard"], keys[ok].tobytes(), n[ok].tobytes(), words.tobytes()], schema)], schema=schema)

    some = docs.select("lang", "text").mapInArrow(scan, "level int, shard int, part int, keys binary, words binary")
    if parts > 1:
        some = some.groupBy("level", "shard", "part").applyInArrow(distinct, "level int, shard int, keys binary, words binary")
    return some.groupBy("level", "shard").cogroup(store.groupBy("level", "shard")).applyInArrow(count, "level int, shard int, keys binary, counts binary, words binary")


def _parts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, keys of the cuts' parts, language keys) of a shard's phrases."""
    level = row["level"]
    words = np.frombuffer(row["words"], "<u8").reshape(-1, level + 1)
    w = [words[:, k] for k in range(level)]
    cuts = [w[0], w[1]] if level == 2 else [w[0], _join(w[1], w[2]), _join(w[0], w[1]), w[2]]
    return np.frombuffer(row["keys"], "<u8"), np.frombuffer(row["counts"], "<i8"), np.stack(cuts, 1), words[:, level]


ASKED = "level int, shard int, from_level int, source int, keys binary"


def asked(some: DataFrame, shard_bits: int) -> DataFrame:
    """For each shard of phrases and each shard that holds parts of theirs, the distinct parts: (level, shard, from_level, source, keys)."""

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                _, _, cuts, langs = _parts(r)
                if not len(langs):
                    continue
                ones = [langs, cuts[:, 0], cuts[:, -1]]
                for level, keys in ((1, np.unique(np.concatenate(ones))), (2, np.unique(cuts[:, 1:3]) if r["level"] == 3 else np.zeros(0, np.uint64))):
                    if not len(keys):
                        continue
                    shards, borders = _cut(keys, shard_bits)
                    n = len(shards)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, level, np.int32)), pa.array(shards), pa.array(np.full(n, r["level"], np.int32)), pa.array(np.full(n, r["shard"], np.int32)), K.blobs(keys, borders)], names=["level", "shard", "from_level", "source", "keys"])

    return some.mapInArrow(read, ASKED)


def answers(questions: DataFrame, store: DataFrame) -> DataFrame:
    """(level, shard, keys, counts) for the shards that asked: counts read by slot."""

    def read(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"level": left["from_level"], "shard": left["source"], "keys": left["keys"]}
        counts = []
        if len(left):
            s = right.to_pylist()[0]
            table, by_slot = PerfectHash.load(s["sizes"], s["bits"], s["keys"]), np.frombuffer(s["counts"], "<i8")
            for keys in left["keys"].to_pylist():
                slot, known = table.find(np.frombuffer(keys, "<u8"))
                counts.append(np.where(known, by_slot[slot], 0).astype("<i8").tobytes())
        return pa.table({**out, "counts": pa.array(counts, pa.binary())})

    return questions.groupBy("level", "shard").cogroup(store.groupBy("level", "shard")).applyInArrow(read, "level int, shard int, keys binary, counts binary")


SCORED = "level int, shard int, keys binary, langs binary, a binary, l binary, r binary, n binary, score binary, beaten binary"
NUMBERS = ["a", "l", "r", "n", "score"]


def scores(a: np.ndarray, cuts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, r, score) at the cut with the least score, the first of equal ones; integers of any size in between."""
    square = a.astype(object) ** 2 * 1_000_000
    best = None
    for l, r in cuts:  # noqa: E741
        # all parts have the phrase's count at least, so a score is one million at most
        s = (square // (l.astype(object) * r.astype(object))).astype(np.int64)
        if best is None:
            best = [l.copy(), r.copy(), s]
        else:
            less = s < best[2]
            for old, new in zip(best, (l, r, s)):
                old[less] = new[less]
    return tuple(best)


def score(some: DataFrame, counts: DataFrame) -> DataFrame:
    """Arrays a shard: each phrase with its worst cut, its language's words; `beaten`: pairs that the triples make superfluous."""

    def read(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("level", pa.int32()), ("shard", pa.int32()), *[(c, pa.binary()) for c in ("keys", "langs", *NUMBERS, "beaten")]])
        if not len(left) or not len(right):
            return schema.empty_table()
        row = left.to_pylist()[0]
        keys, a, cuts, langs = _parts(row)
        known, f = (np.concatenate([np.frombuffer(x, t) for x in right[c].to_pylist()]) for c, t in (("keys", "<u8"), ("counts", "<i8")))
        order = np.argsort(known)
        known, f = known[order], f[order]
        of = lambda k: f[np.searchsorted(known, k)]
        parts = of(cuts)
        l, r, s = scores(a, [(parts[:, k], parts[:, k + 1]) for k in range(0, parts.shape[1], 2)])  # noqa: E741
        beaten = np.unique(cuts[:, 1:3][100 * a[:, None] >= 50 * parts[:, 1:3]]) if row["level"] == 3 else np.zeros(0, np.uint64)
        values = [keys, langs, a, l, r, of(langs), s, beaten]
        return pa.table([pa.array([row["level"]], pa.int32()), pa.array([row["shard"]], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in values]], schema=schema)

    return some.groupBy("level", "shard").cogroup(counts.groupBy("level", "shard")).applyInArrow(read, SCORED)


def best(scored: DataFrame, top: int, shard_bits: int) -> DataFrame:
    """(key, lang_key, a, l, r, n, score) of phrases that no triple beats, of each shard and language the `top` best and all that tie with the last."""

    def send(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.frombuffer(r["beaten"], "<u8")
                shards, borders = _cut(keys, shard_bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shards), 2, np.int32)), pa.array(shards), K.blobs(keys, borders)], names=["level", "shard", "beaten"])

    def pick(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["key", "lang_key", *NUMBERS]
        cols = {c: np.zeros(0, np.int64) for c in names}
        if len(left):
            row = left.to_pylist()[0]
            keys, langs = np.frombuffer(row["keys"], "<u8"), np.frombuffer(row["langs"], "<i8")
            num = {c: np.frombuffer(row[c], "<i8") for c in NUMBERS}
            ok = np.ones(len(keys), bool)
            if len(right):
                ok = ~np.isin(keys, np.concatenate([np.frombuffer(x, "<u8") for x in right["beaten"].to_pylist()]))
            order = np.lexsort((-num["a"], -num["score"], langs))
            order = order[ok[order]]
            s, a, lang = num["score"][order], num["a"][order], langs[order]
            begin = np.flatnonzero(np.append(True, lang[1:] != lang[:-1])) if len(order) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(order)))
            last = np.repeat(begin + np.minimum(size, top) - 1, size)
            chosen = order[(s > s[last]) | ((s == s[last]) & (a >= a[last]))]
            cols = {"key": keys[chosen].view(np.int64), "lang_key": langs[chosen], **{c: v[chosen] for c, v in num.items()}}
        return pa.table({c: pa.array(cols[c]) for c in names})

    beaten = scored.where("level = 3").select("beaten").mapInArrow(send, "level int, shard int, beaten binary")
    schema = "key long, lang_key long, a long, l long, r long, n long, score long"
    return scored.drop("beaten").groupBy("level", "shard").cogroup(beaten.groupBy("level", "shard")).applyInArrow(pick, schema)


def spelled(docs: DataFrame, bits: list, wanted) -> DataFrame:
    """(key, lang, phrase) of the phrases whose keys have their bit in `wanted`, once a task or a few times."""

    def scan(batches):
        filters, asked_for = [Bits(b.value) for b in bits], Bits(wanted.value)
        seen: set[int] = set()
        for langs, buf, starts, ends, key, follows, _, _, doc in _sentences(batches):
            for level in (2, 3):
                if len(key) < level:
                    continue
                first, found = _phrases(key, follows, level, filters)
                ok = asked_for.has(found)
                found, one = np.unique(found[ok], return_index=True)
                first = first[ok][one]
                new = np.array([k not in seen for k in found.tolist()], bool)
                found, first = found[new], first[new]
                if len(seen) > BLOCK:
                    seen.clear()
                seen.update(found.tolist())
                phrases = [" ".join([K.LOWER[buf[starts[i + k] : ends[i + k]]].tobytes().decode() for k in range(level)]) for i in first.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array([langs[d] for d in doc[first].tolist()], pa.string()), pa.array(phrases, pa.string())], names=["key", "lang", "phrase"])

    return docs.select("lang", "text").mapInArrow(scan, "key long, lang string, phrase string")


def _bits_of(keys: DataFrame) -> np.ndarray:
    """The packed bits of the column `key`, set in Spark byte by byte; at most 2**BITS / 8 bytes with a bit reach the driver."""
    at = keys.select(F.shiftrightunsigned("key", 64 - BITS).alias("at"))
    words = at.groupBy(F.shiftrightunsigned("at", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(7 - at % 8 AS int)))").alias("flags"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in words.toLocalIterator():
        out[r["byte"]] = r["flags"]
    return out


def collocations(docs: DataFrame, least: int = 10, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two and three words.

    a counts the phrase, l and r its first part and its rest at the cut with the least score, n all words. A pair
    inside a frequent triple that has half its occurrences or more is left out.
    """
    spark = docs.sparkSession
    shard_bits, parts = _shards(docs)
    stores, bits = [], []
    for level in (1, 2, 3):
        stores.append(count_level(docs, level, bits, shard_bits, parts, "collocations"))
        bits.append(spark.sparkContext.broadcast(frequent_bits(stores[-1], least, shard_bits)))
    store = stores[0].unionByName(stores[1]).unionByName(stores[2])
    some = scratch.settle(phrases(docs, bits, store, least, shard_bits, parts), "collocations-phrases")
    scratch.release(spark)
    scored = scratch.settle(score(some, answers(asked(some, shard_bits), store)), "collocations-scores")
    leading = scratch.settle(best(scored, top, shard_bits), "collocations-best")
    for t in [*stores, some, scored]:
        scratch.drop(spark, t)
    ties = [F.desc("score"), F.desc("a")]
    salted = leading.withColumn("salt", F.pmod("key", F.lit(SALTS))).withColumn("k", F.rank().over(Window.partitionBy("lang_key", "salt").orderBy(*ties))).where(F.col("k") <= top)
    chosen = scratch.settle(salted.withColumn("k", F.rank().over(Window.partitionBy("lang_key").orderBy(*ties))).where(F.col("k") <= top).drop("salt", "k"), "collocations-chosen")
    wanted = spark.sparkContext.broadcast(_bits_of(chosen.select("key")))
    words = spelled(docs, bits[:2], wanted).dropDuplicates(["key"])
    order = Window.partitionBy("lang").orderBy(*ties, "phrase")
    ranked = chosen.join(words, "key").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
