"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of `length` bytes that covers it starts at another place too. Each such string holds one
anchor, the start of its least-hashed k-mer (leftmost of equals), so equal strings have their anchors at equal
places. Only suffixes at anchors whose k-mer occurs elsewhere can matter. Each part of the documents sorts these and
sends front-coded runs; a bucket (a range of k-mer hashes) merges its runs with a loser tree that keeps the known
common prefix of each head with the last output and never compares those bytes again. The merged order and its
common prefixes give the matches to the right of an anchor, a second order of the bytes before it those to the left;
a string at distance a before the anchor repeats if one neighbour matches a bytes to the left and length - a to the
right. Equal contexts of a part are sent once. Where a group is so large and mixed that neighbours in neither order
decide, its undecided strings are counted by hash over all parts, which no group size can skew.

With `words`, passages are so many words, whatever their bytes: the same search runs over texts in which each word is
WORD_BYTES bytes of its hash, and words whose bytes all go take the white space between them along. With `passages`,
the search for passages of so many words runs beside the one that removes, on the same shuffled texts, and is only counted.

Documents are dealt to parts by the place of their rows in the input's files, so repeated rows spread like others; an
input that is not read from files is written once first. All passes see the same rows in the same parts.

Edge cases: null or empty text: 0 bytes, nothing removed; rows may repeat and doc_ids may be null or equal, a row each
comes out; texts shorter than `length` keep all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from . import scratch

LENGTH, KMER = 400, 64
#: Bytes that stand for a word where passages are counted in words.
WORD_BYTES = 6
#: Text bytes that are hashed at once; a dozen arrays of eight times this size are alive meanwhile.
SLICE_BYTES = 500_000
PART_BYTES = 6 << 20
BUCKET_ANCHORS = 1 << 16
#: Neighbours that are looked at in each order and direction before the count by hash decides.
SCAN = 64


class Scale(NamedTuple):
    """What a search counts in: bytes of a repeated string and of its k-mers, over texts or over codes of their words."""

    length: int
    k: int
    by_word: bool
    n_buckets: int


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = KMER):
    """(place, first and last window start, k-mer hash) of every anchor; windows lie within documents."""
    n = len(buf)
    sizes = np.maximum(np.diff(offs) - length + 1, 0)
    if n < length or not sizes.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    s = K.rolling(buf)
    h = K.mix((s[k:] - s[:-k]) * K.powers(K.BASE_INV, n + 1)[: n - k + 1])
    bits = np.uint64(max(24, int(n).bit_length()))
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    w = length - k + 1
    pad = np.full(-(-len(key) // w) * w, np.uint64(K.MASK))
    pad[: len(key)] = key
    grid = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    p = K.gather(offs[:-1], sizes)
    at = (np.minimum(behind[p], ahead[p + w - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], p[first], p[np.append(first[1:], len(p)) - 1], h[at[first]]


def word_codes(buf: np.ndarray, offs: np.ndarray):
    """(codes, borders of the documents in them, (starts, ends, first words) of the words): each word as WORD_BYTES bytes of its hash."""
    a, b, first = K.words(buf, offs, K.SPACE_WORD)
    h = K.spans_hash(K.rolling(buf), a, b)
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].ravel(), first * WORD_BYTES, (a, b, first)


def word_bytes(gone: np.ndarray, n: int, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Of n text bytes those of words whose codes are all gone, and the white space between two such words of a document."""
    a, b, first = words
    mark = np.zeros(n + 1, np.int32)
    if len(a):
        w = gone.reshape(-1, WORD_BYTES).all(axis=1)
        doc = np.searchsorted(first, np.arange(len(a)), "right")
        b = b.copy()
        on = np.flatnonzero(w[:-1] & w[1:] & (doc[:-1] == doc[1:]))
        b[on] = a[on + 1]
        mark[a[w]] += 1
        mark[b[w]] -= 1
    return np.cumsum(mark[:-1]) > 0


def _hash_blob(h: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(h.astype("<u8")).tobytes(), 1)


def _hashes(raw: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(raw), "<u8")


def bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets by the low half of the hash: anchors have small hashes, so the high half would put all in the first."""
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(n_buckets)) >> np.uint64(32)


def _kmers(scales: list[Scale]):
    """(part, text) rows -> (scale, bucket, parts, hashes, twice): the k-mers of a task's anchors with their parts, and those seen again in a part."""

    def run(batches):
        import zstandard

        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in scales]
        size = 0

        def flush():
            rows = [[], [], [], [], []]
            for i, (scale, own) in enumerate(zip(scales, held)):
                if not own:
                    continue
                h, part = (np.concatenate(x) for x in zip(*own))
                bucket = bucket_of(h, scale.n_buckets)
                order = np.lexsort((h, part, bucket))
                h, part, bucket = h[order], part[order], bucket[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])))
                again = np.diff(np.append(first, len(h))) > 1
                h, part, bucket = h[first], part[first], bucket[first]
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
                for x, y in zip(cut, [*cut[1:], len(h)]):
                    parts = zstandard.compress(part[x:y].astype("<u4").tobytes(), 1)
                    for r, v in zip(rows, (i, int(bucket[x]), parts, _hash_blob(h[x:y]), _hash_blob(h[x:y][again[x:y]]))):
                        r.append(v)
                own.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(r, pa.int64()) for r in rows[:2]], *[pa.array(r, pa.binary()) for r in rows[2:]]], names=["scale", "bucket", "parts", "hashes", "twice"])

        for batch in batches:
            for rows, buf, offs in K.pieces(batch, limit=SLICE_BYTES):
                for scale, own in zip(scales, held):
                    codes, borders = word_codes(buf, offs)[:2] if scale.by_word else (buf, offs)
                    at, _, _, h = anchors(codes, borders, scale.length, scale.k)
                    if len(h):
                        own.append((h, rows.column("part").to_numpy()[np.searchsorted(borders, at, "right") - 1]))
                    size += len(h)
                if size > 2_000_000:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


def _repeated(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """A bucket's k-mers -> (scale, part, blob): those of each part that occur twice or more over all parts."""
    import zstandard

    own = np.concatenate([_hashes(x.as_py()) for x in t["hashes"]])
    part = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), "<u4") for x in t["parts"]])
    h = np.sort(np.concatenate([own, *(_hashes(x.as_py()) for x in t["twice"])]))
    hit = np.isin(own, np.unique(h[1:][h[1:] == h[:-1]]))
    own, part = own[hit], part[hit]
    order = np.argsort(part, kind="stable")
    own, part = own[order], part[order]
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    blobs = [_hash_blob(np.unique(x)) for x in np.split(own, cut[1:])] if len(part) else []
    return pa.table([pa.array([key[0].as_py()] * len(cut), pa.int64()), pa.array(part[cut].astype(np.int64)), pa.array(blobs, pa.binary())], names=["scale", "part", "blob"])


def ordered(docs: pa.Table) -> pa.Table:
    """The documents of a part in a fixed order."""
    order = docs.append_column("at", pa.array(np.arange(len(docs)))).sort_by([("doc_id", "ascending"), ("text", "ascending")])["at"] if len(docs) else pa.array([], pa.int64())
    return docs.take(order)


class Part:
    """The ordered documents of a part, and the contexts of their candidate anchors."""

    def __init__(self, docs: pa.Table, repeated: list[bytes], scale: Scale):
        self.docs = docs
        self.known = np.unique(np.concatenate([_hashes(x) for x in repeated])) if repeated else np.zeros(0, np.uint64)
        self.length, self.k, self.by_word, _ = scale
        self.index: dict[tuple, int] = {}
        self.count: list[int] = []
        self.hash: list[int] = []

    def walk(self):
        """For each slice: (rows, bytes, borders, anchors, context numbers, words if passages are counted in them)."""
        for rows, buf, offs in K.pieces(self.docs, limit=SLICE_BYTES):
            codes, borders, words = word_codes(buf, offs) if self.by_word else (buf, offs, None)
            at, s, e, h = anchors(codes, borders, self.length, self.k)
            if len(self.known):
                where = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
                hit = self.known[where] == h
            else:
                hit = np.zeros(len(h), bool)
            at, s, e, h = at[hit], s[hit], e[hit], h[hit]
            raw, number = codes.tobytes(), []
            for i, x, y, z in zip(at.tolist(), s.tolist(), e.tolist(), h.tolist()):
                key = (raw[i : y + self.length], raw[x:i])
                n = self.index.setdefault(key, len(self.count))
                if n == len(self.count):
                    self.count.append(1)
                    self.hash.append(z)
                else:
                    self.count[n] = 2
                number.append(n)
            yield rows, buf, offs, at, number, words


def front_coded(rows: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """Sorted (right, reversed left, number, count) -> a run: common prefix lengths, rest bytes, left bytes, facts."""
    import zstandard

    lcp, rests = [0] * len(rows), []
    before = b""
    for i, (right, _, _, _) in enumerate(rows):
        lcp[i] = common(before, right)
        rests.append(right[lcp[i] :])
        before = right
    facts = np.array([lcp, [len(x) for x in rests], [len(r[1]) for r in rows], [r[2] for r in rows], [r[3] for r in rows]], "<u4")
    return zstandard.compress(np.uint32(len(rows)).tobytes() + facts.tobytes() + b"".join(rests) + b"".join([r[1] for r in rows]), 3)


class Run:
    """A front-coded run, read entry by entry."""

    def __init__(self, raw: bytes, part: int):
        import zstandard

        data = zstandard.decompress(raw)
        n = int(np.frombuffer(data, "<u4", 1)[0])
        self.lcps, rest, left, self.numbers, self.counts = np.frombuffer(data, "<u4", 5 * n, 4).reshape(5, n).tolist()
        at = 4 + 20 * n
        ends = np.cumsum([0, *rest]).tolist()
        self.rests = [data[at + a : at + b] for a, b in zip(ends, ends[1:])]
        at += ends[-1]
        ends = np.cumsum([0, *left]).tolist()
        self.lefts = [data[at + a : at + b] for a, b in zip(ends, ends[1:])]
        self.part, self.n, self.i, self.right = part, n, -1, b""

    def next(self) -> int | None:
        """Step to the next entry: its common prefix with the one before in this run."""
        self.i += 1
        if self.i >= self.n:
            self.right = None
            return None
        lcp = self.lcps[self.i]
        self.right = self.right[:lcp] + self.rests[self.i]
        return lcp


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, of which `start` bytes are known."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    lo, hi = start, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    step = 16
    while lo + step < hi and a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(hi, lo + step)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def merge(runs: list[Run]):
    """Entries of all runs in order: (right, left, part, number, count, common prefix with the entry before).

    A loser tree. heads[j] is the common prefix of run j's head with the last output: of two heads the one with the
    longer known prefix is smaller, and only heads with equal prefixes are compared, from that place on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [0] * k
    loser = [-1] * k
    for r in runs:
        r.next()

    def beats(a: int, b: int) -> bool:
        """Does run a's head come before run b's? The loser's known prefix becomes that with the winner."""
        x = runs[a] if a < len(runs) else None
        y = runs[b] if b < len(runs) else None
        if y is None or y.right is None:
            return True
        if x is None or x.right is None:
            return False
        p, q = heads[a], heads[b]
        if p != q:
            return p > q
        n = common(x.right, y.right, p)
        if n < len(x.right) and n < len(y.right):
            first = x.right[n] < y.right[n]
        elif len(x.right) != len(y.right):
            first = len(x.right) < len(y.right)
        else:
            first = (x.lefts[x.i], a) < (y.lefts[y.i], b)
        heads[b if first else a] = n
        return first

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        win, lose = (a, b) if beats(a, b) else (b, a)
        loser[node] = lose
        return win

    win = build(1) if k > 1 else 0
    while win < len(runs) and runs[win].right is not None:
        r = runs[win]
        yield r.right, r.lefts[r.i], r.part, r.numbers[r.i], r.counts[r.i], heads[win]
        heads[win] = r.next() or 0
        node = (win + k) // 2
        while node:
            if not beats(win, loser[node]):
                win, loser[node] = loser[node], win
            node //= 2


def subtract(spans: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    """Closed spans without lo..hi."""
    out = []
    for a, b in spans:
        if a < lo:
            out.append((a, min(b, lo - 1)))
        if b > hi:
            out.append((max(a, hi + 1), b))
    return [(a, b) for a, b in out if a <= b]


def decide(group: list[tuple], length: int, scan: int = SCAN) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """For each entry of a group with one k-mer, in merged order: (matched distances, undecided distances), closed spans."""
    n = len(group)
    open_ = [[(max(0, length - len(g[0])), len(g[1]))] for g in group]
    own = [x[0] for x in open_]
    hits: list[list[tuple[int, int]]] = [[] for _ in group]

    def pair(i: int, left: int, right: int) -> None:
        lo, hi = max(own[i][0], length - right), min(own[i][1], left)
        if lo <= hi:
            hits[i].append((lo, hi))
            open_[i] = subtract(open_[i], lo, hi)

    for i, g in enumerate(group):
        if g[4] > 1:
            hits[i].append(own[i])
            open_[i] = []
    right_lcp = [g[5] for g in group] + [0]
    for i in range(n):  # neighbours in right order
        for step in (-1, 1):
            j, right, steps = i, len(group[i][0]), 0
            while open_[i]:
                right = min(right, right_lcp[j] if step < 0 else right_lcp[j + 1])
                j += step
                if j < 0 or j >= n:
                    right = 0
                open_here = open_[i]
                if length - right > open_here[-1][1]:
                    break
                steps += 1
                if steps > scan:
                    break
                pair(i, common(group[i][1], group[j][1]), right)
    if n <= scan + 1 or not any(open_):
        return hits, [[] for _ in group]
    order = sorted(range(n), key=lambda i: group[i][1])
    place = [0] * n
    for p, i in enumerate(order):
        place[i] = p
    left_lcp = [0] + [common(group[a][1], group[b][1]) for a, b in zip(order, order[1:])] + [0]
    undecided: list[list[tuple[int, int]]] = [[] for _ in group]
    for i in range(n):
        if not open_[i]:
            continue
        # what the right order has decided: distances that need a longer right match than the scan's end left
        reach = [0, 0]
        for d, step in enumerate((-1, 1)):
            j, right = i, len(group[i][0])
            for _ in range(scan + 1):
                right = min(right, right_lcp[j] if step < 0 else right_lcp[j + 1])
                j += step
                if j < 0 or j >= n:
                    right = 0
                    break
            reach[d] = right
        open_[i] = subtract(open_[i], -1, length - max(reach) - 1)
        ends = [0, 0]
        for d, step in enumerate((-1, 1)):
            p, left, steps = place[i], len(group[i][1]), 0
            while open_[i]:
                left = min(left, left_lcp[p] if step < 0 else left_lcp[p + 1])
                p += step
                if p < 0 or p >= n:
                    left = -1
                if left < open_[i][0][0]:
                    break
                steps += 1
                if steps > scan:
                    break
                pair(i, left, common(group[i][0], group[order[p]][0]))
            ends[d] = left
        undecided[i] = subtract(open_[i], max(ends) + 1, 1 << 30)
    return hits, undecided


def _contexts(scales: list[Scale]):
    """(documents, repeated k-mers) of a part -> (scale, bucket, part, run)."""

    def run(key, docs: pa.Table, rep: pa.Table) -> pa.Table:
        docs, known = ordered(docs), rep.to_pylist()
        out: list[list] = [[], [], []]
        for i, scale in enumerate(scales):
            part = Part(docs, [r["blob"] for r in known if r["scale"] == i], scale)
            for _ in part.walk():
                pass
            rows: dict[int, list] = {}
            for (right, left), number in part.index.items():
                rows.setdefault(((part.hash[number] & 0xFFFFFFFF) * scale.n_buckets) >> 32, []).append((right, left[::-1], number, part.count[number]))
            for bucket, x in rows.items():
                for o, v in zip(out, (i, bucket, front_coded(sorted(x)))):
                    o.append(v)
            del part, rows
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([key[0].as_py()] * len(out[0]), pa.int64()), pa.array(out[2], pa.binary())], names=["scale", "bucket", "part", "run"])

    return run


VERDICT = "scale long, part long, window long, number int, distance int, blob binary"


def _merge_bucket(scales: list[Scale]):
    """A bucket's runs -> per part a blob of (number, from, to) matches; and rows (window hash, ...) of the undecided."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        length, k = scales[key[0].as_py()][:2]
        found: dict[int, list] = {}
        windows = [[], [], [], []]

        def close(group: list[tuple]) -> None:
            if len(group) < 2 and group[0][4] < 2:
                return
            hits, undecided = decide(group, length)
            for g, h in zip(group, hits):
                if h:
                    found.setdefault(g[2], []).extend((g[3], a, b) for a, b in h)
            spans = [s for u in undecided for s in u]
            if not spans:
                return
            wanted = np.zeros(length + 1, bool)
            for a, b in spans:
                wanted[a : b + 1] = True
            for g in group:  # whoever can match an undecided string must be counted with it
                text = np.frombuffer(g[1][::-1] + g[0], np.uint8)
                a = np.flatnonzero(wanted)
                a = a[(a >= length - len(g[0])) & (a <= len(g[1]))]
                start = len(g[1]) - a
                h = K.spans_hash(K.rolling(text), start, start + length)
                for w, v in zip(windows, (np.full(len(a), g[2]), h.view(np.int64), np.full(len(a), g[3], np.int32), a.astype(np.int32))):
                    w.append(v)

        group: list[tuple] = []
        for entry in merge([Run(r.as_py(), p) for r, p in zip(t["run"], t["part"].to_pylist())]):
            if group and entry[5] < k:
                close(group)
                group = []
            group.append(entry)
        if group:
            close(group)
        parts = list(found)
        blobs = pa.array([np.array(found[p], "<i4").tobytes() for p in parts], pa.binary())
        n = len(parts)
        cat = lambda x, kind: np.concatenate([np.zeros(n, kind), *x]).astype(kind)
        part, window, number, distance = (cat(x, kind) for x, kind in zip(windows, (np.int64, np.int64, np.int32, np.int32)))
        part[:n] = parts
        none = np.arange(len(part)) < n
        columns = [pa.array([key[0].as_py()] * len(part), pa.int64()), pa.array(part), *[pa.array(x, mask=none) for x in (window, number, distance)], pa.concat_arrays([blobs, pa.nulls(len(part) - n, pa.binary())])]
        del windows, found
        pa.default_memory_pool().release_unused()
        return pa.table(columns, names=["scale", "part", "window", "number", "distance", "blob"])

    return run


def _marked(docs: pa.Table, facts: list[dict], scale: Scale):
    """For each slice of a part's ordered documents: (rows, bytes, borders, whether each byte lies in a repeated string)."""
    part = Part(docs, [r["blob"] for r in facts if r["kind"] == 0], scale)
    spans: dict[int, list] = {}
    for r in facts:
        if r["kind"] == 1:
            for n, a, b in np.frombuffer(r["blob"], "<i4").reshape(-1, 3).tolist():
                spans.setdefault(n, []).append((a, b))
        elif r["kind"] == 2:
            spans.setdefault(r["number"], []).append((r["distance"], r["distance"]))
    for rows, buf, offs, at, number, words in part.walk():
        cover = np.zeros((len(words[0]) * WORD_BYTES if scale.by_word else len(buf)) + 1, np.int32)
        for i, n in zip(at.tolist(), number):
            for a, b in spans.get(n, ()):
                cover[i - b] += 1
                cover[i - a + scale.length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        yield rows, buf, offs, word_bytes(gone, len(buf), words) if scale.by_word else gone


def _runs(gone: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marked bytes, maximal runs of them) of each document."""
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    inner = offs[(offs > 0) & (offs < len(gone))]
    first[inner] = gone[inner]  # a run ends with its document
    return tuple(np.diff(np.append(0, np.cumsum(x))[offs]) for x in (gone, first))


def _remove(scales: list[Scale], keep_text: bool, with_row: bool):
    """(documents, repeated k-mers and matches) of a part -> the result rows."""

    def run(key, docs: pa.Table, facts: pa.Table) -> pa.Table:
        docs, facts_ = ordered(docs), facts.to_pylist()
        of = lambda i: (docs, [r for r in facts_ if r["scale"] == i], scales[i])
        counted = [_runs(gone, offs) for _, _, offs, gone in _marked(*of(1))] if len(scales) > 1 else []
        out: list[list] = [[], [], [], [], [], []]
        carried = []
        for rows_, buf, offs, gone in _marked(*of(0)):
            if with_row:
                carried.append(rows_.select(["row"]))
            raw = buf.tobytes()
            for d, x, y in zip(rows_.column("doc_id").to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                g = gone[x:y]
                removed = int(g.sum())
                kept = buf[x:y][~g].tobytes() if removed else raw[x:y]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8))) if removed else np.zeros(0, np.int64)
                for o, v in zip(out, (d, y - x, removed, len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None)):
                    o.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        n = 6 if keep_text else 5
        done = pa.table([pa.array(o, t) for o, t in zip(out[:n], kinds)], names=names[:n])
        if len(scales) > 1:
            for name, x in zip(("n_passage_bytes", "n_passages"), zip(*counted) if counted else ((), ())):
                done = done.append_column(name, pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)))
        if not with_row:
            return done
        return done.append_column("row", pa.concat_tables(carried)["row"] if carried else docs["row"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = KMER, keep_text: bool = False, with_row: bool = False, part_bytes: int = PART_BYTES, words: int | None = None, passages: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    keep_text adds kept_text, the remaining bytes without those of cut characters; with_row adds row, a struct of all
    columns of the input but its text. With words, passages of so many words count, not those of `length` bytes. With
    passages, n_passage_bytes and n_passages tell of the bytes that passages of so many words cover which start at another
    place too, and of their maximal runs; nothing is removed for it.
    """
    spark = docs.sparkSession
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] * with_row
    texts = scratch.placed(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *rest, scratch.PLACE)
    total = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n_parts = max(1, -(-total // part_bytes))
    sizes = [(length, k, False) if words is None else (words * WORD_BYTES, min(k, words * WORD_BYTES), True)]
    if passages is not None:
        sizes.append((passages * WORD_BYTES, min(k, passages * WORD_BYTES), True))
    scales = [Scale(*x, max(1, -(-total // (x[0] // 3) // BUCKET_ANCHORS))) for x in sizes]
    parted = texts.withColumn("part", F.pmod(F.col(scratch.PLACE), F.lit(n_parts))).drop(scratch.PLACE)
    sent = parted.select("part", "text").mapInArrow(_kmers(scales), "scale long, bucket long, parts binary, hashes binary, twice binary")
    repeated = scratch.settle(sent.groupBy("scale", "bucket").applyInArrow(_repeated, "scale long, part long, blob binary"), "kmers")
    runs = parted.select("doc_id", "text", "part").groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(_contexts(scales), "scale long, bucket long, part long, run binary")
    verdict = scratch.settle(runs.groupBy("scale", "bucket").applyInArrow(_merge_bucket(scales), VERDICT), "matches")
    scratch.release(spark)
    windows = verdict.where("window is not null")
    often = windows.groupBy("scale", "window").count().where("count > 1")
    facts = repeated.select("scale", "part", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("int").alias("distance"), "blob")
    facts = facts.unionByName(verdict.where("blob is not null").select("scale", "part", F.lit(1).alias("kind"), "number", "distance", "blob"))
    facts = facts.unionByName(windows.join(often, ["scale", "window"], "left_semi").select("scale", "part", F.lit(2).alias("kind"), "number", "distance", "blob"))
    schema = T.StructType()
    for name, kind in [("doc_id", "long"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), *[("kept_text", "string")] * keep_text, *[("n_passage_bytes", "long"), ("n_passages", "long")] * (passages is not None)]:
        schema = schema.add(name, kind)
    if with_row:
        schema = schema.add("row", parted.schema["row"].dataType)
    return parted.groupBy("part").cogroup(facts.groupBy("part")).applyInArrow(_remove(scales, keep_text, with_row), schema)
