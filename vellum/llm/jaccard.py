"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set holds the 64-bit hashes of its distinct 5-word shingles; equal sets are one node from the start,
whatever documents have them. Sizes fall into bands; pairs whose smaller set lies in band k meet under scheme k, which
cuts the hash universe into segments. The symmetric difference of a linked pair is at most (|r| + |s|) / 7, so of more
non-empty segments than that at least one must agree. Segments below a scheme's `q` also give their subsets with one
token left out, so that they bear one difference more. A cost model chooses both numbers by the signatures they send;
small sets take each token as its segment. A set whose segments cannot bear its bound (about one in a million) is
compared with all others.

Allocation goes on with the signatures' frequencies: a set that bears b differences more than its bound shares more
than b signatures with every linked larger set, so it need not ask with its b most frequent ones. Signatures meet in
buckets; what is shared goes back to its sets, which say with what they ask. In each group of sets that share an asked
signature the member with the least hash is the pivot, at every size of the group, and only pairs with a pivot become
candidates, each once: as many as members at most. Count vectors over BINS hash ranges bound the difference from
below; what is left is verified exactly on the sets. A group
whose members all came into one component is done. Of the others, members of different components are compared by
count vectors inside a task, in blocks of BLOCK members, and only pairs within the bound leave it, to be verified.
Nothing is capped: every pair that shares an asked signature is verified, out of bounds, or joined already.

Identity is by 64-bit hashes (shingles) and 63 bits of their sums (equal sets). Edge cases: no words or a null text:
n_shingles 0, linked with nothing; each row is a document, repeated ones too; a null doc_id takes part, and is the
component_id only where no member has one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import scratch
from .components import components

WORDS = 5
BLANKS = " \t\n\x0b\x0c\r"
SMALL = 64
#: Standard deviations by which a scheme bears more than its bound.
MARGIN = 5
BINS = 256
BUCKET_SIGS = 1 << 20
FLUSH_SIGS = 1_000_000
#: Text bytes that are hashed at once.
SLICE_BYTES = 400_000
#: Members of a group that are compared with as many others in one task.
BLOCK = 4096
#: Rows of open groups that one task takes, unless it is one block.
LUMP_ROWS = 1 << 16
#: Rows of two longs that are broadcast at most, about 40 MB.
BROADCAST_ROWS = 1 << 19


def sets(batch):
    """For each slice of a batch: (rows, hashes, borders): each document's distinct shingles, ascending."""
    for rows, buf, offs in K.pieces(batch, limit=SLICE_BYTES):
        a, b, first = K.words(buf, offs, K.SPACE_WORD)
        h, doc = K.shingles(K.spans_hash(K.rolling(buf, lower=True), a, b), first, WORDS)
        yield (rows, *K.distinct(h, doc, len(rows)))


def sums_of(h: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, together its identity."""
    return tuple(np.diff(np.concatenate([[np.uint64(0)], np.cumsum(K.mix(h + np.uint64(c)), dtype=np.uint64)])[borders]) for c in (0x1234567, 0x9876543210))


def nodes(h: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Node numbers: 63 bits of each set's two sums; equal sets have equal nodes."""
    s1, s2 = sums_of(h, borders)
    return ((s1 ^ K.mix(s2)) >> np.uint64(1)).astype(np.int64)


@cache
def bands(up_to: int) -> list[tuple[int, int]]:
    """Size bands (least, most): a set at least 3/4 as large as another lies in its band or the one before."""
    out, lo = [], 1
    while lo <= up_to:
        out.append((lo, max(lo, lo * 4 // 3)))
        lo = out[-1][1] + 1
    return out


def bound(size):
    """Most differences of a linked pair whose smaller set has this size."""
    return (size + size * 4 // 3) // 7


@cache
def scheme(lo: int, hi: int) -> tuple[int, int]:
    """(segments m, of these with one-deletion subsets q) for smaller sets of lo to hi; m = 0: each token is a segment.

    Cost: signatures sent at both ends of the band, and half a signature for each one-token segment, which selects
    little. Allowed: at both ends the expected number of differences borne is above the bound by MARGIN standard
    deviations. A segment's tokens are taken as Poisson, given their total.
    """
    if hi <= SMALL:
        return 0, 0
    best = None
    for m in range(int(0.3 * hi), hi * 2, max(1, hi // 50)):
        for q in (m * k // 20 for k in range(21)):
            cost = 0.0
            for n in (lo, hi):
                x = n / m
                p0, p1 = math.exp(-x), x * math.exp(-x)
                two = 1 - p0 - p1
                slope = (m * p0 + q * p1) / m  # of a segment's mean bearing, by x
                spread = (m - q) * p0 * (1 - p0) + q * (p1 + 4 * two - (1 - p0 + two) ** 2) - m * x * slope * slope
                if m * (1 - p0) + q * two - MARGIN * math.sqrt(max(spread, 0)) < bound(n) + 1:
                    break
                cost += m * (1 - p0) + q * (x - p1) + 0.5 * m * p1
            else:
                if best is None or cost < best[0]:
                    best = cost, m, q
    return best[1:] if best else (0, 0)


def signatures(h: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, set number of each, is it of the set's own band, differences each set bears there, sets that can't bear their bound)."""
    sizes = np.diff(borders)
    table = bands(int(sizes.max()) + 1 if len(sizes) else 1)
    band = np.searchsorted(np.array([b for _, b in table]), sizes)
    out, own, role, weak = [], [], [], []
    bears = sizes.copy()
    n_sets = len(sizes)
    doc = np.repeat(np.arange(n_sets), sizes)
    mixed = K.mix(h)

    def send(sig: np.ndarray, of: np.ndarray, back: int) -> None:
        out.append(sig)
        own.append(of)
        role.append(np.full(len(sig), back == 0))

    for back in (0, 1):
        at = band - back
        ok = (at >= 0) & (sizes >= 3)
        plan = np.array([scheme(*table[max(k, 0)]) for k in range(len(table))]).reshape(-1, 2)[np.maximum(at, 0)]
        m, q = plan[:, 0].astype(np.uint64), plan[:, 1]
        salt = K.mix((at + 7).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        whole = np.flatnonzero((ok & (m == 0))[doc])
        send(K.mix(h[whole] + salt[doc[whole]]), doc[whole], back)
        part = np.flatnonzero((ok & (m > 0))[doc])
        if not len(part):
            continue
        d = doc[part]
        seg = ((h[part] >> np.uint64(32)) * m[d]) >> np.uint64(32)
        head = np.append(True, (d[1:] != d[:-1]) | (seg[1:] != seg[:-1]))
        start = np.flatnonzero(head)
        total = np.add.reduceat(mixed[part], start)
        count = np.diff(np.append(start, len(part)))
        d0, key = d[start], salt[d[start]] + seg[start] * np.uint64(0x9FB21C651E98DF25)
        free = (seg[start].astype(np.int64) < q[d0]) & (count >= 2)
        send(K.mix(total ^ K.mix(key)), d0, back)
        if free.any():
            group = np.cumsum(head) - 1
            tok = np.flatnonzero(free[group])
            g = group[tok]
            send(K.mix((total[g] - mixed[part][tok]) ^ K.mix(key[g])), d[tok], back)
        if back == 0:
            cut = ok & (m > 0)
            bears[cut] = np.bincount(d0, weights=1.0 + free, minlength=n_sets)[cut]
            weak.append(np.flatnonzero(cut & (bears < bound(sizes) + 1)))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(out, np.uint64), cat(own, np.int64), cat(role, bool), bears, cat(weak, np.int64)


def _pack(x: np.ndarray, width: int) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def _unpack(raw: bytes, width: int) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").ravel()


def _emit(n_buckets: int):
    """Documents -> (bucket, sigs, at, nodes): each task sends each distinct set once.

    sigs ascend and are sent as differences; at says which of the row's nodes each belongs to.
    """

    def flush(sig, node, role):
        bucket = ((sig >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
        low = ((sig & np.uint64((1 << 44) - 1)) << np.uint64(1)) | role  # the role in the lowest bit
        order = np.lexsort((low, bucket))
        low, node, bucket = low[order], node[order], bucket[order]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(cut[1:], len(low))
        rows = []
        for a, b in zip(cut.tolist(), ends.tolist()):
            own, at = np.unique(node[a:b], return_inverse=True)
            rows.append((int(bucket[a]), _pack(np.diff(low[a:b], prepend=np.uint64(0)), 6), _pack(at.astype(np.uint64), 3), _pack(own.view(np.uint64), 8)))
        return _columns(rows, ["bucket", "sigs", "at", "nodes"], [pa.int64(), *[pa.binary()] * 3]).combine_chunks().to_batches()[0]

    def run(batches):
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for _, h, borders in sets(batch):
                node = nodes(h, borders)
                keep = np.zeros(len(node), bool)
                for i, s in enumerate(node.tolist()):
                    if borders[i + 1] > borders[i] and s not in seen:
                        keep[i] = True
                        seen.add(s)
                if len(seen) > 100_000:
                    seen.clear()
                at = np.flatnonzero(keep)
                sizes = np.diff(borders)[at]
                sig, own, role, *_ = signatures(h[K.gather(borders[at], sizes)], np.concatenate([[0], np.cumsum(sizes)]))
                held.append((sig, node[at][own], role))
                size += len(sig)
                if size >= FLUSH_SIGS:
                    yield flush(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
                    pa.default_memory_pool().release_unused()
        if size:
            yield flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def _columns(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    """Rows of Python values as a table."""
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _deal(key: np.ndarray, by: np.ndarray, *columns: tuple[np.ndarray, int]) -> list[tuple]:
    """Rows (key, packed columns): the rows of each key together, ordered by `by`; columns with their widths in bytes."""
    order = np.lexsort((by, key))
    key = key[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(key))
    sorted_ = [(c[order].astype(np.int64).view(np.uint64), w) for c, w in columns]
    return [(int(key[a]), *[_pack(c[a:b], w) for c, w in sorted_]) for a, b in zip(cut.tolist(), ends.tolist())]


def _shared(n_parts: int):
    """A bucket's signatures -> what several sets share, dealt by node: (part, nodes, groups, sizes, roles)."""

    def run(key, t):
        low = np.concatenate([np.cumsum(_unpack(x.as_py(), 6), dtype=np.uint64) for x in t["sigs"]])
        node = np.concatenate([_unpack(x.as_py(), 8).view(np.int64)[_unpack(at.as_py(), 3).view(np.int64)] for x, at in zip(t["nodes"], t["at"])])
        sig, role = low >> np.uint64(1), (low & np.uint64(1)).astype(np.int64)
        order = np.lexsort((node, sig))
        sig, node, role = sig[order], node[order], role[order]
        keep = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
        sig, node, role = sig[keep], node[keep], role[keep]
        head = np.append(True, sig[1:] != sig[:-1])
        size = np.diff(np.append(np.flatnonzero(head), len(sig)))
        group = np.cumsum(head) - 1
        several = size[group] >= 2
        node, role, group = node[several], role[several], group[several]
        gid = (key[0].as_py() << 32) | group
        rows = _deal(np.mod(node, n_parts), node, (node, 8), (gid, 8), (size[group], 5), (role, 1))
        return _columns(rows, ["part", "nodes", "groups", "sizes", "roles"], [pa.int64(), *[pa.binary()] * 4])

    return run


def _allot(key, shared: pa.Table, facts: pa.Table) -> pa.Table:
    """Each set of a part keeps asking with all but its most frequent signatures, as many as it bears beyond its bound.

    -> (bucket, groups, nodes, sizes, asks), dealt by the group's bucket; sizes are those of the sets.
    """
    cat = lambda c, w: np.concatenate([np.zeros(0, np.uint64), *[_unpack(x.as_py(), w) for x in shared[c]]]).view(np.int64)
    node, gid, size, role = cat("nodes", 8), cat("groups", 8), cat("sizes", 5), cat("roles", 1)
    names = facts["node"].to_numpy()
    by = np.argsort(names)
    where = by[np.searchsorted(names[by], node)] if len(node) else np.zeros(0, np.int64)
    n, bears = facts["n_shingles"].to_numpy()[where], facts["bears"].to_numpy()[where]
    order = np.lexsort((gid, -size, -role, node))  # a set's own signatures first, frequent ones first
    node, gid, role, n, bears = node[order], gid[order], role[order], n[order], bears[order]
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    asks = (role == 1) & (rank >= bears - bound(n) - 1)
    rows = _deal(gid >> 32, node, (gid & 0xFFFFFFFF, 4), (node, 8), (n, 5), (asks, 1))
    return _columns(rows, ["bucket", "groups", "nodes", "sizes", "asks"], [pa.int64(), *[pa.binary()] * 4])


#: What an entry of a group says: its set asks; it may be linked with the pivot; the group has more members than two.
ASKS, STAR, MANY = 1, 2, 4


def _grouped(n_parts: int):
    """A bucket's groups -> their members, dealt by node: (part, nodes, groups, pivots, flags)."""

    def run(t):
        cat = lambda c, w: np.concatenate([_unpack(x.as_py(), w) for x in t[c]]).view(np.int64)
        gid, node, n, asks = cat("groups", 4), cat("nodes", 8), cat("sizes", 5), cat("asks", 1).astype(bool)
        gid |= t["bucket"][0].as_py() << 32
        order = np.lexsort((K.mix(node.view(np.uint64)), gid))
        gid, node, n, asks = gid[order], node[order], n[order], asks[order]
        start = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
        count = np.diff(np.append(start, len(gid)))
        group = np.repeat(np.arange(len(start)), count)
        first = start[group]
        star = ((asks & (n <= n[first])) | (asks[first] & (n[first] <= n))) & (4 * np.minimum(n, n[first]) >= 3 * np.maximum(n, n[first]))
        star &= first != np.arange(len(gid))
        many = (count > 2)[group]
        keep = np.flatnonzero((np.add.reduceat(asks, start) > 0)[group] & (star | many))
        flags = asks[keep] * ASKS + star[keep] * STAR + many[keep] * MANY
        rows = _deal(np.mod(node[keep], n_parts), node[keep], (node[keep], 8), (gid[keep], 8), (node[first][keep], 8), (flags, 1))
        return _columns(rows, ["part", "nodes", "groups", "pivots", "flags"], [pa.int64(), *[pa.binary()] * 4])

    return run


GROUPED = "part long, nodes binary, groups binary, pivots binary, flags binary"


def _entries(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Nodes, groups, pivots and flags of a part's entries."""
    widths = {"nodes": 8, "groups": 8, "pivots": 8, "flags": 1}
    return tuple(np.concatenate([np.zeros(0, np.uint64), *[_unpack(x.as_py(), w) for x in t[c]]]).view(np.int64) for c, w in widths.items())


def _stars(t: pa.Table) -> pa.Table:
    """A part's entries -> rows (a, b): each pair of a pivot and a set once."""
    node, _, pivot, flags = _entries(t)
    ok = (flags & STAR) > 0
    node, pivot = node[ok], pivot[ok]
    order = np.lexsort((pivot, node))
    a, b = pivot[order], node[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return pa.table([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def _labelled_groups(key, met: pa.Table, facts: pa.Table) -> pa.Table:
    """A part's entries of larger groups with the components of their sets, dealt by bucket."""
    node, gid, _, flags = _entries(met)
    many = (flags & MANY) > 0
    node, gid, flags = node[many], gid[many], flags[many]
    names = facts["node"].to_numpy()
    by = np.argsort(names)
    at = by[np.searchsorted(names[by], node)] if len(node) else np.zeros(0, np.int64)
    comp, n = facts["component"].to_numpy()[at], facts["n_shingles"].to_numpy()[at]
    rows = _deal(gid >> 32, node, (gid, 8), (node, 8), (comp, 8), (n, 5), (flags & ASKS, 1))
    return _columns(rows, ["bucket", "groups", "nodes", "comps", "sizes", "asks"], [pa.int64(), *[pa.binary()] * 5])


LABELLED = "bucket long, groups binary, nodes binary, comps binary, sizes binary, asks binary"


def _open(t: pa.Table) -> pa.Table:
    """A bucket's groups -> the members of those with sets of several components; of groups with equal members one."""
    cat = lambda c, w: np.concatenate([_unpack(x.as_py(), w) for x in t[c]]).view(np.int64)
    gid, node, comp, n, asks = cat("groups", 8), cat("nodes", 8), cat("comps", 8), cat("sizes", 5), cat("asks", 1)
    order = np.argsort(gid, kind="stable")
    gid, node, comp, n, asks = gid[order], node[order], comp[order], n[order], asks[order]
    start = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
    count = np.diff(np.append(start, len(gid)))
    several = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
    alike = np.add.reduceat(K.mix(node.view(np.uint64) * np.uint64(2) + asks.astype(np.uint64)), start) + count.astype(np.uint64)
    _, one = np.unique(alike, return_index=True)
    keep = np.zeros(len(start), bool)
    keep[one] = True
    rows = np.flatnonzero(np.repeat(keep & several, count))
    size = np.repeat(count, count)[rows]
    return pa.table([pa.array(x) for x in (gid[rows], size, node[rows], comp[rows], n[rows], asks[rows] > 0)], names=["gid", "size", "node", "component", "n_shingles", "asks"])


OPEN = "gid long, size long, node long, component long, n_shingles long, asks boolean"


def _verify(batches):
    """(a, b, set_a, set_b) -> (u, v) of the pairs with 100 * intersection >= 75 * union."""
    for batch in batches:
        u, v = [], []
        for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("set_a"), batch.column("set_b")):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 4 * min(len(p), len(q)) < 3 * max(len(p), len(q)):
                continue
            both = np.concatenate([p, q])
            both.sort(kind="stable")
            inter = int((both[1:] == both[:-1]).sum())
            if 100 * inter >= 75 * (len(both) - inter):
                u.append(a)
                v.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _set_rows(batches):
    for batch in batches:
        for _, h, borders in sets(batch):
            yield pa.RecordBatch.from_arrays([pa.array(nodes(h, borders)), K.blobs(h, borders)], names=["node", "set"])


ABOUT = "doc_id long, text_hash long, node long, n_shingles long, bears long, sketch binary, weak boolean"


def _about(batches):
    """(doc_id, text, text_hash) -> what is known of each document's set."""
    for batch in batches:
        for rows, h, borders in sets(batch):
            n = np.diff(borders)
            doc = np.repeat(np.arange(len(n)), n)
            bins = np.bincount(doc * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), minlength=len(n) * BINS)
            sketch = K.blobs(np.minimum(bins, 255).astype(np.uint8), np.arange(len(n) + 1) * BINS)
            *_, bears, weak = signatures(h, borders)
            is_weak = np.zeros(len(n), bool)
            is_weak[weak] = True
            ids, texts = (rows.column(c).combine_chunks().cast(pa.int64()) for c in ("doc_id", "text_hash"))
            yield pa.RecordBatch.from_arrays([ids, texts, pa.array(nodes(h, borders)), pa.array(n), pa.array(bears), sketch, pa.array(is_weak)], names=["doc_id", "text_hash", "node", "n_shingles", "bears", "sketch", "weak"])


def _near(batches):
    """(a, b, .., size_a, size_b, sketch_a, sketch_b) -> the pairs whose count vectors differ by no more than the bound."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.array([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column(c)], np.int16) for c in ("sketch_a", "sketch_b"))
        size = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
        ok = pa.array(7 * np.abs(x - y).sum(1) <= size)
        yield batch.select(["a", "b"]).filter(ok)


def _across(t: pa.Table) -> pa.Table:
    """Members of pairs (i, j) of blocks of groups -> pairs across components whose difference may be within the bound."""
    unit = np.unique(np.stack([t[c].to_numpy() for c in ("gid", "i", "j")]), axis=1, return_inverse=True)[1]
    order = np.argsort(unit, kind="stable")
    t, unit = t.take(pa.array(order)), unit[order]
    block, i, j, node, comp, n = (t[c].to_numpy() for c in ("block", "i", "j", "node", "component", "n_shingles"))
    asks = t["asks"].to_numpy(zero_copy_only=False)
    sk = np.array([np.frombuffer(x.as_buffer(), np.uint8) for x in t["sketch"]], np.int16).reshape(-1, BINS)
    seen: set[tuple[int, int]] = set()
    for rows in np.split(np.arange(len(unit)), np.flatnonzero(unit[1:] != unit[:-1]) + 1):
        left, right = rows[block[rows] == i[rows]], rows[block[rows] == j[rows]]
        for x in left.tolist():
            y = right[(comp[right] != comp[x]) & (4 * np.minimum(n[right], n[x]) >= 3 * np.maximum(n[right], n[x]))]
            y = y[(asks[y] & (n[y] <= n[x])) | (asks[x] & (n[x] <= n[y]))]
            y = y[7 * np.abs(sk[y] - sk[x]).sum(1) <= n[y] + n[x]] if len(y) else y
            seen.update((min(node[x], z), max(node[x], z)) for z in node[y].tolist())
    return _columns(sorted(seen), ["a", "b"], [pa.int64(), pa.int64()])


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which name a row but for repeated ones."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def few(names: DataFrame) -> DataFrame:
    """The settled names, to be broadcast where they are BROADCAST_ROWS at most: then the texts need not move."""
    return F.broadcast(names) if names.count() <= BROADCAST_ROWS else names


def names_of(about: DataFrame) -> DataFrame:
    """node and x, the least (doc_id, text_hash) with this set: copies meet in a partial aggregation, not in a join."""
    return about.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))


def sets_of(texts: DataFrame, names: DataFrame, ids: DataFrame) -> DataFrame:
    """node, set of the nodes in ids, made from one text of each; names: node and x, the (doc_id, text_hash) of that text."""
    one = names.select("node", "x").join(ids.select("node").distinct(), "node", "left_semi")
    one = one.select(F.col("x.doc_id").alias("of_doc"), F.col("x.text_hash").alias("of_text")).distinct()
    one = few(scratch.settle(one, "named"))
    named = texts.join(one, texts["doc_id"].eqNullSafe(one["of_doc"]) & (texts["text_hash"] == one["of_text"]), "left_semi")
    return scratch.settle(named.select("text").mapInArrow(_set_rows, "node long, set binary").dropDuplicates(["node"]), "sets")


def links(docs: DataFrame, about: DataFrame) -> DataFrame:
    """Edges (u, v) between nodes, all of them linked, whose components are those of all links between different sets."""
    spark = docs.sparkSession
    texts = hashed(docs)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, int(total) // 8 // BUCKET_SIGS + 1)
    n_parts = 2 * n_buckets + 1
    facts = scratch.settle(about.where("n_shingles > 2").groupBy("node").agg(*[F.min(c).alias(c) for c in ("n_shingles", "bears", "sketch")], F.min(F.struct("doc_id", "text_hash")).alias("x")), "facts")
    part = F.pmod("node", F.lit(n_parts)).alias("part")
    sent = texts.select("doc_id", "text").mapInArrow(_emit(n_buckets), "bucket long, sigs binary, at binary, nodes binary")
    shared = sent.groupBy("bucket").applyInArrow(_shared(n_parts), "part long, nodes binary, groups binary, sizes binary, roles binary")
    asked = facts.select(part, "node", "n_shingles", "bears").groupBy("part")
    allotted = shared.groupBy("part").cogroup(asked).applyInArrow(_allot, "bucket long, groups binary, nodes binary, sizes binary, asks binary")
    met = scratch.settle(allotted.groupBy("bucket").applyInArrow(_grouped(n_parts), GROUPED), "met")
    scratch.release(spark)

    def of_node(x: str) -> DataFrame:
        return facts.select(F.col("node").alias(x), F.col("n_shingles").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    drawn = met.groupBy("part").applyInArrow(_stars, "a long, b long").join(of_node("a"), "a").join(of_node("b"), "b")
    near = drawn.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_near, "a long, b long")
    pairs = scratch.settle(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    rows = sets_of(texts, facts, pairs.select(F.explode(F.array("a", "b")).alias("node")))

    def check(cand: DataFrame, rows: DataFrame) -> DataFrame:
        left = cand.join(rows.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        full = left.join(rows.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        return scratch.settle(full.select("a", "b", "set_a", "set_b").mapInArrow(_verify, "u long, v long"), "links")

    first = check(pairs, rows)
    comp = scratch.settle(components(first), "components")
    scratch.release(spark)

    known = facts.select("node", "n_shingles").join(comp, "node", "left").select(part, "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    dealt = met.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_labelled_groups, LABELLED)
    undecided = scratch.settle(dealt.groupBy("bucket").applyInArrow(_open, OPEN), "open")
    n_lumps = undecided.count() // LUMP_ROWS + 1
    members = undecided.join(facts.select("node", "sketch"), "node").withColumn("n_blocks", (F.col("size") / BLOCK).cast("int") + 1)
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    members = members.select("gid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "n_shingles", "asks", "sketch")
    lumps = members.withColumn("lump", F.pmod(F.xxhash64("gid", "i", "j"), F.lit(n_lumps))).groupBy("lump")
    across = lumps.applyInArrow(_across, "a long, b long")
    cand = scratch.settle(across.distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    scratch.release(spark)
    more = cand.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(rows.select("node"), "node", "left_anti")
    second = check(cand, rows.unionByName(sets_of(texts, facts, more)))
    return reduce(DataFrame.unionByName, _weak_links(texts, about), first.unionByName(second))


#: Shingles of weak sets that go out at once.
WEAK_SHINGLES = 2_000_000


def _weak_links(texts: DataFrame, about: DataFrame) -> list[DataFrame]:
    """Edges of the weak sets with all others, in blocks of weak sets of a fixed size, one pass over the texts each."""
    weak = about.where("weak")
    if not weak.limit(1).count():
        return []
    blocks, held, size = [], [], 0
    for r in sets_of(texts, names_of(weak), weak).toLocalIterator():
        held.append((r["node"], np.frombuffer(r["set"], np.uint64)))
        size += len(held[-1][1])
        if size >= WEAK_SHINGLES:
            blocks.append(_against(texts, held))
            held, size = [], 0
    return [*blocks, *[_against(texts, held)] * bool(held)]


def _against(texts: DataFrame, weak: list[tuple[int, np.ndarray]]) -> DataFrame:
    """Edges between the weak sets and all documents, by exact counts, settled."""
    token = np.concatenate([x for _, x in weak])
    owner = np.repeat(np.arange(len(weak)), [len(x) for _, x in weak])
    order = np.argsort(token, kind="stable")
    shared = texts.sparkSession.sparkContext.broadcast((token[order], owner[order], np.array([n for n, _ in weak]), np.array([len(x) for _, x in weak])))

    def run(batches):
        token, owner, names, sizes = shared.value
        for batch in batches:
            for _, h, borders in sets(batch):
                lo, hi = np.searchsorted(token, h, "left"), np.searchsorted(token, h, "right")
                doc = np.repeat(np.repeat(np.arange(len(borders) - 1), np.diff(borders)), hi - lo)
                pair, both = np.unique(doc * len(names) + owner[K.gather(lo, hi - lo)], return_counts=True)
                d, w = pair // len(names), pair % len(names)
                ok = 100 * both >= 75 * (np.diff(borders)[d] + sizes[w] - both)
                yield pa.RecordBatch.from_arrays([pa.array(nodes(h, borders)[d[ok]]), pa.array(names[w[ok]])], names=["u", "v"])

    return scratch.settle(texts.select("text").mapInArrow(run, "u long, v long").where("u <> v").distinct(), "weak")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settled: (doc_id, text_hash, n_shingles, component) of every document with words; each component's least (doc_id, text_hash), nulls last."""
    about = scratch.settle(hashed(docs).mapInArrow(_about, ABOUT), "about")
    comp = scratch.settle(components(links(docs, about)), "components")
    reached = about.where("n_shingles > 0").select("doc_id", "text_hash", "node", "n_shingles").join(comp, "node", "left")
    rows = scratch.settle(reached.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "node").alias("component")), "labels")
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("x"))
    return rows, scratch.settle(least.select("component", "x.doc_id", "x.text_hash"), "least")


def without_words(docs: DataFrame) -> DataFrame:
    """The documents with a null text or none but white space."""
    return docs.where(F.translate(F.coalesce("text", F.lit("")), BLANKS, "") == "")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows, least = _labelled(docs)
    named = rows.join(least.select("component", F.col("doc_id").alias("component_id")), "component").select("doc_id", "n_shingles", "component_id")
    alone = without_words(docs).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without those that follow another one of their component in doc_id order.

    Documents without words all stay; of rows with equal doc_id and text one stays.
    """
    _, least = _labelled(docs)
    first = few(least.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")))
    some = docs.where(F.translate("text", BLANKS, "") != "").withColumn("__text", F.xxhash64("text"))
    kept = some.join(first, some["doc_id"].eqNullSafe(first["__doc"]) & (some["__text"] == first["__hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text"]).select(*docs.columns).unionByName(without_words(docs))
