"""Vectorised text kernels over the UTF-8 buffers of Arrow string columns.

A text batch is (buf, offs): all bytes of the batch and the n + 1 row borders. Word and byte-window hashes
are polynomial hashes modulo 2**64 taken from one running sum, so no kernel loops over documents or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)

_rng = np.random.default_rng(20240501)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes: all but the six ASCII white-space characters.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: Word bytes: ASCII letters and digits (after lower-casing) and everything outside ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x41:0x5B] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the largest n asked for up to 4M."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        k = 1
        while k < size:
            have[k : 2 * k] = have[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (new array)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array without nulls (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    col = col.cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, borders) of an array from strings()."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = 2_000_000) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """The batch in slices of about `limit` text bytes at most (or one longer document): (rows, bytes, borders)."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    col = strings(table.column(text))
    buf, offs = buffer(col)
    n, at = len(offs) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield table.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def rolling(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running sums S so that the hash of bytes [a, b) is (S[b] - S[a]) * BASE**-a."""
    code = BYTE_CODE[LOWER] if lower else BYTE_CODE
    s = np.empty(len(buf) + 1, np.uint64)
    s[0] = 0
    np.cumsum(code[buf] * powers(BASE, len(buf)), out=s[1:])
    return s


def spans_hash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte spans [a, b) under running sums s; the length enters the hash."""
    inv = powers(BASE_INV, len(s))
    return mix((s[b] - s[a]) * inv[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, borders): byte spans of the words, and each document's first word (n + 1 borders)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = is_word[buf]
    begin, end = np.empty(n + 1, bool), np.empty(n + 1, bool)
    begin[0], begin[n] = m[0], False
    end[0], end[n] = False, m[-1]
    np.greater(m[1:], m[:-1], out=begin[1:n])
    np.less(m[1:], m[:-1], out=end[1:n])
    inner = offs[(offs > 0) & (offs < n)]
    inner = inner[m[inner] & m[inner - 1]]  # a word can't cross a border
    begin[inner] = end[inner] = True
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end), np.searchsorted(starts, offs, "left")


def shingles(h: np.ndarray, borders: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and their document numbers; a document of 1 to k - 1 words gives its whole sequence."""
    n_words = np.diff(borders)
    out, doc = [], []
    if len(h) >= k:
        acc = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + h[j : len(h) - k + 1 + j]
        d = np.repeat(np.arange(len(n_words)), n_words)
        ok = d[: len(acc)] == d[k - 1 :]
        out.append(mix(acc[ok]))
        doc.append(d[: len(acc)][ok])
    for i in np.flatnonzero((n_words > 0) & (n_words < k)):
        acc = n_words[i].astype(np.uint64)
        with np.errstate(over="ignore"):
            for x in h[borders[i] : borders[i + 1]]:
                acc = acc * np.uint64(0x9FB21C651E98DF25) + x
        out.append(mix(np.array([acc], np.uint64)))
        doc.append(np.array([i]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(doc)


def distinct(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, ascending, with n_docs + 1 borders."""
    if not len(h):
        return h, np.zeros(n_docs + 1, np.int64)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n_docs + 1), "left")


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of the concatenated spans starts[i] .. starts[i] + lens[i]."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


def blobs(data: np.ndarray, borders: np.ndarray) -> pa.Array:
    """Rows of `data` between borders as a binary column."""
    width = data.dtype.itemsize
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer((borders * width).astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
