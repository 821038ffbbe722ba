"""Exact tokenisation by units: white-space-delimited pieces whose tokens do not depend on their neighbours.

The public byte-level and word-end BPE files split a text by a pattern none of whose matches runs from a
non-space into a space. A run of ASCII white space with the word after it therefore has the same tokens
alone as in its text, unless other Unicode white space stands in the text; such texts are encoded whole.
Units repeat a lot, so each worker keeps a bounded cache of their ids.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import bpe
from . import kernels as K

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizers library's object for a .json file, single-threaded, loaded once per worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def library(path: str, units: list[str]) -> list[np.ndarray]:
    """Ids of the units as the library gives them; many go in one call, parted by a special token."""
    tok = tokenizer(path)

    def alone(unit: str) -> np.ndarray:
        return np.array(tok.encode(unit, add_special_tokens=False).ids, np.uint32)

    special = sorted((i, t.content) for i, t in tok.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word))
    if not special or len(units) < 4:
        return [alone(u) for u in units]
    (sep_id, sep), out = special[0], []
    for at in range(0, len(units), 1000):
        part = units[at : at + 1000]
        text = sep.join(part)
        if text.count(sep) != len(part) - 1:
            out += [alone(u) for u in part]
            continue
        (e,) = tok.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        cut = np.flatnonzero(ids == sep_id)
        out += [ids[a:b] for a, b in zip([0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)])]
    return out


class Table:
    """A worker's bounded cache: 64-bit unit hash -> its ids, as an open-addressing table of numpy arrays.

    It starts again when 60 % full, so its memory has a fixed bound (about 60 MB).
    """

    BITS = 20

    def __init__(self, path: str):
        self.path = path
        self.merger = bpe.Merger.load(path)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << self.BITS, np.uint64)
        self.start = np.zeros(1 << self.BITS, np.int64)
        self.size = np.zeros(1 << self.BITS, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = self.filled = 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Slots that hold h or are free."""
        last = (1 << self.BITS) - 1
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        at = self.key[slot]
        open_ = np.flatnonzero((at != h) & (at != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & last
            at = self.key[slot[open_]]
            open_ = open_[(at != h[open_]) & (at != 0)]
        return slot

    def _insert(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need - len(self.flat), len(self.flat)), np.uint32)])
        self.flat[self.used : need] = ids
        starts = self.used + np.cumsum(sizes) - sizes
        self.used = need
        todo = np.arange(len(h))
        while len(todo):  # those that ask for the same free slot take turns
            slot = self._slots(h[todo])
            self.key[slot] = h[todo]
            won = self.key[slot] == h[todo]
            got = todo[won]
            self.start[slot[won]], self.size[slot[won]] = starts[got], sizes[got]
            todo = todo[~won]
        self.filled += len(h)

    def _make(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of the units [a, b)."""
        ok = bpe.plain(buf, a, b) if self.merger is not None else np.zeros(len(a), bool)
        sizes = np.zeros(len(a), np.int64)
        ids, sizes[ok] = self.merger.encode(buf[K.gather(a[ok], (b - a)[ok])], (b - a)[ok]) if ok.any() else (np.zeros(0, np.uint32), 0)
        rest = np.flatnonzero(~ok)
        if len(rest):
            got = library(self.path, [buf[x:y].tobytes().decode() for x, y in zip(a[rest].tolist(), b[rest].tolist())])
            sizes[rest] = [len(g) for g in got]
            both = np.concatenate([ids, *got])
            order = np.concatenate([np.repeat(np.flatnonzero(ok), sizes[ok]), np.repeat(rest, sizes[rest])])
            ids = both[np.argsort(order, kind="stable")]
        return ids, sizes

    def find(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts in .flat, sizes) of the units [a, b) with hashes h; unknown ones are made first."""
        if self.filled > 0.6 * len(self.key):
            self.clear()
        h = np.where(h == 0, np.uint64(1), h)
        slot = self._slots(h)
        new = np.flatnonzero(self.key[slot] != h)
        if len(new):
            _, one = np.unique(h[new], return_index=True)
            if len(one) + self.filled > 0.9 * len(self.key):  # more than the table can hold: make these without it
                ids, sizes = self._make(buf, a, b)
                self.clear()
                self.flat = ids
                return np.cumsum(sizes) - sizes, sizes
            one = new[one]
            for at in range(0, len(one), 50_000):
                part = one[at : at + 50_000]
                self._insert(h[part], *self._make(buf, a[part], b[part]))
            slot = self._slots(h)
        return self.start[slot], self.size[slot].astype(np.int64)


def table(path: str) -> Table:
    """This worker's table of a tokenizer file."""
    if f"table:{path}" not in _loaded:
        _loaded[f"table:{path}"] = Table(path)
    return _loaded[f"table:{path}"]


_LEADS = np.zeros(256, bool)
_LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def odd_space(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each document: does it hold white space or separators other than the six ASCII characters?"""
    at = np.flatnonzero(_LEADS[buf])
    end = len(buf) - 1
    x, y, z = buf[at], buf[np.minimum(at + 1, end)], buf[np.minimum(at + 2, end)]
    hit = x < 0x20
    hit |= (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    hit |= (x == 0xE1) & (((y == 0x9A) & (z == 0x80)) | ((y == 0xA0) & (z == 0x8E)))
    hit |= (x == 0xE2) & (y == 0x80) & (((z >= 0x80) & (z <= 0x8F)) | ((z >= 0xA8) & (z <= 0xAF)))
    hit |= (x == 0xE2) & (y == 0x81) & (z >= 0x9F)
    hit |= (x == 0xE3) & (y == 0x80) & (z == 0x80)
    out = np.zeros(len(offs) - 1, bool)
    out[np.searchsorted(offs, at[hit], "right") - 1] = True
    return out


def split(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the units, which cover the bytes without gaps, and each document's first unit (n + 1 borders)."""
    _, ends, _ = K.words(buf, offs, K.SPACE_WORD)
    odd = odd_space(buf, offs)
    if odd.any():
        ends = ends[~odd[np.searchsorted(offs, ends, "left") - 1]]
    flag = np.zeros(len(buf) + 1, bool)
    flag[ends] = True
    flag[offs] = True
    borders = np.flatnonzero(flag)
    return borders, np.searchsorted(borders, offs, "left")


def encode(buf: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents one after the other, token borders of the n documents)."""
    borders, first = split(buf, offs)
    if len(borders) < 2:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    a, b = borders[:-1], borders[1:]
    t = table(path)
    start, size = t.find(buf, a, b, K.spans_hash(K.rolling(buf), a, b))
    total = np.concatenate([[0], np.cumsum(size)])
    return t.flat[K.gather(start, size)], total[first]
