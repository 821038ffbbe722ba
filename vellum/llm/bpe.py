"""Byte-pair merging of many short Latin-1 units at once in numpy, by a tokenizer file's own merge table.

Only units whose result is plain to derive come here; `takes` says which. All others go to the library.
"""

from __future__ import annotations

import json

import numpy as np

INF = np.uint32(0xFFFFFFFF)

#: Character classes of Latin-1: 0 white space, 1 letter, 2 number, 3 other.
CLASS = np.full(256, 3, np.uint8)
CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
for _a, _b in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA)):
    CLASS[_a : _b + 1] = 1
CLASS[0x30:0x3A] = 2
CLASS[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER[0xC0:0xDF] += 32
LOWER[0xD7] = 0xD7

#: Bytes that a plain unit can hold: space, newline, printable ASCII but ' and <, and the two bytes of a Latin-1 character.
_BAD = np.ones(256, bool)
_BAD[[0x20, 0x0A, 0xC2, 0xC3]] = False
_BAD[0x21:0x7F] = False
_BAD[0x80:0xC0] = False
_BAD[[0x27, 0x3C]] = True
LONGEST = 200


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def plain(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each unit, the bytes [a, b): can the merger take it?"""
    bad = _BAD[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC2)
    after = buf[lead + 1]
    bad[lead[(after <= 0xA0) | (after == 0xAD)]] = True
    sums = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(bad, out=sums[1:], dtype=np.int32)
    return (sums[a] == sums[b]) & (b - a <= LONGEST)


class Merger:
    """Merge table of a .json BPE file. `style`: 'byte' (a space belongs to the next word) or 'word' (word-end suffix)."""

    def __init__(self, spec: dict, style: str):
        model = spec["model"]
        vocab, self.style = model["vocab"], style
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.uint32)
        end = model.get("end_of_word_suffix") or ""
        self.last = np.array([vocab[c + end] for c in chars], np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.bits = 19
        self.key = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rank = np.full(1 << self.bits, INF)
        self.made = np.zeros(1 << self.bits, np.uint32)
        for r, (k, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.key[slot] != 0xFFFFFFFFFFFFFFFF and self.key[slot] != k:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            if self.key[slot] != k:
                self.key[slot], self.rank[slot], self.made[slot] = k, r, made[r]

    @staticmethod
    def load(path: str) -> Merger | None:
        """The file's merger, or None if the file is of a kind that this module doesn't know."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, norm = spec.get("model", {}), spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) and len(model["vocab"]) < 1 << 16 and spec.get("post_processor") is None
        if not plain:
            return None
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not model.get("end_of_word_suffix"):
            return Merger(spec, "byte")
        kinds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        steps = pre.get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex"):
            return Merger(spec, "word")
        return None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, or of an empty place."""
        slot = self._slot(keys)
        at = self.key[slot]
        open_ = np.flatnonzero((at != keys) & (at != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.key[slot[open_]]
            open_ = open_[(at != keys[open_]) & (at != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return slot

    def _symbols(self, c: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol ids, pre-token number, unit number), a row for each byte that counts."""
        unit = np.repeat(np.arange(len(lens)), lens)
        kind = CLASS[c]
        lead = np.flatnonzero(c >= 0xC0)
        char = ((c[lead] & 3) << 6) | (c[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = CLASS[char]
        start = np.empty(len(c), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[(np.cumsum(lens) - lens)[lens > 0]] = True
        if self.style == "word":
            number = kind == 2
            number[lead + 1] = False
            start |= number
            c = LOWER[np.where(c < 0x80, c, 0x80)] if not len(lead) else self._lowered(c, lead, char)
        else:
            before = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & (unit[:-1] == unit[1:]))  # the last space of a gap
            start[before] = True
            start[before[c[before] == 0x20] + 1] = False
        word = np.cumsum(start) - 1
        if self.style == "word":
            keep = kind != 0
            c, word, unit = c[keep], word[keep], unit[keep]
        ids = self.first[c]
        if len(ids):
            tail = np.append(word[1:] != word[:-1], True)
            ids[tail] = self.last[c[tail]]
        return ids, word, unit

    @staticmethod
    def _lowered(c: np.ndarray, lead: np.ndarray, char: np.ndarray) -> np.ndarray:
        out = np.where(c < 0x80, LOWER[c], c)
        low = LOWER[char]
        out[lead] = 0xC0 | (low >> 6)
        out[lead + 1] = 0x80 | (low & 0x3F)
        return out

    def encode(self, c: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of plain units: their bytes one after the other, and their lengths."""
        if not len(c):
            return np.zeros(0, np.uint32), np.zeros(len(lens), np.int64)
        ids, word, unit = self._symbols(c, lens)
        order = np.arange(len(ids))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(ids) > 1:
            same = word[1:] == word[:-1]
            keys = (ids[:-1].astype(np.uint64) << np.uint64(16)) | ids[1:]
            slot = self._look(keys)
            rank = np.where(same & (self.key[slot] == keys), self.rank[slot], INF)
            head = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(np.append(rank, INF), head)
            lens_now = np.diff(np.append(head, len(ids)))
            live = best != INF
            if not live.any():
                break
            own = np.repeat(best, lens_now)
            at = np.flatnonzero((rank == own[:-1]) & (rank != INF))
            if len(at) > 1:  # of overlapping places every other one, from the left
                run = np.append(True, np.diff(at) != 1)
                since = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                at = at[since % 2 == 0]
            ids[at] = self.made[slot[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            stay = np.repeat(live, lens_now)
            over = keep & ~stay
            if over.any():
                done.append((ids[over], unit[over], order[over]))
            keep &= stay
            ids, word, unit, order = ids[keep], word[keep], unit[keep], order[keep]
        done.append((ids, unit, order))
        ids, unit, order = (np.concatenate(x) for x in zip(*done))
        by = np.argsort(order, kind="stable")
        return ids[by], np.bincount(unit, minlength=len(lens))
