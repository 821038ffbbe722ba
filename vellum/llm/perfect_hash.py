"""A minimal perfect hash of 64-bit keys in levels of bits, with the keys stored by slot.

At each level a key has one place; where it is alone there, its bit is set and its slot is the number of bits before
it; keys that share a place go to the next level. A key that was never given may meet a bit, too: its slot then holds
another key, so lookups compare.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K

#: Places for each key of a level.
SPARE = 1.6


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & K.MASK)
    return (K.mix(keys ^ seed) >> np.uint64(11)) % np.uint64(size)


class PerfectHash:
    def __init__(self, bits: list[np.ndarray], keys: np.ndarray):
        """bits: the levels as booleans; keys: by slot."""
        self.bits, self.keys = bits, keys
        before, self.rank = 0, []
        for b in bits:
            self.rank.append(np.cumsum(b, dtype=np.int64) - b + before)
            before += int(b.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys."""
        left, bits = keys, []
        while len(left):
            size = max(8, int(len(left) * SPARE))
            at = _place(left, len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            left = left[~alone[at]]
        out = cls(bits, np.zeros(len(keys), np.uint64))
        stored = np.empty(len(keys), np.uint64)
        stored[out._slots(keys)[0]] = keys
        out.keys = stored
        return out

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.bits, self.rank)):
            if not len(open_):
                break
            at = _place(keys[open_], level, len(bits))
            hit = bits[at]
            slot[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        met = np.ones(len(keys), bool)
        met[open_] = False
        return slot, met

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, known): the slot of a key that is not known has no meaning."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        slot, met = self._slots(keys)
        return slot, met & (self.keys[slot] == keys)

    def dump(self) -> tuple[list[int], list[bytes], bytes]:
        """(sizes of the levels, their bits, keys by slot)."""
        return [len(b) for b in self.bits], [np.packbits(b).tobytes() for b in self.bits], self.keys.astype("<u8").tobytes()

    @classmethod
    def load(cls, sizes: list[int], bits: list[bytes], keys: bytes) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(sizes, bits)], np.frombuffer(keys, "<u8"))
