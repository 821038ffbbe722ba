"""A bidirectional LSTM in numpy that labels every block of a page as main text or not.

A block's input vector has hashed counts of its tag path (nearer elements weigh more) and of the class and id words on
it, a hashed sum of its words, and a few measures. One LSTM reads the page's blocks forwards, one backwards; a logistic
unit on both states labels the block. `extractor.npz` holds the weights that `train` made from generated pages.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from . import kernels as K
from .blocks import Block

TAGS, NAMES, WORDS, MEASURES = 48, 80, 32, 8
INPUT = TAGS + NAMES + WORDS + MEASURES
HIDDEN = 24
_slot: dict[str, int] = {}


def slot(word: str, n: int) -> int:
    """A fixed bucket of the word."""
    got = _slot.get(word)
    if got is None:
        if len(_slot) > 100_000:
            _slot.clear()
        got = _slot[word] = zlib.crc32(word.encode())
    return got % n


def features(pages: list[list[Block]]) -> np.ndarray:
    """Input vectors of all blocks of the pages, one after the other."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), INPUT), np.float32)
    paths: dict[tuple, np.ndarray] = {}
    for i, b in enumerate(flat):
        row = paths.get(b.path)
        if row is None:
            row = np.zeros(TAGS + NAMES, np.float32)
            for depth, (tag, names) in enumerate(reversed(b.path)):
                weight = 0.8**depth
                row[slot(tag, TAGS)] += weight
                for w in names:
                    row[TAGS + slot(w, NAMES)] += weight
            paths[b.path] = row
        x[i, : TAGS + NAMES] = row
    for part, buf, offs in K.pieces(pa.table({"text": pa.array([b.text for b in flat], pa.large_string()), "i": pa.array(np.arange(len(flat)))})):
        first = int(part["i"][0].as_py())
        a, e, border = K.words(buf, offs, K.SPACE_WORD)
        h = K.spans_hash(K.rolling(buf, lower=True), a, e)
        n = np.diff(border)
        own = np.repeat(np.arange(len(n)), n)
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        hashed = np.bincount(own * WORDS + (h % np.uint64(WORDS)).astype(np.int64), weights=sign, minlength=len(n) * WORDS).reshape(-1, WORDS)
        x[first : first + len(n), TAGS + NAMES : TAGS + NAMES + WORDS] = hashed / np.sqrt(np.maximum(n, 1))[:, None]
        x[first : first + len(n), -MEASURES] = np.log1p(n) / 4
        x[first : first + len(n), -MEASURES + 1] = np.log1p(np.diff(offs)) / 6
    at = 0
    for p in pages:
        for k, b in enumerate(p):
            size = max(len(b.text), 1)
            x[at + k, -MEASURES + 2 :] = (min(b.links / size, 1.0), min(b.tags, 5) / 5, b.text[-1] in ".!?:;…\"'", sum(c.isdigit() for c in b.text[:200]) / min(size, 200), (k + 1) / len(p), 1 / (1 + k))
        at += len(p)
    return x


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Random weights."""
    w: dict[str, np.ndarray] = {}
    for d in "fb":
        w[f"{d}x"] = rng.normal(0, (1 / INPUT) ** 0.5, (INPUT, 4 * HIDDEN)).astype(np.float32)
        w[f"{d}h"] = rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w[f"{d}b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    w["o"] = rng.normal(0, 0.2, (2 * HIDDEN,)).astype(np.float32)
    w["c"] = np.zeros(1, np.float32)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, wx, wh, b, keep: bool = False):
    """Hidden states (time, page, unit) of input (time, page, value); masked steps leave the state as it was."""
    steps, pages, _ = x.shape
    pre = x.reshape(steps * pages, -1) @ wx + b
    pre = pre.reshape(steps, pages, -1)
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out, tape = np.empty((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ wh
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new_c = f * c + i * g
        tanh_c = np.tanh(new_c)
        if keep:
            tape.append((i, f, o, g, c, h, tanh_c, m))
        h = np.where(m, o * tanh_c, h)
        c = np.where(m, new_c, c)
        out[t] = h
    return out, tape


def lstm_back(x: np.ndarray, dout: np.ndarray, tape, wh):
    """Gradients of wx, wh, b."""
    steps, pages, _ = x.shape
    dz_all = np.empty((steps, pages, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, c, h, tanh_c, m = tape[t]
        dh = dh + dout[t]
        live = np.where(m, dh, 0)
        dnew = np.where(m, dc, 0) + live * o * (1 - tanh_c**2)
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * tanh_c * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
        dz_all[t] = dz
        dwh += h.T @ dz
        dh = np.where(m, dz @ wh.T, dh)
        dc = np.where(m, dnew * f, dc)
    flat = dz_all.reshape(steps * pages, -1)
    return x.reshape(steps * pages, -1).T @ flat, dwh, flat.sum(0)


def padded(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, value) input and its mask."""
    steps = max(sizes)
    out, mask = np.zeros((steps, len(sizes), x.shape[1]), np.float32), np.zeros((steps, len(sizes)), bool)
    at = 0
    for k, n in enumerate(sizes):
        out[:n, k] = x[at : at + n]
        mask[:n, k] = True
        at += n
    return out, mask


def scores(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits (time, page)."""
    fwd, ft = lstm(x, mask, w["fx"], w["fh"], w["fb"], keep)
    bwd, bt = lstm(x[::-1], mask[::-1], w["bx"], w["bh"], w["bb"], keep)
    both = np.concatenate([fwd, bwd[::-1]], axis=2)
    return both @ w["o"] + w["c"], both, ft, bt


def label(w: dict[str, np.ndarray], pages: list[list[Block]], cells: int = 20_000) -> list[np.ndarray]:
    """For each page, which of its blocks are main text. Pages of like length run together, about `cells` blocks at once."""
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and len(pages[order[to]]) * (to + 1 - at) <= cells:
            to += 1
        some = [pages[k] for k in order[at:to]]
        z, *_ = scores(w, *padded(features(some), [len(p) for p in some]))
        for j, k in enumerate(order[at:to]):
            out[k] = z[: len(pages[k]), j] > 0
        at = to
    return out
