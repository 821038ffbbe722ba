"""Fits the boosted trees of `pii` on generated lines: python -m vellum.llm.train_pii [LINES].

Each line holds made-up words and some items, which are personal (an address, a card number that passes its check, a
telephone number, in many forms) or look like it (dates, prices, versions, orders, book numbers, times, numbers that
fail the check), with or without cue words. The candidates of a line are the examples; those that are exactly a
personal item are positive. Half of the lines fit the trees, half calibrate them and set the thresholds.
"""

from __future__ import annotations

import json
import random
import sys
from pathlib import Path

import numpy as np

from . import pii

#: Lines; trees, their depth, learning rate, borders of a feature, least examples of a leaf; precision that thresholds keep.
LINES, TREES, DEPTH, RATE, BORDERS, LEAST, PRECISION = 24_000, 90, 4, 0.25, 40, 12, 0.995


class Writer:
    """Makes lines: (text, spans of the personal items)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def number(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        w = "".join(self.r.choice(["th", "er", "an", "on", "é", "ß", "ñ", "le", "st", "re", "in", "ou", "de", "la", "at", "en", "sch", "to"]) for _ in range(self.r.randint(1, 4)))
        return self.r.choice([w, w, w, w.capitalize(), w.upper()]) + self.r.choice(["", "", "", "", ",", ".", "***", "%%%", ":", "$$$", "!!"])

    def name(self, a: int, b: int) -> str:
        return "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(self.r.randint(a, b)))

    def checked(self, n: int) -> str:
        d = self.r.choice("3456456456") + self.number(n - 2) if self.r.random() < 0.6 else self.number(n - 1)
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    def grouped(self, d: str, sizes: list[int], sep: str) -> str:
        at, out = 0, []
        for s in sizes:
            out.append(d[at : at + s])
            at += s
        return sep.join([*out, d[at:]] if at < len(d) else out)

    def email(self) -> str:
        r = self.r
        user, host, tld = r.choice([self.name(2, 9), f"{self.name(2, 6)}.{self.name(3, 8)}"]), self.name(3, 10), r.choice(["com", "org", "net", "de", "fr", "es", "io", "co.uk"])
        at = r.choice(["@", " @ ", " at ", "[at]", " [at] ", "(at)", " (at) ", "@", " AT "])
        dot = "." if at in ("@", " @ ", "[at]", "(at)") and r.random() < 0.6 else r.choice([" dot ", "[dot]", " [dot] ", "(dot)", " DOT "])
        return f"{user}{at}{host}{dot}{tld.replace('.', dot)}"

    def ip(self) -> str:
        r = self.r
        if r.random() < 0.4:
            groups = [f"{r.randint(0, 65535):x}" for _ in range(8)]
            return ":".join(groups) if r.random() < 0.5 else ":".join(groups[: r.randint(1, 4)]) + "::" + ":".join(groups[: r.randint(1, 3)])
        return r.choice([".", ".", "[.]", "(.)", " . "]).join(str(r.randint(0, 255) if k else r.randint(11, 255)) for k in range(4))

    def card(self) -> str:
        r = self.r
        d = self.checked(r.choice([16, 16, 16, 16, 15, 13, 19]))
        return r.choice([d, self.grouped(d, [4, 4, 4], " "), self.grouped(d, [4, 4, 4], "-"), self.grouped(d, [4, 4, 4], "."), self.grouped(d, [4, 6], " ")])

    def phone(self) -> str:
        r, n = self.r, self.number
        return r.choice([
            f"+{r.randint(1, 99)} ({n(3)}) {n(3)}-{n(4)}", f"+1 ({n(3)}) {n(3)}-{n(4)}", f"+{r.randint(20, 99)} {n(2)} {n(2)} {n(2)} {n(2)} {n(2)}", f"+{r.randint(20, 99)}{n(9)}", f"+{r.randint(20, 99)}-{n(3)}-{n(3)}-{n(3)}",
            f"({n(3)}) {n(3)}-{n(4)}", f"{r.randint(2, 9)}{n(2)}-{n(3)}-{n(4)}", f"00{r.randint(30, 49)} {n(3)} {n(6)}", f"0{n(2)} {n(3)} {n(2)} {n(2)}", f"0{n(3)}/{n(6)}", f"0{n(1)}.{n(2)}.{n(2)}.{n(2)}.{n(2)}",
        ])

    def harmless(self) -> str:
        r, n = self.r, self.number
        y = r.randint(1900, 2050)
        wrong = next(d for d in iter(lambda: n(r.choice([13, 14, 15, 16, 16, 16, 17, 19])), None) if not pii.luhn(d))
        dates = [f"{y}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{y}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{y}", f"{y}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}:{n(1)}0:{n(1)}5", f"{y}-{y + 9}", f"{y} - {y + 3}"]
        numbers = [f"{n(1)}.{n(1)}.{n(2)}", f"{r.randint(1, 9)} {n(3)} {n(3)}", f"{r.randint(1, 99)}.{n(3)}.{n(3)}", f"${n(3)}.{n(2)}", f"{n(2)}.{n(5)}, -{n(2)}.{n(5)}", n(r.randint(1, 8)), f"0.{n(7)}", " ".join(n(r.randint(1, 3)) for _ in range(r.randint(3, 12))), f"{n(2)}:{n(2)}:{n(2)}", f"{n(1)}:{n(1)}:{n(1)}"]
        cued = [f"version {n(1)}.{n(1)}.{n(1)}.{n(2)}", f"v {n(1)}.{n(2)}.{n(1)}.{n(1)}", f"section {n(1)}.{n(1)}.{n(1)}.{n(1)}", f"ISBN 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"ISBN 978{n(10)}", f"order {n(3)}-{n(7)}-{n(7)}", f"invoice no {n(10)}", f"tracking {self.checked(16) if r.random() < 0.5 else wrong}", f"ref {n(4)}-{n(4)}-{n(4)}", f"serial {n(3)}-{n(3)}-{n(4)}", f"id {n(13)}", f"build {n(4)}.{n(2)}.{n(3)}.{n(1)}"]
        marks = [f"@{self.name(3, 8)}", f"{self.word()} @ {n(2)}", f"{n(2)} at {n(2)} dot {n(1)}", f"{self.name(3, 8)} at the dot", f"{self.name(3, 6)}@{self.name(3, 6)}", ":".join(f"{r.randint(0, 255):02x}" for _ in range(6)), "::", "std::vector", f"meet at noon. {self.word()}"]
        return r.choice([wrong, self.grouped(wrong, [4, 4, 4], " "), wrong, r.choice(dates), r.choice(dates), r.choice(numbers), r.choice(numbers), r.choice(cued), r.choice(marks)])

    def line(self) -> tuple[str, list[tuple[int, int, int]]]:
        r, text, spans = self.r, "", []
        for _ in range(r.randint(1, 5)):
            text += " ".join(self.word() for _ in range(r.choice([0, 1, 2, 4]))) + r.choice([" ", " ", " ", "\n", " | "])
            if r.random() < 0.45:
                kind = r.randrange(4)
                if r.random() < 0.35:
                    text += r.choice(pii.CUES[pii.KINDS[kind]].split()) + r.choice([" ", ": ", " is "])
                item = (self.email, self.ip, self.card, self.phone)[kind]()
                if text[-1:].isspace() or not text:
                    spans.append((kind, len(text), len(text) + len(item)))
                text += item
            else:
                text += self.harmless()
            text += r.choice([" ", " ", "", ", ", ". ", "!! ", "*** ", "\n"])
            if text[-1] not in " \n":
                text += " "
        return text, spans


def examples(lines: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, is it personal) of every candidate."""
    w, x, y = Writer(seed), [], []
    for _ in range(lines):
        text, spans = w.line()
        own = set(spans)
        for s in pii.candidates(text):
            x.append(pii.features(text, *s))
            y.append(s in own)
    return np.array(x, np.float64), np.array(y, np.float64)


def grow(x: np.ndarray, y: np.ndarray) -> dict:
    """Trees of one depth by Newton steps on the logistic loss, over histograms of each feature's borders."""
    borders = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BORDERS))) for c in x.T]
    bins = np.stack([np.searchsorted(b, c, "left") for b, c in zip(borders, x.T)], 1)  # bin <= k: x <= borders[k]
    width, p = BORDERS + 1, y.mean()
    start = float(np.log(p / (1 - p)))
    score, out = np.full(len(y), start), {"feature": [], "border": [], "leaf": [], "start": start}
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        at, feature, border = np.zeros(len(y), np.int64), [], []
        for depth in range(DEPTH):
            nodes = 1 << depth
            best = [(0.0, 0, len(borders[0]) - 1)] * nodes
            for f in range(x.shape[1]):
                cell = at * width + bins[:, f]
                sums = [np.bincount(cell, w, nodes * width).reshape(nodes, width) for w in (g, h, np.ones(len(y)))]
                gl, hl, nl = (np.cumsum(s, 1) for s in sums)
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
                gain = gain[:, : len(borders[f])]
                for k, j in enumerate(np.argmax(gain, 1)):
                    if gain[k, j] > best[k][0] + 1e-9:
                        best[k] = (gain[k, j], f, int(j))
            feature += [f for _, f, _ in best]
            border += [float(borders[f][j]) if gain else float("inf") for gain, f, j in best]
            cut = np.array([j if gain else width for gain, _, j in best])
            of = np.array([f for _, f, _ in best])
            at = 2 * at + (bins[np.arange(len(y)), of[at]] > cut[at])
        leaf = RATE * np.bincount(at, g, 1 << DEPTH) / (np.bincount(at, h, 1 << DEPTH) + 1)
        score += leaf[at]
        out["feature"].append(feature)
        out["border"].append([min(b, 1e18) for b in border])
        out["leaf"].append([round(float(v), 6) for v in leaf])
    return out


def calibrate(raw: np.ndarray, y: np.ndarray, kind: np.ndarray) -> dict:
    """Logistic curve of each kind, and the least probability from which on the candidates have the precision."""
    out = {"slope": [], "shift": [], "threshold": [], "recall": []}
    for k in range(len(pii.KINDS)):
        own, s, t = kind == k, 1.0, 0.0
        x, z = raw[own], y[own]
        for _ in range(25):
            q = 1 / (1 + np.exp(-(s * x + t)))
            w = q * (1 - q) + 1e-9
            step = np.linalg.solve([[np.sum(w * x * x) + 1e-6, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-6]], [np.sum((z - q) * x), np.sum(z - q)])
            s, t = s + step[0], t + step[1]
        p = 1 / (1 + np.exp(-(s * x + t)))
        order = np.argsort(-p)
        good = np.cumsum(z[order]) / np.arange(1, len(order) + 1) >= PRECISION
        last = int(np.flatnonzero(good)[-1])
        out["slope"].append(float(s))
        out["shift"].append(float(t))
        out["threshold"].append(max(0.5, float(p[order][last])))
        out["recall"].append(float(np.sum(z[p >= out["threshold"][-1]]) / np.sum(z)))
    return out


def main() -> None:
    lines = int(sys.argv[1]) if len(sys.argv) > 1 else LINES
    x, y = examples(lines // 2, 1)
    model = grow(x, y)
    held, truth = examples(lines // 2, 2)
    blank = {"slope": [1.0] * 4, "shift": [0.0] * 4, "threshold": [0.5] * 4}
    model |= calibrate(pii.Trees({**model, **blank}).raw(held), truth, held[:, 0].astype(int))
    print({k: model[k] for k in ("slope", "shift", "threshold", "recall")}, len(y), y.mean())
    Path(pii.__file__).with_name("pii_trees.json").write_text(json.dumps(model))


if __name__ == "__main__":
    main()
