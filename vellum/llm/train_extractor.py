"""Trains the block labeller on generated pages and writes extractor.npz: python -m vellum.llm.train_extractor WORDS.parquet

Pages are drawn from many layouts; their labels are known as they are made. WORDS is a table with a text column whose
words fill the pages. The number of pages is a parameter, and so bounds what is trained on.
"""

from __future__ import annotations

import html
import random
import sys
from pathlib import Path

import numpy as np

from . import labeller as L
from .blocks import blocks

PAGES, EPOCHS, BATCH = 3000, 5, 32
MARK = "☃"


class Maker:
    """Pages whose main text is marked by a character at the start of each of its blocks."""

    def __init__(self, texts: list[str], seed: int):
        self.r = random.Random(seed)
        self.docs = [t.split() for t in texts if t and len(t.split()) > 20]

    def words(self, lo: int, hi: int) -> str:
        doc = self.r.choice(self.docs)
        n = self.r.randint(lo, hi)
        at = self.r.randrange(max(1, len(doc) - n))
        return html.escape(" ".join(doc[at : at + n]))

    def name(self, *names: str) -> str:
        n = self.r.choice(names)
        kind = self.r.choice(("class", "class", "id"))
        extra = self.r.choice(("", "", "-wrap", " box", "-1", "-block"))
        return f' {kind}="{n}{extra}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(n))

    def menu(self) -> str:
        r = self.r
        body = f"<ul>{self.links(r.randint(2, 9))}</ul>"
        return r.choice((f"<nav>{body}</nav>", f"<div{self.name('menu', 'nav', 'navigation', 'topbar', 'breadcrumb')}>{body}</div>", f"<header>{body}</header>", f"<header><h2>{self.words(1, 4)}</h2>{body}</header>", f"<div{self.name('header', 'masthead', 'site-header')}><h1>{self.words(1, 3)}</h1><p>{self.words(2, 8)}</p></div>"))

    def foot(self) -> str:
        text = self.r.choice(("&copy; example.com &middot; ", "Copyright 2020 ", "", "&copy; ")) + self.words(2, 15)
        return self.r.choice((f"<footer>{text}</footer>", f"<footer><p>{text}</p><ul>{self.links(3)}</ul></footer>", f"<div{self.name('footer', 'bottom', 'copyright', 'site-footer')}><p>{text}</p></div>"))

    def extra(self) -> str:
        r = self.r
        w = self.words
        return r.choice(
            (
                f"<div{self.name('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{w(3, 25)}</div>",
                f"<aside{self.name('sidebar', 'side', 'widget')}><h3>{w(1, 3)}</h3><ul>{self.links(4)}</ul><p>{w(5, 30)}</p></aside>",
                f"<div{self.name('sidebar', 'related', 'widget', 'recommended')}><h3>{w(1, 3)}</h3><p>{w(5, 30)}</p></div>",
                f"<div{self.name('cookie', 'notice', 'consent', 'gdpr', 'alert')}><p>{w(6, 30)}</p><button>{w(1, 2)}</button></div>",
                f"<form{self.name('search', 'login', 'newsletter', 'subscribe')}><label>{w(1, 4)}</label><input name=q><p>{w(3, 12)}</p></form>",
                f"<div{self.name('share', 'social', 'tags')}><a href=#>{w(1, 2)}</a> <a href=#>{w(1, 2)}</a></div>",
            )
        )

    def comments(self) -> str:
        r = self.r
        items = "".join(f"<{t}{self.name('comment', 'reply')}><b>{self.words(1, 2)}</b><p>{self.words(4, 60)}</p></{t}>" for t in [r.choice(("li", "div", "article"))] for _ in range(r.randint(1, 6)))
        return r.choice((f"<section{self.name('comments', 'discussion', 'responses')}><h2>{self.words(1, 2)}</h2>{items}</section>", f"<div{self.name('comments', 'comment-list', 'disqus')}>{items}</div>"))

    def article(self) -> str:
        r = self.r
        out = [f"<h1>{MARK}{self.words(3, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 2, 3, 5, 8, 14, 25))):
            k = r.random()
            if k < 0.72:
                out.append(f"<p>{MARK}{self.words(1, 3) if r.random() < 0.1 else self.words(4, 120)}</p>")
            elif k < 0.78:
                out.append(f"<p><b>{MARK}{self.words(3, 60)}<br>")
            elif k < 0.84:
                out.append(f"<h{(h := r.randint(2, 4))}>{MARK}{self.words(1, 7)}</h{h}>")
            elif k < 0.9:
                out.append(f"<ul>{''.join(f'<li>{MARK}{self.words(2, 20)}</li>' for _ in range(r.randint(1, 4)))}</ul>")
            elif k < 0.94:
                out.append(f"<blockquote>{MARK}{self.words(5, 40)}</blockquote>")
            elif k < 0.97:
                out.append(f"<table><tr><td>{MARK}{self.words(1, 5)}</td><td>{MARK}{self.words(1, 5)}</td></tr></table>")
            else:
                out.append(self.extra())
        body = "".join(out)
        kind = r.random()
        if kind < 0.45:
            return f"<article>{body}</article>"
        if kind < 0.6:
            return f"<main>{body}</main>"
        if kind < 0.9:
            return f"<div{self.name('content', 'post', 'entry', 'article', 'story', 'main', 'body', 'text')}>{body}</div>"
        return f"<section><div>{body}</div></section>"

    def page(self) -> str:
        r = self.r
        some = lambda p, f: [f() for _ in range(r.choice((1, 1, 2)))] if r.random() < p else []
        parts = [*some(0.85, self.menu), *some(0.5, self.extra), self.article(), *some(0.35, self.comments), *some(0.35, self.extra), *some(0.85, self.foot)]
        return f"<!DOCTYPE html><html><head><title>{self.words(3, 9)}</title><style>p{{margin:0}}</style></head><body>{''.join(parts)}</body></html>"


def examples(maker: Maker, n: int):
    pages, labels = [], []
    while len(pages) < n:
        found = blocks(maker.page())
        y = np.array([b.text.startswith(MARK) for b in found])
        for b in found:
            b.text = b.text.removeprefix(MARK).strip() or "."
        if found:
            pages.append(found)
            labels.append(y)
    return pages, labels


def train(texts: list[str], n: int = PAGES, epochs: int = EPOCHS, seed: int = 7) -> tuple[dict[str, np.ndarray], float]:
    """(weights, accuracy on held-out pages)."""
    maker, rng = Maker(texts, seed), np.random.default_rng(seed)
    pages, labels = examples(maker, n)
    held = n // 10
    w = L.start(rng)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(np.arange(held, n))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            some = [pages[k] for k in own]
            x, mask = L.padded(L.features(some), [len(p) for p in some])
            drop = rng.random(x.shape[2]) < 0.05  # a layout may lack any clue
            x[:, :, drop] = 0
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(own):
                y[: len(labels[k]), j] = labels[k]
            z, both, ft, bt = L.scores(w, x, mask, keep=True)
            dz = ((L.sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)
            g = {"o": np.einsum("tp,tph->h", dz, both), "c": dz.sum(keepdims=True).reshape(1)}
            dboth = dz[:, :, None] * w["o"]
            g["fx"], g["fh"], g["fb"] = L.lstm_back(x, dboth[:, :, : L.HIDDEN], ft, w["fh"])
            g["bx"], g["bh"], g["bb"] = L.lstm_back(x[::-1], dboth[::-1, :, L.HIDDEN :], bt, w["bh"])
            norm = float(np.sqrt(sum((x_**2).sum() for x_ in g.values())))
            step += 1
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            for k in w:
                d = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * d
                v2[k] = 0.999 * v2[k] + 0.001 * d * d
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    got = L.label(w, pages[:held])
    right = sum(int((a == b).sum()) for a, b in zip(got, labels[:held]))
    return w, right / sum(map(len, got))


if __name__ == "__main__":
    import pyarrow.parquet as pq

    weights, accuracy = train(pq.read_table(sys.argv[1], columns=["text"])["text"].to_pylist())
    np.savez_compressed(Path(__file__).with_name("extractor.npz"), **{k: v.astype(np.float16) for k, v in weights.items()})
    print(f"held-out block accuracy {accuracy:.4f}")
