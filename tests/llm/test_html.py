"""Block reading and the recurrent labeller: gradients, held-out pages, page texts."""

from __future__ import annotations

import random

import numpy as np

from vellum.llm import html_text, labeller, train_extractor
from vellum.llm.blocks import blocks


def test_blocks_of_broken_markup():
    page = '<nav><ul><li><a href="/x">One</a><li>Two</ul></nav><script>var t="</p>";</script><!-- <p>no</p> --><article><h1>Top &amp; more</h1><p><b>First  line<br><p>Second\n<i>li</i>ne</p></article><p>after &copy;'
    found = blocks(page)
    assert [b.text for b in found] == ["One", "Two", "Top & more", "First line", "Second line", "after ©"]
    assert [b.path[-1][0] for b in found] == ["li", "li", "h1", "p", "p", "p"]
    assert blocks("") == [] and blocks("<p></p>") == []


def test_broken_markup_takes_linear_time():
    """A megabyte of unclosed tags, quotes, comments, nested or hidden elements: seconds each, not hours."""
    import time

    for piece in ("<b ", '<a "', "<a '", '<a ">', "<!-- ", "<![CDATA[", "<div>x", "<script>", "<svg>x", "<", "</p", "<li>x", "<p class='", "</x>y"):
        page = piece * (1_000_000 // len(piece))
        t = time.perf_counter()
        blocks(page)
        assert time.perf_counter() - t < 60, piece
    assert [b.text for b in blocks('<p title="open>One</p><p>Two</p>')] == ["One", "Two"]
    assert [b.text for b in blocks('<p title="a>b">One</p><p>Two</p><p x="')] == ["One", "Two"] + ['<p x="']


def test_head_without_end():
    found = blocks("<html><head><title>no</title><meta charset=x><link href=y><body><p>One</p>")
    assert [b.text for b in found] == ["One"]
    assert [b.text for b in blocks("<head><style>p{}</style><p>Two")] == ["Two"]


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in labeller.start(rng).items()}
    x, mask = rng.normal(size=(4, 2, labeller.INPUT)) * 0.3, np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)

    def loss():
        z, *_ = labeller.scores(w, x, mask)
        return float((z * mask).sum())

    _, both, ft, bt = labeller.scores(w, x, mask, keep=True)
    dz = mask.astype(float)
    d = dz[:, :, None] * w["o"]
    got = dict(zip(("fx", "fh", "fb"), labeller.lstm_back(x, d[:, :, : labeller.HIDDEN], ft, w["fh"])))
    got |= dict(zip(("bx", "bh", "bb"), labeller.lstm_back(x[::-1], d[::-1, :, labeller.HIDDEN :], bt, w["bh"])))
    for k, g in got.items():
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        old, eps = w[k][at], 1e-3
        w[k][at] = old + eps
        up = loss()
        w[k][at] = old - eps
        down = loss()
        w[k][at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_held_out_pages():
    r = random.Random(77)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(500)]
    texts = [" ".join(r.choice(words) for _ in range(200)) + "." for _ in range(50)]
    pages, labels = train_extractor.examples(train_extractor.Maker(texts, 12345), 300)
    got = labeller.label(html_text.weights(), pages)
    right = sum(int((a == b).sum()) for a, b in zip(got, labels))
    assert right / sum(map(len, labels)) > 0.97


def test_extract(spark):
    main = "".join(f"<p>Paragraph {k} of the story with enough words to read.</p>" for k in range(4))
    rows = [(1, "u", f"<html><body><nav><ul><li><a href=a>Home</a></li></ul></nav><article><h1>Title of it</h1>{main}</article><footer>&copy; me</footer></body></html>", "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "<<<>>><p", "x")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1]["text"] == "Title of it\n" + "\n".join(f"Paragraph {k} of the story with enough words to read." for k in range(4))
    assert [(got[k]["text"], got[k]["n_chars"]) for k in (2, 3)] == [("", 0)] * 2 and len(got) == 4
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
