"""Every template of the stock against a backtracking matcher, with texts that match and texts that nearly do."""

from __future__ import annotations

import random
import re

from vellum.llm import licenses

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def parse(text: str):
    """Template -> nested lists: a word, ("rep", kind, low, high), or ("region", may be missing, branches)."""
    tokens = re.findall(rf"<<[^>]*>>|{WORD}", text.lower())

    def sequence(k):
        out = []
        while k < len(tokens) and tokens[k] not in ("<<or>>", "<<end>>"):
            t = tokens[k]
            if t in ("<<opt>>", "<<one>>"):
                branches, free = [], t == "<<opt>>"
                while t != "<<end>>":
                    branch, k = sequence(k + 1)
                    branches.append(branch)
                    t = tokens[k]
                out.append(("region", free, branches))
            elif t.startswith("<<"):
                kind, span = t[2:-2].split()
                out.append(("rep", kind, *map(int, span.split("-"))))
            else:
                out.append(t)
            k += 1
        return out, k

    return sequence(0)[0]


def fits(kind, word):
    return kind == "any" or (word.isascii() and word.isdigit() and (kind == "number" or len(word) == 4))


def ends(part, words, at):
    """All places where the sequence can end that starts at `at`, by backtracking."""
    if not part:
        yield at
        return
    head, rest = part[0], part[1:]
    if isinstance(head, str):
        if at < len(words) and words[at] == head:
            yield from ends(rest, words, at + 1)
    elif head[0] == "rep":
        for k in range(head[3] + 1):
            if k and (at + k > len(words) or not fits(head[1], words[at + k - 1])):
                return
            if k >= head[2]:
                yield from ends(rest, words, at + k)
    else:
        for branch in head[2] + ([[]] if head[1] else []):
            for e in ends(branch, words, at):
                yield from ends(rest, words, e)


def render(part, r):
    out = []
    for x in part:
        if isinstance(x, str):
            out.append(x)
        elif x[0] == "rep":
            some = {"any": ["acme", "the", "2020", "ünal"], "number": ["3", "2020"], "year": ["1999", "2024"]}[x[1]]
            out += [r.choice(some) for _ in range(r.randint(x[2], x[3]))]
        else:
            out += render(r.choice(x[2] + ([[]] if x[1] else [])), r)
    return out


def test_every_template_against_backtracking(spark):
    r = random.Random(7)
    stock = licenses.stock()
    parsed = {label: [parse(t) for t in texts] for label, texts in stock.items()}
    assert {"mit", "mit-text", "gpl-3.0-notice", "zlib-text"} <= set(parsed)
    texts, meant = [], []
    for label, parts in parsed.items():
        for part in parts:
            for _ in range(4):
                words = render(part, r)
                texts.append(["some", "words", *words, "and", "more"])
                meant.append(label)
                k = r.randrange(len(words))
                texts += [words[:k] + words[k + 1 :], words[:k] + ["zzz"] + words[k:], words[:k] + ["zzz"] + words[k + 1 :], words[:-1], words[1:]]
                meant += [None] * 5

    def labels(words):
        return {label for label, parts in parsed.items() for part in parts for at in range(len(words)) if next(ends(part, words, at), None) is not None}

    rows = [(i, r.choice([" ", ", ", "\n"]).join(w).title() if i % 3 else " ".join(w)) for i, w in enumerate(texts)]
    got = {x["doc_id"]: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    near = 0
    for i, words in enumerate(texts):
        want = labels(words)
        found = set(got[i]["labels"].split(",")) - set(licenses.PHRASES.values()) - {""}
        assert found == want - set(licenses.PHRASES.values()), (i, words)
        assert meant[i] is None or meant[i] in found
        near += not want
        assert 0 <= got[i]["score"] <= 1 and (got[i]["score"] > 0.5) == bool(want)
    assert near > 100


def test_scores_rise_with_the_wording(spark):
    whole = render(parse(licenses.stock()["mit-text"][0]), random.Random(1))
    rows = [(1, "nothing here"), (2, "all rights reserved"), (3, "released under the MIT license"), (4, " ".join(whole)), (5, None), (6, "")]
    got = {x["doc_id"]: x["score"] for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[5] == got[6] == 0 and got[2] == 0.5 < got[3] < got[4] == 1


def test_whole_texts_are_read_to_their_end(spark):
    """A text whose last mandatory words are others has no -text label; nor has one with another word near its beginning."""
    wholes = {label: render(parse(t[0]), random.Random(3)) for label, t in licenses.stock().items() if label.endswith("-text")}
    rows = []
    for label, words in wholes.items():
        rows += [(label, "whole", " ".join(words)), (label, "end", " ".join([*words[:-12], "unless", "the", "buyer", "pays"])), (label, "word", " ".join([*words[:4], "never", *words[5:]]))]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(df).collect()}
    for i, (label, kind, _) in enumerate(rows):
        assert (label in found[i]) == (kind == "whole"), (label, kind)
    mit = " ".join(wholes["mit-text"]).split(" whether in an action")[0]
    (row,) = licenses.scan(spark.createDataFrame([(1, mit + " unless the buyer pays a fee of ten dollars each month")], "doc_id long, text string")).collect()
    assert "mit-text" not in row["labels"]
