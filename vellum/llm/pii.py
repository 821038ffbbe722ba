"""Personal data: fixed base rules, and spans that boosted trees choose among overlapping candidates.

Generators of high recall propose spans of each kind: addresses with and without the usual signs, dotted and colon
forms, and windows of digit groups, so that one stretch of text has many candidates. Each gets format features (length,
digits, groups, check digits, letters around it) and context features (cue words before and after). Boosted trees give
it a log odds, which a logistic curve fitted on held-out candidates turns into a probability; a kind's threshold is the
least probability with the precision asked for there. Of candidates that overlap, the most probable one is taken. Base
spans stay whatever the trees say; a chosen span that overlaps one is not added. `python -m
vellum.llm.train_pii` makes the model from generated lines.

Base rules read leftmost matches that do not overlap, kind by kind; those that fail their check are dropped, without
another try. Every text is read whole; work is linear in its length.

Edge cases: a null or empty text has no spans; repeated rows give a row each; a null doc_id stays null; an empty table
gives an empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

KINDS = ["email", "ip", "card", "phone"]
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
#: Characters of context on each side; digit groups of a window; candidates that are scored at once.
CONTEXT, GROUPS, AT_ONCE = 32, 8, 50_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SIGN = re.compile(r"[ ]?[\[({<]?[ ]?(?:@|\b(?:at|AT)\b)[ ]?[\])}>]?[ ]?")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:[ ]?[\[({<]?[ ]?(?:\.|\b(?:dot|DOT)\b)[ ]?[\])}>]?[ ]?[A-Za-z0-9-]{1,63}){0,4}")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_DOTS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[ ]?(?:\.|\[\.\]|\(\.\))[ ]?[0-9]{1,3}){3}(?![0-9])")
_GROUP = re.compile(r"[+(]{0,2}[0-9]+\)?")
_BETWEEN = re.compile(r"[ .\-/ ‐-–]{0,3}")

CUES = {
    "email": "mail email e-mail contact write courriel correo kontakt send address",
    "ip": "ip ipv4 ipv6 host addr server client gateway dns adresse login",
    "card": "card visa mastercard amex credit debit carte tarjeta karte kreditkarte cc pan payment",
    "phone": "phone tel telephone call fax mobile cell telefon téléphone teléfono ring sms whatsapp number",
    "none": "version v release order invoice isbn ref reference id no nr serial tracking part section page price total build commit chapter art article score lot sku fig figure eq room",
}
_CUE = {w: k for k, kind in enumerate(CUES) for w in CUES[kind].split()}
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
FEATURES = [
    "kind", "length", "digits", "groups", "first", "last", "least", "most", "plus", "parens", "spaces", "dots", "dashes", "slashes", "luhn", "octets",
    "letters", "labels", "tail", "at", "distinct", "before", "after", "near", "cue", "other", "against", "later", "zero", "colons", "year", "known", "behind",
]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the base rules, by kind and start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((0, a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in [p.lstrip("0") for p in m.group().split(".")]):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() < 40 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all proposals, with many overlaps; their number is linear in the length of the text."""
    found = set()
    for m in _SIGN.finditer(text):
        a = m.start()
        while a > 0 and m.start() - a < 64 and text[a - 1] in _LOCAL:
            a -= 1
        host = _HOST.match(text, m.end()) if a < m.start() else None
        if host and ("@" in m.group() or not host.group().replace("-", "").isalnum()):
            found.add((0, a, host.end()))
    found |= {(1, *m.span()) for m in _DOTS.finditer(text)}
    if ":" in text:
        found |= {(1, *m.span()) for m in _COLONS.finditer(text)}
    groups = [m.span() for m in _GROUP.finditer(text)]
    for i, (a, _) in enumerate(groups):
        n, end = 0, None
        for j in range(i, min(i + GROUPS, len(groups))):
            x, y = groups[j]
            if end is not None and not (x - end <= 3 and _BETWEEN.fullmatch(text, end, x)):
                break
            end, n = y, n + sum(c.isdigit() for c in text[x : min(y, x + 24)])
            if n > 19:
                break
            if n >= 13:
                found.add((2, a, end))
            if 7 <= n <= 15 and (j > i or text[a] in "+(0"):
                found.add((3, a, end))
    return sorted(found)


def _sort(c: str) -> int:
    """Kind of a neighbouring character: none or space, letter, digit, opening or end mark, symbol."""
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in ",;:!?()[]<>\"'|" else 4 if c == "." else 5


def features(text: str, kind: int, a: int, b: int) -> list[float]:
    span = text[a:b]
    digits = _digits(span)
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    cue = other = against = 0
    for k, w in enumerate(reversed(_WORDS.findall(before.casefold())[-4:])):
        c = _CUE.get(w)
        if c is not None:
            weight = 4 - k
            cue, other, against = max(cue, weight * (c == kind)), max(other, weight * (c < 4 and c != kind)), max(against, weight * (c == 4))
    later = any(_CUE.get(w) == kind for w in _WORDS.findall(after.casefold())[:2])
    labels = re.split(r"[^A-Za-z0-9_%+-]+", span)
    tail = labels[-1] if labels else ""
    octets = max((int(g[:6]) for g in re.findall("[0-9]+", span)), default=0)
    return [
        kind, b - a, len(digits), len(groups), groups[0], groups[-1], min(groups), max(groups), span.startswith("+"), span.count("("), span.count(" "), span.count("."), span.count("-"), span.count("/"),
        luhn(digits) if len(digits) >= 13 else 0, min(octets, 1000), sum(c.isalpha() for c in span), len(labels), len(tail) if tail.isalpha() else 0, span.count("@"), len(set(digits)),
        _sort(text[a - 1 : a]), _sort(text[b : b + 1]), _sort(after.lstrip()[:1]), cue, other, against, later, span.startswith("0"), span.count(":"), 1900 <= octets <= 2100 if max(groups) == 4 else 0, digits[:1] in "3456" if digits else 0, _sort(before.rstrip()[-1:]),
    ]


class Trees:
    """Boosted regression trees of one depth, as arrays: (tree, inner node) -> feature and border, (tree, leaf) -> log odds."""

    def __init__(self, model: dict):
        self.feature = np.array(model["feature"], np.int64)
        self.border = np.array(model["border"], np.float64)
        self.leaf = np.array(model["leaf"], np.float64)
        self.start, self.slope, self.shift = model["start"], np.array(model["slope"]), np.array(model["shift"])
        self.threshold = np.array(model["threshold"])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds before calibration."""
        out, depth = np.full(len(x), self.start), (self.feature.shape[1] + 1).bit_length() - 1
        rows = np.arange(len(x))
        for f, b, leaf in zip(self.feature, self.border, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            out += leaf[at - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        kind = x[:, 0].astype(np.int64)
        return 1 / (1 + np.exp(-(self.slope[kind] * self.raw(x) + self.shift[kind])))


@cache
def model(path: str = str(Path(__file__).with_name("pii_trees.json"))) -> dict:
    with open(path) as f:
        return json.load(f)


def choose(spans: list[tuple[int, int, int]], p: np.ndarray, threshold: np.ndarray) -> list[tuple[int, int, int]]:
    """Of the candidates above their kind's threshold the most probable ones that do not overlap; equal ones by length, then place."""
    order = sorted((-p[i], s[1] - s[2], s[1], s[0], i) for i, s in enumerate(spans) if p[i] >= threshold[s[0]])
    starts: list[int] = []
    taken: dict[int, tuple[int, int, int]] = {}
    for *_, i in order:
        _, a, b = spans[i]
        k = bisect_left(starts, b)
        if k and taken[starts[k - 1]][2] > a:
            continue
        starts.insert(k, a)
        taken[a] = spans[i]
    return sorted(taken.values())


def _added(base: list[tuple[int, int, int]], chosen: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Chosen spans that overlap no base span."""
    ends = sorted((a, b) for _, a, b in base)
    furthest, reach = [], 0
    for _, b in ends:
        reach = max(reach, b)
        furthest.append(reach)
    out = []
    for kind, a, b in chosen:
        k = bisect_left(ends, (b, 0))
        if not k or furthest[k - 1] <= a:
            out.append((kind, a, b))
    return out


def find(texts: list[str], trees: Trees) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    out: list = [None] * len(texts)
    rows, held, size = [], [], 0

    def flush() -> None:
        nonlocal size
        p = trees.probability(np.array(rows, np.float64)) if rows else np.zeros(0)
        at = 0
        for i, base, spans in held:
            out[i] = base, _added(base, choose(spans, p[at : at + len(spans)], trees.threshold))
            at += len(spans)
        rows.clear()
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        base, spans = base_spans(text), candidates(text)
        rows += [features(text, *s) for s in spans]
        held.append((i, base, spans))
        size += len(spans)
        if size > AT_ONCE:
            flush()
    flush()
    return out


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)])


def _suspects(batch: pa.RecordBatch) -> tuple[list[int], list[str]]:
    """Rows with a digit, @, a spelled dot or two colons; no other row has a span or a candidate."""
    col = batch.column("text")
    hit = pc.fill_null(pc.match_substring_regex(col.cast(pa.large_string()), r"[0-9@]|\b(dot|DOT)\b|::"), False)
    return np.flatnonzero(hit.to_numpy(zero_copy_only=False)).tolist(), col.filter(hit).to_pylist()


def spans(docs: DataFrame, given: dict | None = None) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256, spans (all of them) and n_added of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(given or model())

    def run(batches):
        trees = Trees(shared.value)
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts, digest, told, added = np.zeros((4, n), np.int64), [nothing] * n, [""] * n, np.zeros(n, np.int64)
            where, texts = _suspects(batch)
            for i, (base, more) in zip(where, find(texts, trees)):
                for kind, _, _ in base:
                    counts[kind, i] += 1
                digest[i], told[i], added[i] = hashlib.sha256(_told(base).encode()).hexdigest(), _told([*base, *more]), len(more)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(told, pa.string()), pa.array(added)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, given: dict | None = None, mark: str = "[{}]") -> DataFrame:
    """doc_id, text with a mark in the place of each span (overlapping ones as one, named after the first kind), n_spans."""
    shared = docs.sparkSession.sparkContext.broadcast(given or model())

    def run(batches):
        trees = Trees(shared.value)
        for batch in batches:
            out, n = batch.column("text").to_pylist(), np.zeros(batch.num_rows, np.int64)
            where, texts = _suspects(batch)
            for i, text, (base, more) in zip(where, texts, find(texts, trees)):
                parts, done, open_ = [], 0, 0
                for kind, a, b in sorted([*base, *more], key=lambda s: (s[1], -s[2], s[0])):
                    if a >= open_:
                        parts += [text[done:a], mark.format(KINDS[kind].upper())]
                    done = open_ = max(open_, b)
                    n[i] += 1
                out[i] = "".join([*parts, text[done:]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.string()), pa.array(n)], names=["doc_id", "text", "n_spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, n_spans long")
