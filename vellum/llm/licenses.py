"""Licence scans by template-markup matching.

A template is wording with markup: <<opt>> ... <<end>> may be missing, <<one>> ... <<or>> ... <<end>> is one of its
branches (an optional region may have branches too), <<any 2-5>> stands for 2 to 5 replaceable words, <<number 1-2>> for
words of digits, <<year 1-1>> for a word of four digits; regions nest. Short notices are in TEMPLATES, notices and texts
of several sentences in license_templates.txt, which the driver reads. Templates are compiled into one token automaton
(an epsilon-free set of states, made deterministic as it runs); a text has a template's label where the automaton,
started at a word, reads the mandatory wording exactly, in order and without gaps. A template is read from every place
of its first word, so texts in texts are found. Words are lower-cased (A-Z) runs of ASCII letters, digits and characters outside ASCII. Base phrases are
plain word sequences, counted at all their places.

Edge cases: a null or empty text has no words, empty labels, null places and score 0; repeated rows give a row each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label -> templates of short notices.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache <<opt>>software<<end>> license <<opt>>version<<end>> 2 0", "you may not use this <<any 0-2>> except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted <<opt>>subject to the limitations in the disclaimer below<<end>> provided that the following conditions are met"],
    "cc-by-nc": ["licensed under <<opt>>a<<end>> <<opt>>the<<end>> <<opt>>creative commons<<end>> cc by nc <<opt>>sa<<end>> <<opt>>nd<<end>> <<any 0-2>>", "creative commons attribution noncommercial <<any 0-2>> license"],
    "cc-by-4.0": ["licensed under <<opt>>a<<end>> <<opt>>the<<end>> <<opt>>creative commons<<end>> cc by 4 0", "creative commons attribution 4 0 international <<opt>>public<<end>> license"],
    "copyright": ["copyright <<opt>>c<<end>> <<any 0-6>> all rights reserved"],
    "gpl-notice": ["this <<any 0-2>> is <<opt>>free software<<end>> <<opt>>licensed<<end>> <<opt>>distributed<<end>> under the <<opt>>terms of the<<end>> gnu <<opt>>lesser<<end>> <<opt>>affero<<end>> general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version <<any 0-1>>"],
    "isc": ["permission to use copy modify and <<opt>>or<<end>> distribute this software <<opt>>and its documentation<<end>> for any purpose with or without fee is hereby granted"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this <<any 0-1>> and associated documentation files <<opt>>the software<<end>> to deal in the <<any 0-1>> without restriction"],
    "public-domain": ["this <<any 0-1>> is <<opt>>hereby<<end>> <<opt>>free and unencumbered software<<end>> <<opt>>released<<end>> <<opt>>dedicated<<end>> <<opt>>placed<<end>> <<opt>>to<<end>> <<opt>>in<<end>> <<opt>>into<<end>> the public domain"],
}
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
#: A template's tokens: markup, or a word as texts have them.
TOKEN = re.compile(r"<<[^>]*>>|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Transitions that a worker remembers at most.
MEMO = 1 << 18
#: Words of wording at which the score reaches 1.
SURE = 32


def stock(path: str = str(Path(__file__).with_name("license_templates.txt"))) -> dict[str, list[str]]:
    """TEMPLATES and the file's: label -> templates."""
    out = {k: list(v) for k, v in TEMPLATES.items()}
    for part in re.split(r"(?m)^== ", Path(path).read_text(encoding="utf-8"))[1:]:
        label, wording = part.split("\n", 1)
        out.setdefault(label.strip(), []).append(wording)
    return out


def kinds(word: bytes) -> tuple[str, ...]:
    """The kinds of replaceable words that a word can stand for."""
    if not word.isdigit():
        return ("any",)
    return ("any", "number", "year") if len(word) == 4 else ("any", "number")


class Automaton:
    """All templates as one automaton over words."""

    def __init__(self, templates: dict[str, list[str]]):
        self.edges: list[dict[bytes, set[int]]] = []  # word -> states
        self.skips: list[set[int]] = []  # free moves
        self.kinds: list[dict[str, set[int]]] = []  # moves on any word of a kind
        self.labels: dict[int, str] = {}
        starts = set()
        for label, texts in templates.items():
            for text in texts:
                first = self._state()
                starts.add(first)
                self.labels[self._compile(TOKEN.findall(text.lower()), first)] = label
        self.start = self._closed(starts)
        self.memo: dict[tuple, tuple] = {}
        self.first_words = sorted({w for s in self.start for w in self.edges[s]})
        if any(self.kinds[s] for s in self.start) or any(s in self.labels for s in self.start):
            raise ValueError("a template must begin with a mandatory word")

    def _state(self) -> int:
        self.edges.append({})
        self.skips.append(set())
        self.kinds.append({})
        return len(self.edges) - 1

    def _compile(self, tokens: list[str], at: int) -> int:
        opened: list[tuple[int, set[int]]] = []  # where a region begins, where its branches end
        for t in tokens:
            if t in ("<<opt>>", "<<one>>"):
                opened.append((at, {at} if t == "<<opt>>" else set()))
            elif t in ("<<or>>", "<<end>>"):
                if not opened:
                    raise ValueError(f"{t} outside of a region")
                begin, ends = opened[-1]
                ends.add(at)
                at = begin
                if t == "<<end>>":
                    opened.pop()
                    at = self._state()
                    for e in ends:
                        self.skips[e].add(at)
            elif t.startswith("<<"):
                found = re.fullmatch(r"<<(any|number|year) (\d+)-(\d+)>>", t)
                if not found:
                    raise ValueError(f"unknown markup {t}")
                kind, low, high = found.groups()
                end = self._state()
                for k in range(int(high) + 1):
                    if k >= int(low):
                        self.skips[at].add(end)
                    if k < int(high):
                        new = self._state()
                        self.kinds[at].setdefault(kind, set()).add(new)
                        at = new
                at = end
            else:
                new = self._state()
                self.edges[at].setdefault(t.encode(), set()).add(new)
                at = new
        if opened:
            raise ValueError("a region without <<end>>")
        return at

    def _closed(self, states: set[int]) -> tuple:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return tuple(sorted(seen))

    def step(self, states: tuple, word: bytes) -> tuple[tuple, frozenset]:
        """(states after the word, labels of the accepting ones)."""
        known, like = any(word in self.edges[s] for s in states), kinds(word)
        key = (states, like, word if known else None)
        if key not in self.memo:
            if len(self.memo) >= MEMO:  # a worker that lives long starts again
                self.memo.clear()
            new = set()
            for s in states:
                for kind in like:
                    new |= self.kinds[s].get(kind, set())
                new |= self.edges[s].get(word, set()) if known else set()
            after = self._closed(new)
            self.memo[key] = after, frozenset(self.labels[s] for s in after if s in self.labels)
        return self.memo[key]


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Per document: words, places of base phrases, base labels, all labels, and a score. `templates`: the stock, unless given.

    Score: 0 without wording, 0.5 with base phrases only; with templates it rises from 0.5 with the words of the longest
    matching wording, to 1 at SURE words.
    """
    templates = stock() if templates is None else templates
    Automaton(templates)  # fails early

    def hash_of(word: bytes) -> int:
        buf = np.frombuffer(word, np.uint8)
        return int(K.spans_hash(K.rolling(buf, lower=True), np.array([0]), np.array([len(word)]))[0])

    def run(batches):
        machine = Automaton(templates)
        split = {tuple(p.encode().split()): v for p, v in phrases.items()}
        wanted = np.unique(np.array([hash_of(w) for w in {*machine.first_words, *(p[0] for p in split)}], np.uint64))
        maybe = np.zeros(1 << 16, bool)
        maybe[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
        heads: dict[bytes, list] = {}
        for p, v in split.items():
            heads.setdefault(p[0], []).append((p, v))
        starters = set(machine.first_words)
        for batch in batches:
            for rows, buf, offs in K.pieces(batch):
                a, b, first = K.words(buf, offs, K.ALNUM_WORD)
                h = K.spans_hash(K.rolling(buf, lower=True), a, b)
                at = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
                at = at[np.isin(h[at], wanted)]
                doc = np.searchsorted(first, at, "right") - 1
                n = len(rows)
                places: dict[int, list[int]] = {}
                base: dict[int, set] = {}
                more: dict[int, set] = {}
                longest: dict[int, int] = {}
                raw, begin, end, border = buf.tobytes(), a.tolist() if len(at) else [], b.tolist() if len(at) else [], first.tolist()
                for i, d in zip(at.tolist(), doc.tolist()):
                    stop = border[d + 1]
                    word = raw[begin[i] : end[i]].lower()
                    for phrase, label in heads.get(word, ()):
                        if i + len(phrase) <= stop and all(raw[begin[i + k] : end[i + k]].lower() == w for k, w in enumerate(phrase)):
                            places.setdefault(d, []).append(i - border[d])
                            base.setdefault(d, set()).add(label)
                    if word in starters:
                        states, j = machine.start, i
                        while states and j < stop:
                            states, hit = machine.step(states, raw[begin[j] : end[j]].lower())
                            if hit:
                                more.setdefault(d, set()).update(hit)
                                longest[d] = max(longest.get(d, 0), j - i + 1)
                            j += 1
                out = [rows.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(np.diff(first)), *[[] for _ in NAMES[2:]]]
                for d in range(n):
                    p, x, y = places.get(d, []), base.get(d, set()), more.get(d, set())
                    vals = (len(p), min(p) if p else None, max(p) if p else None, ",".join(sorted(x)), ",".join(sorted(x | y)), 0.5 + min(longest[d], SURE) / (2 * SURE) if y else 0.5 if x else 0.0)
                    for o, v in zip(out[2:], vals):
                        o.append(v)
                types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([*out[:2], *[pa.array(o, t) for o, t in zip(out[2:], types)]], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
