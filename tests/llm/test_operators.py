"""Each operator against a brute-force version, with nulls, empty and long texts, repeated rows and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from vellum.llm import fingerprints, jaccard, licenses, packing, quality, queries, rans, scratch, suffixes, token_counts, word_shuffle

SPACE = r"[^\x20\x09-\x0D]+"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Columns whose names the operators use inside.
EXTRA = ", node long, part long, n_tokens string, row string, text_length int"
SCHEMA = "doc_id long, text string, lang string, source string" + EXTRA
WORDS = "the of and to in is that for it with as was on are be this by an which or from at one had but not".split()


def texts() -> list[tuple]:
    r = random.Random(11)
    say = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", ",", ".", "\n", "é"]) for _ in range(n))
    long = say(9000)
    some = [None, "", " ", "\n\n", "a", "Word", "x  y\t z\r\n", "café   　 end", "I'll  say 's <|endoftext|> and 12 345", "中文 \U0001d49c İ", long, long[:-9] + "changed!", say(300)]
    base = [say(r.randint(5, 160)) for _ in range(12)]
    some += base + [b + " tail words here" for b in base[:6]] + [base[0]] * 4 + [base[7] + base[8], "CC BY-NC 4.0. All rights reserved. all Rights  reserved", "Released under the MIT License. General Public License cc by"]
    rows = [(i, t) for i, t in enumerate(some)]
    rows += [rows[20], rows[20], (None, say(40)), (None, None)]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), 1, 2, "3", "4", 5) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def settled(docs):
    return scratch.settle(docs, "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, expected: list[tuple], *columns: str) -> None:
    got = collections.Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
    want = collections.Counter(expected)
    assert got == want, [*(got - want).items()][:3] + [*(want - got).items()][:3]


def test_suffixes(docs, empty, rows):
    length = 60
    count = collections.Counter()
    for row in rows:
        b = (row[1] or "").encode()
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    want = []
    for row in rows:
        b = (row[1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        want.append((row[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = suffixes.remove_repeats(docs, length, 16, keep_text=True, with_row=True, part_bytes=30_000)
    same(got, want, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got.where("row.lang = 'de'").count() == sum(r[2] == "de" for r in rows)
    assert suffixes.remove_repeats(empty, length, 16).count() == 0


def test_suffix_query_counts_in_bytes(spark, tmp_path):
    """op1 at its own 400 bytes: n_bytes is the whole text, a repeated string goes from 400 bytes on whatever its words; counted in words, the shorter passage goes too."""
    r = random.Random(23)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(3, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    exact = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    short, long, under, at, twice = say(55), say(90), exact(399), exact(400), exact(450)
    assert len(short.encode()) < 400 < len(long.encode())
    around = lambda x: f"{say(40)} {x} {say(40)}"
    texts = [around(x) for x in (short, short, long, long)] + [f"{say(5)}<{under}>{say(5)}", f"{say(5)}({under}){say(5)}", f"{say(5)}<{at}>{say(5)}", f"{say(5)}({at}){say(5)}"]
    texts += [f"{twice}|{say(30)}|{twice}", "ab" * 300, say(200), "", None]
    count = collections.Counter(b[p : p + 400] for b in ((t or "").encode() for t in texts) for p in range(len(b) - 399))
    want = []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert [bool(w[2]) for w in want] == [False, False, True, True, False, False, True, True, True, True, False, False, False]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same(queries.op1_suffix_dedup(spark, str(tmp_path)), want, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    by_word = {row.doc_id for row in suffixes.remove_repeats(docs, words=51).where("n_removed > 0").collect()}
    assert by_word >= {0, 1, 2, 3} and not by_word & {10, 11, 12}


def test_suffix_query_counts_passages(spark, tmp_path):
    """op1 also tells of repeated passages of over 50 words that are shorter than 400 bytes, and removes nothing for it."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(3, 6)))
    say = lambda n: [word() for _ in range(n)]
    fifty, least, more, other = say(50), say(51), say(60), say(52)
    assert all(len(" ".join(x).encode()) < 400 for x in (fifty, least, more, other))
    around = lambda *x: say(30) + [w for p in x for w in p] + say(30)
    spoken = [around(fifty), around(fifty), around(least), around(more), around(more[:51]), around(least, other), around(other, say(5), other), say(200), say(51), ["ab"] * 70, []]
    texts = [" ".join(w) for w in spoken] + ["\n ".join(around(least)) + "\r\n", None]
    pieces = [[m.span() for m in re.finditer(SPACE.encode(), (t or "").encode())] for t in texts]
    said = [[(t or "").encode()[a:b] for a, b in p] for t, p in zip(texts, pieces)]
    count = collections.Counter(tuple(w[p : p + 51]) for w in said for p in range(len(w) - 50))
    want = []
    for i, (t, p, w) in enumerate(zip(texts, pieces, said)):
        hit = {x for q in range(len(w) - 50) if count[tuple(w[q : q + 51])] > 1 for x in range(q, q + 51)}
        runs = [x for x in hit if x - 1 not in hit]
        want.append((i, len((t or "").encode()), 0, sum(p[x][1] - p[x][0] for x in hit) + sum(p[x + 1][0] - p[x][1] for x in hit if x + 1 in hit), len(runs)))
    assert [w[4] for w in want] == [0, 0, 1, 1, 1, 1, 2, 0, 0, 1, 0, 1, 0] and want[3][3] < want[11][3] + 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same(queries.op1_suffix_dedup(spark, str(tmp_path)), want, "doc_id", "n_bytes", "n_removed", "n_passage_bytes", "n_passages")


def test_kmers_rows():
    """A task sends one row for each scale and bucket, however many parts its documents belong to."""
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(900)) for _ in range(60)]
    scales = [suffixes.Scale(400, 64, False, 2), suffixes.Scale(306, 64, True, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array([texts[i // 2] for i in range(60)])], names=["part", "text"])
    sent = pa.Table.from_batches(list(suffixes._kmers(scales)([batch])))
    assert sorted(zip(sent["scale"].to_pylist(), sent["bucket"].to_pylist())) == [(0, 0), (0, 1), (1, 0)]
    parts = set()
    for i in range(len(sent)):
        t = sent.slice(i, 1)
        got = suffixes._repeated((t["scale"][0], t["bucket"][0]), t)
        assert len(got) == len(set(got["part"].to_pylist()))
        parts |= set(got["part"].to_pylist())
    assert parts == set(range(60))


@pytest.mark.parametrize("scan", [1, 64])
def test_large_mixed_groups(scan):
    """Groups whose members match to the left and to the right with different others; few neighbours looked at leave the rest undecided, never wrong."""
    r = random.Random(5)
    length, k = 24, 6
    core = b"abcdef"
    side = [bytes(r.choice(b"xy") for _ in range(14)) for _ in range(6)]
    entries = sorted({(core + r.choice(side)[: r.randint(4, 12)] + bytes([r.randrange(97, 99)]) * 8, r.choice(side)[: r.randint(0, 10)] + bytes([r.randrange(97, 99)]) * 5) for _ in range(80)})
    group, before = [], b""
    for i, (right, left) in enumerate(entries):
        group.append((right, left, 0, i, 1, suffixes.common(before, right)))
        before = right
    hits, undecided = suffixes.decide(group, length, scan)
    for i, g in enumerate(group):
        true = set()
        for j, o in enumerate(group):
            if i != j:
                a = range(max(length - suffixes.common(g[0], o[0]), length - len(g[0]), 0), min(suffixes.common(g[1], o[1]), len(g[1])) + 1)
                true.update(a)
        found = {a for lo, hi in hits[i] for a in range(lo, hi + 1)}
        open_ = {a for lo, hi in undecided[i] for a in range(lo, hi + 1)}
        assert found <= true <= found | open_
        if scan == 64 and len(group) <= 65:
            assert not open_


def test_loser_tree_order():
    r = random.Random(2)
    runs, everything = [], []
    for part in range(5):
        own = sorted({(bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))), b"l%d" % r.randrange(3)) for _ in range(40)})
        runs.append(suffixes.Run(suffixes.front_coded([(a, b, i, 1) for i, (a, b) in enumerate(own)]), part))
        everything += own
    out = list(suffixes.merge(runs))
    assert [(o[0], o[1]) for o in out] == sorted(everything)
    assert all(o[5] == suffixes.common(p[0], o[0]) for p, o in zip(out, out[1:]))


def sets(rows):
    out = []
    for row in rows:
        w = re.findall(SPACE, (row[1] or "").translate(LOW))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    return out


def brute_components(rows):
    """Row number -> rows of its component, by brute force; each row is a document."""
    s, up = sets(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= 75 * (len(s[i]) + len(s[j]) - both):
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return s, {i: g for g in groups.values() for i in g}


def test_jaccard(docs, empty, rows):
    s, group = brute_components(rows)
    want = []
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in group[i] if rows[j][0] is not None]
        want.append((row[0], len(s[i]), (min(ids) if ids else None) if s[i] else row[0]))
    same(jaccard.near_components(docs), want, "doc_id", "n_shingles", "component_id")
    assert jaccard.near_components(empty).count() == 0


def test_jaccard_keeps_one(docs, rows):
    s, group = brute_components(rows)
    got = jaccard.keep_one(docs)
    assert got.columns == docs.columns
    kept = collections.Counter((r["doc_id"], r["text"]) for r in got.collect())
    for i, row in enumerate(rows):
        members = {(rows[j][0], rows[j][1]) for j in group[i]}
        if s[i]:
            assert sum(n for k, n in kept.items() if k in members) == 1
        else:
            assert kept[row[0], row[1]] == sum(x[:2] == row[:2] for x in rows)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 7])
def test_jaccard_clusters(spark, monkeypatch, block):
    """Near copies at all distances around the threshold, also with blocks and lumps of a few members."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LUMP_ROWS", 16 * block)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for cluster, n in enumerate((90, 20, 8)):
        base = [word() for _ in range(120 if cluster else 220)]
        for _ in range(n):
            own = list(base)
            for _ in range(r.randint(0, 12)):
                own[r.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    shared = [word() for _ in range(40)]
    rows += [(len(rows) + k, " ".join([word() for _ in range(60)] + shared + [word() for _ in range(60)])) for k in range(70)]
    s, group = brute_components(rows)
    same(jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")), [(i, len(s[i]), min(group[i])) for i in range(len(rows))], "doc_id", "n_shingles", "component_id")


def test_schemes_bear_their_bound():
    r = np.random.default_rng(1)
    for n in (3, 10, 64, 65, 120, 300, 3000):
        h = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        sig, _, _, bears, weak = jaccard.signatures(h, np.array([0, n]))
        assert not len(weak) and bears[0] > jaccard.bound(n) and len(sig) < 2.1 * n


def test_one_deletion_signatures(monkeypatch):
    """Sets with fewer differences than one bears share a signature, with one-deletion subsets in all segments too."""
    monkeypatch.setattr(jaccard, "scheme", lambda lo, hi: (0, 0) if hi <= jaccard.SMALL else (hi // 5, hi // 5))
    r = np.random.default_rng(2)
    for n in (120, 300, 3000):
        for _ in range(20):
            h = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
            a = np.sort(h[:n])
            bears = jaccard.signatures(a, np.array([0, n]))[3][0]
            d = int(bears) - 1
            b = np.sort(np.concatenate([r.permutation(a)[d // 2 :], h[n : n + d - d // 2]]))
            sig, of, _, _, _ = jaccard.signatures(np.concatenate([a, b]), np.array([0, n, n + len(b)]))
            assert set(sig[of == 0]) & set(sig[of == 1]) and bears > n // 5


def test_weak_sets_meet_all(spark):
    """What the path for sets that can't bear their bound finds: the pairs at the threshold, exactly."""
    r = random.Random(9)
    base = ["w%d" % r.randrange(10**6) for _ in range(104)]
    rows = [(0, " ".join(base))] + [(k, " ".join(base[:-k] + ["x%d" % j for j in range(k)])) for k in range(1, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = jaccard.hashed(df)
    about = texts.mapInArrow(jaccard._about, jaccard.ABOUT)
    names = {x["node"]: x["doc_id"] for x in about.collect()}
    got = {names[x["u"]] for d in jaccard._weak_links(texts, about.withColumn("weak", about["doc_id"] == 0)) for x in d.collect()}
    s = sets(rows)
    assert got == {k for k in range(1, 40) if 100 * len(s[0] & s[k]) >= 75 * len(s[0] | s[k])} != set()


def library(name, text):
    from vellum.llm.units import tokenizer

    return tokenizer(P.path(name)).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, empty, rows):
    limit = 64
    got = packing.pack(docs, P.path("byte_bpe_50k.json"), limit, 0).collect()
    want = collections.Counter()
    for row in rows:
        ids, start = [*library("byte_bpe_50k.json", row[1]), 0], 0
        to, k = len(ids) % limit or limit, 0
        while start < len(ids):
            want[row[0], k, start, to - start, crc(ids[start:to])] += 1
            start, to, k = to, to + limit, k + 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= limit
    assert len(bins) <= 1.1 * sum(k[3] * n for k, n in want.items()) / limit + 1
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_packer_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (9, 5)] == [(0, 0), (1, 0)]
    assert p.place(6) == (2, 0)  # sequence 0, with one place left, closes
    assert p.place(1) == (2, 6)
    assert p.place(5) == (1, 5)


def brute_quality(text):
    w = re.findall(SPACE, text or "")
    n = len(w)
    tri = collections.Counter(tuple(w[k : k + 3]) for k in range(n - 2))
    cov = {k + j for k in range(n - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cov)


def test_quality_statistics(docs, empty, rows):
    same(quality.judge(docs), [(r[0], *brute_quality(r[1])) for r in rows], "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality.judge(docs).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(empty).count() == 0


def test_quality_outliers(spark):
    """Junk among clean text of its own language and source is rejected, clean text stays, columns stay as they were."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(r.randint(60, 200))), "en", "s", "n") for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(100)), "en", "s", "n") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert {x["doc_id"] for x in kept.collect()} == set(range(300))


def numpy_mcd(x, floor, rng, tries=200):
    """Least log determinant, centre and covariance (floor added) of half the rows, from many random starts."""
    h, best = (len(x) + 1) // 2, None
    for _ in range(tries):
        m, c = (y := x[rng.choice(len(x), 6, replace=False)]).mean(0), np.cov(y.T, bias=True) + np.diag(floor) ** 2
        for _ in range(40):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            y = x[np.argsort(d, kind="stable")[:h]]
            m, c = y.mean(0), np.cov(y.T, bias=True) + np.diag(floor) ** 2
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, m, c
    return best


@pytest.mark.parametrize("groups_limit", [quality.GROUPS, 0])
def test_quality_mcd_equals_numpy(spark, monkeypatch, groups_limit):
    """Centre, covariance and determinant of contaminated groups against numpy's best of many starts; both joins."""
    monkeypatch.setattr(quality, "GROUPS", groups_limit)
    rng = np.random.default_rng(4)
    mix = np.array([[0.5, 0.1, 0, 0.2], [0, 0.4, 0.1, 0], [0, 0, 0.6, 0], [0, 0, 0, 0.3]])
    data = {}
    for g, (n, bad) in enumerate([(400, 120), (300, 0), (250, 50)]):
        x = rng.normal(size=(n, 4)) @ mix
        x[:bad] = rng.normal(size=(bad, 4)) * 0.2 + [3, -2, 4, 1]
        data["g%d" % g] = x
    rows = spark.createDataFrame([("en", g, *map(float, v)) for g, x in data.items() for v in x], "g0 string, g1 string, x0 double, x1 double, x2 double, x3 double")
    got = {r["g1"]: r for r in quality.least_determinants(scratch.settle(rows, "t"))[0].collect()}
    for g, x in data.items():
        det, m, c = numpy_mcd(x, np.array(quality.FLOOR), rng)
        r = got[g]
        assert r["n"] == len(x) and r["det"] < det + 0.05
        mine = np.array([[r[f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)]) + np.diag(quality.FLOOR) ** 2
        d = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        ref = c * max(1.0, np.median(d(m, c)) / quality.CHI2_MEDIAN)
        centre = np.array([r[f"m{i}"] for i in range(4)])
        assert np.abs(centre - m).max() < 0.1 and np.abs(mine / np.sqrt(np.outer(np.diag(ref), np.diag(ref))) - ref / np.sqrt(np.outer(np.diag(ref), np.diag(ref)))).max() < 0.2
        ours, theirs = d(centre, mine) <= quality.CUTOFF, d(m, ref) <= quality.CUTOFF
        assert (ours != theirs).mean() <= 0.01


def test_quality_small_groups_and_ties(spark):
    """A group of one row leans on its language; equal rows get equal verdicts; all rows null or short give no verdict."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(r.randint(60, 200))), "en", "s%d" % (i % 3)) for i in range(150)]
    junk = " ".join(word() + "###" for _ in range(100))
    rows += [(200, rows[0][1], "en", "alone"), (201, junk, "en", "odd"), (202, rows[1][1], None, None), *[(300, rows[2][1], "en", "s0")] * 20]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = collections.defaultdict(set)
    for x in quality.judge(df).collect():
        got[x["doc_id"]].add(x["kept"])
    assert got[201] == {False} and all(got[i] == {True} for i in [*range(150), 200, 202, 300])
    none = spark.createDataFrame([(1, None, None, None), (2, "few words", "en", "s")], "doc_id long, text string, lang string, source string")
    assert [(x["base_failed"], x["kept"], x["d"]) for x in quality.judge(none).collect()] == [(True, False, None)] * 2


def test_quality_is_native(docs):
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_token_counts(docs, empty, rows):
    ids = [len(library("word_bpe_49k.json", r[1])) for r in rows]
    want = [(r[0], len((r[1] or "").encode()), n, n > 100) for r, n in zip(rows, ids)]
    same(token_counts.token_counts(docs, P.path("word_bpe_49k.json"), 100), want, "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert token_counts.token_counts(empty, P.path("word_bpe_49k.json")).count() == 0


def test_licenses(docs, empty, rows):
    want = []
    for row in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (row[1] or "").translate(LOW))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        want.append((row[0], len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    got = licenses.scan(docs)
    same(got, want, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert {"cc-by,reserved", "cc-by,gpl,mit"} <= {r["labels"] for r in got.collect()}
    assert licenses.scan(empty).count() == 0


def test_template_markup():
    m = licenses.Automaton({"x": ["use <<opt>>only<<end>> the <<any 0-2>> tool"]})

    def accepts(text):
        states = m.start
        for w in text.split():
            states, hit = m.step(states, w.encode())
            if hit:
                return True
        return False

    assert all(map(accepts, ["use the tool", "use only the tool", "use the big tool", "use only the big old tool"]))
    assert not any(map(accepts, ["use the very big old tool", "use tool", "only the tool"]))
    for bad in ("<<any 0-2>> tool", "a <<any 2>>", "a <<opt>> b", "a <<end>>", "a <<or>> b", "<<opt>>a<<end>>"):
        with pytest.raises(ValueError):
            licenses.Automaton({"x": [bad]})


def test_fingerprints(docs, empty, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 20_000)
    known = [r for r in {r[:2]: r for r in rows if r[0] is not None}.values()]
    spark = docs.sparkSession
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(spark.createDataFrame(known, SCHEMA)).collect()}
    known.sort()
    assert set(got) == {r[0] for r in known}
    for row, following in zip(known, known[1:] + known[:1]):
        text, new = row[1] or "", following[1] or ""
        k = len(text) // 4
        changed = text[: len(text) - k] + new[:k]
        r = got[row[0]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        a, b, c = fingerprints.sketches([text, changed, new])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.text_of(a), fingerprints.text_of(b))
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    assert fingerprints.fingerprint(docs).count() == len(rows)
    assert fingerprints.fingerprint(empty).count() == 0


def test_sketch_estimates():
    r = random.Random(1)
    text = " ".join(r.choice(WORDS) + str(r.randrange(1000)) for _ in range(20_000))
    a, part = fingerprints.sketches([text, text[: len(text) // 5]])
    assert fingerprints.likeness(a, part) > 0.99
    one, two = fingerprints.sketches([text[:60_000], text[60_000 - fingerprints.WINDOW + 1 :]])
    assert np.array_equal(fingerprints.merge(one, two), a)
    exact = lambda t: {t[i : i + fingerprints.WINDOW] for i in range(len(t) - fingerprints.WINDOW + 1)}
    assert abs(len(a) * fingerprints.SCALE / len(exact(text)) - 1) < 0.1


def test_short_sketches():
    r = random.Random(4)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(1000)) for _ in range(n))
    short = [say(n) for n in range(3, 60) for _ in range(4)]
    got = fingerprints.sketches(short)
    windows = [{t[i : i + fingerprints.WINDOW] for i in range(len(t) - fingerprints.WINDOW + 1)} for t in short]
    for s, w in zip(got, windows):
        assert min(len(w), fingerprints.LEAST) <= len(s) <= len(w)
    assert all(fingerprints.likeness(x, y) == 0 for x, y in zip(got[:8], got[8:16]))
    off = [abs(fingerprints.likeness(s, e) - len(w & v) / min(len(w), len(v))) for t, s, w in zip(short, got, windows) for x in [fingerprints.edited(t, say(40))] for e, v in [(fingerprints.sketches([x])[0], {x[i : i + fingerprints.WINDOW] for i in range(len(x) - fingerprints.WINDOW + 1)})]]
    assert max(off) < 0.4 and sum(off) / len(off) < 0.1
    text = "".join(short[:100])
    for at in (100, 400, 3000):
        one, two, both = fingerprints.sketches([text[:at], text[at - fingerprints.WINDOW + 1 :], text])
        assert np.array_equal(fingerprints.merge(one, two), both)
    one, two, both = fingerprints.sketches([text[:300], text[300 - fingerprints.WINDOW + 1 : 500], text[:500]])
    assert np.array_equal(fingerprints.merge(one, two), both)
    loop, none = fingerprints.sketches(["na " * 5000, ""])
    assert len(loop) == 3 and not len(none) and fingerprints.likeness(loop, none) == 0 and fingerprints.likeness(none, none) == 1
    long = say(20_000)
    tiny = fingerprints.sketches([x for i in range(0, 3000, 20) for x in [long[i : i + 20]]])
    assert {fingerprints.likeness(x, fingerprints.sketches([long])[0]) for x in tiny[:20]} <= {None, 1.0}


def test_rans_files(docs, empty, rows):
    spark = docs.sparkSession
    known = [r for r in {r[:2]: r for r in rows}.values() if r[0] is not None]
    out = scratch.fresh(spark, "files")
    path = P.path("word_bpe_49k.json")
    rans.write(spark.createDataFrame(known, SCHEMA), path, out, 2)
    want, start = [], 0
    for row in sorted(known):
        ids = [*library("word_bpe_49k.json", row[1]), 2]
        want.append((row[0], start, len(ids), crc(ids)))
        start += len(ids)
    same(rans.read(spark, out), want, "doc_id", "start", "n_tokens", "ids_crc32")
    assert rans.read(spark, out).count() == len(known)
    everything = [i for row in sorted(known) for i in [*library("word_bpe_49k.json", row[1]), 2]]
    for first, last in ((0, 5), (17, len(everything) - 3), (len(everything) - 1, len(everything) + 10)):
        runs = sorted((r["start"], r["ids"]) for r in rans.read_ids(spark, out, first, last).collect())
        assert runs[0][0] == first and np.frombuffer(b"".join(x for _, x in runs), "<u4").tolist() == everything[first:last]
    own = """import sys; from vellum.session import session; from vellum.llm import rans
s = session("local[2]", spark__ui__enabled="false"); print("ROWS", sorted(map(tuple, rans.read(s, sys.argv[1]).collect())))"""
    said = subprocess.run([sys.executable, "-c", own, out], capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_LOCAL_DIRS", "_PYSPARK"))})
    assert said.stdout.rpartition("ROWS ")[2].strip() == str(sorted(want)), said.stderr[-500:]
    blocks = spark.read.schema(rans.BLOCKS).parquet(f"{out}/blocks").collect()
    book = rans.codebook(spark, out)
    for field in ("n_docs", "n_ids", "doc_ids", "null_ids", "lengths", "states", "words", "crc"):
        row = blocks[0].asDict()
        row[field] = row[field] + 1 if isinstance(row[field], int) else bytes([row[field][0] ^ 1]) + bytes(row[field][1:])
        with pytest.raises(ValueError):
            list(rans.checked(pa.RecordBatch.from_pylist([row]), book.crc))
    row = dict(zip(["version", "scale_bits", "lanes", "step_rows", "ids", "freqs", "crc"], book.row()))
    for field in ("version", "ids", "freqs", "crc"):
        bad = row | {field: row[field] + 1 if isinstance(row[field], int) else bytes(row[field][:4]) + bytes([row[field][4] ^ 1]) + bytes(row[field][5:])}
        with pytest.raises(ValueError):
            rans.Codebook.of_row(bad)
    repeated = [(7, "some text"), (7, "some text"), (7, "other text"), (None, "a"), (None, "a"), (None, None)]
    for table in (docs, spark.createDataFrame(repeated, "doc_id long, text string")):
        out = scratch.fresh(spark, "files")
        rans.write(table, path, out, 2)
        got = rans.read(spark, out, keep_ids=True).collect()
        texts = collections.Counter((r["doc_id"], tuple(library("word_bpe_49k.json", r["text"]))) for r in table.collect())
        assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()[:-1])) for r in got) == texts
        ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    out = scratch.fresh(spark, "files")
    rans.write(empty, path, out, 2)
    assert rans.read(spark, out).count() == 0


def test_rans_checkpoints_and_checksums():
    r = np.random.default_rng(3)
    ids = np.minimum(r.geometric(0.01, 20_000), 3000).astype(np.uint32)
    values, counts = np.unique(ids, return_counts=True)
    book = rans.Codebook(values, counts)
    assert int(book.freq.sum()) == 1 << rans.SCALE_BITS
    states, marks, words = rans.encode_block(ids, book, lanes=16, step=100)
    at, got = rans.decode_block(states, marks, words, len(ids), book, lanes=16, step=100)
    assert at == 0 and np.array_equal(got, ids)
    for first, last in ((1600, None), (12433, 12500), (19999, 20000), (5, 6)):
        at, part = rans.decode_block(states, marks, words, len(ids), book, first, last, lanes=16, step=100)
        assert at == first // 1600 * 1600 and np.array_equal(part, ids[at:last])
    p = counts / counts.sum()
    assert len(words) * 8 < 1.02 * -(p * np.log2(p)).sum() * len(ids) + 16 * 64


def test_word_shuffle(settled, empty, rows):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = word_shuffle.encoding(path, P.PATTERN)
    want = []
    for row in rows:
        ids = enc.encode_ordinary(row[1] or "")
        want.append((row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    same(word_shuffle.encode_decode(settled, path, P.PATTERN), want, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert word_shuffle.encode_decode(empty, path, P.PATTERN).count() == 0


def test_word_shuffle_in_small_blocks(settled, rows, monkeypatch):
    """Blocks cut by bytes, and words forgotten and encoded again, give the same rows."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    whole = sorted(map(str, word_shuffle.encode_decode(settled, path, P.PATTERN).collect()))
    for name, value in (("TEXT_BYTES", 200), ("BLOCK_BYTES", 1000), ("KNOWN_WORDS", 3)):
        monkeypatch.setattr(word_shuffle, name, value)
    assert sorted(map(str, word_shuffle.encode_decode(settled, path, P.PATTERN).collect())) == whole


def test_slots_grow_beyond_their_first_size(spark, monkeypatch):
    """One text with far more distinct words than the table has places at first, read in one slice."""
    monkeypatch.setattr(word_shuffle.Slots, "BITS", 6)
    r = np.random.default_rng(5)
    slots, seen = word_shuffle.Slots(), {}
    for _ in range(8):
        h = r.integers(0, 1500, 700).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        got, new = slots.add(h)
        for x, s in zip(h.tolist(), got.tolist()):
            assert seen.setdefault(x or 1, s) == s
        assert len(set(seen.values())) == len(seen) == slots.n and 2 * slots.n <= len(slots.key)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = word_shuffle.encoding(path, P.PATTERN)
    long = " ".join(f"w{i}x{i * 7919 % 10007}" for i in range(5000))
    got = word_shuffle.encode_decode(spark.createDataFrame([(1, long), (2, "w1x7919 short")], "doc_id long, text string").coalesce(1), path, P.PATTERN).collect()
    for row, text in zip(sorted(got, key=lambda g: g["doc_id"]), [long, "w1x7919 short"]):
        ids = enc.encode_ordinary(text)
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_word_shuffle_notices_other_rows(spark):
    """A table that gives other words, or the same in another order, when it is read again is an error."""

    def changing(batches):
        words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
        random.SystemRandom().shuffle(words)
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(words)])], names=["doc_id", "text"])

    for seed in range(3):  # equal orders in both runs have a chance of 1 in 720 each time
        df = spark.range(1).coalesce(1).mapInArrow(changing, "doc_id long, text string")
        with pytest.raises(Exception, match="other rows"):
            word_shuffle.encode_decode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()


ALPHABET = [" ", "  ", "\n", "\t", "\r\n", "a", "Bc", "'s", "'ll", "1", "23", "<|endoftext|>", "<|", " ", "é", "é", "中", "!", "...", "\x1c", " ", "İ", "Σ", "\u0085", "­", "²", "ß", "É"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_equal_the_library(name):
    import pyarrow as pa

    from vellum.llm import kernels as K
    from vellum.llm import units

    r = random.Random(6)
    some = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    ids, borders = units.encode(*K.buffer(K.strings(pa.array(some))), P.path(name))
    want = [e.ids for e in units.tokenizer(P.path(name)).encode_batch(some, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == want


def test_pretokens_equal_the_pattern():
    import regex

    from vellum.llm import kernels as K
    import pyarrow as pa

    r = random.Random(9)
    some = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(2000)]
    buf, offs = K.buffer(K.strings(pa.array(some)))
    borders = word_shuffle.pretokens(buf, offs, P.PATTERN)
    raw = buf.tobytes()
    words = [raw[a:b].decode() for a, b in zip(borders, borders[1:])]
    assert words == [w for t in some for w in regex.findall(P.PATTERN, t)]
