"""The Merkle manifest against plain recursion: odd runs, single rows, nulls, repeated rows, small runs over many partitions."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from vellum.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, node int, g int, part string, `at` int"


def h(*xs: str) -> str:
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """(root, for each node its place and its run's others, level by level)."""
    paths: list[list] = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            begin = i - i % fanout
            run = nodes[begin : begin + fanout]
            paths[k].append((i - begin, run[: i - begin] + run[i - begin + 1 :]))
        nodes = [h(*nodes[b : b + fanout]) for b in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def expected(rows: list[tuple], fanout: int) -> list[tuple]:
    order = lambda v: (v is not None, v if v is None or isinstance(v, int) else v.encode())
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=order)
    trees = {}
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (order(r[0]), leaf(*r[:5])))
        trees[lang] = own, *climb([leaf(*r[:5]) for r in own], fanout)
    root, above = climb([trees[lang][1] for lang in langs], fanout)
    out = []
    for k, lang in enumerate(langs):
        own, sub, paths = trees[lang]
        for r, path in zip(own, paths):
            path = path + above[k]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf(*r[:3], r[3] + 1, r[4]) if changed else leaf(*r[:5])
            for place, others in path:
                node = h(*others[:place], node, *others[place:])
            out.append((r[0], leaf(*r[:5]), sub, root, h(*[x for _, others in path for x in others]), node, node == root))
    return sorted(out, key=repr)


def table(n: int) -> list[tuple]:
    r = random.Random(n)
    langs = [None, "", "en", "en", "en", "zz", "é", "Z"]
    rows = [(r.choice([i, i, i, None, 5]), r.choice(["a", None, ""]), r.choice(langs), r.choice([i, None, 0, (1 << 63) - 1]), r.choice([f"text {i}", None, "", "é中\U0001d49c" * i]), "k", 1, 2, "p", 3) for i in range(n)]
    return rows + rows[:3] * 3 + [(1, "a", "only", 1, "x" * 100_000, "k", 1, 2, "p", 3)]


@pytest.mark.parametrize(("n", "fanout", "run", "span"), [(0, 2, 4, 2), (1, 2, 4, 2), (150, 2, 7, 2), (150, 3, 5, 2), (130, 2, 1 << 14, 256), (90, 5, 1, 3)])
def test_manifest(spark, monkeypatch, n, fanout, run, span):
    monkeypatch.setattr(merkle, "RUN", run)
    monkeypatch.setattr(merkle, "SPAN", span)
    rows = table(n)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), fanout).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, fanout)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_changed_rows_fail(spark):
    rows = [(i, "a", "en" if i % 3 else None, i, f"t{i}", "k", 1, 2, "p", 3) for i in range(60)]
    for row in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert row["verified"] == (zlib.crc32(str(row["doc_id"]).encode()) % 7 != 0)


@pytest.mark.parametrize("fanout", [2, 3, 4])
def test_runs_of_a_range_meet_in_merges(fanout):
    """Any cut of any number of leaves gives the root of the whole, whatever the order of merging."""
    r = random.Random(fanout)
    for total in [*range(1, 40), 257]:
        leaves = [h(str(i)) for i in range(total)]
        cuts = sorted({0, total, *r.sample(range(total), min(total, 4))})
        edges, inner = [], []
        for a, b in zip(cuts, cuts[1:]):
            tree = merkle.Range(fanout)
            for i in range(a, b):
                tree.push(i, leaves[i].encode())
            tree.close(total if b == total else None)
            edges, inner = edges + tree.edges, inner + tree.inner
            assert len(tree.edges) <= 2 * (fanout - 1) * len(merkle.widths(total, fanout))
        fresh, left = merkle.merge(edges, total, fanout)
        tops = {node for level, _, node in [*edges, *inner, *fresh] if level == len(merkle.widths(total, fanout)) - 1}
        assert tops == {climb(leaves, fanout)[0].encode()} and not left
