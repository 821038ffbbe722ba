"""Merkle manifest of a table: one tree a group of rows, a tree over the groups' roots, a proof for every row.

Leaves are hashed by built-in functions and written as narrow rows, which are sorted over range partitions by group
and key. Each partition cuts its rows into indexed runs of at most RUN leaves of one group; numbers of leaves before a
run come from the runs' lengths alone. A run goes through a mountain-range stack: a leaf is pushed like a one added to
a number in base `fanout`, each carry hashes a full aligned run into its parent, and what stays in the stack are the
peaks; where a group ends its last, shorter runs are hashed as they are, without padding. Peaks and the unaligned
nodes at a run's left edge are a few a level; SPAN runs at a time merge theirs, in as many rounds as that needs, and
every node that a merge completes is a record. A run's proofs need, besides its own nodes, only the children of those
ancestors that reach beyond it, which it looks up among the records.

H is the lowercase hex SHA-256 of its concatenated inputs. Rows of a group ascend by key, null first; rows of one key
by leaf. Groups ascend by UTF-8 bytes, null first.

Edge cases: null values hash as `-`; a null key or group is a key or group of its own; repeated rows are leaves of
their own, next to one another and dealt over partitions; a group of one row has its leaf as root; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Leaves of a run at most; bytes of leaves in a range partition, about; runs whose edges one merge takes.
RUN, PART_BYTES, SPAN = 1 << 14, 64 << 20, 256
NODE = "g string, seq long, total long, level int, at long, node binary, top boolean"
PATH = "array<struct<place:int,others:array<string>>>"


def _h(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def widths(total: int, fanout: int) -> list[int]:
    """Numbers of nodes at each level, leaves first, one root last."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Range:
    """The mountain-range stack of consecutive leaves: for each level the nodes of its unfinished run."""

    def __init__(self, fanout: int):
        self.fanout = fanout
        self.runs: list[list[bytes]] = []
        self.last: list[int] = []
        self.inner: list[tuple[int, int, bytes]] = []
        self.edges: list[tuple[int, int, bytes]] = []

    def push(self, at: int, node: bytes, level: int = 0) -> None:
        """The node with number `at` of its level, the one after the last one there."""
        while True:
            if level == len(self.runs):
                self.runs.append([])
                self.last.append(at)
            run = self.runs[level]
            run.append(node)
            self.last[level] = at
            if (at + 1) % self.fanout:
                return
            if len(run) < self.fanout:  # it began before these leaves
                self._leave(level)
                return
            node, at, level = _h(run), at // self.fanout, level + 1
            run.clear()
            self.inner.append((level, at, node))

    def close(self, total: int | None) -> None:
        """No further leaves; `total` where the tree ends here, so that its last runs are hashed however short."""
        for level, width in enumerate(widths(total, self.fanout)[:-1] if total else ()):
            run = self.runs[level] if level < len(self.runs) else []
            if run and (width - len(run)) % self.fanout == 0:
                node, at = _h(run), (width - 1) // self.fanout
                run.clear()
                self.inner.append((level + 1, at, node))
                self.push(at, node, level + 1)
        for level in range(len(self.runs)):
            self._leave(level)

    def _leave(self, level: int) -> None:
        run = self.runs[level]
        first = self.last[level] - len(run) + 1
        self.edges += [(level, first + k, node) for k, node in enumerate(run)]
        run.clear()


def merge(nodes: list[tuple[int, int, bytes]], total: int, fanout: int) -> tuple[list, list]:
    """(completed nodes, nodes whose parents are still incomplete) of some runs' edges."""
    size = widths(total, fanout)
    at: list[dict[int, bytes]] = [{} for _ in size]
    for level, i, node in nodes:
        at[level][i] = node
    fresh, left = [], []
    for level, here in enumerate(at[:-1]):
        for parent in sorted({i // fanout for i in here}):
            span = range(parent * fanout, min((parent + 1) * fanout, size[level]))
            if all(i in here for i in span):
                at[level + 1][parent] = _h([here[i] for i in span])
                fresh.append((level + 1, parent, at[level + 1][parent]))
            else:
                left += [(level, i, here[i]) for i in span if i in here]
    return fresh, left


def asked(first: int, n: int, total: int, fanout: int) -> list[tuple[int, int]]:
    """Nodes (level, number) that a run of n leaves needs from elsewhere: the children of its incomplete ancestors, the root."""
    if n == total:
        return []
    size, out, reach = widths(total, fanout), [], 1
    for level, width in enumerate(size[:-1]):
        low, high = first // reach, (first + n - 1) // reach
        reach *= fanout
        for parent in sorted({low // fanout, high // fanout}):
            if parent * reach < first or min((parent + 1) * reach, total) > first + n:
                out += [(level, i) for i in range(parent * fanout, min((parent + 1) * fanout, width))]
    return [*out, (len(size) - 1, 0)]


class Proofs:
    """Siblings of a run's leaves up to the root, and from there up a path that all leaves share."""

    def __init__(self, first: int, nodes: list[bytes], total: int, fanout: int, known: list[tuple[int, int, bytes]], path: list[tuple[int, list[bytes]]]):
        self.first, self.fanout, self.size, self.path = first, fanout, widths(total, fanout), path
        tree = Range(fanout)
        for i, node in enumerate(nodes):
            tree.push(first + i, node)
        tree.close(total if first + len(nodes) == total else None)
        self.at: list[dict[int, bytes]] = [{} for _ in self.size]
        self.at[0] = {first + i: node for i, node in enumerate(nodes)}
        for level, i, node in [*tree.inner, *known]:
            self.at[level][i] = node
        self.root = self.at[-1][0]
        #: First level at which all leaves have the same ancestor.
        low, high, self.joint = first, first + len(nodes) - 1, 0
        while low != high:
            low, high, self.joint = low // fanout, high // fanout, self.joint + 1
        self.top = low
        self.upper = b"".join(b"".join(others) for _, others in self.steps(self.joint, low)) + b"".join(b"".join(others) for _, others in path)
        self.seen: dict[bytes, bytes] = {}

    def steps(self, level: int, i: int) -> Iterator[tuple[int, list[bytes]]]:
        """(place in its run, the run's other nodes) of the node and its ancestors, up to the root."""
        f = self.fanout
        while level < len(self.size) - 1:
            yield self.step(level, i)
            level, i = level + 1, i // f

    def step(self, level: int, i: int) -> tuple[int, list[bytes]]:
        begin, here = i - i % self.fanout, self.at[level]
        return i - begin, [here[k] for k in range(begin, min(begin + self.fanout, self.size[level])) if k != i]

    def above(self, node: bytes) -> bytes:
        """The top root from a node at the joint level."""
        if node not in self.seen:
            got = node
            for place, others in [*self.steps(self.joint, self.top), *self.path]:
                got = _h([*others[:place], got, *others[place:]])
            self.seen[node] = got
        return self.seen[node]

    def leaf(self, k: int, claimed: bytes) -> tuple[bytes, bytes]:
        """(hash of the siblings, top root folded from the claimed leaf) for the run's leaf k."""
        i, node, parts = self.first + k, claimed, []
        for level in range(self.joint):
            place, others = self.step(level, i)
            parts += others
            node = _h([*others[:place], node, *others[place:]])
            i //= self.fanout
        return hashlib.sha256(b"".join(parts) + self.upper).hexdigest().encode(), self.above(node)


def runs(leaves: DataFrame, name: str) -> DataFrame:
    """(part, run, g, n, labels, nodes, claims), written: leaves (g, key, label, node, claim) in order, RUN at most a row."""
    spark, leaves = leaves.sparkSession, scratch.settle(leaves, name + "-leaves")
    rows = scratch.placed(leaves)
    order = ["g", F.col("key").asc_nulls_first(), "node", scratch.PLACE]
    in_order = rows.repartitionByRange(scratch.parts(leaves, PART_BYTES), *order).sortWithinPartitions(*order)

    def cut(batches):
        part, number, g, held, kept = TaskContext.get().partitionId(), 0, None, 0, []

        def row(table: pa.Table) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.concat_arrays(table[c].chunks)) for c in ("label", "node", "claim")]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([g], pa.string()), pa.array([len(table)], pa.int64()), *lists], names=["part", "run", "g", "n", "labels", "nodes", "claims"])

        for batch in batches:
            groups, a = batch.column("g").to_pylist(), 0
            while a < len(groups):
                if held and (groups[a] != g or held == RUN):
                    yield row(pa.concat_tables(kept))
                    number, kept, held = number + 1, [], 0
                g, b = groups[a], min(len(groups), a + RUN - held)
                if groups[b - 1] != g:
                    b = next(k for k in range(a, b) if groups[k] != g)
                kept.append(pa.Table.from_batches([batch.slice(a, b - a)]))
                held, a = held + b - a, b
        if held:
            yield row(pa.concat_tables(kept))

    schema = "part long, run long, g string, n long, labels array<string>, nodes array<binary>, claims array<binary>"
    made = scratch.settle(in_order.select("g", "label", "node", "claim").mapInArrow(cut, schema), name + "-runs")
    scratch.drop(spark, leaves)
    return made


def places(cut: DataFrame) -> DataFrame:
    """(part, run, g, n, first, total, seq): of each run the leaves before it in its group, the group's leaves, its number there. Reads lengths only."""
    order = Window.partitionBy("g").orderBy("part", "run")
    before, total = F.sum("n").over(order) - F.col("n"), F.sum("n").over(Window.partitionBy("g"))
    return cut.select("part", "run", "g", "n").select("*", before.alias("first"), total.alias("total"), (F.row_number().over(order) - 1).cast("long").alias("seq"))


_NODE = pa.schema([("g", pa.string()), ("seq", pa.int64()), ("total", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("node", pa.binary()), ("top", pa.bool_())])


def _rows(g, seq, total: int, fanout: int, nodes: list[tuple[int, int, bytes]]) -> dict[str, list]:
    k, top = len(nodes), len(widths(total, fanout)) - 1
    return {"g": [g] * k, "seq": [seq] * k, "total": [total] * k, "level": [x[0] for x in nodes], "at": [x[1] for x in nodes], "node": [bytes.fromhex(x[2].decode()) for x in nodes], "top": [x[0] == top for x in nodes]}


def _hex(rows: list[dict]) -> list[tuple[int, int, bytes]]:
    return [(r["level"], r["at"], r["node"].hex().encode()) for r in rows]


def records(cut: DataFrame, where: DataFrame, fanout: int, name: str) -> DataFrame:
    """Node records (g, level, at, node, top), written: each run's edges and what each merge of edges completed."""

    def climb(batches):
        for batch in batches:
            for r in batch.to_pylist():
                tree = Range(fanout)
                for i, node in enumerate(r["nodes"]):
                    tree.push(r["first"] + i, node.hex().encode())
                tree.close(r["total"] if r["first"] + r["n"] == r["total"] else None)
                yield pa.RecordBatch.from_pydict(_rows(r["g"], r["seq"], r["total"], fanout, tree.edges), _NODE)

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        given = table.to_pylist()
        total = given[0]["total"]
        fresh, left = merge(_hex(given), total, fanout)
        flags = [True] * len(fresh) + [False] * len(left)
        return pa.table({**_rows(key[0].as_py(), key[1].as_py(), total, fanout, [*fresh, *left]), "fresh": flags}, _NODE.append(pa.field("fresh", pa.bool_())))

    given = cut.select("part", "run", "nodes").join(where, ["part", "run"]).select("g", "n", "first", "total", "seq", "nodes")
    left = scratch.settle(given.mapInArrow(climb, NODE), name + "-edges")
    found = [left]
    n_runs = (where.agg(F.max("seq")).first()[0] or 0) + 1
    while n_runs > 1:  # rounds: the logarithm of the number of runs to the base SPAN
        n_runs = -(-n_runs // SPAN)
        some = left.where("not top").withColumn("seq", F.floor(F.col("seq") / SPAN).cast("long"))
        merged = scratch.settle(some.groupBy("g", "seq").applyInArrow(join, NODE + ", fresh boolean"), name + "-merged")
        # a completed node whose parent is not complete stands in both lists
        found.append(merged.where("fresh").drop("fresh"))
        left = merged.where("not fresh").drop("fresh")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("g", "level", "at", "node", "top")


def lookups(where: DataFrame, nodes: DataFrame, fanout: int) -> DataFrame:
    """where with `known`: the nodes from elsewhere that each run's proofs need, a few a level."""

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                need = asked(r["first"], r["n"], r["total"], fanout)
                k = len(need)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * k, pa.int64()), pa.array([r["run"]] * k, pa.int64()), pa.array([r["g"]] * k, pa.string()), pa.array([x[0] for x in need], pa.int32()), pa.array([x[1] for x in need], pa.int64())], names=["part", "run", "g", "level", "at"])

    need = where.select("part", "run", "g", "n", "first", "total").mapInArrow(ask, "part long, run long, g string, level int, at long")
    got = need.join(nodes.drop("top"), ["g", "level", "at"]).groupBy("part", "run").agg(F.collect_list(F.struct("level", "at", "node")).alias("known"))
    return where.join(got, ["part", "run"], "left")


def _proofs(r: dict, fanout: int, path: list[tuple[int, list[bytes]]]) -> Proofs:
    return Proofs(r["first"], [x.hex().encode() for x in r["nodes"]], r["total"], fanout, _hex(r["known"] or []), path)


def group_paths(groups: DataFrame, fanout: int) -> DataFrame:
    """(g, subroot, root, path) of groups (g, node): the tree over all groups' roots, with each one's siblings."""
    cut = runs(groups.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("g").alias("label"), "node", F.lit(None).cast("binary").alias("claim")), "merkle-top")
    where = scratch.settle(places(cut), "merkle-top-places")
    nodes = records(cut, where, fanout, "merkle-top")

    def walk(batches):
        for batch in batches:
            for r in batch.to_pylist():
                tree = _proofs(r, fanout, [])
                path = [[{"place": p, "others": [x.decode() for x in others]} for p, others in tree.steps(0, r["first"] + k)] for k in range(r["n"])]
                kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))
                yield pa.RecordBatch.from_arrays([pa.array(r["labels"], pa.string()), pa.array([x.hex() for x in r["nodes"]]), pa.array([tree.root.decode()] * r["n"]), pa.array(path, kind)], names=["g", "subroot", "root", "path"])

    small = lookups(where, nodes, fanout)
    return cut.drop("g", "n").join(small, ["part", "run"]).mapInArrow(walk, f"g string, subroot string, root string, path {PATH}")


def proofs(leaves: DataFrame, fanout: int = 2) -> DataFrame:
    """(label, leaf, subroot, root, proof_sha256, folded_root) of leaves (g, key, label, node, claim).

    g is a string and not null; node and claim are digests of 32 bytes; a claim that is not null is folded in the
    place of its leaf, with the leaf's own siblings.
    """
    cut = runs(leaves, "merkle")
    where = scratch.settle(places(cut), "merkle-places")
    nodes = scratch.settle(records(cut, where, fanout, "merkle"), "merkle-nodes")
    paths = scratch.settle(group_paths(nodes.where("top").select("g", "node"), fanout), "merkle-paths")

    def walk(batches):
        for batch in batches:
            for r in batch.to_pylist():
                tree = _proofs(r, fanout, [(s["place"], [x.encode() for x in s["others"]]) for s in r["path"]])
                leaf = [x.hex() for x in r["nodes"]]
                got = [tree.leaf(k, (c.hex() if c is not None else leaf[k]).encode()) for k, c in enumerate(r["claims"])]
                n = r["n"]
                cols = [r["labels"], leaf, [r["subroot"]] * n, [r["root"]] * n, [g[0].decode() for g in got], [g[1].decode() for g in got]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["label", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    small = lookups(where, nodes, fanout).join(paths, "g")
    return cut.drop("g", "n").join(small, ["part", "run"]).mapInArrow(walk, "label string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(values: list[Column]) -> Column:
    """H of the values, each as `-` if null, else its UTF-8 length, a colon and itself."""
    texts = [F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")) for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(t, F.lit("-")) for t in texts]).cast("binary"), 256))


def manifest(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document; groups are languages.

    Where 7 divides the CRC-32 of the decimal doc_id, the folded root starts at a leaf whose n_chars is one more (null
    stays null), as a check that proofs notice changes.
    """
    cols = [F.col(c) for c in FIELDS]
    one_more = [F.col("n_chars").cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("g"),
        F.col("doc_id").alias("key"),
        F.col("doc_id").cast("string").alias("label"),
        digest(cols).alias("node"),
        F.when(changed, digest(one_more)).alias("claim"),
    )
    out = proofs(leaves, fanout)
    return out.select(F.col("label").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
