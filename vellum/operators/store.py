"""A stored index: notes, chunks, links and full-text postings in numbered segments that commit together.

Each table lies under its name as `seg=<version>` folders. A version writes its rows, the paths that it replaces or
removes (tombstones), and last its manifest; readers take the versions that have one, so a run that fails leaves nothing
that anybody sees, and a later run writes over its folders. A row counts while no later version names its path. The
manifest carries the number of live chunks and of their words, so that a search reads no other statistics.

A chunk has a number in its version, and only that number stands in postings. `dead` holds one bit for each chunk that a
later version replaced or removed, 64 numbers a row, so chunks and postings meet narrow rows to know what lives.

Postings are grouped into blocks of one term: at most BLOCK chunks of like term frequency, with the largest frequency
and the least length. The tasks that read chunks make the blocks, HELD postings at a time, so no posting is a row in a
shuffle. A version also writes by how much it changes the number of live chunks of each term.
Terms are dealt into BUCKETS folders by their CRC-32, and a search lists and reads only the folders of its own terms.
Tombstones and dead bits are read whole; `compact` puts an end to old ones.

A version made from batch `number` names it; the same batch again is known by its number and changes nothing.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as X

from . import chunks as C
from . import links as L
from .graph import written
from .search import B, K1, LEAST_IDF, WEIGHTS

BUCKETS, BLOCK, HELD = 64, 1024, 1 << 21
TABLES = {
    "notes": "path string, title string, content_hash string",
    "chunks": "id long, path string, ord int, title string, heading string, body string, chunk_hash string, len long",
    "links": "path string, kind string, target string, pos int, candidates array<string>",
    "postings": "t string, ids array<long>, tfs array<double>, most_tf double, shortest long",
    "frequencies": "t string, delta long",
    "tombstones": "path string",
    "dead": "of int, word long, bits long",
}
#: Columns of a chunk that a search reads.
COLUMNS = ("title", "heading", "body")
BY_TERM = ("postings", "frequencies")
#: A chunk's place in `dead`: its row, its bit there, and whether that is set in `bits`.
WORD, BIT, IS_SET = "shiftright(id, 6)", "shiftleft(1L, CAST(id & 63 AS INT))", "getbit(bits, CAST(id & 63 AS INT)) = 1"
MANIFEST = "batch long, chunks long, words long"


def sections_and_windows(notes: DataFrame) -> DataFrame:
    return C.windows(C.sections(notes))


class Store:
    def __init__(self, spark: SparkSession, root: str, pieces: Callable[[DataFrame], DataFrame] = sections_and_windows):
        """`pieces` cuts notes into chunks (path, ord, title, heading, body)."""
        self.spark, self.root, self.pieces = spark, root.rstrip("/"), pieces
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _folders(self, *parts: str) -> list[str]:
        at = self._path(*parts)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """Committed versions, ascending. A manifest is one file that its writer moves into place when it is whole."""
        return sorted(int(x.split("=")[1]) for x in self._folders("manifest") if x.startswith("v="))

    def manifests(self) -> DataFrame:
        paths = [f"{self.root}/manifest/v={v}" for v in self.versions()]
        if not paths:
            return self.spark.createDataFrame([], MANIFEST + ", v int")
        return self.spark.read.schema(MANIFEST).option("basePath", f"{self.root}/manifest").json(paths)

    def _committed(self) -> tuple[int, dict]:
        """(last version, its manifest); version 0 is the empty index."""
        v = max(self.versions(), default=0)
        if not v:
            return 0, {"batch": -1, "chunks": 0, "words": 0}
        return v, self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/v={v}").first().asDict()

    def _segments(self, table: str, last: int, inside: list[str] | None = None, first: int = 0) -> DataFrame:
        """All rows of committed segments with their number, dead ones as well; `inside` names folders under the segments."""
        base = max((int(s[4:]) for s in self._folders("bases") if s.startswith("seg=") and int(s[4:]) <= last), default=0)
        found = [f"{self.root}/{table}/{s}" for s in self._folders(table) if s.startswith("seg=") and max(base, first) <= int(s[4:]) <= last]
        if inside is not None:
            found = [f"{s}/{f}" for s in found for f in inside if self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{s}/{f}"))]
        schema = TABLES[table] + ", seg int" + (", bucket int" if table in BY_TERM else "")
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*found)

    def _living(self, rows: DataFrame, last: int) -> DataFrame:
        """Rows (path, seg) that no later version replaces or removes."""
        dead = self._segments("tombstones", last).groupBy("path").agg(F.max("seg").alias("since"))
        return rows.join(dead, "path", "left").where("since IS NULL OR seg >= since").drop("since")

    def _living_chunks(self, rows: DataFrame, last: int) -> DataFrame:
        """Rows (seg, id) of chunks that no later version replaces or removes."""
        dead = self._segments("dead", last).groupBy(F.col("of").alias("seg"), "word").agg(F.bit_or("bits").alias("bits"))
        return rows.withColumn("word", F.expr(WORD)).join(dead, ["seg", "word"], "left").where(f"bits IS NULL OR NOT {IS_SET}").drop("word", "bits")

    def table(self, name: str) -> DataFrame:
        """The live rows of notes, chunks or links."""
        last, _ = self._committed()
        rows = self._segments(name, last)
        return self._living_chunks(rows, last).drop("seg", "id") if name == "chunks" else self._living(rows, last).drop("seg")

    def apply(self, number: int, fresh: DataFrame, gone: DataFrame, apart: bool = False) -> bool:
        """One version: notes (path, title, tags, body) that are new or changed, and paths that are gone.

        A path in both is not gone; a caller who knows that there is none says so by `apart`, and `fresh` is read once. Notes whose text is as stored are left alone. False where the batch number is not above the last one's.
        """
        last, old = self._committed()
        if number <= old["batch"]:
            return False
        v = last + 1
        changed = fresh.withColumn("content_hash", X.content_hash(F.coalesce("body", F.lit(""))))
        if last:
            stored = self.table("notes").select("path", F.col("content_hash").alias("old_hash"))
            changed = changed.join(stored, "path", "left").where("old_hash IS NULL OR old_hash <> content_hash").drop("old_hash")
        changed = written(changed, "changed")
        gone = gone.select("path") if apart else gone.select("path").join(fresh.select("path"), "path", "left_anti")
        touched = written(changed.select("path").unionByName(gone).distinct(), "touched")
        self._write(touched, "tombstones", v)
        self._write(changed.select("path", "title", "content_hash"), "notes", v)
        self._write_chunks(C.with_hashes(self.pieces(changed)), v)
        self._write(L.edges(changed.where("contains(body, '[[') OR contains(body, '](')").withColumn("body", L.prose(F.col("body")))), "links", v)
        live = self._living_chunks(self._segments("chunks", last).select("seg", "id", "path", "len"), last)
        lost = written(live.join(touched, "path", "left_semi").select("seg", "id", "len"), "lost")
        dead = lost.groupBy(F.col("seg").alias("of"), F.expr(WORD).alias("word")).agg(F.bit_or(F.expr(BIT)).alias("bits"))
        self._write(dead, "dead", v)
        # live totals: the last ones, without the chunks of touched paths, with the new ones
        total = [F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("w")]
        fewer, more = lost.agg(*total).first(), self._segments("chunks", v, first=v).agg(*total).first()
        change = self._counts(self._segments("postings", v, first=v))
        if fewer["n"]:
            bits = self._segments("dead", v, first=v).select(F.col("of").alias("seg"), "word", "bits")
            each = self._segments("postings", last).select("seg", "t", F.explode("ids").alias("id")).withColumn("word", F.expr(WORD))
            gone_too = each.join(bits, ["seg", "word"]).where(IS_SET).groupBy("t").agg((-F.count("*")).alias("delta"))
            change = change.unionByName(gone_too)
        self._write(change.groupBy("t").agg(F.sum("delta").alias("delta")).where("delta <> 0"), "frequencies", v)
        self._commit(v, number, old["chunks"] - fewer["n"] + more["n"], old["words"] - fewer["w"] + more["w"])
        return True

    def _write_chunks(self, pieces: DataFrame, v: int) -> None:
        """Chunks with their numbers, and their postings, made from the rows as they were written."""
        words = sum((X.count_terms(F.coalesce(F.col(c), F.lit(""))) for c in COLUMNS), F.lit(0)).cast("long")
        rows = pieces.select(F.monotonically_increasing_id().alias("id"), "path", "ord", "title", "heading", "body", "chunk_hash", words.alias("len"))
        self._write(rows, "chunks", v)
        texts = self._segments("chunks", v, first=v).select("id", "len", *[F.array_join(t, " ").alias(c) for c, t in zip(COLUMNS, _terms())])
        self._write(texts.mapInArrow(_blocks, TABLES["postings"]), "postings", v)

    @staticmethod
    def _counts(postings: DataFrame) -> DataFrame:
        return postings.groupBy("t").agg(F.sum(F.size("ids")).alias("delta"))

    def _write(self, rows: DataFrame, table: str, v: int) -> None:
        out = f"{self.root}/{table}/seg={v}"
        if table in BY_TERM:
            dealt = rows.withColumn("bucket", (F.crc32(F.col("t").cast("binary")) % BUCKETS).cast("int")).hint("rebalance", "bucket")
            dealt.sortWithinPartitions("bucket", "t").write.mode("overwrite").partitionBy("bucket").parquet(out)
        else:
            rows.write.mode("overwrite").parquet(out)

    def _commit(self, v: int, number: int, chunks: int, words: int) -> None:
        """The manifest is written aside and renamed; where another writer was first, this version fails."""
        aside, at = f"{self.root}/_manifest-{v}-{number}", self._path("manifest", f"v={v}")
        self.spark.createDataFrame([(number, chunks, words)], MANIFEST).coalesce(1).write.mode("overwrite").json(aside)
        self._fs.mkdirs(self._path("manifest"))
        if self._fs.exists(at) or not self._fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(aside), at):
            raise RuntimeError(f"version {v} was committed by another run")

    def compact(self) -> None:
        """One version with all live rows, from which on readers read; the folders before it may be removed when nobody has them open."""
        last, old = self._committed()
        v = last + 1
        for name in ("notes", "links"):
            self._write(self.table(name), name, v)
        self._write_chunks(self.table("chunks"), v)
        before = self._segments("frequencies", last).groupBy("t").agg(F.sum("delta").alias("delta")).where("delta <> 0")
        self._write(before, "frequencies", v)
        for name in ("tombstones", "dead"):
            self._write(self.spark.createDataFrame([], TABLES[name]), name, v)
        self._write(self.spark.createDataFrame([(v,)], "from long"), "bases", v)
        self._commit(v, old["batch"], old["chunks"], old["words"])

    def _of_terms(self, table: str, terms: list[str], last: int) -> DataFrame:
        folders = sorted({f"bucket={zlib.crc32(t.encode()) % BUCKETS}" for t in terms})
        return self._segments(table, last, folders).where(F.col("t").isin(terms))

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of the terms, dead rows in them too; reads only the folders of these terms."""
        return self._of_terms("postings", terms, self._committed()[0])

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """(path, ord, score): BM25 over the live chunks, all hits or the `limit` best (ties by path and ord).

        With a limit, the strongest term that enough chunks have gives a score which so many reach. A block whose bound,
        with the best of every other term, is below it proposes no chunk.
        """
        asked = X.query_terms(query)
        last, m = self._committed()
        df = {r["t"]: r["df"] for r in self._of_terms("frequencies", list(dict.fromkeys(asked)), last).groupBy("t").agg(F.sum("delta").alias("df")).collect()} if asked and m["chunks"] else {}
        found = {t: n for t, n in df.items() if n > 0}
        if not found:
            return self.spark.createDataFrame([], "path string, ord int, score double")
        weight = {t: asked.count(t) * max(math.log((m["chunks"] - n + 0.5) / (n + 0.5)), LEAST_IDF) for t, n in found.items()}
        of = lambda values: F.create_map(*[F.lit(x) for t, v in values.items() for x in (t, float(v))])[F.col("t")]
        mean = m["words"] / m["chunks"]
        part = lambda tf, n: of(weight) * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(n) / mean))
        blocks = self._of_terms("postings", list(found), last).withColumn("bound", part("most_tf", "shortest"))
        chunks = self._segments("chunks", last).select("seg", "id", "path", "ord", "len")
        open_ = lambda some: self._living_chunks(some.select("seg", "t", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf")))), last)
        weighed = lambda rows: rows.join(chunks, ["seg", "id"]).select("path", "ord", "t", part("tf", "len").alias("w"))
        sums = lambda rows: weighed(rows).groupBy("path", "ord").agg(F.sum("w").alias("score"))
        if limit is None:
            return sums(open_(blocks))
        tops = {r["t"]: r["top"] for r in blocks.groupBy("t").agg(F.max("bound").alias("top")).collect()}
        strong = max((t for t, n in found.items() if n >= limit), key=lambda t: tops[t], default=None)
        sure = 0.0
        if strong is not None:
            sure = weighed(open_(blocks.where(F.col("t") == strong))).orderBy(F.desc("w")).limit(limit).agg(F.min("w").alias("w")).first()["w"]
        others = {t: sum(tops.values()) - tops[t] for t in found}
        proposed = open_(blocks.where(F.col("bound") + of(others) >= sure - 1e-9)).select("seg", "id").distinct()
        scored = sums(open_(blocks).join(proposed, ["seg", "id"], "left_semi"))
        return scored.orderBy(F.desc(F.round("score", 9)), "path", "ord").limit(limit)


def _terms() -> list:
    return [X.terms(F.coalesce(F.col(c), F.lit(""))) for c in COLUMNS]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of chunks (id, len, the terms of each column) in blocks; a column's terms count with its weight."""
    codes, held, n = _numbering(), [], 0
    for batch in batches:
        for id_, length, *texts in zip(*(batch.column(c).to_pylist() for c in ("id", "len", *COLUMNS))):
            tf = defaultdict(float)
            for c, text in zip(COLUMNS, texts):
                for t, k in Counter(text.split(" ")).items() if text else ():
                    tf[t] += WEIGHTS[c] * k
            held.append((id_, length, np.fromiter(map(codes.__getitem__, tf), np.int64, len(tf)), np.fromiter(tf.values(), np.float64, len(tf))))
            n += len(tf)
            if n >= HELD:
                yield _grouped(codes, held)
                codes, held, n = _numbering(), [], 0
    if n:
        yield _grouped(codes, held)


def _numbering() -> defaultdict:
    """Each new key is numbered by how many came before."""
    codes = defaultdict()
    codes.default_factory = codes.__len__
    return codes


def _grouped(codes: dict[str, int], held: list[tuple]) -> pa.RecordBatch:
    """One row for at most BLOCK chunks of a term with like frequency, in the order in which they came."""
    sizes = [len(x[2]) for x in held]
    ids, lengths = np.repeat([x[0] for x in held], sizes), np.repeat([x[1] for x in held], sizes)
    code, tf = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
    kind = np.floor(np.log2(tf + 1)).astype(np.int64)
    order = np.argsort(code * 64 + kind, kind="stable")
    ids, lengths, code, tf, kind = (x[order] for x in (ids, lengths, code, tf, kind))
    new = np.append(True, (code[1:] != code[:-1]) | (kind[1:] != kind[:-1]))
    first = np.flatnonzero(new)
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    starts = np.flatnonzero(place % BLOCK == 0)
    ends = pa.array(np.append(starts, len(code)), pa.int32())
    rows = [
        pa.array(list(codes)).take(pa.array(code[starts])),
        pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())),
        pa.ListArray.from_arrays(ends, pa.array(tf, pa.float64())),
        pa.array(np.maximum.reduceat(tf, starts)),
        pa.array(np.minimum.reduceat(lengths, starts), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(rows, ["t", "ids", "tfs", "most_tf", "shortest"])
