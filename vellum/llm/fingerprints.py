"""Document fingerprints by a threshold-scaled sketch.

Every window of WINDOW UTF-8 bytes is hashed; the sketch keeps all hashes below 1 / SCALE of the range, and the LEAST
least ones in any case. As the rule is the same for all texts, a merged sketch is what the rule keeps of the union. Two
sketches are compared over the part of the range that both have whole; shared hashes over those of the one with fewer
there estimate its containment in the other, however unequal the two are. A text shorter than a window is its own only
shingle. A fingerprint is the ascending hashes, each 6 bytes, in base 64.

Edge cases: a null or empty text, and no other, has an empty fingerprint; two empty ones are alike (1), an empty and
another are not (0); where the part of the range holds no hash of one of two texts, as of a short text beside a very
long one, their likeness is unknown (null); rows of one doc_id follow each other by their text's hash; null doc_ids come first; one row alone is followed by
itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WINDOW, SCALE, LEAST = 16, 32, 32
THRESHOLD = np.uint64((1 << 48) // SCALE)
RANGE_BYTES = 24 << 20
#: Ranges at most: borders are literals of one plan. A range is sorted with spill and read as a stream, so it may be any size.
RANGES = 1 << 16
FIRST = -(1 << 63)
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The sketch (ascending 48-bit hashes) of each text."""
    out: list[np.ndarray] = []
    for _, buf, offs in K.pieces(pa.table({"text": pa.array(texts, pa.large_string())})):
        sizes = np.diff(offs)
        n = np.maximum(sizes - WINDOW + 1, 0)
        s = K.rolling(buf)
        if len(buf) >= WINDOW:
            every = K.mix((s[WINDOW:] - s[:-WINDOW]) * K.powers(K.BASE_INV, len(s))[: len(s) - WINDOW]) >> np.uint64(16)
            at = np.flatnonzero(every < THRESHOLD)
            doc = np.searchsorted(offs, at, "right") - 1
            ok = at - offs[doc] < n[doc]
            h, borders = K.distinct(every[at[ok]], doc[ok], len(sizes))
        else:
            h, borders = np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64)
        whole = K.spans_hash(s, offs[:-1], offs[1:]) >> np.uint64(16)
        for i in range(len(sizes)):
            own = whole[i : i + 1] if 0 < sizes[i] < WINDOW else h[borders[i] : borders[i + 1]]
            if n[i] and len(own) < LEAST:
                own = np.unique(every[offs[i] : offs[i] + n[i]])[:LEAST]
            out.append(own)
    return out


def text_of(sketch: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()).decode()


def reach(sketch: np.ndarray) -> int:
    """The end of the part of the range of which the sketch has all the text's hashes."""
    return 1 << 48 if len(sketch) < LEAST else max(int(THRESHOLD), int(sketch[LEAST - 1]) + 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float | None:
    """Containment of the smaller sketch in the larger one where both are whole; null if one has nothing there."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    end = np.uint64(min(reach(a), reach(b)))
    a, b = a[: np.searchsorted(a, end)], b[: np.searchsorted(b, end)]
    if not len(a) or not len(b):
        return None
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) / min(len(a), len(b))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    return both[: max(LEAST, int(np.searchsorted(both, THRESHOLD)))]


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _deal(cuts: np.ndarray):
    """(doc_id, text) -> (bucket, late, key, tie, doc_id, text): ranges of ids; the first row of a range also ends the one before."""

    def run(batches):
        for batch in batches:
            key = batch.column("doc_id").fill_null(FIRST).to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(cuts, key, "right") - 1
            n = batch.num_rows
            tie = batch.column("tie").to_numpy()
            ends = np.flatnonzero(cuts[bucket] == key)
            ends = ends[np.lexsort((tie[ends], bucket[ends]))]
            ends = ends[np.unique(bucket[ends], return_index=True)[1]]  # the first in order alone can follow the range before
            row = np.concatenate([np.arange(n), ends])
            late = np.concatenate([np.zeros(n, np.int32), np.ones(len(ends), np.int32)])
            to = np.concatenate([bucket, (bucket[ends] - 1) % len(cuts)])
            took = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(late), pa.array(key[row]), took.column("tie"), took.column("doc_id"), took.column("text")], names=["bucket", "late", "key", "tie", "doc_id", "text"])

    return run


def _rows(batches):
    """Sorted rows of whole buckets -> results."""

    def results(rows: list[tuple]):
        """All but the last of the rows, each with the next; rows: (bucket, late, doc_id, text)."""
        sk = sketches([r[3] for r in rows])
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        if not own:
            return None
        changed = [edited(rows[i][3], rows[i + 1][3]) for i in own]
        sk2 = sketches(changed)
        out = [[] for _ in NAMES]
        for i, text, s in zip(own, changed, sk2):
            vals = (rows[i][2], len(rows[i][3]), hashlib.sha256(text.encode()).hexdigest(), text_of(sk[i]), text_of(s), likeness(sk[i], s), likeness(sk[i], sk[i + 1]))
            for o, v in zip(out, vals):
                o.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names=NAMES)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "late", "doc_id")]
        texts = K.strings(batch.column("text"))
        for i, (bucket, late, doc) in enumerate(zip(*cols)):
            held.append((bucket, late, doc, texts[i].as_py()))
            size += len(held[-1][3])
            if size > 1_000_000 and len(held) > 1:
                done = results(held)
                held, size = held[-1:], 0
                if done is not None:
                    yield done
    if held:
        done = results([*held, (None, 1, None, "")])
        if done is not None:
            yield done


def fingerprint(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and the likeness to that and to the next document's."""
    texts = docs.select("doc_id", "text")
    key = F.coalesce("doc_id", F.lit(FIRST))
    total, least = texts.agg(F.sum(F.octet_length("text")), F.min(key)).first()
    n = min(RANGES, max(1, -(-int(total or 0) // RANGE_BYTES)))
    shares = [i / n for i in range(1, n)]
    inner = texts.agg(F.percentile_approx(key, shares, 20 * n)).first()[0] if n > 1 else []
    cuts = np.unique(np.array([least if least is not None else 0, *(inner or [])], np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def deal(batches):
        return _deal(shared.value)(batches)

    dealt = texts.withColumn("tie", F.xxhash64("text")).mapInArrow(deal, "bucket long, late int, key long, tie long, doc_id long, text string")
    parted = dealt.repartition(max(1, len(cuts)), "bucket").sortWithinPartitions("bucket", "late", "key", "tie")
    return parted.select("bucket", "late", "doc_id", "text").mapInArrow(_rows, SCHEMA)
