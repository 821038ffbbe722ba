"""Main text of web pages by the recurrent block labeller.

Edge cases: a null or empty page, or one without blocks of main text, gives an empty text of 0 characters; broken
markup is read as far as it goes; repeated rows give a row each; an empty table gives an empty result; columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labeller
from .blocks import blocks

SCHEMA = "page_id long, url string, text string, n_chars long"


@cache
def weights(path: str = str(Path(__file__).with_name("extractor.npz"))) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def texts(pages: list[str], w: dict[str, np.ndarray]) -> list[str]:
    """The main text of each page."""
    found = [blocks(p or "") for p in pages]
    return ["\n".join([b.text for b, keep in zip(bs, own) if keep]) for bs, own in zip(found, labeller.label(w, found))]


def extract(pages: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page. The model (some 40,000 numbers) goes along with the tasks."""
    shared = pages.sparkSession.sparkContext.broadcast(model or weights())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = texts(part.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
