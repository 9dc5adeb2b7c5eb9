"""Operator 2: number of tokens per document.

Texts are encoded in Arrow functions that return lengths only. A batch holds about
the same number of bytes whatever the number of texts, and a text longer than a
batch is cut before spaces that no token crosses, so that no single call grows
with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm import chunks
from txnrisk.llm.tables import text_rows

PIECE_CHARS = 1 << 20


def lengths(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text, in batches of about ``chunks.SLICE_BYTES``."""
    table = chunks.library(path)
    out = np.zeros(len(texts), np.int64)
    for begin, part in chunks.slices(texts):
        if len(part) == 1 and pc.binary_length(part)[0].as_py() > 2 * PIECE_CHARS:
            for piece in chunks.safe_pieces(part[0].as_py(), PIECE_CHARS):
                out[begin] += len(table.texts(pa.array([piece]))[0])
        else:
            out[begin : begin + len(part)] = table.texts(part)[1]
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row.

    One row per input row, repeated ids included. A null text counts as empty:
    zero bytes, zero tokens. Other columns of ``docs`` are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = lengths(batch.column("text"), path)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": n,
            })

    rows = text_rows(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
