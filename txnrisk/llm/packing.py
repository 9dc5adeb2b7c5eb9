"""Operator 3: best-fit packing of documents into sequences.

Only the lengths decide where a piece goes, and there are at most ``capacity``
different lengths. The plan is therefore made on their counts: pieces above a third
of the capacity are matched in pairs, the largest first and each with the largest
partner that fits, which leaves the fewest sequences; shorter pieces then go,
longest first, into the tightest gap that takes them. A step places all pieces of
one length into all sequences of one kind, so the plan is a short list of steps
however many documents there are. Each piece finds its place by its length and its
number among the pieces of that length.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.llm import chunks
from txnrisk.llm.tables import text_rows
from txnrisk.session import checkpoint

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Numbers of pieces of one length are given out within groups of about so many rows.
GROUP_ROWS = 1_000_000
MIN_GROUPS = 64


def cut(n: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of ``n`` ids: all full but the first."""
    first = n % capacity or min(n, capacity)
    starts = np.concatenate([[0], np.arange(first, n, capacity)])
    return starts, np.diff(starts, append=n)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut only if above ``capacity``.

    A null text is an empty one and gives a single piece that holds the end id.
    Rows with the same doc_id are documents of their own.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks.byte_level(path)
        for batch in batches:
            for begin, part in chunks.slices(batch.column("text")):
                yield _cut_batch(batch.column("doc_id").slice(begin, len(part)), *table.texts(part))

    def _cut_batch(doc_ids, ids, counts) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [])  # row of the document, then the columns of its piece
        ids, end = memoryview(ids.astype("<u4")).cast("B"), np.array([end_id], "<u4").tobytes()
        at = 0
        for doc, n in enumerate(counts.tolist()):
            own = ids[4 * at : 4 * (at + n)]
            at += n
            for k, (s, size) in enumerate(zip(*(x.tolist() for x in cut(n + 1, capacity)))):
                last = s + size == n + 1
                crc = zlib.crc32(own[4 * s : 4 * (s + size - last)])
                for column, v in zip(out, (doc, k, s, size, zlib.crc32(end, crc) if last else crc)):
                    column.append(v)
        columns = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays(
            [doc_ids.take(columns[0]), *columns[1:]],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return text_rows(docs).mapInArrow(encode, PIECES)


class _Bins:
    """Sequences of equal content, by the gap they leave."""

    def __init__(self):
        self.gaps: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in self.runs:
            insort(self.gaps, gap)
            self.runs[gap] = []
        heapq.heappush(self.runs[gap], (first, n))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.gaps, length)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        first, n = heapq.heappop(self.runs[gap])
        if not self.runs[gap]:
            del self.runs[gap], self.gaps[at]
        return gap, first, n


def plan(counts: dict[int, int], capacity: int = 2048) -> np.ndarray:
    """Steps (length, rank, n, sequence, each, offset) for ``counts`` pieces per length.

    Pieces ``rank .. rank+n-1`` of ``length`` go to the sequences from ``sequence``
    on, ``each`` per sequence, the first at ``offset`` and the next behind it.
    """
    steps: list[tuple[int, ...]] = []
    left = {k: v for k, v in counts.items() if v}
    used = dict.fromkeys(left, 0)
    bins, total = _Bins(), 0

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        steps.append((length, used[length], n, first, each, offset))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect_left(large, capacity - a + 1) - 1
            while at >= 0 and left[large[at]] < (2 if large[at] == a else 1):
                at -= 1
            n = left[a]
            if at < 0:
                place(a, n, total, 1, 0)
                bins.add(capacity - a, total, n)
            else:
                b = large[at]
                n = n // 2 if a == b else min(n, left[b])
                place(a, n, total, 1, 0)
                place(b, n, total, 1, a)
                bins.add(capacity - a - b, total, n)
            total += n
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while n := left[a]:
            gap, first, size = bins.tightest(a) or (capacity, total, -(-n // (capacity // a)))
            total = max(total, first + size)
            each, offset = gap // a, capacity - gap
            full = min(size, n // each)
            if full:
                place(a, full * each, first, each, offset)
                bins.add(gap - each * a, first, full)
            if full < size:
                rest = min(left[a], each)
                if rest:
                    place(a, rest, first + full, rest, offset)
                bins.add(gap - rest * a, first + full, 1)
                bins.add(gap, first + full + 1, size - full - 1)
    return np.array(steps, np.int64).reshape(-1, 6)


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """``items`` with sequence_id and offset; lengths lie in 1 .. ``capacity``.

    ``items`` needs doc_id, piece and length; all columns are kept. The numbers of
    pieces within a length are given out per group of ids and shifted by the groups
    before; there are as many groups as keep a length that all pieces share below
    ``GROUP_ROWS`` in a group. Ties of all ordering columns are interchangeable:
    such pieces have the same length. An empty table stays empty.
    """
    items = checkpoint(items)
    groups = math.ceil(items.count() / GROUP_ROWS) + MIN_GROUPS
    items = items.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sizes = items.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    # at most one row per length
    totals = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = plan(totals, capacity)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]

    within = Window.partitionBy("length", "_group").orderBy("doc_id", "piece")
    ranked = items.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
    ranked = ranked.join(shifts, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.select(*items.drop("_group").columns, "_rank")
    schema = items.drop("_group").schema.add("sequence_id", "long").add("offset", "long")
    keys = steps[:, 0] << 44 | steps[:, 1]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            step = steps[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            bin_at, in_bin = np.divmod(rank - step[:, 1], step[:, 4])
            own = batch.drop_columns(["_rank"])
            own = own.append_column("sequence_id", pa.array(step[:, 3] + bin_at))
            yield own.append_column("offset", pa.array(step[:, 5] + in_bin * length))

    return ranked.mapInArrow(locate, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """The pieces of all documents with their places."""
    return pack(pieces(docs, path, capacity), capacity)
