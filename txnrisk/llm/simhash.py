"""Operator 7: SimHash near-duplicates, found by Golay-code keys.

Fingerprints of equal value are one node. Every distinct fingerprint gets the keys
of ``golay.keys``; fingerprints that share a key are compared, and a key's group
gives a spanning forest of its links, never all pairs. A group above ``GROUP`` is
not held in one task: it is cut into tiles by a hash of the fingerprint, and every
pair of tiles is compared by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions.scale import salted_join
from txnrisk.llm import chunks, golay
from txnrisk.llm.components import components
from txnrisk.llm.tables import text_rows
from txnrisk.session import checkpoint

MAX_BITS = 4
#: Distinct fingerprints of one key that a task compares at once.
GROUP = 4096
_FLUSH = 1 << 16
#: Ids are below this number.
NO_ID = 1 << 62


def simhashes(texts: list[str], width: int) -> np.ndarray:
    """64-bit fingerprints: a bit is set if more than half of the shingle hashes have it."""
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    held: list[int] = []
    rows: list[int] = []
    sizes: list[int] = []
    digest = xxhash.xxh64_intdigest

    def flush() -> None:
        if not held:
            return
        bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.cumsum(sizes) - sizes
        sums = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        np.add.at(ones, rows, sums)
        np.add.at(total, rows, sizes)
        for x in (held, rows, sizes):
            x.clear()

    for row, text in enumerate(texts):
        # bytes: lower() changes A-Z only, split() cuts at exactly 20 and 09-0D
        words = text.encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = max(1, len(words) - width + 1)
        ends = ends[-n:]
        for at in range(0, n, _FLUSH):
            spans = zip(starts[at : min(n, at + _FLUSH)].tolist(), ends[at : at + _FLUSH].tolist())
            before = len(held)
            held.extend([digest(joined[a:b], 42) for a, b in spans])
            rows.append(row)
            sizes.append(len(held) - before)
            if len(held) >= _FLUSH:
                flush()
    flush()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a null text has fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in chunks.slices(batch.column("text")):
                fp = simhashes(part.to_pylist(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, len(part)), pa.array(fp)], ["doc_id", "fp"])

    return text_rows(docs).mapInArrow(run, "doc_id long, fp long")


def forest(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that connect what values within ``max_bits`` connect."""
    left = np.arange(len(values))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= max_bits
            if near.any():
                found = left[near]
                a.append(np.full(len(found), at))
                b.append(found)
                queue.extend(found.tolist())
                left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def run_links(fp: np.ndarray, node: np.ndarray, first: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all runs; ``first`` marks where a run of rows with one key begins."""
    starts = np.flatnonzero(first)
    size = np.diff(starts, append=len(fp))
    a, b = [], []
    # short runs: neighbours at distance 1, 2, ... of all runs together
    short = np.repeat(size <= 8, size)
    run = np.cumsum(first)[short]
    f, n = fp[short], node[short]
    for lag in range(1, 8):
        if len(f) <= lag:
            break
        hit = (run[lag:] == run[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= max_bits)
        a.append(n[:-lag][hit])
        b.append(n[lag:][hit])
    for s, k in zip(starts[size > 8].tolist(), size[size > 8].tolist()):
        x, y = forest(fp[s : s + k], max_bits)
        a.append(node[s + x])
        b.append(node[s + y])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _compare(rows: DataFrame, by: list[str], max_bits: int, limit: int) -> DataFrame:
    """Links within rows of equal ``by``: columns a, b; rows of larger groups come back with a key.

    The rows of a task arrive sorted, so at most one group of ``limit`` rows is
    carried from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns of the group that may go on
        large = False

        def out(a, b, key=None, fp=None) -> pa.RecordBatch:
            n = len(a)
            columns = [pa.array(a), pa.array(b)]
            columns += [pa.array(x) if x is not None else pa.nulls(n, pa.int64()) for x in (key, fp)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "fp"])

        def finish(columns) -> Iterator[pa.RecordBatch]:
            """Links of whole groups; whole groups above the limit are passed on."""
            *keys, fp, node = columns
            first = np.ones(len(fp), bool)
            first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            starts = np.flatnonzero(first)
            size = np.repeat(np.diff(starts, append=len(fp)), np.diff(starts, append=len(fp)))
            over = size > limit
            if over.any():
                yield out(node[over], node[over], keys[0][over], fp[over])
                first, fp, node = first[~over], fp[~over], node[~over]
            a, b = run_links(fp.view(np.uint64), node, first, max_bits)
            if len(a):
                yield out(a, b)

        for batch in batches:
            new = [batch.column(c).to_numpy() for c in (*by, "fp", "node")]
            if not len(new[0]):
                continue
            columns = [np.concatenate(x) for x in zip(held, new)] if held else new
            last = np.logical_and.reduce([k == k[-1] for k in columns[: len(by)]])
            tail = len(last) - (int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0)
            cut = len(last) - tail
            if cut:
                if large:  # the group carried so far has been passed on; pass on its end as well
                    key = np.logical_and.reduce([k == k[0] for k in columns[: len(by)]])
                    end = int(np.flatnonzero(~key)[0])
                    yield out(columns[-1][:end], columns[-1][:end], columns[0][:end], columns[-2][:end])
                    columns, cut, large = [x[end:] for x in columns], cut - end, False
                if cut:
                    yield from finish([x[:cut] for x in columns])
            held = [x[cut:] for x in columns]
            if large or tail > limit:
                large = True
                yield out(held[-1][:-1], held[-1][:-1], held[0][:-1], held[-2][:-1])
                held = [x[-1:] for x in held]
        if held and large:
            yield out(held[-1], held[-1], held[0], held[-2])
        elif held:
            yield from finish(held)

    sorted_rows = rows.repartition(*by).sortWithinPartitions(*by)
    return sorted_rows.mapInArrow(run, "a long, b long, key long, fp long")


def links(nodes: DataFrame, max_bits: int = MAX_BITS, limit: int | None = None) -> DataFrame:
    """Links (a, b) that connect all nodes whose fingerprints connect within ``max_bits``.

    ``nodes`` has node and fp, one row per distinct fp. ``max_bits`` is at most 4.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the keys are proven for up to 4 differing bits")
    limit = limit or GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 8192):
                part = batch.slice(at, 8192)
                fp = part.column("fp").to_numpy()
                key, row = golay.keys(fp.view(np.uint64))
                node = part.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, fp[row], node[row])], ["key", "fp", "node"])

    keyed = nodes.select("fp", "node").mapInArrow(run, "key long, fp long, node long")
    found = checkpoint(_compare(keyed, ["key"], max_bits, limit))
    near = found.where("key is null").select("a", "b")
    large = found.where("key is not null").select("key", "fp", F.col("a").alias("node"))
    if large.isEmpty():
        return near
    tiles = F.ceil(2 * F.col("n") / F.lit(limit)).cast("long")
    sizes = large.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", "n", tiles.alias("tiles"))
    # one row per key above the limit and so fewer than (rows of large / limit)
    own = large.join(F.broadcast(sizes), "key").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select("key", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "fp", "node")
    # a tile pair that by chance exceeds four times its mean size would come back: hold it whole
    return near.unionByName(_compare(pairs, ["key", "t", "u"], max_bits, 1 << 40).select("a", "b"))


def groups(marked: DataFrame) -> DataFrame:
    """fp, component_id (as in ``near_duplicates``) and _n (rows) of every distinct fingerprint.

    ``marked`` is a checkpoint of rows (doc_id, fp).
    """
    distinct = checkpoint(
        marked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("_n"))
    )
    # a group without any id gets a number above all ids, taken from its fingerprint
    stand_in = F.coalesce("node", F.lit(NO_ID) + F.shiftrightunsigned("fp", 2))
    numbered = distinct.withColumn("_node", stand_in)
    found = components(links(numbered.select("fp", F.col("_node").alias("node"))))
    root = F.coalesce("root", "_node")
    return numbered.join(found.withColumnRenamed("node", "_node"), "_node", "left").select(
        "fp", F.when(root < NO_ID, root).alias("component_id"), "_n"
    )


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    ``component_id`` is the smallest doc_id reachable over links, the document's own
    included. Texts without words (null, empty) have fingerprint zero and link like
    any other. Rows with a null doc_id take part; a component of such rows alone has
    a null id. Repeated rows come back as often. An empty table gives an empty result.
    """
    marked = checkpoint(fingerprints(docs, width))
    joined = salted_join(marked, groups(marked), ["fp"], "doc_id", "_n")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
