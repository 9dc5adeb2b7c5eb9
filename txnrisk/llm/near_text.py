"""Near copies of texts by the exact Jaccard similarity of their sets of word shingles.

Texts with equal sets are one node. Operator 7 gives the candidates: every text has its
SimHash of the same shingles, and a component of its links is a key of the nodes in it.
Its keys are proven for 4 differing bits, while two sets of similarity 0.8 differ in
about 10 of 64, so every distinct set gets ``BANDS`` keys more, each from
``ROWS`` minima of its hashed shingles; two sets of similarity s share one of these with
probability 1 - (1 - s^ROWS)^BANDS, which is 0.99993 at 0.8. Nodes that share a key are
compared by their whole sets, so no link is below the least similarity. Keys with the
same nodes are compared once. A key's group gives a spanning forest of its links, never
all pairs; a group beyond ``GROUP`` nodes or ``GROUP_SHINGLES`` is cut into tiles, and
every pair of tiles is compared by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions.scale import salted_join
from txnrisk.llm import chunks, simhash
from txnrisk.llm.components import components
from txnrisk.session import checkpoint

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
GROUP = 2048
GROUP_SHINGLES = 4 << 20
_FLUSH = 1 << 16
#: Odd multipliers of the minima, and of the keys made from them.
_FACTORS = np.random.default_rng(7).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; words as in ``simhash.simhashes``.

    A text of fewer than ``width`` words is one shingle, one without words has none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    ends = ends[-n:]
    digest = xxhash.xxh64_intdigest
    out = np.zeros(n, np.uint64)
    for at in range(0, n, _FLUSH):
        spans = zip(starts[at : min(n, at + _FLUSH)].tolist(), ends[at : at + _FLUSH].tolist())
        part = [digest(joined[a:b], 42) for a, b in spans]
        out[at : at + len(part)] = part
    return np.unique(out)


def band_keys(own: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes, one per band."""
    low = (own >> np.uint64(32)).astype(np.uint32)
    minima = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        minima = np.minimum(minima, (low[at : at + 512, None] * _FACTORS).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in minima.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def forest(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that connect what sets of similarity ``least`` or more connect."""
    size = np.array([len(s) for s in sets], np.int64)
    vocabulary, at_word = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    begin = np.cumsum(size) - size
    seen = np.zeros(len(vocabulary), bool)
    left = np.arange(len(sets))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            hub = queue.pop()
            fit = left[np.minimum(size[left], size[hub]) >= least * np.maximum(size[left], size[hub]) - 1e-9]
            if not len(fit):
                continue
            own = at_word[begin[hub] : begin[hub] + size[hub]]
            seen[own] = True
            both = np.array([np.count_nonzero(seen[at_word[begin[k] : begin[k] + size[k]]]) for k in fit])
            seen[own] = False
            # both / (size + size - both) >= least, free of division
            found = fit[both * (1 + least) >= least * (size[fit] + size[hub]) - 1e-9]
            if len(found):
                a.append(np.full(len(found), hub))
                b.append(found)
                queue.extend(found.tolist())
                left = np.setdiff1d(left, found, assume_unique=True)
    return np.concatenate(a), np.concatenate(b)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, node (hash of the set), n (its size), keys and fp (SimHash) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in chunks.slices(batch.column("text")):
                rows = batch.slice(begin, len(part))
                texts = part.to_pylist()
                sets = [shingles(t) for t in texts]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("digest"), pa.array(node), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([band_keys(s).tolist() if len(s) else [] for s in sets], pa.list_(pa.int64())),
                     pa.array(simhash.simhashes(texts, WIDTH).view(np.int64))],
                    ["doc_id", "digest", "node", "n", "keys", "fp"])

    return docs.mapInArrow(run, "doc_id long, digest long, node long, n long, keys array<long>, fp long")


def _alike(rows: DataFrame) -> DataFrame:
    """key and node of the nodes of every SimHash component (operator 7); ``rows`` has node and fp."""
    marked = checkpoint(rows.select("node", "fp").distinct())
    # ids of operator 7 are below 1 << 62; nodes that share an id are compared like others of one key
    found = simhash.groups(marked.select(F.shiftright("node", 2).alias("doc_id"), "fp"))
    joined = salted_join(marked, found, ["fp"], "node", "_n")
    return joined.select(F.xxhash64(F.lit("simhash"), "component_id").alias("key"), "node").distinct()


def _sets(rows: DataFrame) -> DataFrame:
    """node and its shingle hashes as bytes, of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in chunks.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(begin, len(part)),
                     pa.array([shingles(t).tobytes() for t in part.to_pylist()], pa.binary())], ["node", "own"])

    return rows.select("node", "text").mapInArrow(run, "node long, own binary")


def _links(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b) of ``members`` (key, node, n); ``texts`` has node and text."""
    # keys with the same nodes are one group: equal number and sums of two hashes of the nodes
    shares = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    groups = shares.where("size > 1").groupBy("size", "x", "y").agg(
        F.min("key").alias("key"), F.max("total").alias("total"))
    tiles = F.ceil(F.greatest(
        F.when(F.col("size") > GROUP, 2 * F.col("size") / GROUP).otherwise(1),
        F.when(F.col("total") > GROUP_SHINGLES, 2 * F.col("total") / GROUP_SHINGLES).otherwise(1))).cast("long")
    own = checkpoint(members.join(groups.select("key", tiles.alias("tiles")), "key"))
    tile = F.pmod(F.xxhash64("node"), "tiles")
    pairs = own.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select("key", "node", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"))
    wanted = texts.join(own.select("node").distinct(), "node", "left_semi")
    rows = pairs.join(_sets(wanted), "node")

    def compare(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        a, b = forest([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("own")], least)
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    return rows.groupBy("key", "t", "u").applyInArrow(compare, "a long, b long")


def survivors(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of every group of near copies: the one of the smallest (doc_id, digest of the text).

    Groups are connected by pairs of texts whose sets of five-word shingles have a
    Jaccard similarity of ``least`` or more; operator 7 and keys of minima bring the pairs
    together. Texts without words are one group. A row with a null doc_id takes part and
    comes after all others. Of rows with equal doc_id and text one stays.
    """
    marked = docs.withColumn("digest", F.xxhash64("text"))
    plain = marked.select("doc_id", "digest", F.coalesce("text", F.lit("")).alias("text"))
    rows = checkpoint(_sketches(plain))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    nodes = checkpoint(rows.groupBy("node").agg(
        F.min(order).alias("first"), F.max("n").alias("n"), F.first("keys").alias("keys")))
    minima = nodes.select(F.explode("keys").alias("key"), "node", "n")
    alike = _alike(rows).join(nodes.where("n > 0").select("node", "n"), "node")
    members = checkpoint(minima.unionByName(alike))
    reps = nodes.select(F.col("first.doc_id").alias("doc_id"), F.col("first.digest").alias("digest"), "node")
    match = [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc_id", "digest")]
    crowded = members.join(
        members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"), "key", "left_semi")
    asked = checkpoint(reps.join(crowded.select("node").distinct(), "node", "left_semi"))
    texts = plain.alias("d").join(asked.alias("r"), match).select("r.node", "d.text").dropDuplicates(["node"])
    found = components(_links(members, texts, least))
    first = nodes.select("node", "first").join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = checkpoint(first.agg(F.min("first").alias("first")).select("first.doc_id", "first.digest"))
    stays = marked.alias("d").join(kept.alias("r"), match, "left_semi")
    return stays.dropDuplicates(["doc_id", "digest"]).select(*docs.columns)
