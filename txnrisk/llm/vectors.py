"""Operator 4: near-duplicate embeddings, by quantised products of tiles.

Equal vectors are one node. Nodes are grouped around pivots, and groups are cut into
tiles of bounded size. Two groups are compared only if the angle between their
pivots, less the angles of their farthest members, is within the threshold: by the
triangle inequality for angles no link is lost. Within a pair of tiles

* every unit vector is rounded to int8, ``v = s q + e``, and ``|e|`` is kept
* the tile product of the int8 values is exact, and ``s_x s_y q_x.q_y`` differs from
  the cosine by at most ``|s_x q_x| |e_y| + |e_x|`` (Cauchy-Schwarz)
* only pairs whose bound reaches the threshold are computed again in double precision

A pair of tiles returns numbers of links per vector and links that connect what is
connected, so a group of near copies never gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions.scale import salted_join
from txnrisk.llm.components import components
from txnrisk.session import checkpoint

#: Vectors of a group that travel together, and rows of a product in memory.
TILE, BLOCK = 8192, 1024
#: There is a pivot per TILE vectors, but at most so many.
PIVOTS = 256
#: Room for the rounding of double arithmetic in bounds and angles.
SLACK = 1e-9
#: Ids are below this number.
NO_ID = 1 << 62


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, lengths of the rounded vectors and of the rounding errors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    rounded = q * scale[:, None]
    return q, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(unit - rounded, axis=1)


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y (unit vectors) have a product of at least ``threshold``."""
    qx, sx, lx, ex = quantise(x)
    qy, sy, _, ey = quantise(y)
    # sums of at most 1,040 products of int8 are exact in single precision, others in double
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (qx.astype(kind) @ qy.astype(kind).T).astype(np.float64)
    product *= sx[:, None]
    product *= sy
    maybe = product + lx[:, None] * ey + ex[:, None] >= threshold - SLACK
    a, b = np.nonzero(maybe)
    out = np.zeros(maybe.shape, bool)
    if len(a) > maybe.size // 16:
        out[:] = maybe & (x @ y.T >= threshold)
    else:
        for at in range(0, len(a), 1 << 16):
            i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            out[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return out


def forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (row, column) of links that connect all that ``close`` connects."""
    rows, columns = close.shape
    row_left, column_left = close.any(axis=1), close.any(axis=0)
    a, b = [], []
    while row_left.any():
        queue, side = [int(np.argmax(row_left))], [0]
        row_left[queue[0]] = False
        while queue:
            at, on = queue.pop(), side.pop()
            found = np.flatnonzero(close[at] & column_left) if on == 0 else np.flatnonzero(close[:, at] & row_left)
            (column_left if on == 0 else row_left)[found] = False
            same = np.full(len(found), at)
            a.append(same if on == 0 else found)
            b.append(found if on == 0 else same)
            queue.extend(found.tolist())
            side.extend([1 - on] * len(found))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow of the squares
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, pivots: int = PIVOTS, tile: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    ``vectors`` has vec_id (long) and embedding (array of numbers); other columns are
    not read. A vector that is null, empty, zero or holds null or non-finite components
    has no link and is its own component. Vectors of different widths do not link.
    Rows with equal vectors link with each other; repeated ids are rows of their own.
    ``pivots`` are taken from the rows with the smallest hashes: they steer only which
    tiles are skipped, never the result.
    """
    tile = tile or TILE
    block = min(tile, BLOCK)
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = checkpoint(vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("v")).withColumn(
        "ok", F.coalesce(
            (F.size("v") > 0)
            & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
            & F.exists("v", lambda c: c != 0), F.lit(False))
    ).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda c: c + F.lit(0).cast(kind)))))  # -0.0 is 0.0
    nodes = checkpoint(rows.where("ok").groupBy("v").agg(
        F.coalesce(F.min("vec_id"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("v"), 2)).alias("node"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("width", F.size("v")))
    parts = [
        _links_of_width(nodes.where(F.col("width") == w["width"]), w["width"], threshold, pivots, tile, block, kind)
        for w in nodes.select("width").distinct().collect()
    ]
    found = parts[0] if parts else nodes.select(
        F.col("node").alias("a"), F.col("node").alias("b"), "n").limit(0)
    for part in parts[1:]:
        found = found.unionByName(part)
    found = checkpoint(found)
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(found.where("n = 0").select("a", "b"))
    labels = nodes.join(counts, "node", "left").join(roots, "node", "left").select(
        "v", F.col("n").alias("_n"),
        (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"),
    )
    joined = salted_join(rows, labels, ["v"], "vec_id", "_n")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).when(F.col("root") < NO_ID, F.col("root"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _links_of_width(nodes: DataFrame, width: int, threshold: float, n_pivots: int,
                    tile: int, block: int, kind: str) -> DataFrame:
    """Rows (a, b, 0) that connect, and rows (a, null, n): node a links with n rows of other nodes."""
    n_pivots = max(1, min(n_pivots, nodes.count() // tile))
    hashed = nodes.select("v", F.xxhash64("v").alias("h"))
    first = [r["v"] for r in hashed.orderBy("h").limit(n_pivots).collect()]
    pivot = _unit(np.array(first, np.float64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = _unit(_matrix(batch.column("v"), width)) @ pivot.T
            at = cosine.argmax(axis=1).astype(np.int32)
            angle = np.arccos(np.clip(cosine.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "n", "v")), pa.array(at), pa.array(angle)],
                ["node", "n", "v", "pivot", "angle"],
            )

    placed = checkpoint(nodes.select("node", "n", "v").mapInArrow(
        assign, f"node long, n long, v array<{kind}>, pivot int, angle double"))
    # one row per pivot
    caps = {r["pivot"]: (r["size"], r["cap"]) for r in placed.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("size"), F.max("angle").alias("cap")).collect()}
    reach = np.arccos(threshold) + 1e-7
    between = np.arccos(np.clip(pivot @ pivot.T, -1, 1))
    tiles = {p: -(-size // tile) for p, (size, _) in caps.items()}
    partners = {p: [q for q in caps if between[p, q] - caps[p][1] - caps[q][1] <= reach] for p in caps}
    spark = nodes.sparkSession
    # at most pivots squared rows
    grid = spark.createDataFrame(
        [(p, tiles[p], q, tiles[q]) for p in caps for q in partners[p]],
        "pivot int, tiles long, other int, others long",
    )
    own = placed.join(F.broadcast(grid), "pivot").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    spread = own.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    here, there = F.struct(F.col("pivot").alias("p"), F.col("tile").alias("t")), F.struct(F.col("other").alias("p"), F.col("t").alias("t"))
    pairs = spread.select(
        F.least(here, there).alias("x"), F.greatest(here, there).alias("y"), (here <= there).alias("in_x"), "node", "n", "v"
    )

    def compare(table: pa.Table) -> pa.Table:
        m = _unit(_matrix(table.column("v").combine_chunks(), width))
        node, n, in_x = (table.column(c).to_numpy() for c in ("node", "n", "in_x"))
        within = table.column("x")[0] == table.column("y")[0]
        x = np.flatnonzero(in_x)
        y = x if within else np.flatnonzero(~in_x)
        a, b, counts = [], [], np.zeros(len(node), np.int64)
        for i in range(0, len(x), block):
            for j in range(0, len(y), block):
                if within and j < i:
                    continue
                r, c = x[i : i + block], y[j : j + block]
                close = close_pairs(m[r], m[c], threshold)
                if within and i == j:
                    np.fill_diagonal(close, False)
                if not close.any():
                    continue
                counts[r] += close @ n[c]
                if not within or i != j:
                    counts[c] += n[r] @ close
                f, g = forest(close)
                a.append(node[r[f]])
                b.append(node[c[g]])
        linked = np.flatnonzero(counts)
        none = np.zeros(0, np.int64)
        ends = [np.concatenate([none, *z]) for z in (a, b)]
        return pa.table({
            "a": np.concatenate([ends[0], node[linked]]),
            "b": pa.concat_arrays([pa.array(ends[1]), pa.nulls(len(linked), pa.int64())]),
            "n": np.concatenate([np.zeros(len(ends[0]), np.int64), counts[linked]]),
        })

    return pairs.groupBy("x", "y").applyInArrow(compare, "a long, b long, n long")
