"""Weakly connected components of all daily snapshots, by one merge forest.

The snapshot of a date holds the edges first seen before it. All snapshots are told
by one forest, built by Boruvka's rounds: every node takes its earliest edge, nodes
joined by these edges contract to a parent, and the earliest edges between parents
make up the graph of the next round. At least half of the nodes go per round. A node
remembers the day ``t`` of the edge it took.

Two nodes are connected by edges before a date if and only if the way between them in
the forest has only nodes with ``t`` before that date (King, 1997): a node's edge is the
earliest at it, and along the edges taken days never rise towards the root of a
contraction. So the component of a node on a date is its highest ancestor below which
all ``t`` lie before the date, and its size is the number of leaves that reach this
ancestor by then. Nothing is repeated per date: a node has a row per ancestor at which
its component changes, and an ancestor a row per day on which it grows.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions.days import day_number
from txnrisk.functions.scale import counted_keys, hot_rows, salted_join, stack
from txnrisk.session import checkpoint

#: Edges of a contracted graph whose last rounds run in one task: some 2 MB, whatever the input.
FINISH_EDGES = 100_000


@dataclasses.dataclass
class MergeForest:
    """Components of all dates.

    ``history``  (node_id, level, label, since, until): the component of a node on days
                 ``since`` to ``until`` - 1 (null: for ever); none before its first edge.
    ``growth``   (level, label, day, n): leaves that reach the label by an edge of ``day``.
    ``ends``     (level, label, t): day of the edge by which a component merges into another, null for a root.
    """

    history: DataFrame
    growth: DataFrame
    ends: DataFrame
    rounds: int


def earliest_edges(edges: DataFrame) -> DataFrame:
    """(lo, hi, t): each pair of different nodes with its first day. ``edges`` is (src, dst, first_date)."""
    return edges.where("src <> dst").groupBy(
        F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")
    ).agg(F.min(day_number("first_date")).alias("t"))


def _taken(edges: DataFrame) -> DataFrame:
    """(a, next, t, degree): the earliest edge of every node, ties by its ends, and where it leads."""
    ends = edges.select("t", F.explode(F.array(
        F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")),
        F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")),
    )).alias("e")).select("e.a", "e.b", "t")
    first = F.min(F.struct("t", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")))
    return ends.groupBy("a").agg(first.alias("e"), F.count(F.lit(1)).alias("degree")).select(
        "a", F.when(F.col("e.lo") == F.col("a"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("next"), "e.t", "degree")


def _jump(nodes: DataFrame, rows: int) -> DataFrame:
    """``nodes`` with ``further``: where the next node leads. A node many lead to is split."""
    further = nodes.select(F.col("a").alias("next"), F.col("next").alias("further"))
    if rows > hot_rows(nodes.sparkSession):
        further = counted_keys(nodes.select("next"), further, ["next"], "_w")
        return salted_join(nodes, further, ["next"], "a", "_w", "inner")
    return nodes.join(further, "next")


def _contracted(taken: DataFrame, rows: int) -> DataFrame:
    """(a, t, degree, label): the root of each node. Of two nodes that took one edge the smaller is the root."""
    root = (F.col("further") == F.col("a")) & (F.col("a") < F.col("next"))
    nodes = _jump(checkpoint(taken), rows).select(
        "a", F.when(root, F.col("a")).otherwise(F.col("next")).alias("next"), "t", "degree")
    while True:
        # two doublings per stored table
        for _ in range(2):
            nodes = _jump(nodes, rows).select(
                "a", F.col("further").alias("next"), "t", "degree", (F.col("further") != F.col("next")).alias("moved"))
        nodes = checkpoint(nodes)
        if nodes.where("moved").isEmpty():
            return nodes.select("a", "t", "degree", F.col("next").alias("label"))


def _relabelled(edges: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """Earliest edges between the contracted nodes."""
    for end, other in (("lo", "hi"), ("hi", "lo")):
        label = nodes.select(F.col("a").alias(end), F.col("label").alias("_label"), F.col("degree").alias("_w"))
        edges = salted_join(edges, label, [end], other, "_w", "inner", rows=rows, stored=True).select(
            "t", F.col("_label").alias(end), other)
    return edges.where("lo <> hi").groupBy(
        F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).agg(F.min("t").alias("t"))


def _round(lo: np.ndarray, hi: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """One round in memory: nodes, the days they took, their roots; and the edges left."""
    a, b, day = np.concatenate([lo, hi]), np.concatenate([hi, lo]), np.concatenate([t, t])
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), day, a))
    first = order[np.flatnonzero(np.diff(a[order], prepend=a[order[0]] - 1))]
    nodes, taken = a[first], day[first]
    lead = np.searchsorted(nodes, b[first])
    own = np.arange(len(nodes))
    lead = np.where((lead[lead] == own) & (own < lead), own, lead)
    while (lead[lead] != lead).any():
        lead = lead[lead]
    root = nodes[lead]
    x, y = root[np.searchsorted(nodes, lo)], root[np.searchsorted(nodes, hi)]
    lo, hi, t = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y], t[x != y]
    order = np.lexsort((t, hi, lo))
    lo, hi, t = lo[order], hi[order], t[order]
    kept = np.ones(len(lo), bool)
    kept[1:] = (np.diff(lo) != 0) | (np.diff(hi) != 0)
    return nodes, taken, root, lo[kept], hi[kept], t[kept]


def _finished(graph: DataFrame) -> DataFrame:
    """(level, a, t, label) of all rounds that a contracted graph of few edges still needs, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("lo", pa.int64()), ("hi", pa.int64()), ("t", pa.int32())]))
        lo, hi, t = (rows.column(c).to_numpy() for c in ("lo", "hi", "t"))
        level = 0
        while len(lo):
            level += 1
            nodes, taken, root, lo, hi, t = _round(lo, hi, t)
            yield pa.RecordBatch.from_pydict({
                "level": pa.array(np.full(len(nodes), level, np.int32)), "a": nodes, "t": pa.array(taken, pa.int32()), "label": root})

    one = graph.select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("t").cast("int").alias("t"))
    return one.coalesce(1).mapInArrow(run, "level int, a long, t int, label long")


def merge_forest(edges: DataFrame, finish: int = FINISH_EDGES) -> MergeForest:
    """The merge forest of ``edges`` (src, dst, first_date); loops connect nothing. Empty without edges.

    The first round is always spread; later ones are until at most ``finish`` edges are left.
    """
    spark = edges.sparkSession
    graph = checkpoint(earliest_edges(edges))
    first = rows = graph.count()
    rounds: list[DataFrame] = []  # (a, t, label) of each round
    while rows:
        if rounds and rows <= finish:
            rest = checkpoint(_finished(graph))
            more = rest.agg(F.max("level")).first()[0]
            rounds += [rest.where(F.col("level") == k).drop("level") for k in range(1, more + 1)]
            break
        nodes = _contracted(_taken(graph), 2 * rows)
        rounds.append(nodes.drop("degree"))
        graph = checkpoint(_relabelled(graph, nodes, rows))
        rows = graph.count()
    if not rounds:
        empty = spark.createDataFrame([], "node_id long, level int, label long, since int, until int, day int, n long, t int")
        return MergeForest(empty.select("node_id", "level", "label", "since", "until"),
                           empty.select("level", "label", "day", "n"), empty.select("level", "label", "t"), 0)
    # from the second round on a label is the contracted node of the round before; a node has at most
    # one ancestor per round and fewer rounds than 64
    way = rounds[0].select(F.col("a").alias("node_id"), F.col("label").alias("l1"), F.col("t").alias("d1"))
    for k, step in enumerate(rounds[1:], 2):
        up = step.select(F.col("a").alias(f"l{k - 1}"), F.col("label").alias(f"l{k}"), F.col("t").alias("_t"))
        if 2 * first > hot_rows(spark):
            up = counted_keys(way.select(f"l{k - 1}"), up, [f"l{k - 1}"], "_w")
            way = checkpoint(salted_join(way, up, [f"l{k - 1}"], "node_id", "_w"))
        else:
            way = way.join(up, f"l{k - 1}", "left")
        way = way.withColumn(f"d{k}", F.when(F.col(f"l{k}").isNotNull(), F.greatest(f"d{k - 1}", "_t"))).drop("_t")
    n = len(rounds)
    steps = checkpoint(way.select("node_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), F.col(f"l{k}").alias("label"), F.col(f"d{k}").alias("day")) for k in range(1, n + 1)
    ])).alias("s")).select("node_id", "s.*").where("label is not null"))
    # of the ancestors that a node reaches on one day the highest counts
    upwards = Window.partitionBy("node_id").orderBy("level")
    history = steps.withColumn("until", F.lead("day").over(upwards) + 1).where(
        "until is null or until > day + 1").select("node_id", "level", "label", (F.col("day") + 1).alias("since"), "until")
    growth = steps.groupBy("level", "label", "day").agg(F.count(F.lit(1)).alias("n"))
    ends = [r.select(F.lit(k).alias("level"), F.col("a").alias("label"), "t") for k, r in enumerate(rounds[1:], 1)]
    merged = stack(ends) if ends else spark.createDataFrame([], "level int, label long, t int")
    return MergeForest(history, growth, merged, n)


def wcc(edges: DataFrame, node_days: DataFrame, last_date: dt.date, forest: MergeForest | None = None) -> DataFrame:
    """``(node_id, feature_date, wcc_size, wcc_size_log)`` for each of ``node_days``.

    A node that is not in the snapshot has size 0. ``last_date`` ends the dates asked for.
    """
    forest = forest or merge_forest(edges)
    asked = node_days.select("node_id", "feature_date", day_number("feature_date").alias("day"))
    found = checkpoint(asked.alias("a").join(forest.history.alias("h"), (
        (F.col("a.node_id") == F.col("h.node_id")) & (F.col("a.day") >= F.col("h.since"))
        & (F.col("h.until").isNull() | (F.col("a.day") < F.col("h.until")))
    ), "left").select("a.*", "h.level", "h.label"))
    # one row per label and day that is asked for or on which it grows
    wanted = found.where("label is not null").groupBy("level", "label", "day").agg(F.count(F.lit(1)).alias("_w"))
    both = stack([
        wanted.withColumn("n", F.lit(0).cast("long")),
        forest.growth.select("level", "label", (F.col("day") + 1).alias("day"), F.lit(0).cast("long").alias("_w"), "n"),
    ]).groupBy("level", "label", "day").agg(F.sum("_w").alias("_w"), F.sum("n").alias("n"))
    until = Window.partitionBy("level", "label").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = both.withColumn("size", F.sum("n").over(until)).where("_w > 0").select("level", "label", "day", "size", "_w")
    # nodes without a component on the day are spread like a hot key of their own
    sized = salted_join(found, sizes, ["level", "label", "day"], "node_id", "_w").select(
        "node_id", "feature_date", F.coalesce("size", F.lit(0)).alias("wcc_size"))
    return sized.withColumn("wcc_size_log", F.log1p("wcc_size"))


def component_summary(edges: DataFrame, last_date: dt.date, forest: MergeForest | None = None) -> DataFrame:
    """``(feature_date, n_components, largest)`` for each date with a snapshot, up to ``last_date``.

    A component counts from the first leaf that reaches its label until the label
    merges into another; components only grow, so the largest is a running maximum.
    """
    forest = forest or merge_forest(edges)
    grown = checkpoint(forest.growth)
    upto = Window.partitionBy("level", "label").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    largest = grown.withColumn("size", F.sum("n").over(upto)).groupBy("day").agg(F.max("size").alias("size"))
    born = grown.groupBy("level", "label").agg(F.min("day").alias("day"))
    lives = born.join(forest.ends, ["level", "label"], "left").where("t is null or t > day")
    turns = stack([
        lives.select("day", F.lit(1).alias("turn")), lives.where("t is not null").select(F.col("t").alias("day"), F.lit(-1).alias("turn")),
    ]).groupBy("day").agg(F.sum("turn").alias("turn"))
    last = (last_date - dt.date(1970, 1, 1)).days
    per_day = turns.join(largest, "day", "full").select(
        F.col("day"), F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("size", F.lit(0)).alias("size")
    ).where(F.col("day") < last)
    # one row per day from here on
    span = per_day.agg(F.min("day").alias("a")).where("a is not null").select(
        F.explode(F.sequence(F.col("a"), F.lit(last - 1))).alias("day"))
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return span.join(per_day, "day", "left").select(
        F.date_from_unix_date(F.col("day") + 1).alias("feature_date"),
        F.sum(F.coalesce("turn", F.lit(0))).over(running).alias("n_components"),
        F.max(F.coalesce("size", F.lit(0))).over(running).alias("largest"),
    )
