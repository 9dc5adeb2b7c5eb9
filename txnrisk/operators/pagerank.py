"""PageRank of all daily snapshots, a block of dates at a time.

With the damped link matrix ``L`` of a snapshot and the uniform start ``u``, one
iteration is

    y = L r,   r' = y + (1 - sum(y)) u

where the second term returns teleport and dangling mass in one constant per date.
A node's state is one row with a number per date of the block, and an edge is one
row with its first date: it passes on the numbers of the later dates. The join and
the partial sums therefore handle edges, not edges x dates, and what is shuffled is
one row per (task, receiver), however many dates the block has. An iteration reads
the state before it and writes its own; older ones are released.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.functions.days import day_number
from txnrisk.functions.scale import hot_rows, stack
from txnrisk.session import checkpoint


def pagerank(
    edges: DataFrame,
    node_days: DataFrame,
    last_date: dt.date,
    damping: float = 0.85,
    iterations: int = 20,
    block: int = 32,
) -> DataFrame:
    """``(node_id, feature_date, pagerank, pagerank_log)`` for each of ``node_days``.

    Distinct edges without weights, uniform teleport, dangling mass spread
    uniformly, a fixed number of iterations. ``pagerank_log`` is ``log1p(N * rank)``
    with N nodes in the snapshot; a node that is not in the snapshot has 0.
    ``edges`` is read several times and should be a checkpoint or a table.
    ``block`` dates share a row; it bounds the width of a row and changes no result.
    """
    last = (last_date - dt.date(1970, 1, 1)).days
    links = edges.select("src", "dst", day_number("first_date").alias("t")).where(F.col("t") < last)
    seen = checkpoint(
        links.select("t", F.explode(F.array("src", "dst")).alias("node_id"))
        .groupBy("node_id").agg(F.min("t").alias("seen"))
    )
    # one row per date to the driver
    arrivals = dict(seen.groupBy("seen").count().collect())
    first = min(arrivals, default=last)
    n_nodes: dict[int, int] = {}
    for day in range(first + 1, last + 1):
        n_nodes[day] = n_nodes.get(day - 1, 0) + arrivals.get(day - 1, 0)

    asked = node_days.select("node_id", "feature_date", day_number("feature_date").alias("day"))
    zero = F.lit(0.0)
    if not n_nodes:
        return asked.select(
            "node_id", "feature_date", zero.alias("pagerank"), zero.alias("pagerank_log")
        )
    links, hot = _placed(links)
    days = list(n_nodes)
    states, refills = [], []
    for i in range(0, len(days), block):
        state, refill = _iterate(links, hot, {d: n_nodes[d] for d in days[i:i + block]}, damping, iterations)
        states.append(state.select(
            "node_id", F.lit(i // block).alias("block"), "v"
        ))
        refills += refill
    links.unpersist()

    def by_day(values: list[float]) -> Column:
        return F.element_at(F.expr(_array(f"{v!r}D" for v in values)), F.col("day") - days[0] + 1)

    # the constant of a date is the same for all nodes of its snapshot
    offset = F.col("day") - days[0]
    known = (
        asked.join(seen, "node_id").where("seen < day")
        .withColumn("block", F.floor(offset / block).cast("int"))
        .join(stack(states), ["node_id", "block"], "left")
        .select(
            "node_id", "day",
            (F.coalesce(F.element_at("v", F.pmod(offset, F.lit(block)) + 1), zero) + by_day(refills)).alias("v"),
        )
    )
    n = by_day([float(n) for n in n_nodes.values()])
    return asked.join(known, ["node_id", "day"], "left").select(
        "node_id", "feature_date",
        F.coalesce("v", zero).alias("pagerank"),
        F.when(F.col("v").isNotNull(), F.log1p(F.col("v") * n)).otherwise(zero).alias("pagerank_log"),
    )


def _array(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"


def _placed(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Links placed once for the joins of all iterations, and the senders to split.

    The edges of a sender above the limit are spread over salts; its row of shares
    is repeated once per salt. There are at most edges / hotKeyRows such senders,
    which bounds the broadcast.
    """
    limit = hot_rows(links.sparkSession)
    degrees = checkpoint(links.groupBy("src").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > limit))
    if degrees.isEmpty():
        hot, placed = None, links.repartition("src")
    else:
        hot = degrees.select("src", F.ceil(F.col("d") / limit).cast("int").alias("salts"))
        salt = F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")
        placed = (
            links.join(F.broadcast(hot), "src", "left").withColumn("salt", salt).drop("salts")
            .repartition("src", "salt")
        )
    # materialized before the loop, so that its plans see the placement and move only ranks
    placed = placed.persist(StorageLevel.MEMORY_AND_DISK)
    placed.count()
    return placed, hot


def _iterate(
    links: DataFrame, hot: DataFrame | None, n_nodes: dict[int, int], damping: float, iterations: int
) -> tuple[DataFrame, list[float]]:
    """``(node_id, v)`` after the last iteration, and a constant per date.

    The rank on a date is the received mass ``v`` plus the constant. ``f`` is the
    part of its rank that a sender passes to each receiver, null on dates before its
    first edge. The constants enter as one array, so that the plans of all iterations
    have the same generated code.
    """
    days = list(n_nodes)
    known = links.where(F.col("t") < days[-1])
    # one SQL text per list of dates: a Column object per date takes longer than the work
    factors = known.groupBy(F.col("src").alias("node_id")).agg(F.expr(_array(
        f"{damping!r}D / nullif(count_if(t < {d}), 0L)" for d in days
    )).alias("f")).repartition("node_id").persist(StorageLevel.MEMORY_AND_DISK)
    received_by_day = F.expr(_array(
        f"coalesce(sum(CASE WHEN t < {d} THEN v[{j}] END), 0D)" for j, d in enumerate(days)
    ))
    total_by_day = F.expr(_array(f"coalesce(sum(v[{j}]), 0D)" for j in range(len(days))))
    keys = ["src"] if hot is None else ["src", "salt"]

    def passed_on(state: DataFrame, constants: list[float]) -> DataFrame:
        added = F.expr(_array(f"{c!r}D" for c in constants))
        ranks = F.coalesce(F.zip_with("v", added, lambda v, c: v + c), added)
        shares = state.where("f IS NOT NULL").select(
            F.col("node_id").alias("src"), F.zip_with(ranks, "f", lambda r, f: r * f).alias("v")
        )
        if hot is not None:
            shares = shares.join(F.broadcast(hot), "src", "left").withColumn(
                "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
            ).drop("salts")
        received = shares.join(known, keys).groupBy(F.col("dst").alias("node_id")).agg(
            received_by_day.alias("v")
        )
        # the sums are already placed by node, like the factors
        return checkpoint(received.join(factors, "node_id", "full"))

    constants = [1.0 / n for n in n_nodes.values()]
    state = factors.withColumn("v", F.lit(None).cast("array<double>"))
    for _ in range(iterations):
        state = passed_on(state, constants)
        # one row to the driver
        totals = state.agg(total_by_day).first()[0]
        constants = [(1.0 - total) / n for total, n in zip(totals, n_nodes.values())]
    # the last state is stored by now
    factors.unpersist()
    return state, constants
