"""Nodes, edges, daily snapshots and the features that need no iteration."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions.days import before_day, day_number
from txnrisk.functions.scale import global_index, salted_join
from txnrisk.session import checkpoint


def _endpoints(txn: DataFrame) -> DataFrame:
    """Distinct (bank, account) over both roles with their number of rows per role.

    An endpoint without bank or account is no node.
    """
    ends = txn.select(F.explode(F.array(
        F.struct(F.col("from_bank").alias("bank"), F.col("from_account").alias("account"),
                 F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("to_bank").alias("bank"), F.col("to_account").alias("account"),
                 F.lit(0).alias("out"), F.lit(1).alias("in")),
    )).alias("e")).select("e.*").where("bank IS NOT NULL AND account IS NOT NULL")
    return ends.groupBy("bank", "account").agg(
        F.sum("out").alias("n_out"), F.sum("in").alias("n_in")
    )


def build_node_map(txn: DataFrame) -> DataFrame:
    """Dense ids from 0 in (bank, account) order.

    Also carries ``n_out`` and ``n_in``, the rows of each account per role, which
    ``encode_nodes`` needs to split busy accounts.
    """
    indexed = global_index(_endpoints(txn), ["bank", "account"], "node_id")
    return checkpoint(indexed.select("node_id", "bank", "account", "n_out", "n_in"))


def encode_nodes(txn: DataFrame, node_map: DataFrame) -> DataFrame:
    """Add ``src`` and ``dst``, null for an endpoint that is no node.

    ``node_map`` comes from a checkpoint or a table. ``id_consistency`` lists such rows.
    """
    for role, end, weight in (("from", "src", "n_out"), ("to", "dst", "n_in")):
        keys = [f"{role}_bank", f"{role}_account"]
        side = node_map.select(
            F.col("bank").alias(keys[0]), F.col("account").alias(keys[1]),
            F.col("node_id").alias(end), F.col(weight).alias("_rows"),
        )
        txn = salted_join(txn, side, keys, "txn_id", "_rows", stored=True)
    return txn


def topology(txn: DataFrame) -> DataFrame:
    """Transactions that are edges of the graph: no self-loops."""
    return txn.where("src <> dst")


def build_edges(txn: DataFrame) -> DataFrame:
    """Directed edges with first date and number of transactions."""
    return topology(txn).groupBy("src", "dst").agg(
        F.min("txn_date").alias("first_date"), F.count(F.lit(1)).alias("n_txn")
    )


def snapshot(edges: DataFrame, date: dt.date) -> DataFrame:
    """Edges known before ``date``."""
    return edges.where(F.col("first_date") < F.lit(date))


def snapshots(edges: DataFrame, last_date: dt.date) -> DataFrame:
    """All snapshots up to ``last_date`` keyed by ``feature_date``.

    A generator in place of the join ``first_date < feature_date``.
    """
    return (
        edges.where(F.col("first_date") < F.lit(last_date))
        .withColumn("feature_date", F.explode(F.sequence(
            F.date_add("first_date", 1), F.lit(last_date)
        )))
    )


def snapshot_audit(snapshot_edges: DataFrame) -> DataFrame:
    """Snapshot edges that are not older than their feature date; must be empty."""
    return snapshot_edges.where("first_date >= feature_date")


def pair_day(txn: DataFrame) -> DataFrame:
    """Transactions per directed pair and day with the count on earlier days."""
    per_day = topology(txn).groupBy("src", "dst", "txn_date").agg(F.count(F.lit(1)).alias("n_today"))
    return per_day.withColumn("day", day_number("txn_date")).select(
        "src", "dst", "txn_date", "n_today",
        F.coalesce(F.sum("n_today").over(before_day("src", "dst")), F.lit(0)).alias("n_prior"),
    )


def pair_history(txn: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_pair_txn``: the three pair features, one row per transaction.

    Work happens per (pair, day): the reverse direction is looked up there, before
    the result is joined to the transactions. Self-loops have no pair and get 0; they
    stay out of the join, so that one busy account does not fill a task with them.
    """
    reverse = edges.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("first_date").alias("_reverse")
    )
    days = (
        pair_day(txn).join(reverse, ["src", "dst"], "left")
        .withColumn(
            "_reverse_seen", F.coalesce(F.col("_reverse") < F.col("txn_date"), F.lit(False)).cast("int")
        )
        .drop("_reverse")
    )
    keys = txn.select("txn_id", "src", "dst", "txn_date")
    alone = keys.where(~F.coalesce(F.col("src") != F.col("dst"), F.lit(False)))
    joined = salted_join(topology(keys), days, ["src", "dst", "txn_date"], "txn_id", "n_today")
    paired = joined.select(
        "txn_id",
        F.coalesce((F.col("n_prior") > 0).cast("int"), F.lit(0)).alias("g_pair_seen_before"),
        F.coalesce(F.log1p("n_prior"), F.lit(0.0)).alias("g_pair_prior_count_log"),
        F.coalesce("_reverse_seen", F.lit(0)).alias("g_reverse_pair_seen"),
    )
    return paired.unionByName(alone.select(
        "txn_id", F.lit(0).alias("g_pair_seen_before"), F.lit(0.0).alias("g_pair_prior_count_log"),
        F.lit(0).alias("g_reverse_pair_seen"),
    ))


def active_days(txn: DataFrame) -> DataFrame:
    """Nodes and the days on which they send or receive, with rows per role."""
    return txn.select("txn_date", F.explode(F.array(
        F.struct(F.col("src").alias("node_id"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("out"), F.lit(1).alias("in")),
    )).alias("e")).groupBy(F.col("e.node_id").alias("node_id"), F.col("txn_date").alias("feature_date")).agg(
        F.sum("e.out").alias("n_out_today"), F.sum("e.in").alias("n_in_today")
    )


def counterparties(edges: DataFrame, node_days: DataFrame) -> DataFrame:
    """Distinct receivers and senders of each node before each of ``node_days``.

    An edge is new exactly once, on its first date, so a running sum of new edges
    is an exact distinct count. New edges and requested days are stacked and
    aggregated per (node, day); a hub contributes one row per day to the window.
    """
    new = edges.select("first_date", F.explode(F.array(
        F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("e")).select(
        "e.node_id", F.col("first_date").alias("feature_date"),
        F.col("e.o").alias("o"), F.col("e.i").alias("i"), F.lit(0).alias("asked"),
    )
    asked = node_days.select(
        "node_id", "feature_date", F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(1).alias("asked")
    )
    w = before_day("node_id")
    return (
        new.unionByName(asked).groupBy("node_id", "feature_date")
        .agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("asked").alias("asked"))
        .withColumn("day", day_number("feature_date"))
        .select(
            "node_id", "feature_date", "asked",
            F.coalesce(F.sum("o").over(w), F.lit(0)).alias("n_unique_out"),
            F.coalesce(F.sum("i").over(w), F.lit(0)).alias("n_unique_in"),
        )
        .where("asked = 1").drop("asked")
        .withColumns({
            "n_unique_out_log": F.log1p("n_unique_out"),
            "n_unique_in_log": F.log1p("n_unique_in"),
            "has_sent_before": (F.col("n_unique_out") > 0).cast("int"),
            "has_received_before": (F.col("n_unique_in") > 0).cast("int"),
        })
    )
