"""Graph hand-off tables and the feature matrix."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.config import Config
from txnrisk.functions.scale import salted_join
from txnrisk.operators.account import attach_by_node_day, fill_cold_start
from txnrisk.operators.components import MergeForest, wcc
from txnrisk.operators.graph import active_days, counterparties
from txnrisk.operators.pagerank import pagerank


def graph_node_day(
    txn: DataFrame, edges: DataFrame, last_date: dt.date, config: Config = Config(), forest: MergeForest | None = None,
) -> DataFrame:
    """Node features for every (node, day) that occurs in a transaction.

    ``edges`` should be a checkpoint or a written table, because it is read by
    each of the three features.
    """
    days = active_days(txn).select("node_id", "feature_date")
    ranks = pagerank(edges, days, last_date, config.damping, config.pagerank_iterations)
    keys = ["node_id", "feature_date"]
    return (
        counterparties(edges, days)
        .join(ranks.select(*keys, "pagerank_log"), keys)
        .join(wcc(edges, days, last_date, forest).select(*keys, "wcc_size_log"), keys)
        .select(*S.GRAPH_NODE_DAY.fieldNames())
    )


def assemble(
    txn: DataFrame, history: DataFrame, node_day: DataFrame, pair: DataFrame
) -> DataFrame:
    """M1 rows plus account, network and pair features, one row per transaction.

    Account history and network features share their key, so they are joined to
    each other first and travel to the transactions together: one join per side
    instead of two.
    """
    network = node_day.select(
        "node_id", "feature_date",
        *[F.col(c.removeprefix("g_")).alias(c) for c in S.NODE_GRAPH],
    )
    both = fill_cold_start(history).join(network, ["node_id", "feature_date"], "left")
    both = both.fillna(0, S.NODE_GRAPH)
    by_id = txn.join(pair, "txn_id", "left").fillna(0, S.PAIR_HISTORY)
    return attach_by_node_day(by_id, both, [*S.ACCOUNT_HISTORY, *S.NODE_GRAPH, "has_history"])


def select_features(matrix: DataFrame, model: str, variant: str) -> DataFrame:
    """Id, period, label and the columns of one configuration."""
    return matrix.select("txn_id", "period", "is_laundering", *S.feature_set(model, variant))
