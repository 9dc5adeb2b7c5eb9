"""Shared inputs of the registered queries, built once per session and data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.config import Config
from txnrisk.functions.days import first_and_last_date
from txnrisk.operators import account, assemble, graph, split, txn_features
from txnrisk.session import checkpoint
from txnrisk.sources.events import transactions_from_events


class Stages:
    """Lazily built tables over all rows of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.config = Config()

    @cached_property
    def txn(self) -> DataFrame:
        return transactions_from_events(self.spark, self.sf_dir)

    @cached_property
    def dates(self):
        return first_and_last_date(self.txn)

    @property
    def first_date(self):
        return self.dates[0]

    @property
    def last_date(self):
        return self.dates[1]

    @cached_property
    def bounds(self) -> split.Bounds:
        return split.period_bounds(self.first_date, self.config)

    @cached_property
    def amount_stats(self) -> DataFrame:
        return checkpoint(split.fit_amount_stats(self.txn, self.bounds))

    @cached_property
    def node_map(self) -> DataFrame:
        return graph.build_node_map(self.txn)

    @cached_property
    def clean(self) -> DataFrame:
        """Transactions with node ids, period and the M1 features."""
        encoded = graph.encode_nodes(split.assign_period(self.txn, self.bounds), self.node_map)
        return checkpoint(txn_features.txn_features(encoded, self.amount_stats))

    @cached_property
    def edges(self) -> DataFrame:
        return checkpoint(graph.build_edges(self.clean))

    @cached_property
    def history(self) -> DataFrame:
        return checkpoint(account.account_history(self.clean, self.first_date))

    @cached_property
    def pair(self) -> DataFrame:
        return checkpoint(graph.pair_history(self.clean, self.edges))

    @cached_property
    def node_day(self) -> DataFrame:
        return checkpoint(
            assemble.graph_node_day(self.clean, self.edges, self.last_date, self.config)
        )

    @cached_property
    def matrix(self) -> DataFrame:
        return checkpoint(assemble.assemble(self.clean, self.history, self.node_day, self.pair))

    @cached_property
    def pos_weight(self) -> float:
        return split.scale_pos_weight(self.clean, self.bounds).first()["scale_pos_weight"]

    @cached_property
    def scored(self) -> DataFrame:
        """Transactions with deterministic surrogate scores that SQL can repeat."""
        joined = self.clean.join(self.pair, "txn_id")
        return checkpoint(joined.withColumns(surrogate_scores()))


def surrogate_scores() -> dict:
    m1 = m1_linear()
    m2 = m1 + F.when(F.col("g_pair_seen_before") == 0, 1.0).otherwise(0.0)
    return {"m1_score": F.round(m1, 6), "m2_score": F.round(m2, 6)}


def m1_linear():
    ach = F.when(F.col("payment_format") == "ACH", 1.0).otherwise(0.0)
    return 0.3 * F.log1p("amount_paid") + 0.8 * ach + 0.2 * F.col("t_is_fx").cast("double")


_CACHE: dict[tuple[str, str], Stages] = {}


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = Stages(spark, sf_dir)
    return _CACHE[key]
