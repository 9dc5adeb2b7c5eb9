import pytest
from pyspark.sql import functions as F

from conformance.stages import stages
from txnrisk.operators import account, components, graph, leakage, split, txn_features
from txnrisk.session import checkpoint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def s(spark):
    return stages(spark, SF)


def encoded(s, txn):
    """Features with node ids and statistics held fixed."""
    return txn_features.txn_features(graph.encode_nodes(txn, s.node_map), s.amount_stats)


def test_strict_date_audit_passes_and_can_fail(s):
    assert leakage.strict_date_audit(s.clean, s.history, s.first_date, s.last_date).count() == 0
    leaky = s.history.withColumn("n_out_rate", F.col("n_out_rate") + F.col("n_out_today"))
    found = leakage.strict_date_audit(s.clean, leaky, s.first_date, s.last_date)
    assert {r.column_name for r in found.select("column_name").distinct().collect()} == {"n_out_rate"}


def test_account_history_ignores_the_future(s):
    found = leakage.future_perturbation(
        s.clean, s.bounds.test,
        lambda t: account.account_history(encoded(s, t.select(*s.txn.columns)), s.first_date)
        .drop("n_out_today", "n_in_today"),
        ["node_id", "feature_date"])
    assert found.count() == 0


def test_perturbation_is_noticed_by_a_leaky_feature(s):
    found = leakage.future_perturbation(
        s.txn, s.bounds.test,
        lambda t: t.groupBy(F.col("from_account").alias("node_id"), F.col("txn_date").alias("feature_date"))
        .agg(F.max("amount_paid").alias("today")),
        ["node_id", "feature_date"])
    assert found.count() > 0


def test_graph_features_ignore_the_future(s):
    def build(txn):
        e = encoded(s, txn.select(*s.txn.columns))
        edges = checkpoint(graph.build_edges(e))
        days = graph.active_days(e)
        keys = ["node_id", "feature_date"]
        return graph.counterparties(edges, days).join(components.wcc(edges, days, s.last_date), keys)

    assert leakage.future_perturbation(s.clean, s.bounds.test, build, ["node_id", "feature_date"]).count() == 0


def test_labels_do_not_enter_features(s):
    def build(txn):
        e = encoded(s, txn)
        edges = checkpoint(graph.build_edges(e))
        pair = graph.pair_history(e, edges)
        return account.attach_account_history(e, account.account_history(e, s.first_date)).drop(
            "is_laundering").join(pair, "txn_id")

    assert leakage.label_invariance(s.txn, build, ["txn_id"]).count() == 0


def test_statistics_come_from_train_only(s):
    assert leakage.train_only_statistics(s.txn, s.bounds).count() == 0
    # the same check notices statistics fitted on another period
    late = split.Bounds(s.bounds.first, s.bounds.test, s.bounds.tail, s.bounds.tail, s.bounds.tail)
    moved = leakage.keyed_diff(
        split.fit_amount_stats(s.txn, s.bounds), split.fit_amount_stats(s.txn, late), ["payment_currency"])
    assert moved.count() > 0
