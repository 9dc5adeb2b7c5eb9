import math
import random
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from micro import DAY1, account_ids, day, prepared, transactions
from txnrisk import schema as S
from txnrisk.operators import account, assemble, graph, quality, split, txn_features
from txnrisk.session import checkpoint
from txnrisk.sources import tables


def history(spark, rows):
    txn, _ = prepared(spark, rows)
    names = account_ids(spark, txn)
    out = account.account_history(txn, DAY1).collect()
    return {(names[r.node_id], r.feature_date): r for r in out}


def test_gap(spark):
    row = history(spark, [(1, 1, 2), (9, 1, 2)])[1, day(9)]
    assert row.days_since_last == 8 and row.days_active_frac == 1 / 8 and row.n_out_rate == 1 / 8


def test_same_day_is_no_history(spark):
    rows = history(spark, [(2, 1, 2), (2, 1, 3)])
    assert rows[1, day(2)].has_history == 0 and rows[1, day(2)].days_since_last is None


def test_cold_start_defaults(spark):
    txn, _ = prepared(spark, [(1, 1, 2)])
    row = account.attach_account_history(txn, account.account_history(txn, DAY1)).first()
    for side in "sr":
        assert row[f"{side}_days_since_last"] == -1
        assert row[f"{side}_has_history"] == 0
        assert all(row[f"{side}_{c}"] == 0 for c in S.ACCOUNT_HISTORY if c != "days_since_last")


def test_self_loop_counts_in_both_roles(spark):
    row = history(spark, [(1, 1, 1), (2, 1, 2)])[1, day(2)]
    assert row.n_out_rate == 1 and row.n_in_rate == 1


def brute_history(rows, z):
    out = {}
    for node in {a for _, a, b, *_ in rows} | {b for _, a, b, *_ in rows}:
        for d in {n for n, a, b, *_ in rows if node in (a, b)}:
            o = [i for i, (n, a, b, *_) in enumerate(rows) if a == node and n < d]
            i = [i for i, (n, a, b, *_) in enumerate(rows) if b == node and n < d]
            days = {rows[k][0] for k in o + i}
            out[node, d] = (
                len(o) / (d - 1) if d > 1 else None, len(i) / (d - 1) if d > 1 else None,
                mean(z[k] for k in o) if o else None, mean(z[k] for k in i) if i else None,
                max((z[k] for k in o), default=None), len(days) / (d - 1) if d > 1 else None,
                d - max(days) if days else None, len({rows[k][3]["payment_format"] for k in o + i}),
            )
    return out


def test_history_equals_brute_force_with_a_hot_account(spark, hot):
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        a = 1 if rng.random() < 0.4 else rng.randint(1, 6)
        rows.append((rng.randint(1, 7), a, rng.randint(1, 6),
                     {"payment_format": rng.choice("wxyz"), "amount_paid": rng.random() * 100}))
    txn, _ = prepared(spark, rows)
    names = account_ids(spark, txn)
    z = {r.txn_id: r.t_amount_z_in_currency for r in txn.collect()}
    want = brute_history(rows, z)
    table = account.account_history(txn, DAY1)
    got = {(names[r.node_id], (r.feature_date - DAY1).days + 1): r for r in table.collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        for name, value in zip(S.ACCOUNT_HISTORY, values):
            mine = got[key][name]
            if name == "fmt_diversity":
                mine = mine or 0
            assert (mine is None) == (value is None), (key, name)
            assert mine is None or mine == pytest.approx(value), (key, name)
    attached = account.attach_account_history(txn, table).collect()
    assert len(attached) == len(rows)
    for r in attached:
        n, a, b, _ = rows[r.txn_id]
        assert r.s_n_out_rate == pytest.approx(want[a, n][0] or 0)
        assert r.r_days_since_last == (-1 if want[b, n][6] is None else want[b, n][6])


def test_amount_z_fallbacks(spark):
    rows = [(2, 1, 2, {"amount_paid": v, "payment_currency": "USD"}) for v in (1.0, 5.0, 20.0)]
    rows += [(3, 1, 2, {"amount_paid": 7.0, "payment_currency": "FLAT"}) for _ in range(2)]
    rows += [(9, 1, 2, {"amount_paid": 9.0, "payment_currency": "NEW"})]
    txn, _ = prepared(spark, rows)
    got = {r.txn_id: r.t_amount_z_in_currency for r in txn.collect()}
    logs = [math.log1p(v) for v in (1, 5, 20, 7, 7)]
    usd = logs[:3]
    assert got[0] == pytest.approx((usd[0] - mean(usd)) / stdev(usd))
    assert got[3] == pytest.approx((math.log1p(7) - mean(logs)) / stdev(logs))
    assert got[5] == pytest.approx((math.log1p(9) - mean(logs)) / stdev(logs))


def test_constant_training_amounts_give_zero(spark):
    txn, _ = prepared(spark, [(2, 1, 2, {"amount_paid": 3.0}), (3, 1, 2, {"amount_paid": 3.0}), (9, 1, 2)])
    assert {r.t_amount_z_in_currency for r in txn.collect()} == {0.0}


def test_large_lookup_is_not_broadcast(spark, hot):
    from txnrisk.functions.scale import BROADCAST_ROWS_CONF

    rows = [(2, 1, 2, {"payment_currency": c, "amount_paid": float(i)}) for i in range(15) for c in ("A", "B", "C")]
    small, _ = prepared(spark, rows)
    spark.conf.set(BROADCAST_ROWS_CONF, "1")
    try:
        large, _ = prepared(spark, rows)
    finally:
        spark.conf.unset(BROADCAST_ROWS_CONF)
    assert sorted(large.collect()) == sorted(small.collect())


def test_periods(spark):
    txn, bounds = prepared(spark, [(n, 1, 2) for n in range(1, 13)])
    got = [r.period for r in txn.orderBy("txn_id").collect()]
    assert got == ["warmup"] + ["train"] * 5 + ["validation"] * 2 + ["test"] * 2 + ["tail"] * 2
    for p in S.PERIODS:
        assert split.only_period(txn, bounds, p).count() == got.count(p)


def test_duplicates_are_flagged_and_kept(spark, hot):
    same = {"amount_paid": 1.0, "amount_received": 1.0, "txn_ts": __import__("datetime").datetime(2024, 9, 2),
            "payment_format": None}
    txn = transactions(spark, [(2, 1, 2, same)] * 25 + [(2, 1, 3)])
    flagged = quality.flag_duplicates(txn)
    assert flagged.count() == 26
    assert sorted(r.txn_id for r in flagged.where("is_exact_dup").collect()) == list(range(1, 25))


def test_schema_report(spark):
    txn = transactions(spark, [(1, 1, 2), (1, 1, 2, {"amount_paid": None}), (1, 1, 2, {"is_laundering": 5})])
    got = {(r.column_name, r.issue, r.n_rows) for r in quality.validate_schema(txn).collect()}
    assert got == {("amount_paid", "null", 1), ("is_laundering", "domain", 1)}
    got = {(r.column_name, r.issue) for r in quality.validate_schema(txn.drop("txn_ts").withColumn("x", F.lit(1))).collect()}
    assert {("txn_ts", "missing"), ("x", "extra")} <= got


def test_ids_are_dense_unique_and_repeatable(spark):
    txn = transactions(spark, [(1 + i % 3, i % 4, i % 5, {"amount_paid": float(i % 6)}) for i in range(60)])
    raw = txn.select(*S.SOURCE_COLUMNS)
    a = tables.with_ids(raw.repartition(3)).collect()
    b = tables.with_ids(raw.repartition(7)).collect()
    assert sorted(r.txn_id for r in a) == list(range(60))
    assert sorted(a) == sorted(b)


def test_feature_set_sizes():
    sizes = [len(S.feature_set(m, v)) for m in ("M1", "M2") for v in ("full", "no_shortcut")]
    assert sizes == [8, 4, 39, 33]
    assert [len(S.GROUPS[g]) for g in "APC"] == [16, 3, 12]


def test_round_trips(spark, tmp_path):
    txn, _ = prepared(spark, [(1, 1, 2), (2, 2, 1), (3, 1, 2)])
    nodes = graph.build_node_map(txn)
    clean = quality.flag_duplicates(txn).select(*S.CLEAN.fieldNames())
    edges = checkpoint(graph.build_edges(txn))
    node_day = assemble.graph_node_day(txn, edges, day(3))
    pair = graph.pair_history(txn, edges)
    for df, write, contract, name in (
        (clean, tables.write_clean, S.CLEAN, "clean"),
        (nodes.select("node_id", "bank", "account"), tables.write_node_map, S.NODE_MAP, "nodes"),
        (node_day, tables.write_node_day, S.GRAPH_NODE_DAY, "node_day"),
        (pair, tables.write_pair_txn, S.GRAPH_PAIR_TXN, "pair"),
    ):
        path = str(tmp_path / name)
        write(df, path)
        back = tables.read_table(spark, path, contract)
        assert back.schema == contract
        assert sorted(map(str, back.collect())) == sorted(map(str, df.select(*contract.fieldNames()).collect()))
    plan = tables.read_table(spark, str(tmp_path / "clean"), S.CLEAN).where(
        split.in_period(split.period_bounds(DAY1), "warmup"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(txn_date" in plan


def test_csv_source(spark, tmp_path):
    txn = transactions(spark, [(1, 1, 2), (2, 2, 3)])
    txn.write.option("header", True).csv(str(tmp_path / "csv"))
    back = tables.read_transactions(spark, str(tmp_path / "csv"), "csv")
    assert back.schema == S.TXN and sorted(back.collect()) == sorted(txn.collect())
