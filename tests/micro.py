"""Hand-made transactions."""

import datetime as dt

from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.operators import graph, split, txn_features
from txnrisk.session import checkpoint

DAY1 = dt.date(2024, 9, 1)


def day(n: int) -> dt.date:
    return DAY1 + dt.timedelta(days=n - 1)


def transactions(spark, rows):
    """Rows are (day, from, to) or (day, from, to, dict of columns); bank = 1."""
    out = []
    for i, (n, a, b, *more) in enumerate(rows):
        values = {
            "txn_id": i, "txn_ts": dt.datetime.combine(day(n), dt.time(9, i % 60)), "txn_date": day(n),
            "from_bank": 1, "from_account": a, "to_bank": 1, "to_account": b,
            "payment_currency": "USD", "receiving_currency": "USD", "amount_paid": 10.0 + i,
            "amount_received": 10.0 + i, "payment_format": "ACH", "is_laundering": 0,
            **(more[0] if more else {}),
        }
        out.append(tuple(values[f] for f in S.TXN.fieldNames()))
    return spark.createDataFrame(out, S.TXN)


def prepared(spark, rows):
    """Transactions with node ids, period and M1 features; and the bounds."""
    txn = transactions(spark, rows)
    bounds = split.period_bounds(DAY1)
    stats = checkpoint(split.fit_amount_stats(txn, bounds))
    encoded = graph.encode_nodes(split.assign_period(txn, bounds), graph.build_node_map(txn))
    return checkpoint(txn_features.txn_features(encoded, stats)), bounds


def account_ids(spark, txn):
    """node id -> account number"""
    rows = txn.select(F.col("src").alias("n"), F.col("from_account").alias("a")).union(
        txn.select("dst", "to_account")).distinct().collect()
    return {r.n: r.a for r in rows}
