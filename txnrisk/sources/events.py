"""Transactions derived from the ``events`` test table.

The same text runs in Spark SQL and in DuckDB. The label is made up, so a model
result on this data says nothing about real payments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENT_TRANSACTIONS = """
WITH e AS (
 SELECT event_id, ts, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
x AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN (user_id + k + 10) % 150
                     ELSE user_id - user_id % 10 + k % 10 END AS recv FROM e)
SELECT event_id AS txn_id, ts AS txn_ts, CAST(ts AS DATE) AS txn_date,
  user_id % 7 AS from_bank, user_id AS from_account, recv % 7 AS to_bank, recv AS to_account,
  CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS payment_currency,
  CASE WHEN k % 20 = 0 THEN 'JPY' ELSE CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END END AS receiving_currency,
  value AS amount_paid, CASE WHEN k % 20 = 0 THEN value * 0.5 ELSE value END AS amount_received,
  CASE event_type WHEN 'purchase' THEN 'ACH' WHEN 'view' THEN 'Cheque' WHEN 'click' THEN 'Wire' WHEN 'error' THEN 'Cash' ELSE 'Credit Card' END AS payment_format,
  CASE WHEN (event_id % 97 = 0 AND k % 2 = 0) OR (event_type = 'purchase' AND value > 150 AND k % 4 = 0) THEN 1 ELSE 0 END AS is_laundering
FROM x
"""


def transactions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``events`` as transactions."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(EVENT_TRANSACTIONS.replace("FROM events", "FROM {events}"), events=events)


def with_planted_copies(txn: DataFrame) -> DataFrame:
    """Transactions plus a second copy of every thousandth row under a new id."""
    copies = txn.where("txn_id % 1000 = 0").selectExpr(
        "txn_id + 10000000 AS txn_id", *[c for c in txn.columns if c != "txn_id"]
    )
    return txn.unionByName(copies)
