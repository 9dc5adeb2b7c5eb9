"""Account history strictly before the day of a transaction (group A)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.functions.days import before_day, day_number
from txnrisk.functions.scale import salted_join
from txnrisk.session import checkpoint


def _ends(txn: DataFrame) -> DataFrame:
    """Each transaction once for its sender and once for its receiver.

    A self-loop counts in both roles.
    """
    z = F.col("t_amount_z_in_currency")
    nothing = F.lit(None).cast("double")
    return txn.select(
        "txn_date", "payment_format",
        F.explode(F.array(
            F.struct(F.col("src").alias("node_id"), F.lit(1).alias("out"), F.lit(0).alias("in"),
                     z.alias("z_out"), nothing.alias("z_in")),
            F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("out"), F.lit(1).alias("in"),
                     nothing.alias("z_out"), z.alias("z_in")),
        )).alias("e"),
    ).select("e.*", "txn_date", "payment_format")


def _account_format_day(txn: DataFrame) -> DataFrame:
    """Activity per (node, day, format), placed by node.

    The first aggregation combines before its shuffle, so the second shuffle
    moves at most days x formats rows per node and everything after it that is
    keyed by node needs no further shuffle.
    """
    per_format = _ends(txn).groupBy("node_id", "txn_date", "payment_format").agg(
        F.sum("out").alias("n_out"), F.sum("in").alias("n_in"),
        F.sum("z_out").alias("sum_z_out"), F.sum("z_in").alias("sum_z_in"),
        F.max("z_out").alias("max_z_out"),
    )
    return per_format.repartition("node_id")


def account_day(txn: DataFrame) -> DataFrame:
    """The spine: one row per node and day on which the node is active.

    ``n_new_formats`` counts the formats that the node uses for the first time.
    """
    first_use = F.min("txn_date").over(Window.partitionBy("node_id", "payment_format"))
    is_new = F.col("payment_format").isNotNull() & (F.col("txn_date") == first_use)
    return (
        _account_format_day(txn)
        .withColumn("_new", is_new.cast("int"))
        .groupBy("node_id", F.col("txn_date").alias("feature_date"))
        .agg(
            F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"),
            F.sum("sum_z_out").alias("sum_z_out"), F.sum("sum_z_in").alias("sum_z_in"),
            F.max("max_z_out").alias("max_z_out"),
            F.sum("_new").alias("n_new_formats"),
        )
    )


def account_history(txn: DataFrame, first_date: dt.date) -> DataFrame:
    """The eight history features of every active (node, day), before defaults.

    ``txn`` has ``src``, ``dst`` and ``t_amount_z_in_currency``; ``first_date`` is
    the first day of the dataset. Features without any history are null.
    """
    days = account_day(txn).withColumn("day", day_number("feature_date"))
    w = before_day("node_id")
    elapsed = F.nullif(F.col("day") - day_number(F.lit(first_date)), F.lit(0))
    none = F.lit(0).cast("long")
    prior_out = F.coalesce(F.sum("n_out").over(w), none)
    prior_in = F.coalesce(F.sum("n_in").over(w), none)
    return days.select(
        "node_id", "feature_date",
        F.col("n_out").alias("n_out_today"), F.col("n_in").alias("n_in_today"),
        (prior_out / elapsed).alias("n_out_rate"),
        (prior_in / elapsed).alias("n_in_rate"),
        (F.sum("sum_z_out").over(w) / F.nullif(prior_out, none)).alias("mean_z_out"),
        (F.sum("sum_z_in").over(w) / F.nullif(prior_in, none)).alias("mean_z_in"),
        F.max("max_z_out").over(w).alias("max_z_out"),
        (F.count("day").over(w) / elapsed).alias("days_active_frac"),
        (F.col("day") - F.max("day").over(w)).cast("long").alias("days_since_last"),
        F.sum("n_new_formats").over(w).alias("fmt_diversity"),
        F.max("day").over(w).isNotNull().cast("int").alias("has_history"),
    )


def fill_cold_start(history: DataFrame) -> DataFrame:
    """Defaults where an account has no history: -1 days since, 0 for the rest."""
    fills = {
        name: F.coalesce(
            F.col(name).cast("double"), F.lit(-1.0 if name == "days_since_last" else 0.0)
        )
        for name in S.ACCOUNT_HISTORY
    }
    return history.withColumns(fills)


def attach_by_node_day(txn: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Put node-day columns on each transaction, for sender and receiver.

    Both joins are on equality of node and day: ``table`` has a row for every day
    on which a node is active, so no as-of join is needed. ``n_out_today`` and
    ``n_in_today`` tell the join which keys to split.
    """
    table = checkpoint(table.select("node_id", "feature_date", "n_out_today", "n_in_today", *columns))
    sides = {"s": ("src", "n_out_today"), "r": ("dst", "n_in_today")}
    for prefix, (end, weight) in sides.items():
        side = table.select(
            F.col("node_id").alias(end), F.col("feature_date").alias("txn_date"),
            F.col(weight).alias("_rows"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in columns],
        )
        txn = salted_join(txn, side, [end, "txn_date"], "txn_id", "_rows", stored=True)
    return txn


def attach_account_history(txn: DataFrame, history: DataFrame) -> DataFrame:
    """Sixteen history columns and the two ``has_history`` flags."""
    return attach_by_node_day(txn, fill_cold_start(history), [*S.ACCOUNT_HISTORY, "has_history"])
