"""Chronological split and the statistics fitted on the training period."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.config import Config
from txnrisk.functions.days import first_and_last_date


@dataclasses.dataclass(frozen=True)
class Bounds:
    """First day of each period after the warm-up; ``first`` is day 1 of the data."""

    first: dt.date
    train: dt.date
    validation: dt.date
    test: dt.date
    tail: dt.date


def period_bounds(first: dt.date, config: Config = Config()) -> Bounds:
    """Period limits counted from the first date of the data."""
    starts = [first]
    for length in (config.warmup_days, config.train_days, config.validation_days, config.test_days):
        starts.append(starts[-1] + dt.timedelta(days=length))
    return Bounds(*starts)


def find_bounds(txn: DataFrame, config: Config = Config()) -> Bounds:
    """Period limits of a dataset."""
    return period_bounds(first_and_last_date(txn)[0], config)


def assign_period(txn: DataFrame, bounds: Bounds) -> DataFrame:
    """Add ``period``; a pure projection, never a random split."""
    d = F.col("txn_date")
    period = (
        F.when(d < F.lit(bounds.train), "warmup")
        .when(d < F.lit(bounds.validation), "train")
        .when(d < F.lit(bounds.test), "validation")
        .when(d < F.lit(bounds.tail), "test")
        .otherwise("tail")
    )
    return txn.withColumn("period", period)


def in_period(bounds: Bounds, period: str) -> Column:
    """Date condition of a period; on literals, so it prunes day partitions."""
    limits = {
        "warmup": (bounds.first, bounds.train),
        "train": (bounds.train, bounds.validation),
        "validation": (bounds.validation, bounds.test),
        "test": (bounds.test, bounds.tail),
        "tail": (bounds.tail, None),
    }
    start, end = limits[period]
    cond = F.col("txn_date") >= F.lit(start)
    return cond if end is None else cond & (F.col("txn_date") < F.lit(end))


def only_period(txn: DataFrame, bounds: Bounds, period: str = "test") -> DataFrame:
    """Rows of one period, by default the one that headline numbers come from."""
    return txn.where(in_period(bounds, period))


def period_summary(txn: DataFrame) -> DataFrame:
    """Rows and positives per period."""
    return txn.groupBy("period").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("is_laundering").alias("n_positive"),
        F.min("txn_date").alias("first_date"),
        F.max("txn_date").alias("last_date"),
    )


def fit_amount_stats(txn: DataFrame, bounds: Bounds) -> DataFrame:
    """Mean and sample deviation of the log amount per currency, from train only.

    The row without a currency holds the values over all training rows, used for
    currencies that are unseen or constant in training.
    """
    log_amount = F.log1p("amount_paid")
    per_currency = (
        only_period(txn, bounds, "train")
        .groupBy("payment_currency")
        .agg(
            F.count(log_amount).alias("n"),
            F.avg(log_amount).alias("mean_log"),
            F.stddev_samp(log_amount).alias("sd_log"),
        )
        .where("payment_currency IS NOT NULL")
    )
    overall = only_period(txn, bounds, "train").agg(
        F.lit(None).cast("string").alias("payment_currency"),
        F.count(log_amount).alias("n"),
        F.avg(log_amount).alias("mean_log"),
        F.stddev_samp(log_amount).alias("sd_log"),
    )
    return per_currency.unionByName(overall)


def scale_pos_weight(txn: DataFrame, bounds: Bounds) -> DataFrame:
    """Negatives per positive in train, the weight of a positive row."""
    n_pos = F.sum("is_laundering")
    n = F.count("is_laundering")
    return only_period(txn, bounds, "train").agg(
        (n - n_pos).alias("n_negative"),
        n_pos.alias("n_positive"),
        ((n - n_pos) / F.nullif(n_pos, F.lit(0))).alias("scale_pos_weight"),
    )
