"""Features of the transaction alone (model M1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions.scale import small_join


def amount_z(txn: DataFrame, amount_stats: DataFrame) -> DataFrame:
    """Add ``t_log_amount_paid`` and ``t_amount_z_in_currency``.

    ``amount_stats`` comes from ``fit_amount_stats``; pass a checkpoint or a
    written table. A currency without a usable deviation takes the values over
    all training rows; if those have no deviation either, z is 0.
    """
    overall = amount_stats.where("payment_currency IS NULL")
    mean_all = overall.select(F.max("mean_log")).scalar()
    sd_all = overall.select(F.max("sd_log")).scalar()
    usable = amount_stats.where("payment_currency IS NOT NULL AND sd_log > 0").select(
        "payment_currency", F.col("mean_log").alias("_mean"), F.col("sd_log").alias("_sd"),
        # rows of this currency, as an estimate of its share of any other slice
        (F.col("n") * 100).alias("_n"),
    )
    joined = small_join(
        txn.withColumn("t_log_amount_paid", F.log1p("amount_paid")),
        usable, ["payment_currency"], "txn_id", "_n",
    ).withColumn("_sd_all", sd_all).withColumn("_mean_all", mean_all)
    z = F.when(
        F.col("_sd").isNotNull(), (F.col("t_log_amount_paid") - F.col("_mean")) / F.col("_sd")
    ).when(
        F.col("_sd_all") > 0, (F.col("t_log_amount_paid") - F.col("_mean_all")) / F.col("_sd_all")
    ).otherwise(0.0)
    return joined.withColumn("t_amount_z_in_currency", z).drop("_mean", "_sd", "_mean_all", "_sd_all")


def txn_features(txn: DataFrame, amount_stats: DataFrame) -> DataFrame:
    """One row in, one row out, with the eight M1 features added."""
    self_loop = (F.col("from_bank") == F.col("to_bank")) & (
        F.col("from_account") == F.col("to_account")
    )
    return amount_z(txn, amount_stats).withColumns({
        "t_payment_format": F.col("payment_format"),
        "t_cur_paid": F.col("payment_currency"),
        "t_is_fx": (F.col("payment_currency") != F.col("receiving_currency")).cast("int"),
        "t_is_self_loop": self_loop.cast("int"),
        "t_same_bank": (F.col("from_bank") == F.col("to_bank")).cast("int"),
        "t_hour": F.hour("txn_ts"),
    })
