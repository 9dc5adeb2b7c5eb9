"""Paired bootstrap of the difference in average precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.metrics import pr_auc, unpivot_scores

# Cumulative Poisson(1) probabilities; the weight of a draw is the
# number of bounds that do not exceed it.
POISSON_BOUNDS = [
    0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153,
    0.999405815, 0.999916759, 0.999989751, 0.999998875,
]


def uniform_draw(seed: int, replicate: Column, row_id: Column) -> Column:
    """Draw in [0, 1) of a row; the same for every model, engine and retry."""
    text = F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), row_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_weight(draw: Column) -> Column:
    """Number of times a row with this draw is in the resample."""
    weight = F.lit(0)
    for bound in POISSON_BOUNDS:
        weight = weight + (draw >= bound).cast("int")
    return weight


def bootstrap_replicates(
    df: DataFrame, score_1: str, score_2: str, replicates: int = 200, seed: int = 42,
    label: str = "is_laundering",
) -> DataFrame:
    """Both average precisions and their difference per replicate."""
    long = unpivot_scores(df, {"m1": score_1, "m2": score_2}, ["txn_id", label])
    return long_replicates(long, replicates, seed, label)


def long_replicates(
    long: DataFrame, replicates: int = 200, seed: int = 42, label: str = "is_laundering", by: Sequence[str] = (),
) -> DataFrame:
    """The same per ``by`` and replicate, from rows of ``by``, txn_id, label, model (m1 or m2) and score.

    A transaction has the same weight in all groups of a replicate. Rows are first placed by (model, score, id), so that a task sees few distinct
    scores and its partial sums per (replicate, model, score) stay small: the rows
    are shuffled once, not once per replicate, and a score shared by many rows is
    still spread by id. Weight-0 rows leave before the aggregation. Scores should
    be rounded (the models here give six digits), because the sums grow with the
    number of distinct scores.
    """
    # an explicit number keeps the small input of this stage from being merged into
    # a few tasks: the stage multiplies its rows by the number of replicates
    spark = long.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = long.repartitionByRange(tasks, *by, "model", "score", "txn_id")
    drawn = (
        placed.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        # as a generator, the draw is computed once and not again inside the filter
        .withColumn("draw", F.explode(F.array(uniform_draw(seed, F.col("replicate"), F.col("txn_id")))))
        .where(F.col("draw") >= POISSON_BOUNDS[0])
        .withColumn("weight", poisson_weight(F.col("draw")))
    )
    aucs = pr_auc(drawn, "score", label, [*by, "replicate", "model"], "weight")
    return aucs.groupBy(*by, "replicate").agg(
        F.max(F.when(F.col("model") == "m1", F.col("pr_auc"))).alias("pr_auc_m1"),
        F.max(F.when(F.col("model") == "m2", F.col("pr_auc"))).alias("pr_auc_m2"),
    ).withColumn("delta", F.col("pr_auc_m2") - F.col("pr_auc_m1"))


def paired_bootstrap(
    df: DataFrame, score_1: str, score_2: str, replicates: int = 200, seed: int = 42,
    label: str = "is_laundering", confidence: float = 0.95,
) -> DataFrame:
    """Percentile interval of the difference; replicates without positives drop out."""
    return delta_interval(bootstrap_replicates(df, score_1, score_2, replicates, seed, label), confidence)


def delta_interval(drawn: DataFrame, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of the replicates per ``by``; a group has one row per replicate."""
    tail = (1 - confidence) / 2
    return drawn.where("delta IS NOT NULL").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_replicates"),
        F.avg("delta").alias("mean_delta"),
        F.percentile("delta", F.lit(tail)).alias("ci_low"),
        F.percentile("delta", F.lit(1 - tail)).alias("ci_high"),
    )
