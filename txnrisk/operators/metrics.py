"""Ranking and threshold metrics.

Inputs have one row per scored transaction with a label column of 0 and 1. Rows
are first counted per distinct score, so tied scores form one step and everything
after the first aggregation works on distinct scores. A row is predicted positive
when ``score >= threshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions.scale import running_sums, small_join
from txnrisk.session import checkpoint


def _null_if_zero(column):
    return F.nullif(column, F.lit(0).cast("long"))


def score_steps(
    df: DataFrame, score: str, label: str = "is_laundering", by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Per distinct score: rows, positives and both sums down to this score."""
    w = F.col(weight) if weight else F.lit(1)
    counts = (
        df.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.sum(w).cast("long").alias("n"), F.sum(w * F.col(label)).cast("long").alias("pos"))
    )
    return running_sums(counts, "score", ["n", "pos"], by)


def pr_auc(
    df: DataFrame, score: str, label: str = "is_laundering", by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Average precision, the sum of recall gain times precision over the steps.

    Null where there is no positive row.
    """
    return score_steps(df, score, label, by, weight).groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.sum("pos").alias("n_positive"),
        (F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / _null_if_zero(F.sum("pos")))
        .alias("pr_auc"),
    )


def roc_auc(
    df: DataFrame, score: str, label: str = "is_laundering", by: Sequence[str] = ()
) -> DataFrame:
    """Share of (positive, negative) pairs in the right order; ties count half."""
    neg = F.col("n") - F.col("pos")
    above = F.col("cum_pos") - F.col("pos")
    return score_steps(df, score, label, by).groupBy(*by).agg(
        (F.sum(neg * (above + F.col("pos") / 2))
         / _null_if_zero(F.sum("pos")) / _null_if_zero(F.sum(neg))).alias("roc_auc"),
    )


def pr_curve(
    df: DataFrame, score: str, label: str = "is_laundering", by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall and F1 at each distinct score taken as threshold."""
    steps = score_steps(df, score, label, by)
    totals = steps.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.count(F.lit(1)).alias("_w"))
    if by:
        joined = small_join(steps, checkpoint(totals), list(by), "score", "_w", null_safe=True)
    else:
        joined = steps.withColumn("all_pos", totals.select("all_pos").scalar())
    hits = F.col("cum_pos")
    return joined.select(
        *by, F.col("score").alias("threshold"), F.col("cum_n").alias("n_alerts"),
        F.col("cum_pos").alias("n_hits"),
        (hits / F.col("cum_n")).alias("precision"),
        (hits / _null_if_zero(F.col("all_pos"))).alias("recall"),
        (2 * hits / (F.col("cum_n") + F.col("all_pos"))).alias("f1"),
    )


def pick_threshold(
    validation: DataFrame, score: str, label: str = "is_laundering", by: Sequence[str] = ()
) -> DataFrame:
    """The validation score with the best F1; the highest one if several tie."""
    best = F.struct("f1", "threshold")
    return pr_curve(validation, score, label, by).groupBy(*by).agg(
        F.max_by("threshold", best).alias("threshold"), F.max("f1").alias("f1")
    )


def apply_threshold(
    df: DataFrame, score: str, threshold: DataFrame | float, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``predicted`` from a frozen threshold.

    ``threshold`` is a number, a one-row table, or with ``by`` a stored table with
    one row per group.
    """
    if not isinstance(threshold, DataFrame):
        limited = df.withColumn("_limit", F.lit(float(threshold)))
    elif by:
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_w"))
        limits = checkpoint(counts.join(threshold, list(by)).select(
            *by, "_w", F.col("threshold").alias("_limit")
        ))
        limited = small_join(df, limits, by, "txn_id", "_w", null_safe=True)
    else:
        limited = df.withColumn("_limit", threshold.select("threshold").scalar())
    return limited.withColumn("predicted", (F.col(score) >= F.col("_limit")).cast("int")).drop("_limit")


def threshold_metrics(
    predicted: DataFrame, label: str = "is_laundering", by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall and F1 of ``predicted``; accuracy only as a supplement."""
    p, y = F.col("predicted") == 1, F.col(label) == 1
    counts = predicted.groupBy(*by).agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        (tp / _null_if_zero(tp + fp)).alias("precision"),
        (tp / _null_if_zero(tp + fn)).alias("recall"),
        (2 * tp / _null_if_zero(2 * tp + fp + fn)).alias("f1"),
        ((tp + tn) / _null_if_zero(tp + fp + fn + tn)).alias("accuracy"),
    )


def confusion(predicted: DataFrame, label: str = "is_laundering", by: Sequence[str] = ()) -> DataFrame:
    """Counts per ``by`` on the full grid of predicted and actual, zero cells included."""
    counts = threshold_metrics(predicted, label, by)
    cells = F.array(*[
        F.struct(F.lit(p).alias("predicted"), F.lit(y).alias("actual"), F.col(c).alias("n"))
        for p, y, c in ((1, 1, "tp"), (1, 0, "fp"), (0, 1, "fn"), (0, 0, "tn"))
    ])
    return counts.select(*by, F.inline(cells))


def recall_at_budget(
    df: DataFrame, score: str, budget: int | None = None, share: float = 0.01,
    label: str = "is_laundering", by: Sequence[str] = (),
) -> DataFrame:
    """Recall when exactly ``budget`` transactions are alerted.

    Highest scores first, ties by ``txn_id``. Without a count the budget is a
    share of the rows. Only the step in which the budget runs out needs single
    rows, so the alerts are never gathered in one place: whole steps are counted,
    and the last step is filled by id.
    """
    keys = list(by) or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(1))
    steps = checkpoint(score_steps(df, score, label, keys))
    k = F.lit(budget) if budget is not None else F.ceil(F.round(F.sum("n") * F.lit(share), 6))
    totals = checkpoint(steps.groupBy(*keys).agg(
        k.cast("long").alias("budget"), F.sum("pos").alias("n_positive"),
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("_w"),
    ))
    fits = F.col("cum_n") <= F.col("budget")
    cut = small_join(steps, totals.drop("rows"), keys, "score", "_w", null_safe=True).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0).cast("long")).alias("n_whole"),
        F.coalesce(F.sum(F.when(fits, F.col("pos"))), F.lit(0).cast("long")).alias("pos_whole"),
        F.max(F.when(~fits, F.col("score"))).alias("edge"),
    )
    cut = checkpoint(cut.join(totals.drop("_w"), keys))
    edge = cut.select(*keys, "edge", (F.col("budget") - F.col("n_whole")).alias("room"), F.col("rows").alias("_w"))
    tied = small_join(df, edge, keys, "txn_id", "_w", null_safe=True).where(
        F.col(score) == F.col("edge")
    ).select(*keys, "txn_id", "room", F.lit(1).alias("one"), F.col(label).cast("long").alias("pos"))
    filled = (
        running_sums(tied, "txn_id", ["one"], keys, descending=False)
        .where("cum_one <= room")
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"))
    )
    none = F.lit(0).cast("long")
    hits = F.col("pos_whole") + F.coalesce("pos", none)
    return cut.join(filled, keys, "left").select(
        *by, "budget", (F.col("n_whole") + F.coalesce("n", none)).alias("n_alerts"),
        hits.alias("n_hits"), "n_positive", (hits / _null_if_zero(F.col("n_positive"))).alias("recall"),
    )


def unpivot_scores(df: DataFrame, scores: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per transaction and model: ``keep``, ``model``, ``score``."""
    pairs = F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in scores.items()
    ])
    return df.select(*keep, F.inline(pairs))


def pr_auc_delta(
    df: DataFrame, score_1: str, score_2: str, label: str = "is_laundering",
    by: Sequence[str] = (),
) -> DataFrame:
    """Average precision of both models and the headline difference, in one pass."""
    long = unpivot_scores(df, {"m1": score_1, "m2": score_2}, [*by, label])
    aucs = pr_auc(long, "score", label, [*by, "model"])
    return aucs.groupBy(*by).agg(
        F.max("n_rows").alias("n_rows"), F.max("n_positive").alias("n_positive"),
        F.max(F.when(F.col("model") == "m1", F.col("pr_auc"))).alias("pr_auc_m1"),
        F.max(F.when(F.col("model") == "m2", F.col("pr_auc"))).alias("pr_auc_m2"),
    ).withColumn("delta", F.col("pr_auc_m2") - F.col("pr_auc_m1"))


def hard_subset(df: DataFrame) -> DataFrame:
    """Transactions without the strong shortcuts: ACH, no self-loop, no currency change."""
    return df.where("payment_format = 'ACH' AND t_is_self_loop = 0 AND t_is_fx = 0")
