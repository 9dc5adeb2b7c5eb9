"""The tables behind the result pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.functions.days import day_number
from txnrisk.functions.scale import counted_keys, running_sums, salted_join, stack
from txnrisk.operators import bootstrap
from txnrisk.operators.components import component_summary
from txnrisk.operators.metrics import pr_auc, roc_auc
from txnrisk.session import checkpoint


def variant_comparison(results: DataFrame, value: str = "pr_auc") -> DataFrame:
    """One row per model with the full and the no-shortcut value side by side."""
    wide = results.groupBy("model").pivot("variant", ["full", "no_shortcut"]).agg(F.avg(value))
    return wide.withColumn("drop", F.col("full") - F.col("no_shortcut"))


def shortcut_table(matrix: DataFrame) -> DataFrame:
    """Rows, share, positive rate and lift per value of each suspected shortcut."""
    names = ["t_payment_format", "t_cur_paid", "t_is_fx", "t_is_self_loop"]
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in names
    ] + [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("long").cast("string").alias("value"))
        for c in S.SHORTCUTS if c not in names
    ]
    counts = (
        matrix.select("is_laundering", F.inline(F.array(*pairs)))
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("is_laundering").alias("n_positive"))
    )
    totals = counts.where(F.col("feature") == names[0]).agg(
        F.sum("n_rows").alias("n"), F.sum("n_positive").alias("p")
    )
    rate = F.col("n_positive") / F.col("n_rows")
    return counts.withColumns({
        "_n": totals.select("n").scalar(), "_p": totals.select("p").scalar(),
    }).select(
        "feature", "value", "n_rows", "n_positive",
        (F.col("n_rows") / F.col("_n")).alias("row_share"),
        rate.alias("positive_rate"),
        (rate / F.nullif(F.col("_p") / F.col("_n"), F.lit(0.0))).alias("lift"),
    )


def period_metrics(scored: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Rows, prevalence, average precision and ROC-AUC per period and score column."""
    long = scored.select(
        "period", "is_laundering",
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("model"), F.col(c).alias("score")) for c in scores
        ])),
    )
    by = ["period", "model"]
    return (
        pr_auc(long, "score", by=by).join(roc_auc(long, "score", by=by), by)
        .withColumn("prevalence", F.col("n_positive") / F.col("n_rows"))
    )


def feature_drift(
    matrix: DataFrame, features: Sequence[str], base: str = "train", against: str = "tail",
    bins: int = 10,
) -> DataFrame:
    """Population stability index per numeric feature between two periods.

    Bin limits are exact quantiles of the base period: the smallest value whose
    running share reaches i / bins. They come from counts per distinct value, so
    no task holds all values of a feature. Empty bins count as 1e-6.
    """
    values = (
        matrix.where(F.col("period").isin(base, against))
        .select("period", F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features
        ])))
        .where("x IS NOT NULL")
        .groupBy("feature", "x")
        .agg(
            F.count_if(F.col("period") == base).alias("n_base"),
            F.count_if(F.col("period") == against).alias("n_against"),
        )
    )
    ranked = running_sums(values, "x", ["n_base"], ["feature"], descending=False)
    totals = values.groupBy("feature").agg(
        F.sum("n_base").alias("all_base"), F.sum("n_against").alias("all_against")
    )
    # one row per feature
    ranked = ranked.join(F.broadcast(totals), "feature")
    # A value belongs to the bin of the first limit that is not below it, and the
    # limits are quantiles, so its bin follows from the counts before it.
    before = F.col("cum_n_base") - F.col("n_base")
    bin_of = F.least(F.lit(bins - 1), F.floor(before * bins / F.col("all_base")))
    shares = ranked.where("all_base > 0").groupBy("feature", bin_of.alias("bin")).agg(
        F.sum("n_base").alias("n_base"), F.sum("n_against").alias("n_against"),
        F.max("all_base").alias("all_base"), F.max("all_against").alias("all_against"),
    )
    p = F.greatest(F.col("n_base") / F.col("all_base"), F.lit(1e-6))
    q = F.greatest(F.col("n_against") / F.nullif(F.col("all_against"), F.lit(0).cast("long")), F.lit(1e-6))
    return shares.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.max("all_base").alias("n_base"), F.max("all_against").alias("n_against"),
        F.sum((q - p) * F.log(q / p)).alias("psi"),
    )


def network_stats(edges: DataFrame, last_date, components: DataFrame | None = None) -> DataFrame:
    """Nodes, edges, components and share of the largest one per snapshot.

    Counts are running sums of first appearances per date: the calendar bounds
    the rows of the window.
    """
    new_edges = edges.groupBy(F.col("first_date").alias("d")).agg(F.count(F.lit(1)).alias("e"))
    new_nodes = (
        edges.select("first_date", F.explode(F.array("src", "dst")).alias("node_id"))
        .groupBy("node_id").agg(F.min("first_date").alias("d"))
        .groupBy("d").agg(F.count(F.lit(1)).alias("v"))
    )
    fresh = stack([
        new_edges.select("d", "e", F.lit(0).cast("long").alias("v")),
        new_nodes.select("d", F.lit(0).cast("long").alias("e"), "v"),
    ]).groupBy("d").agg(F.sum("e").alias("e"), F.sum("v").alias("v"))
    # every later date sees the addition; rows: dates x dates
    seen = fresh.where(F.col("d") < F.lit(last_date)).withColumn("feature_date", F.explode(
        F.sequence(F.date_add("d", 1), F.lit(last_date))
    )).groupBy("feature_date").agg(F.sum("v").alias("n_nodes"), F.sum("e").alias("n_edges"))
    components = components if components is not None else component_summary(edges, last_date)
    return seen.join(components, "feature_date").select(
        "feature_date", "n_nodes", "n_edges", "n_components", "largest",
        (F.col("largest") / F.col("n_nodes")).alias("largest_share"),
    )


def degree_distribution(edges: DataFrame) -> DataFrame:
    """Number of nodes per in-degree and per out-degree."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.lit("out").alias("direction"), F.col("src").alias("node_id")),
        F.struct(F.lit("in").alias("direction"), F.col("dst").alias("node_id")),
    )).alias("e")).select("e.*")
    return (
        ends.groupBy("direction", "node_id").agg(F.count(F.lit(1)).alias("degree"))
        .groupBy("direction", "degree").agg(F.count(F.lit(1)).alias("n_nodes"))
    )


def new_pair_analysis(txn: DataFrame, pair: DataFrame) -> DataFrame:
    """Volume and positive rate of new and of known pairs per day; no self-loops."""
    return (
        txn.where("src <> dst").join(pair, "txn_id")
        .groupBy("txn_date", "g_pair_seen_before")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("is_laundering").alias("n_positive"))
        .withColumn("positive_rate", F.col("n_positive") / F.col("n_rows"))
    )


def suspicious_subgraph(edges: DataFrame, flagged: DataFrame, hops: int = 1) -> DataFrame:
    """Snapshot edges within ``hops`` of the flagged transactions of each date.

    ``flagged`` has ``src``, ``dst`` and ``txn_date``; an edge is at hop h when one
    of its ends is h - 1 steps from a flagged end. Only edges known before the date
    are followed. ``edges`` should be a checkpoint or a table.
    """
    ends = edges.select(
        "src", "dst", "first_date", F.explode(F.array("src", "dst")).alias("node_id")
    )
    reached = checkpoint(
        flagged.select("txn_date", F.explode(F.array("src", "dst")).alias("node_id"))
        .select(F.col("txn_date").alias("feature_date"), "node_id").distinct()
        .withColumn("hop", F.lit(0))
    )
    found = None
    for hop in range(1, hops + 1):
        frontier = reached.where(F.col("hop") == hop - 1).select("node_id", "feature_date")
        # dates per frontier node as an array (at most one entry per calendar day),
        # so that the frontier has one row per key and a hub's edges can be split
        dates = frontier.groupBy("node_id").agg(F.collect_set("feature_date").alias("dates"))
        # degrees first: the join then has one row per node on both sides
        degree = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("_w")).join(dates, "node_id")
        step = (
            salted_join(ends, degree, ["node_id"], ["src", "dst"], "_w", "inner")
            .withColumn("feature_date", F.explode("dates"))
            .where("first_date < feature_date")
            .select("feature_date", "src", "dst", "first_date", F.lit(hop).alias("hop"))
            .distinct()
        )
        step = checkpoint(step)
        found = step if found is None else found.unionByName(step)
        if hop < hops:
            nodes = step.select(
                "feature_date", F.explode(F.array("src", "dst")).alias("node_id"), "hop"
            ).distinct()
            reached = checkpoint(
                reached.unionByName(nodes).groupBy("feature_date", "node_id")
                .agg(F.min("hop").alias("hop"))
            )
    return found.groupBy("feature_date", "src", "dst").agg(
        F.min("first_date").alias("first_date"), F.min("hop").alias("hop")
    )


def gains(
    scores: DataFrame, replicates: int = 200, seed: int = 42, confidence: float = 0.95, label: str = "is_laundering",
) -> DataFrame:
    """M2 against M1 per variant and seed: average precisions, difference and paired bootstrap interval.

    ``scores`` has a row per transaction, model, variant and seed, as ``run_grid`` gives
    them for one period. A group without positives keeps its row, with nulls.
    """
    by = ["variant", "seed"]
    long = scores.select("txn_id", label, *by, F.lower("model").alias("model"), "score")
    point = pr_auc(long, "score", label, [*by, "model"]).groupBy(*by).agg(
        F.max("n_rows").alias("n_rows"), F.max("n_positive").alias("n_positive"),
        *[F.max(F.when(F.col("model") == m, F.col("pr_auc"))).alias(f"pr_auc_{m}") for m in ("m1", "m2")],
    ).withColumn("delta", F.col("pr_auc_m2") - F.col("pr_auc_m1"))
    drawn = bootstrap.long_replicates(long, replicates, seed, label, by)
    return point.join(bootstrap.delta_interval(drawn, confidence, by), by, "left")  # a row per variant and seed


def gain_summary(found: DataFrame) -> DataFrame:
    """``gains`` over all seeds of a variant: mean and range, and how many intervals lie above zero."""
    return found.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("delta").alias("mean"),
        F.min("delta").alias("lowest"), F.max("delta").alias("highest"),
        F.min("ci_low").alias("lowest_ci_low"), F.max("ci_high").alias("highest_ci_high"),
        F.count(F.when(F.col("ci_low") > 0, 1)).alias("n_above_zero"),
    )


def overview(summary: DataFrame, delta: DataFrame, interval: DataFrame) -> DataFrame:
    """Dataset summary, headline difference and interval as (item, value) rows."""
    def rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in names
        ])))

    return stack([
        rows(summary, ["n_rows", "n_positive", "prevalence", "n_columns", "n_exact_duplicates"]),
        rows(delta, ["pr_auc_m1", "pr_auc_m2", "delta"]),
        rows(interval, ["n_replicates", "ci_low", "ci_high"]),
    ])


def inspector(scored: DataFrame, top: DataFrame) -> DataFrame:
    """Test transactions with both scores, outcome and strongest features.

    ``scored`` carries ``m1_predicted`` and ``m2_predicted``; ``top`` has one row per
    transaction.
    """
    return scored.where("period = 'test'").select(
        "txn_id", "txn_date", "src", "dst", "payment_format", "payment_currency", "amount_paid",
        "m1_score", "m2_score", "m1_predicted", "m2_predicted",
        F.col("is_laundering").alias("actual"),
    ).join(top, "txn_id", "left")
