"""Leakage checks as operators. Each returns violations; empty means passed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.functions.scale import salted_join, stack
from txnrisk.operators.split import Bounds, fit_amount_stats, in_period, scale_pos_weight


def keyed_diff(
    a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 1e-9
) -> DataFrame:
    """Cells that differ between two tables with the same unique keys.

    ``(keys as text, column_name, value_a, value_b)``; a row that only one side has
    differs in ``row``. Numbers may differ by ``tolerance``, since sums depend on
    the order of addition.
    """
    columns = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*columns).alias("_a"))
    right = b.select(*keys, F.struct(*columns).alias("_b"))
    types = dict(a.dtypes)
    # null keys compare equal, as in the table of amount statistics
    joined = left.alias("l").join(
        right.alias("r"),
        on=[F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], how="full",
    )
    cells = [F.struct(
        F.lit("row").alias("column_name"),
        F.col("_a").isNotNull().cast("string").alias("value_a"),
        F.col("_b").isNotNull().cast("string").alias("value_b"),
        (F.col("_a").isNull() != F.col("_b").isNull()).alias("differs"),
    )]
    for c in columns:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        differs = ~x.eqNullSafe(y)
        if types[c] in ("double", "float"):
            close = F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x))
            differs = differs & ~F.coalesce(close, F.lit(False))
        cells.append(F.struct(
            F.lit(c).alias("column_name"), x.cast("string").alias("value_a"),
            y.cast("string").alias("value_b"),
            (F.col("_a").isNotNull() & F.col("_b").isNotNull() & differs).alias("differs"),
        ))
    key = F.concat_ws("/", *[
        F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).cast("string") for k in keys
    ])
    return joined.select(key.alias("row_key"), F.inline(F.array(*cells))).where("differs").drop("differs")


def recomputed_history(txn: DataFrame, first_date: dt.date, last_date: dt.date) -> DataFrame:
    """Account history without windows, for comparison with ``account_history``.

    Each account-day is passed on to every later date and summed there with a plain
    aggregation. It is the slower form (account-days x dates) and shares no history
    code with the feature.
    """
    ends = stack([
        txn.select(F.col("src").alias("node_id"), "txn_date", "payment_format",
                   F.col("t_amount_z_in_currency").alias("z_out"), F.lit(None).cast("double").alias("z_in")),
        txn.select(F.col("dst").alias("node_id"), "txn_date", "payment_format",
                   F.lit(None).cast("double").alias("z_out"), F.col("t_amount_z_in_currency").alias("z_in")),
    ])
    later = F.explode(F.sequence(F.date_add("txn_date", 1), F.lit(last_date)))
    days = ends.where(F.col("txn_date") < F.lit(last_date)).groupBy("node_id", "txn_date").agg(
        F.count("z_out").alias("n_out"), F.count("z_in").alias("n_in"),
        F.sum("z_out").alias("s_out"), F.sum("z_in").alias("s_in"), F.max("z_out").alias("m_out"),
    ).withColumn("feature_date", later)
    elapsed = F.datediff("feature_date", F.lit(first_date))
    sums = days.groupBy("node_id", "feature_date").agg(
        (F.sum("n_out")).alias("n_out"), F.sum("n_in").alias("n_in"),
        F.sum("s_out").alias("s_out"), F.sum("s_in").alias("s_in"), F.max("m_out").alias("max_z_out"),
        F.count(F.lit(1)).alias("n_days"), F.max("txn_date").alias("last_day"),
    )
    formats = (
        ends.where(F.col("payment_format").isNotNull() & (F.col("txn_date") < F.lit(last_date)))
        .groupBy("node_id", "payment_format").agg(F.min("txn_date").alias("txn_date"))
        .withColumn("feature_date", later)
        .groupBy("node_id", "feature_date").agg(F.count(F.lit(1)).alias("fmt_diversity"))
    )
    return sums.join(formats, ["node_id", "feature_date"], "left").select(
        "node_id", "feature_date",
        (F.col("n_out") / elapsed).alias("n_out_rate"), (F.col("n_in") / elapsed).alias("n_in_rate"),
        (F.col("s_out") / F.nullif("n_out", F.lit(0).cast("long"))).alias("mean_z_out"),
        (F.col("s_in") / F.nullif("n_in", F.lit(0).cast("long"))).alias("mean_z_in"),
        "max_z_out", (F.col("n_days") / elapsed).alias("days_active_frac"),
        F.datediff("feature_date", "last_day").cast("long").alias("days_since_last"),
        F.coalesce("fmt_diversity", F.lit(0)).alias("fmt_diversity"),
    )


def strict_date_audit(
    txn: DataFrame, history: DataFrame, first_date: dt.date, last_date: dt.date
) -> DataFrame:
    """Cells of ``history`` that differ from the recomputation, over all rows."""
    keys = ["node_id", "feature_date"]
    with_history = history.where("has_history = 1").select(*keys, *S.ACCOUNT_HISTORY)
    expected = recomputed_history(txn, first_date, last_date).join(
        history.select(*keys), keys, "left_semi"
    )
    return keyed_diff(with_history, expected.select(*with_history.columns), keys)


def recomputed_pairs(txn: DataFrame) -> DataFrame:
    """Pair features per transaction without windows or edges.

    Days of a pair meet the days before them in a join on the pair with ``<`` on the
    date; both sides have one row per (pair, day), so a pair brings at most dates
    squared pairs of rows, however many transactions it has.
    """
    days = txn.where("src <> dst").groupBy("src", "dst", "txn_date").agg(F.count(F.lit(1)).alias("n"))

    def before(a: str, b: str) -> DataFrame:
        then = days.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("txn_date").alias("then"), "n")
        return (
            days.drop("n").join(then, ["src", "dst"]).where("then < txn_date")
            .groupBy("src", "dst", "txn_date").agg(F.sum("n").alias("n"))
        )

    keys = ["src", "dst", "txn_date"]
    known = days.withColumnRenamed("n", "rows").join(before("src", "dst"), keys, "left").join(
        before("dst", "src").withColumnRenamed("n", "reverse"), keys, "left"
    )
    joined = salted_join(txn.select("txn_id", *keys), known, keys, "txn_id", "rows")
    return joined.select(
        "txn_id",
        F.coalesce(F.col("n") > 0, F.lit(False)).cast("int").alias("g_pair_seen_before"),
        F.log1p(F.coalesce("n", F.lit(0))).alias("g_pair_prior_count_log"),
        F.coalesce(F.col("reverse") > 0, F.lit(False)).cast("int").alias("g_reverse_pair_seen"),
    )


def pair_audit(txn: DataFrame, pair: DataFrame) -> DataFrame:
    """Cells of the pair table that differ from the recomputation, over all rows."""
    return keyed_diff(pair.select("txn_id", *S.PAIR_HISTORY), recomputed_pairs(txn), ["txn_id"])


def counterparty_audit(txn: DataFrame, node_day: DataFrame) -> DataFrame:
    """Counterparty cells of the node-day table that differ from a recomputation.

    First meetings come straight from the transactions and meet the node's days in
    a join with ``<`` on the date, after being counted per (node, day).
    """
    pairs = txn.where("src <> dst").groupBy("src", "dst").agg(F.min("txn_date").alias("first"))
    met = stack([
        pairs.select(F.col("src").alias("node_id"), "first", F.lit(1).alias("o"), F.lit(0).alias("i")),
        pairs.select(F.col("dst").alias("node_id"), "first", F.lit(0).alias("o"), F.lit(1).alias("i")),
    ]).groupBy("node_id", "first").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    keys = ["node_id", "feature_date"]
    known = node_day.select(*keys).join(met, "node_id").where("first < feature_date").groupBy(*keys).agg(
        F.sum("o").alias("o"), F.sum("i").alias("i")
    )
    zero = F.lit(0).cast("long")
    expected = node_day.select(*keys).join(known, keys, "left").select(
        *keys,
        F.log1p(F.coalesce("o", zero)).alias("n_unique_out_log"),
        F.log1p(F.coalesce("i", zero)).alias("n_unique_in_log"),
        (F.coalesce("o", zero) > 0).cast("int").alias("has_sent_before"),
        (F.coalesce("i", zero) > 0).cast("int").alias("has_received_before"),
    )
    return keyed_diff(node_day.select(*expected.columns), expected, keys)


def require_none(checks: Mapping[str, DataFrame]) -> None:
    """Raise when a check has violations; names the check and a few of its cells."""
    for name, found in checks.items():
        some = found.limit(5).collect()
        if some:
            raise RuntimeError(f"leakage check {name}: {[r.asDict() for r in some]}")


def repeat_from(txn: DataFrame, date: dt.date) -> DataFrame:
    """All rows, and those on or after ``date`` once more under negative ids.

    Counts of the day itself double, so a feature that sees its own day moves.
    """
    again = txn.where(F.col("txn_date") >= F.lit(date)).withColumn("txn_id", -1 - F.col("txn_id"))
    return txn.unionByName(again)


def alter_from(txn: DataFrame, date: dt.date) -> DataFrame:
    """Change amounts, formats and directions of all rows on or after ``date``.

    Who is active on which day stays the same, so feature tables keep their keys.
    """
    later = F.col("txn_date") >= F.lit(date)
    swapped = {
        a: F.when(later, F.col(b)).otherwise(F.col(a))
        for a, b in (("from_bank", "to_bank"), ("to_bank", "from_bank"),
                     ("from_account", "to_account"), ("to_account", "from_account"),
                     ("src", "dst"), ("dst", "src"))
        if a in txn.columns
    }
    return txn.withColumns({
        **swapped,
        "amount_paid": F.when(later, F.col("amount_paid") * 7 + 3).otherwise(F.col("amount_paid")),
        "payment_format": F.when(later, F.lit("altered")).otherwise(F.col("payment_format")),
    })


def future_perturbation(
    txn: DataFrame, date: dt.date, build: Callable[[DataFrame], DataFrame], keys: Sequence[str],
    date_column: str = "feature_date",
    alter: Callable[[DataFrame, dt.date], DataFrame] = alter_from,
    baseline: DataFrame | None = None,
) -> DataFrame:
    """Features up to ``date`` that move when rows on or after ``date`` are altered.

    ``build`` must not fit statistics on its input; hold them fixed. ``baseline`` is
    the table that ``build`` made of the real rows, if it is stored already.
    """
    def upto(df: DataFrame) -> DataFrame:
        return df.where(F.col(date_column) <= F.lit(date))

    real = build(txn) if baseline is None else baseline
    return keyed_diff(upto(real), upto(build(alter(txn, date))), keys)


def label_invariance(
    txn: DataFrame, build: Callable[[DataFrame], DataFrame], keys: Sequence[str]
) -> DataFrame:
    """Features that move when every label is flipped."""
    flipped = txn.withColumn("is_laundering", (1 - F.col("is_laundering")).cast("int"))
    return keyed_diff(build(txn), build(flipped), keys)


def train_only_statistics(txn: DataFrame, bounds: Bounds, fitted: Bounds | None = None) -> DataFrame:
    """Fitted statistics that move when all rows outside train are altered.

    ``fitted`` are the bounds that the fit uses, if they are not those of the run.
    """
    fitted = fitted or bounds
    outside = ~in_period(bounds, "train")
    altered = txn.withColumns({
        "amount_paid": F.when(outside, F.col("amount_paid") * 7 + 3).otherwise(F.col("amount_paid")),
        "is_laundering": F.when(outside, (1 - F.col("is_laundering")).cast("int"))
        .otherwise(F.col("is_laundering")),
    })
    amounts = keyed_diff(
        fit_amount_stats(txn, fitted), fit_amount_stats(altered, fitted), ["payment_currency"]
    )

    def weight(df: DataFrame) -> DataFrame:
        return scale_pos_weight(df, fitted).withColumn("name", F.lit("scale_pos_weight"))

    return stack([amounts, keyed_diff(weight(txn), weight(altered), ["name"])])
