"""Table contracts and feature lists. Everything here is a fixed value."""

from __future__ import annotations

from pyspark.sql import types as T

# The eleven columns a source delivers.
SOURCE_COLUMNS = [
    "txn_ts", "from_bank", "from_account", "to_bank", "to_account",
    "amount_paid", "payment_currency", "amount_received", "receiving_currency",
    "payment_format", "is_laundering",
]


def transaction_schema(key_type: T.DataType = T.LongType()) -> T.StructType:
    """Transactions with id and date. Banks and accounts are opaque keys."""
    return T.StructType([
        T.StructField("txn_id", T.LongType()),
        T.StructField("txn_ts", T.TimestampNTZType()),
        T.StructField("txn_date", T.DateType()),
        T.StructField("from_bank", key_type),
        T.StructField("from_account", key_type),
        T.StructField("to_bank", key_type),
        T.StructField("to_account", key_type),
        T.StructField("payment_currency", T.StringType()),
        T.StructField("receiving_currency", T.StringType()),
        T.StructField("amount_paid", T.DoubleType()),
        T.StructField("amount_received", T.DoubleType()),
        T.StructField("payment_format", T.StringType()),
        T.StructField("is_laundering", T.IntegerType()),
    ])


TXN = transaction_schema()

CLEAN = T.StructType([
    *TXN.fields,
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("period", T.StringType()),
    T.StructField("is_exact_dup", T.BooleanType()),
])

NODE_MAP = T.StructType([
    T.StructField("node_id", T.LongType()),
    T.StructField("bank", T.LongType()),
    T.StructField("account", T.LongType()),
])

GRAPH_NODE_DAY = T.StructType([
    T.StructField("node_id", T.LongType()),
    T.StructField("feature_date", T.DateType()),
    T.StructField("pagerank_log", T.DoubleType()),
    T.StructField("wcc_size_log", T.DoubleType()),
    T.StructField("n_unique_out_log", T.DoubleType()),
    T.StructField("n_unique_in_log", T.DoubleType()),
    T.StructField("has_sent_before", T.IntegerType()),
    T.StructField("has_received_before", T.IntegerType()),
])

GRAPH_PAIR_TXN = T.StructType([
    T.StructField("txn_id", T.LongType()),
    T.StructField("g_pair_seen_before", T.IntegerType()),
    T.StructField("g_pair_prior_count_log", T.DoubleType()),
    T.StructField("g_reverse_pair_seen", T.IntegerType()),
])

PERIODS = ["warmup", "train", "validation", "test", "tail"]

TXN_FEATURES = [
    "t_log_amount_paid", "t_amount_z_in_currency", "t_payment_format", "t_cur_paid",
    "t_is_fx", "t_is_self_loop", "t_same_bank", "t_hour",
]
CATEGORICAL = ["t_payment_format", "t_cur_paid"]

ACCOUNT_HISTORY = [
    "n_out_rate", "n_in_rate", "mean_z_out", "mean_z_in", "max_z_out",
    "days_active_frac", "days_since_last", "fmt_diversity",
]
PAIR_HISTORY = ["g_pair_seen_before", "g_pair_prior_count_log", "g_reverse_pair_seen"]
NODE_GRAPH = [
    "g_pagerank_log", "g_wcc_size_log", "g_n_unique_out_log", "g_n_unique_in_log",
    "g_has_sent_before", "g_has_received_before",
]


def both_sides(names: list[str]) -> list[str]:
    """Sender and receiver versions of account features."""
    return [f"{side}_{name}" for side in ("s", "r") for name in names]


# Groups of the permutation study.
GROUPS = {
    "A": both_sides(ACCOUNT_HISTORY),
    "P": list(PAIR_HISTORY),
    "C": both_sides(NODE_GRAPH),
}

SHORTCUTS = [
    "t_payment_format", "t_cur_paid", "t_is_fx", "t_is_self_loop",
    "s_fmt_diversity", "r_fmt_diversity",
]


def feature_set(model: str, variant: str) -> list[str]:
    """Columns of M1 or M2, either ``full`` or ``no_shortcut``."""
    if model == "M1":
        columns = list(TXN_FEATURES)
    elif model == "M2":
        columns = [*TXN_FEATURES, *GROUPS["A"], *GROUPS["P"], *GROUPS["C"]]
    else:
        raise ValueError(f"unknown model {model!r}")
    if variant == "full":
        return columns
    if variant == "no_shortcut":
        return [c for c in columns if c not in SHORTCUTS]
    raise ValueError(f"unknown variant {variant!r}")
