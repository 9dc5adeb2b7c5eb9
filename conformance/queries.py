"""Registered queries and the SQL that each is compared with.

Dates leave as text and flags as integers, so that both engines deliver the same
types; doubles are rounded to six digits.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conformance.oracle import average_precision, r, sql
from conformance.stages import Stages, m1_linear, stages
from txnrisk import schema as S
from txnrisk.functions.days import clean_round
from txnrisk.functions.scale import stack
from txnrisk.operators import (
    account, bootstrap, components, explain, graph, leakage, metrics, model, pagerank, quality,
    report, split,
)
from txnrisk.operators.txn_features import txn_features as with_txn_features
from txnrisk.sources import events
from txnrisk.session import checkpoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(build: Callable[[Stages], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: build(stages(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build
    return register


def text(column: str):
    return F.col(column).cast("string").alias(column)


def rounded(*names: str):
    return [clean_round(F.col(c).cast("double")).alias(c) for c in names]


def sql_rounded(*names: str) -> str:
    return ", ".join(r(c, c) for c in names)


def long(*names: str):
    return [F.col(c).cast("long").alias(c) for c in names]


# --- sources, validation, split -------------------------------------------------

@query(sql("""SELECT txn_id, CAST(txn_date AS VARCHAR) AS txn_date, (hour(txn_ts) * 3600 + minute(txn_ts) * 60 + second(txn_ts))::BIGINT AS second_of_day,
 from_bank, from_account, to_bank, to_account, payment_currency, receiving_currency, amount_paid, amount_received, payment_format,
 is_laundering::INTEGER AS is_laundering FROM txn""", "txn"))
def transactions(s):
    seconds = F.hour("txn_ts") * 3600 + F.minute("txn_ts") * 60 + F.second("txn_ts")
    return s.txn.select(
        "txn_id", text("txn_date"), seconds.cast("long").alias("second_of_day"), "from_bank",
        "from_account", "to_bank", "to_account", "payment_currency", "receiving_currency",
        "amount_paid", "amount_received", "payment_format", "is_laundering",
    )


@query(sql("""
SELECT 'payment_format' AS column_name, 'missing' AS issue, NULL::BIGINT AS n_rows
UNION ALL SELECT 'note', 'extra', NULL
UNION ALL SELECT 'from_bank', 'type string, expected bigint', NULL
UNION ALL SELECT 'amount_paid', 'null', count(*) FROM txn WHERE amount_paid < 5
UNION ALL SELECT 'amount_received', 'domain', count(*) FROM txn WHERE -amount_received < 0""", "txn"))
def schema_report(s):
    broken = s.txn.drop("payment_format").withColumns({
        "note": F.lit("x"), "from_bank": F.col("from_bank").cast("string"),
        "amount_paid": F.when(F.col("amount_paid") >= 5, F.col("amount_paid")),
        "amount_received": -F.col("amount_received"),
    })
    return quality.validate_schema(broken)


_PROFILED = ["txn_id", "txn_date", "from_bank", "from_account", "to_bank", "to_account", "payment_currency",
             "receiving_currency", "amount_paid", "amount_received", "payment_format", "is_laundering"]


@query(sql("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM txn"
    for c in _PROFILED), "txn"))
def profile(s):
    return quality.profile(s.txn, _PROFILED)


_COPIES = """(SELECT * FROM txn UNION ALL SELECT * REPLACE (txn_id + 10000000 AS txn_id) FROM txn WHERE txn_id % 1000 = 0)"""
_KEY = ", ".join(S.SOURCE_COLUMNS)


@query(sql(f"""SELECT first_txn_id, n_copies, n_copies - 1 AS n_surplus, from_account, to_account, amount_paid FROM (
 SELECT {_KEY}, min(txn_id) AS first_txn_id, count(*) AS n_copies FROM {_COPIES} GROUP BY {_KEY} HAVING count(*) > 1)""", "txn"))
def duplicate_audit(s):
    return quality.duplicate_audit(events.with_planted_copies(s.txn)).select(
        "first_txn_id", "n_copies", "n_surplus", "from_account", "to_account", "amount_paid"
    )


@query(sql(f"""SELECT txn_id, (row_number() OVER (PARTITION BY {_KEY} ORDER BY txn_id) > 1)::INTEGER AS is_exact_dup FROM {_COPIES}""", "txn"))
def duplicate_flags(s):
    flagged = quality.flag_duplicates(events.with_planted_copies(s.txn))
    return flagged.select("txn_id", F.col("is_exact_dup").cast("int").alias("is_exact_dup"))


@query(sql("""
SELECT 'endpoint_not_in_node_map' AS check_name, bank || '/' || account AS entity, sum(1 + (receiving_currency = 'JPY')::INTEGER)::BIGINT AS n
FROM (SELECT from_bank AS bank, from_account AS account, receiving_currency FROM txn UNION ALL SELECT to_bank, to_account, receiving_currency FROM txn)
WHERE bank = 3 GROUP BY bank, account
UNION ALL SELECT 'missing_in_pair', txn_id::VARCHAR, 0 FROM txn WHERE payment_format = 'Cash'
UNION ALL SELECT 'txn_id_repeated', txn_id::VARCHAR, 2 FROM txn WHERE receiving_currency = 'JPY'
UNION ALL SELECT 'unexpected_in_pair', txn_id::VARCHAR, 2 FROM txn WHERE receiving_currency = 'JPY' AND payment_format <> 'Cash'""", "txn"))
def id_consistency(s):
    txn = s.txn.unionByName(s.txn.where("receiving_currency = 'JPY'"))
    nodes = s.node_map.where("bank <> 3")
    pair = txn.where("payment_format <> 'Cash'").select("txn_id")
    return quality.id_consistency(txn, nodes, {"pair": pair})


@query(sql("""SELECT count(*) AS n_rows, sum(is_laundering)::BIGINT AS n_positive, """ + r("avg(is_laundering)", "prevalence") + f""",
 CAST(min(txn_date) AS VARCHAR) AS first_date, CAST(max(txn_date) AS VARCHAR) AS last_date, 11::BIGINT AS n_columns,
 count(*) - count(DISTINCT ({_KEY})) AS n_exact_duplicates FROM {_COPIES}""", "txn"))
def dataset_summary(s):
    return quality.dataset_summary(events.with_planted_copies(s.txn)).select(
        "n_rows", "n_positive", *rounded("prevalence"), text("first_date"), text("last_date"),
        "n_columns", *long("n_exact_duplicates"),
    )


@query(sql("""SELECT CAST(txn_date AS VARCHAR) AS txn_date, count(*) AS n_rows, sum(is_laundering)::BIGINT AS n_positive FROM txn GROUP BY 1""", "txn"))
def daily_volume(s):
    return quality.daily_volume(s.txn).select(text("txn_date"), "n_rows", "n_positive")


@query(sql("SELECT txn_id, period FROM per", "per"))
def period_assignment(s):
    return split.assign_period(s.txn, s.bounds).select("txn_id", "period")


@query(sql("""SELECT period, count(*) AS n_rows, sum(is_laundering)::BIGINT AS n_positive, CAST(min(txn_date) AS VARCHAR) AS first_date,
 CAST(max(txn_date) AS VARCHAR) AS last_date FROM per GROUP BY period""", "per"))
def period_summary(s):
    return split.period_summary(split.assign_period(s.txn, s.bounds)).select(
        "period", "n_rows", "n_positive", text("first_date"), text("last_date")
    )


@query(sql("SELECT txn_id, CAST(txn_date AS VARCHAR) AS txn_date, amount_paid FROM per WHERE period = 'test'", "per"))
def test_period(s):
    return split.only_period(s.txn, s.bounds, "test").select("txn_id", text("txn_date"), "amount_paid")


@query(sql("SELECT payment_currency, n, " + sql_rounded("mean_log", "sd_log") + " FROM stats", "stats"))
def amount_stats(s):
    return split.fit_amount_stats(s.txn, s.bounds).select("payment_currency", "n", *rounded("mean_log", "sd_log"))


@query(sql("""SELECT (count(*) - sum(is_laundering))::BIGINT AS n_negative, sum(is_laundering)::BIGINT AS n_positive, """
           + r("(count(*) - sum(is_laundering))::DOUBLE / sum(is_laundering)", "scale_pos_weight")
           + " FROM per WHERE period = 'train'", "per"))
def class_weight(s):
    return split.scale_pos_weight(s.txn, s.bounds).select("n_negative", "n_positive", *rounded("scale_pos_weight"))


# --- transaction and account features -------------------------------------------

@query(sql("SELECT txn_id, " + sql_rounded("t_log_amount_paid", "t_amount_z_in_currency")
           + ", t_payment_format, t_cur_paid, t_is_fx, t_is_self_loop, t_same_bank, t_hour FROM full_txn", "full_txn"))
def txn_features(s):
    return s.clean.select(
        "txn_id", *rounded("t_log_amount_paid", "t_amount_z_in_currency"), "t_payment_format", "t_cur_paid",
        "t_is_fx", "t_is_self_loop", "t_same_bank", "t_hour",
    )


@query(sql("SELECT node_id, CAST(feature_date AS VARCHAR) AS feature_date, n_out, n_in, "
           + sql_rounded("sum_z_out", "sum_z_in", "max_z_out") + " FROM spine", "spine"))
def account_day(s):
    return account.account_day(s.clean).select(
        "node_id", text("feature_date"), "n_out", "n_in", *rounded("sum_z_out", "sum_z_in", "max_z_out")
    )


_RATES = ["n_out_rate", "n_in_rate", "mean_z_out", "mean_z_in", "max_z_out", "days_active_frac"]


@query(sql("SELECT node_id, CAST(feature_date AS VARCHAR) AS feature_date, " + sql_rounded(*_RATES)
           + ", days_since_last, fmt_diversity, has_history FROM hist", "hist"))
def account_history(s):
    return account.account_history(s.clean, s.first_date).select(
        "node_id", text("feature_date"), *rounded(*_RATES), "days_since_last",
        F.coalesce("fmt_diversity", F.lit(0)).cast("long").alias("fmt_diversity"), "has_history",
    )


_ACCOUNT_COLUMNS = S.both_sides(S.ACCOUNT_HISTORY)


@query(sql("SELECT txn_id, " + ", ".join(
    r(f"h{c[0]}.{c[2:]}", c) for c in _ACCOUNT_COLUMNS)
    + """, hs.has_history AS s_has_history, hr.has_history AS r_has_history FROM full_txn f
LEFT JOIN hist0 hs ON hs.node_id = f.src AND hs.feature_date = f.txn_date
LEFT JOIN hist0 hr ON hr.node_id = f.dst AND hr.feature_date = f.txn_date""", "full_txn", "hist0"))
def account_features(s):
    attached = account.attach_account_history(s.clean.select("txn_id", "src", "dst", "txn_date"), s.history)
    return attached.select("txn_id", *rounded(*_ACCOUNT_COLUMNS), "s_has_history", "r_has_history")


# --- graph ----------------------------------------------------------------------

@query(sql("SELECT node_id, bank, account FROM nm", "nm"))
def node_map(s):
    return graph.build_node_map(s.txn).select("node_id", "bank", "account")


@query(sql("SELECT txn_id, src, dst FROM full_txn", "full_txn"))
def encoded_nodes(s):
    return graph.encode_nodes(s.txn, s.node_map).select("txn_id", "src", "dst")


@query(sql("SELECT txn_id, src, dst FROM full_txn WHERE NOT (from_bank = to_bank AND from_account = to_account)", "full_txn"))
def topology(s):
    return graph.topology(s.clean).select("txn_id", "src", "dst")


@query(sql("SELECT src, dst, CAST(first_date AS VARCHAR) AS first_date, n_txn FROM edges", "edges"))
def edges(s):
    return graph.build_edges(s.clean).select("src", "dst", text("first_date"), "n_txn")


@query(sql("""SELECT src, dst, CAST(min(txn_date) AS VARCHAR) AS first_date FROM full_txn, span
WHERE src <> dst AND txn_date < first + 8 GROUP BY src, dst""", "full_txn", "span"))
def snapshot(s):
    return graph.snapshot(s.edges, s.bounds.test).select("src", "dst", text("first_date"))


@query(sql("SELECT CAST(d AS VARCHAR) AS feature_date, src, dst FROM snaps", "snaps"))
def snapshot_edges(s):
    return graph.snapshots(s.edges, s.last_date).select(text("feature_date"), "src", "dst")


@query(sql("SELECT txn_id, g_pair_seen_before, " + sql_rounded("g_pair_prior_count_log") + ", g_reverse_pair_seen FROM pair", "pair"))
def pair_history(s):
    return graph.pair_history(s.clean, s.edges).select(
        "txn_id", "g_pair_seen_before", *rounded("g_pair_prior_count_log"), "g_reverse_pair_seen"
    )


@query(sql("SELECT node_id, CAST(feature_date AS VARCHAR) AS feature_date, "
           + sql_rounded("pagerank", "pagerank_log") + " FROM pr", "pr"))
def pagerank_scores(s):
    return pagerank.pagerank(s.edges, graph.active_days(s.clean), s.last_date).select(
        "node_id", text("feature_date"), *rounded("pagerank", "pagerank_log")
    )


@query(sql("SELECT node_id, CAST(feature_date AS VARCHAR) AS feature_date, wcc_size, "
           + sql_rounded("wcc_size_log") + " FROM wcc", "wcc"))
def wcc_size(s):
    return components.wcc(s.edges, graph.active_days(s.clean), s.last_date).select(
        "node_id", text("feature_date"), "wcc_size", *rounded("wcc_size_log")
    )


@query(sql("SELECT node_id, CAST(feature_date AS VARCHAR) AS feature_date, n_unique_out, n_unique_in, "
           + r("ln(1 + n_unique_out)", "n_unique_out_log") + ", " + r("ln(1 + n_unique_in)", "n_unique_in_log")
           + ", (n_unique_out > 0)::INTEGER AS has_sent_before, (n_unique_in > 0)::INTEGER AS has_received_before FROM cp", "cp"))
def unique_counterparties(s):
    return graph.counterparties(s.edges, graph.active_days(s.clean)).select(
        "node_id", text("feature_date"), "n_unique_out", "n_unique_in",
        *rounded("n_unique_out_log", "n_unique_in_log"), "has_sent_before", "has_received_before",
    )


_NODE_DAY = ["pagerank_log", "wcc_size_log", "n_unique_out_log", "n_unique_in_log"]


@query(sql("SELECT node_id, CAST(feature_date AS VARCHAR) AS feature_date, " + sql_rounded(*_NODE_DAY)
           + ", has_sent_before, has_received_before FROM node_day", "node_day"))
def graph_node_day(s):
    return s.node_day.select(
        "node_id", text("feature_date"), *rounded(*_NODE_DAY), "has_sent_before", "has_received_before"
    )


_M2 = S.feature_set("M2", "full")
_INTS = ["t_is_fx", "t_is_self_loop", "t_same_bank", "t_hour", "g_pair_seen_before", "g_reverse_pair_seen",
         *S.both_sides(["g_has_sent_before", "g_has_received_before"])]


def _matrix_columns(names):
    plain = {*S.CATEGORICAL, *_INTS}
    return [F.col(c) if c in plain else rounded(c)[0] for c in names]


def _matrix_sql(names) -> str:
    plain = {*S.CATEGORICAL, *_INTS}
    return ", ".join(c if c in plain else r(c, c) for c in names)


@query(sql(f"SELECT txn_id, period, is_laundering::INTEGER AS is_laundering, {_matrix_sql(_M2)} FROM matrix", "matrix"))
def feature_matrix(s):
    return s.matrix.select("txn_id", "period", "is_laundering", *_matrix_columns(_M2))


def _feature_set_query(name: str, variant: str) -> None:
    from txnrisk.operators.assemble import select_features

    names = S.feature_set(name, variant)

    def build(s):
        return select_features(s.matrix, name, variant).select(
            "txn_id", "period", "is_laundering", *_matrix_columns(names)
        )

    build.__name__ = f"features_{name.lower()}_{variant}"
    query(sql(f"SELECT txn_id, period, is_laundering::INTEGER AS is_laundering, {_matrix_sql(names)} FROM matrix", "matrix"))(build)


for _name, _variant in (("M1", "full"), ("M1", "no_shortcut"), ("M2", "no_shortcut")):
    _feature_set_query(_name, _variant)


# --- models ---------------------------------------------------------------------

# Scores of a grid that SQL can repeat: linear scores with a seeded disturbance.
SEEDS = (42, 43, 44)


def _grid_scores(s) -> DataFrame:
    full = m1_linear()
    plain = 0.3 * F.log1p("amount_paid")
    new_pair = F.when(F.col("g_pair_seen_before") == 0, 1.0).otherwise(0.0)
    parts = []
    for seed in SEEDS:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("txn_id").cast("string"))), 1, 8), 16, 10)
        noise = 0.5 * h.cast("double") / F.lit(4294967296.0)
        for m, v, base in (("M1", "full", full), ("M1", "no_shortcut", plain),
                           ("M2", "full", full + new_pair), ("M2", "no_shortcut", plain + new_pair)):
            parts.append(F.struct(
                F.lit(m).alias("model"), F.lit(v).alias("variant"), F.lit(seed).alias("seed"),
                F.round(base + noise, 6).alias("score"),
            ))
    return s.scored.where("period = 'test'").select("txn_id", "is_laundering", F.inline(F.array(*parts)))


_GRID_ROWS = """(SELECT txn_id, is_laundering, model, variant, seed, round(
  0.3::DOUBLE * ln(1 + amount_paid)
  + CASE WHEN variant = 'full' THEN 0.8::DOUBLE * (payment_format = 'ACH')::INTEGER + 0.2::DOUBLE * t_is_fx ELSE 0::DOUBLE END
  + CASE WHEN model = 'M2' THEN (1 - g_pair_seen_before)::DOUBLE ELSE 0::DOUBLE END
  + 0.5::DOUBLE * (('0x' || substr(md5(seed || '|' || txn_id), 1, 8))::BIGINT)::DOUBLE / 4294967296::DOUBLE, 6) AS score
 FROM scored, (VALUES ('M1'), ('M2')) m(model), (VALUES ('full'), ('no_shortcut')) v(variant), (VALUES (42), (43), (44)) s(seed)
 WHERE period = 'test')"""
_GRID_SQL = f"(SELECT model, variant, seed, pr_auc FROM {average_precision(_GRID_ROWS, 'score', 'model, variant, seed')})"


def _grid_results(s) -> DataFrame:
    return metrics.pr_auc(_grid_scores(s), "score", by=["model", "variant", "seed"])


@query(sql("SELECT model, variant, count(*) AS n_seeds, " + r("avg(pr_auc)", "mean") + ", " + r("stddev_samp(pr_auc)", "sd")
           + ", " + r("min(pr_auc)", "lowest") + ", " + r("max(pr_auc)", "highest") + f" FROM {_GRID_SQL} GROUP BY model, variant", "scored"))
def seed_summary(s):
    return model.seed_summary(_grid_results(s)).select(
        "model", "variant", "n_seeds", *rounded("mean", "sd", "lowest", "highest")
    )


@query(sql("""SELECT model, """ + r("f", "full") + ", " + r("p", "no_shortcut") + ", " + r("f - p", "drop") + f"""
FROM (SELECT model, avg(pr_auc) FILTER (variant = 'full') AS f, avg(pr_auc) FILTER (variant = 'no_shortcut') AS p FROM {_GRID_SQL} GROUP BY model)""", "scored"))
def variant_comparison(s):
    return report.variant_comparison(_grid_results(s)).select("model", *rounded("full", "no_shortcut", "drop"))


@query()
def model_scores(s):
    """One M2 fit, scores of all later rows."""
    fitted = _fitted(s)
    return model.score(fitted, s.matrix.where("period <> 'warmup'")).select("txn_id", "period", "is_laundering", "score")


def _fitted(s):
    if not hasattr(s, "_m2"):
        s._m2 = model.train(s.matrix, _M2, 42, s.pos_weight, s.config)
    return s._m2


@query()
def experiment_grid(s):
    """Two models, two variants, three seeds: twelve fits and their test metrics."""
    scores, _ = model.run_grid(s.matrix, s.pos_weight, s.config)
    return model.grid_results(scores, s.config)


@query()
def shap_values(s):
    shap = explain.shap_values(_fitted(s), s.matrix.where("period = 'test'"))
    return explain.shap_long(shap, _M2)


@query()
def what_if(s):
    return model.what_if(
        _fitted(s), s.matrix.where("period = 'test'"),
        {"g_pair_seen_before": F.lit(1), "g_pair_prior_count_log": F.log1p(F.lit(10.0))},
    ).select("txn_id", "score_before", "score_after", "change")


# One round of depth one over one binary feature has a closed form: a leaf is the
# weighted mean of 2y - 1 of its side, the score 1 / (1 + exp(-2 leaf)), and the SHAP
# value the leaf less the weighted mean of both.
_STUMP = "g_pair_seen_before"
_STUMP_SQL = f"""(SELECT x, leaf, 1 / (1 + exp(-2::DOUBLE * leaf)) AS score, (sum(leaf * w) OVER ()) / (sum(w) OVER ()) AS base FROM (
 SELECT x, sum(w) AS w, sum(w * (2 * y - 1)) / sum(w) AS leaf FROM (
  SELECT {_STUMP} AS x, is_laundering AS y, CASE WHEN is_laundering = 1
   THEN (count(*) FILTER (is_laundering = 0) OVER ())::DOUBLE / (count(*) FILTER (is_laundering = 1) OVER ()) ELSE 1::DOUBLE END AS w
  FROM matrix WHERE period = 'train') GROUP BY x))"""


def _stump(s):
    if not hasattr(s, "_one_stump"):
        config = dataclasses.replace(s.config, tree_rounds=1, tree_depth=1, subsampling=1.0)
        s._one_stump = model.train(s.matrix, [_STUMP], 42, s.pos_weight, config)
    return s._one_stump


@query(sql("SELECT txn_id, period, " + r("score", "score") + f" FROM matrix JOIN {_STUMP_SQL} t ON t.x = matrix.{_STUMP}", "matrix"))
def stump_scores(s):
    return model.score(_stump(s), s.matrix).select("txn_id", "period", *rounded("score"))


@query(sql("SELECT txn_id, " + r("leaf - base", "phi") + f" FROM matrix JOIN {_STUMP_SQL} t ON t.x = matrix.{_STUMP}", "matrix"))
def stump_shap(s):
    shap = explain.shap_values(_stump(s), s.matrix)
    return explain.shap_long(shap, [_STUMP]).select("txn_id", *rounded("phi"))


@query(sql("SELECT txn_id, " + r("t.score", "score_before") + ", " + r("u.score", "score_after") + ", " + r("u.score - t.score", "change")
           + f" FROM matrix JOIN {_STUMP_SQL} t ON t.x = matrix.{_STUMP} JOIN {_STUMP_SQL} u ON u.x = 1 WHERE period = 'test'", "matrix"))
def stump_what_if(s):
    test = s.matrix.where("period = 'test'")
    stored = model.score(_stump(s), test).select("txn_id", "score")
    found = model.what_if(_stump(s), test, {_STUMP: F.lit(1)}, stored)
    return found.select("txn_id", *rounded("score_before", "score_after", "change"))


@query()
def model_importance(s):
    """Grouped permutation importance of the fitted model on the test period."""
    fitted = _fitted(s)
    return explain.grouped_permutation(
        s.matrix.where("period = 'test'"), lambda df: model.score(fitted, df), S.GROUPS
    )


# --- evaluation -----------------------------------------------------------------

_BOTH = """(SELECT period, is_laundering, 'm1' AS model, m1_score AS score FROM scored
UNION ALL SELECT period, is_laundering, 'm2', m2_score FROM scored)"""
_TEST = "(SELECT * FROM scored WHERE period = 'test')"


def _long_scores(s, *keep):
    return metrics.unpivot_scores(s.scored, {"m1": "m1_score", "m2": "m2_score"}, ["is_laundering", *keep])


@query(sql("SELECT period, model, n_rows, n_positive, " + sql_rounded("pr_auc")
           + f" FROM {average_precision(_BOTH, 'score', 'period, model')}", "scored"))
def pr_auc(s):
    return metrics.pr_auc(_long_scores(s, "period"), "score", by=["period", "model"]).select(
        "period", "model", "n_rows", "n_positive", *rounded("pr_auc")
    )


@query(sql("""SELECT t.s AS threshold, count(*) AS n_alerts, sum(is_laundering)::BIGINT AS n_hits, """
           + r("sum(is_laundering)::DOUBLE / count(*)", "precision") + ", "
           + r("sum(is_laundering)::DOUBLE / nullif((SELECT sum(is_laundering) FROM scored WHERE period = 'test'), 0)", "recall") + ", "
           + r("2 * sum(is_laundering)::DOUBLE / (count(*) + (SELECT sum(is_laundering) FROM scored WHERE period = 'test'))", "f1")
           + f""" FROM (SELECT DISTINCT m1_score AS s FROM {_TEST}) t JOIN {_TEST} x ON x.m1_score >= t.s GROUP BY t.s""", "scored"))
def pr_curve(s):
    return metrics.pr_curve(s.scored.where("period = 'test'"), "m1_score").select(
        "threshold", "n_alerts", "n_hits", *rounded("precision", "recall", "f1")
    )


@query(sql("""SELECT period, model, """ + r("""sum(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE WHEN p.score < n.score THEN 0::DOUBLE END) / nullif(count(p.score + n.score), 0)""", "roc_auc")
           + f""" FROM (SELECT DISTINCT period, model FROM {_BOTH}) g LEFT JOIN (SELECT * FROM {_BOTH} WHERE is_laundering = 1) p USING (period, model)
 LEFT JOIN (SELECT * FROM {_BOTH} WHERE is_laundering = 0) n USING (period, model) GROUP BY period, model""", "scored"))
def roc_auc(s):
    found = metrics.roc_auc(_long_scores(s, "period"), "score", by=["period", "model"])
    return found.select("period", "model", *rounded("roc_auc"))


_VALID_F1 = """(SELECT t.s AS threshold, 2 * sum(is_laundering)::DOUBLE / (count(*) + (SELECT sum(is_laundering) FROM scored WHERE period = 'validation')) AS f1
 FROM (SELECT DISTINCT m1_score AS s FROM scored WHERE period = 'validation') t
 JOIN (SELECT * FROM scored WHERE period = 'validation') x ON x.m1_score >= t.s GROUP BY t.s)"""
_CHOSEN = f"(SELECT threshold, f1 FROM {_VALID_F1} ORDER BY f1 DESC, threshold DESC LIMIT 1)"


@query(sql("SELECT threshold, " + sql_rounded("f1") + f" FROM {_CHOSEN}", "scored"))
def pick_threshold(s):
    return metrics.pick_threshold(s.scored.where("period = 'validation'"), "m1_score").select(
        "threshold", *rounded("f1")
    )


def _predicted(s) -> DataFrame:
    chosen = metrics.pick_threshold(s.scored.where("period = 'validation'"), "m1_score")
    return metrics.apply_threshold(s.scored.where("period = 'test'"), "m1_score", chosen)


_PREDICTED = f"(SELECT txn_id, is_laundering, (m1_score >= threshold)::INTEGER AS predicted FROM {_TEST}, {_CHOSEN})"


@query(sql(f"SELECT txn_id, predicted FROM {_PREDICTED}", "scored"))
def apply_threshold(s):
    return _predicted(s).select("txn_id", "predicted")


_COUNTS = f"""(SELECT count(*) FILTER (predicted = 1 AND is_laundering = 1) AS tp, count(*) FILTER (predicted = 1 AND is_laundering = 0) AS fp,
 count(*) FILTER (predicted = 0 AND is_laundering = 1) AS fn, count(*) FILTER (predicted = 0 AND is_laundering = 0) AS tn FROM {_PREDICTED})"""


@query(sql("SELECT tp, fp, fn, tn, " + r("tp::DOUBLE / nullif(tp + fp, 0)", "precision") + ", " + r("tp::DOUBLE / nullif(tp + fn, 0)", "recall")
           + ", " + r("2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0)", "f1") + ", " + r("(tp + tn)::DOUBLE / (tp + fp + fn + tn)", "accuracy")
           + f" FROM {_COUNTS}", "scored"))
def threshold_metrics(s):
    return metrics.threshold_metrics(_predicted(s)).select(
        "tp", "fp", "fn", "tn", *rounded("precision", "recall", "f1", "accuracy")
    )


@query(sql(f"""SELECT predicted, actual, (SELECT count(*) FROM {_PREDICTED} x WHERE x.predicted = g.predicted AND x.is_laundering = g.actual) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(predicted, actual)""", "scored"))
def confusion(s):
    return metrics.confusion(_predicted(s))


@query(sql("""SELECT period, budget, count(*) AS n_alerts, sum(is_laundering)::BIGINT AS n_hits, n_positive, """
           + r("sum(is_laundering)::DOUBLE / nullif(n_positive, 0)", "recall") + """ FROM (
 SELECT period, is_laundering, row_number() OVER (PARTITION BY period ORDER BY m1_score DESC, txn_id) AS rn,
 (ceil(round(count(*) OVER (PARTITION BY period) * 0.01::DOUBLE, 6)))::BIGINT AS budget,
 (sum(is_laundering) OVER (PARTITION BY period))::BIGINT AS n_positive FROM scored) WHERE rn <= budget GROUP BY period, budget, n_positive""", "scored"))
def recall_at_budget(s):
    return metrics.recall_at_budget(s.scored, "m1_score", by=["period"]).select(
        "period", *long("budget", "n_alerts", "n_hits", "n_positive"), *rounded("recall")
    )


def _delta_sql(source: str) -> str:
    return ("SELECT a.n_rows, a.n_positive, " + r("a.pr_auc", "pr_auc_m1") + ", " + r("b.pr_auc", "pr_auc_m2") + ", "
            + r("b.pr_auc - a.pr_auc", "delta")
            + f" FROM {average_precision(source, 'm1_score')} a, {average_precision(source, 'm2_score')} b")


def _delta(df: DataFrame) -> DataFrame:
    return metrics.pr_auc_delta(df, "m1_score", "m2_score").select(
        "n_rows", "n_positive", *rounded("pr_auc_m1", "pr_auc_m2", "delta")
    )


@query(sql(_delta_sql(_TEST), "scored"))
def pr_auc_delta(s):
    return _delta(s.scored.where("period = 'test'"))


_HARD = "(SELECT * FROM scored WHERE period = 'test' AND payment_format = 'ACH' AND t_is_self_loop = 0 AND t_is_fx = 0)"


@query(sql(_delta_sql(_HARD), "scored"))
def hard_subset(s):
    return _delta(metrics.hard_subset(s.scored.where("period = 'test'")))


REPLICATES = 200


def _bootstrap_sql(where: str) -> str:
    cases = " + ".join(f"(u >= {b}::DOUBLE)::INTEGER" for b in bootstrap.POISSON_BOUNDS)
    # rows that are not drawn have no step: 0 / 0 would make the sum NaN
    drawn = f"""(SELECT * FROM (SELECT b, is_laundering, m1_score, m2_score, {cases} AS w FROM (
 SELECT b, is_laundering, m1_score, m2_score, (('0x' || substr(md5('42|' || b || '|' || txn_id), 1, 8))::BIGINT)::DOUBLE / 4294967296::DOUBLE AS u
 FROM scored, range({REPLICATES}) g(b) WHERE {where})) WHERE w > 0)"""
    return ("SELECT count(*) AS n_replicates, " + r("avg(delta)", "mean_delta") + ", " + r("quantile_cont(delta, 0.025)", "ci_low")
            + ", " + r("quantile_cont(delta, 0.975)", "ci_high") + f""" FROM (SELECT y.pr_auc - x.pr_auc AS delta
 FROM {average_precision(drawn, 'm1_score', 'b', 'w')} x JOIN {average_precision(drawn, 'm2_score', 'b', 'w')} y USING (b)) WHERE delta IS NOT NULL""")


GAIN_REPLICATES = 50


def _gains_sql() -> str:
    cases = " + ".join(f"(u >= {b}::DOUBLE)::INTEGER" for b in bootstrap.POISSON_BOUNDS)
    drawn = f"""(SELECT * FROM (SELECT b, is_laundering, model, variant, seed, score, {cases} AS w FROM (
 SELECT t.*, b, (('0x' || substr(md5('42|' || b || '|' || txn_id), 1, 8))::BIGINT)::DOUBLE / 4294967296::DOUBLE AS u
 FROM {_GRID_ROWS} t, range({GAIN_REPLICATES}) g(b))) WHERE w > 0)"""
    each = "max(pr_auc) FILTER (model = 'M1') AS m1, max(pr_auc) FILTER (model = 'M2') AS m2"
    return f"""(SELECT variant, seed, n_rows, n_positive, m1, m2, m2 - m1 AS delta, coalesce(n_replicates, 0) AS n_replicates, ci_low, ci_high
FROM (SELECT variant, seed, max(n_rows) AS n_rows, max(n_positive) AS n_positive, {each}
 FROM {average_precision(_GRID_ROWS, 'score', 'model, variant, seed')} GROUP BY variant, seed) p
LEFT JOIN (SELECT variant, seed, count(*) AS n_replicates, quantile_cont(m2 - m1, 0.025) AS ci_low, quantile_cont(m2 - m1, 0.975) AS ci_high
 FROM (SELECT variant, seed, b, {each} FROM {average_precision(drawn, 'score', 'b, model, variant, seed', 'w')} GROUP BY variant, seed, b)
 WHERE m2 - m1 IS NOT NULL GROUP BY variant, seed) i USING (variant, seed))"""


def _gains(s) -> DataFrame:
    return report.gains(_grid_scores(s), GAIN_REPLICATES)


@query(sql("SELECT variant, seed, n_rows, n_positive, n_replicates, " + r("m1", "pr_auc_m1") + ", " + r("m2", "pr_auc_m2") + ", "
           + sql_rounded("delta", "ci_low", "ci_high") + f" FROM {_gains_sql()}", "scored"))
def gains(s):
    return _gains(s).select(
        "variant", "seed", *long("n_rows", "n_positive"), F.coalesce("n_replicates", F.lit(0).cast("long")).alias("n_replicates"),
        *rounded("pr_auc_m1", "pr_auc_m2", "delta", "ci_low", "ci_high"),
    )


@query(sql("SELECT variant, count(*) AS n_seeds, " + r("avg(delta)", "mean") + ", " + r("min(delta)", "lowest") + ", " + r("max(delta)", "highest")
           + f", count(*) FILTER (ci_low > 0) AS n_above_zero FROM {_gains_sql()} GROUP BY variant", "scored"))
def gain_summary(s):
    return report.gain_summary(_gains(s)).select(
        "variant", "n_seeds", *rounded("mean", "lowest", "highest"), "n_above_zero"
    )


def _interval(df: DataFrame) -> DataFrame:
    return bootstrap.paired_bootstrap(df, "m1_score", "m2_score", REPLICATES)


@query(sql(_bootstrap_sql("period = 'test'"), "scored"))
def paired_bootstrap(s):
    return _interval(s.scored.where("period = 'test'")).select(
        "n_replicates", *rounded("mean_delta", "ci_low", "ci_high")
    )


@query(sql(_bootstrap_sql("period = 'test' AND payment_format = 'ACH' AND t_is_self_loop = 0 AND t_is_fx = 0"), "scored"))
def hard_subset_bootstrap(s):
    return _interval(metrics.hard_subset(s.scored.where("period = 'test'"))).select(
        "n_replicates", *rounded("mean_delta", "ci_low", "ci_high")
    )


@query(sql("SELECT a.period, a.model, n_rows, n_positive, " + r("n_positive::DOUBLE / n_rows", "prevalence") + ", " + sql_rounded("pr_auc", "roc_auc")
           + f""" FROM {average_precision(_BOTH, 'score', 'period, model')} a LEFT JOIN (
 SELECT period, model, sum(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0::DOUBLE END) / count(*) AS roc_auc
 FROM {_BOTH} p JOIN {_BOTH} n USING (period, model) WHERE p.is_laundering = 1 AND n.is_laundering = 0 GROUP BY period, model) b USING (period, model)""", "scored"))
def tail_report(s):
    return report.period_metrics(s.scored, ["m1_score", "m2_score"]).select(
        "period", F.regexp_replace("model", "_score", "").alias("model"), "n_rows", "n_positive",
        *rounded("prevalence", "pr_auc", "roc_auc"),
    )


_DRIFT = [c for c in S.feature_set("M2", "full") if c not in S.CATEGORICAL]


@query(sql("""SELECT feature, n_base, n_against, """ + r("psi", "psi") + """ FROM (
 SELECT feature, max(nb)::BIGINT AS n_base, max(na)::BIGINT AS n_against, sum((q - p) * ln(q / p)) AS psi FROM (
  SELECT feature, nb, na, greatest(count(*) FILTER (period = 'train')::DOUBLE / nb, 1e-6::DOUBLE) AS p,
    greatest(count(*) FILTER (period = 'tail')::DOUBLE / na, 1e-6::DOUBLE) AS q FROM (
   SELECT l.feature, l.period, nb, na, (SELECT count(*) FROM lim WHERE lim.feature = l.feature AND lim.x < l.x) AS bin
   FROM longm l JOIN tot USING (feature)) GROUP BY feature, nb, na, bin) GROUP BY feature)""", "matrix").replace("\nSELECT feature, n_base", ", longm AS MATERIALIZED ("
   + " UNION ALL ".join(f"SELECT '{c}' AS feature, period, round({c}::DOUBLE, 6) AS x FROM matrix WHERE period IN ('train', 'tail')" for c in _DRIFT)
   + """), tot AS (SELECT feature, count(*) FILTER (period = 'train') AS nb, count(*) FILTER (period = 'tail') AS na FROM longm GROUP BY feature),
 lim AS MATERIALIZED (SELECT feature, x FROM (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS rn FROM longm WHERE period = 'train')
  JOIN tot USING (feature), range(1, 10) g(i) WHERE rn = (i * nb + 9) // 10)
SELECT feature, n_base""", 1))
def feature_drift(s):
    values = s.matrix.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in _DRIFT})
    return report.feature_drift(values, _DRIFT).select("feature", *long("n_base", "n_against"), *rounded("psi"))


_SHORT = [("t_payment_format", "t_payment_format"), ("t_cur_paid", "t_cur_paid"), ("t_is_fx", "t_is_fx::VARCHAR"),
          ("t_is_self_loop", "t_is_self_loop::VARCHAR"), ("s_fmt_diversity", "s_fmt_diversity::BIGINT::VARCHAR"),
          ("r_fmt_diversity", "r_fmt_diversity::BIGINT::VARCHAR")]


@query(sql("SELECT feature, value, count(*) AS n_rows, sum(is_laundering)::BIGINT AS n_positive, "
           + r("count(*)::DOUBLE / (SELECT count(*) FROM matrix)", "row_share") + ", " + r("avg(is_laundering)", "positive_rate") + ", "
           + r("avg(is_laundering) / (SELECT avg(is_laundering) FROM matrix)", "lift") + " FROM ("
           + " UNION ALL ".join(f"SELECT '{n}' AS feature, {e} AS value, is_laundering FROM matrix" for n, e in _SHORT)
           + ") GROUP BY feature, value", "matrix"))
def shortcut_table(s):
    return report.shortcut_table(s.matrix).select(
        "feature", "value", "n_rows", "n_positive", *rounded("row_share", "positive_rate", "lift")
    )


# --- explanations ---------------------------------------------------------------

# For a linear score the SHAP value of a feature is weight x (value - mean).
LINEAR = {"amount": 0.3, "ach": 0.8, "fx": 0.2, "new_pair": 1.0}


def _linear_inputs():
    return {
        "amount": F.col("t_log_amount_paid"),
        "ach": F.when(F.col("payment_format") == "ACH", 1.0).otherwise(0.0),
        "fx": F.col("t_is_fx").cast("double"),
        "new_pair": (1 - F.col("g_pair_seen_before")).cast("double"),
    }


def _linear_shap(s) -> DataFrame:
    rows = s.scored.where("period = 'test'").select("txn_id", *[c.alias(n) for n, c in _linear_inputs().items()])
    means = rows.agg(*[F.avg(n).alias(n) for n in LINEAR])
    return rows.select("txn_id", F.array(*[
        F.round(F.lit(w) * (F.col(n) - means.select(n).scalar()), 9) for n, w in LINEAR.items()
    ]).alias("phi"))


_LINEAR_SQL = """(SELECT txn_id, feature, round(w * (x - avg(x) OVER (PARTITION BY feature)), 9) AS phi FROM (
 SELECT txn_id, 'amount' AS feature, 0.3::DOUBLE AS w, t_log_amount_paid AS x FROM scored WHERE period = 'test'
 UNION ALL SELECT txn_id, 'ach', 0.8::DOUBLE, (payment_format = 'ACH')::INTEGER::DOUBLE FROM scored WHERE period = 'test'
 UNION ALL SELECT txn_id, 'fx', 0.2::DOUBLE, t_is_fx::DOUBLE FROM scored WHERE period = 'test'
 UNION ALL SELECT txn_id, 'new_pair', 1::DOUBLE, (1 - g_pair_seen_before)::DOUBLE FROM scored WHERE period = 'test'))"""


@query(sql("SELECT feature, count(*) AS n_rows, " + r("avg(abs(phi))", "mean_abs_phi") + f" FROM {_LINEAR_SQL} GROUP BY feature", "scored"))
def shap_summary(s):
    return explain.shap_summary(_linear_shap(s), list(LINEAR)).select("feature", "n_rows", *rounded("mean_abs_phi"))


@query(sql(f"""SELECT txn_id, string_agg(feature, ',' ORDER BY rn) AS features, """ + r("sum(phi)", "phi_sum") + f""" FROM (
 SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(phi) DESC, feature) AS rn FROM {_LINEAR_SQL}) WHERE rn <= 3 GROUP BY txn_id""", "scored"))
def shap_top_k(s):
    top = explain.shap_top_k(_linear_shap(s), list(LINEAR), 3)
    total = F.aggregate("top_features.phi", F.lit(0.0), lambda a, x: a + x)
    return top.select(
        "txn_id", F.concat_ws(",", "top_features.feature").alias("features"), clean_round(total).alias("phi_sum")
    )


def _surrogate(df: DataFrame) -> DataFrame:
    amount = 0.1 * F.col("s_n_out_rate") + 0.05 * F.col("r_days_since_last") + 0.4 * F.col("g_pair_prior_count_log")
    network = 2.0 * F.col("s_g_pagerank_log") + 0.3 * F.col("r_g_n_unique_in_log")
    return df.withColumn("score", F.round(amount + network + 0.3 * F.col("t_log_amount_paid"), 5))


def _permutation_sql() -> str:
    def score(a: str, p: str, c: str) -> str:
        return (f"round(0.1::DOUBLE * {a}.s_n_out_rate + 0.05::DOUBLE * {a}.r_days_since_last + 0.4::DOUBLE * {p}.g_pair_prior_count_log"
                f" + (2::DOUBLE * {c}.s_g_pagerank_log + 0.3::DOUBLE * {c}.r_g_n_unique_in_log) + 0.3::DOUBLE * x.t_log_amount_paid, 5)")

    swapped = {"none": ("x", "x", "x"), "A": ("y", "x", "x"), "P": ("x", "y", "x"), "C": ("x", "x", "y")}
    source = "(" + " UNION ALL ".join(
        f"SELECT '{g}' AS grp, x.is_laundering, {score(*sides)} AS score FROM ordered x JOIN shuffled y USING (rn)"
        for g, sides in swapped.items()) + ")"
    body = ("SELECT g.grp AS \"group\", g.n_rows, " + r("b.pr_auc", "pr_auc_base") + ", " + r("g.pr_auc", "pr_auc_permuted") + ", "
            + r("b.pr_auc - g.pr_auc", "importance")
            + f" FROM {average_precision(source, 'score', 'grp')} g, {average_precision(source, 'score', 'grp')} b WHERE b.grp = 'none' AND g.grp <> 'none'")
    extra = """, ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY txn_id) AS rn FROM matrix WHERE period = 'test'),
 shuffled AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5('42|' || txn_id), txn_id) AS rn FROM matrix WHERE period = 'test')
"""
    return sql("SELECT @@", "matrix").replace("\nSELECT @@", extra + body)


@query(_permutation_sql())
def grouped_permutation(s):
    return explain.grouped_permutation(s.matrix.where("period = 'test'"), _surrogate, S.GROUPS).select(
        "group", "n_rows", *rounded("pr_auc_base", "pr_auc_permuted", "importance")
    )


# --- report tables --------------------------------------------------------------

def _overview_sql() -> str:
    delta = _delta_sql(_TEST)
    interval = _bootstrap_sql("period = 'test'")
    return sql(f"""SELECT unnest(['n_rows', 'n_positive', 'prevalence', 'n_columns', 'n_exact_duplicates']) AS item,
 unnest([n, p, """ + "round(p / n, 6)" + f""", 11, 0]) AS value FROM (SELECT count(*)::DOUBLE AS n, sum(is_laundering)::DOUBLE AS p FROM scored)
UNION ALL SELECT unnest(['pr_auc_m1', 'pr_auc_m2', 'delta']), unnest([pr_auc_m1, pr_auc_m2, delta]) FROM ({delta})
UNION ALL SELECT unnest(['n_replicates', 'ci_low', 'ci_high']), unnest([n_replicates::DOUBLE, ci_low, ci_high]) FROM ({interval})""", "scored")


@query(_overview_sql())
def overview(s):
    test = s.scored.where("period = 'test'")
    table = report.overview(
        quality.dataset_summary(s.clean), metrics.pr_auc_delta(test, "m1_score", "m2_score"), _interval(test)
    )
    return table.select("item", *rounded("value"))


@query(sql("""SELECT CAST(d AS VARCHAR) AS feature_date, n_nodes, n_edges, n_components, largest, """ + r("largest::DOUBLE / n_nodes", "largest_share") + """
FROM (SELECT d, count(*) AS n_nodes, count(DISTINCT root) AS n_components, max(size) AS largest FROM comp GROUP BY d)
JOIN (SELECT d, count(*) AS n_edges FROM snaps GROUP BY d) USING (d)""", "comp", "snaps"))
def network_stats(s):
    return report.network_stats(s.edges, s.last_date).select(
        text("feature_date"), "n_nodes", "n_edges", "n_components", "largest", *rounded("largest_share")
    )


@query(sql("""SELECT direction, degree, count(*) AS n_nodes FROM (
 SELECT 'out' AS direction, src AS v, count(*) AS degree FROM edges GROUP BY src UNION ALL SELECT 'in', dst, count(*) FROM edges GROUP BY dst)
GROUP BY direction, degree""", "edges"))
def degree_distribution(s):
    return report.degree_distribution(s.edges)


@query(sql("""SELECT CAST(txn_date AS VARCHAR) AS txn_date, g_pair_seen_before, count(*) AS n_rows, sum(is_laundering)::BIGINT AS n_positive, """
           + r("avg(is_laundering)", "positive_rate") + " FROM scored WHERE src <> dst GROUP BY txn_date, g_pair_seen_before", "scored"))
def new_pair_analysis(s):
    return report.new_pair_analysis(s.clean, s.pair).select(
        text("txn_date"), "g_pair_seen_before", "n_rows", "n_positive", *rounded("positive_rate")
    )


_FLAGGED = f"(SELECT txn_date AS d, src, dst FROM scored, {_CHOSEN} WHERE period = 'test' AND m1_score >= threshold)"


@query(sql(f"""SELECT CAST(d AS VARCHAR) AS feature_date, src, dst, CAST(first_date AS VARCHAR) AS first_date, min(hop) AS hop FROM (
 SELECT s.d, s.src, s.dst, s.first_date, 1 AS hop FROM snaps s WHERE EXISTS (SELECT 1 FROM seed WHERE seed.d = s.d AND seed.v IN (s.src, s.dst))
 UNION ALL
 SELECT s.d, s.src, s.dst, s.first_date, 2 FROM snaps s WHERE EXISTS (SELECT 1 FROM ring WHERE ring.d = s.d AND ring.v IN (s.src, s.dst)))
GROUP BY d, src, dst, first_date""", "scored", "snaps").replace("\nSELECT CAST(d", f""", seed AS MATERIALIZED (SELECT d, src AS v FROM {_FLAGGED} UNION SELECT d, dst FROM {_FLAGGED}),
ring AS MATERIALIZED (SELECT s.d, s.src AS v FROM snaps s JOIN seed ON seed.d = s.d AND seed.v IN (s.src, s.dst)
 UNION SELECT s.d, s.dst FROM snaps s JOIN seed ON seed.d = s.d AND seed.v IN (s.src, s.dst))
SELECT CAST(d""", 1))
def suspicious_subgraph(s):
    flagged = _predicted(s).where("predicted = 1")
    return report.suspicious_subgraph(s.edges, flagged, hops=2).select(
        text("feature_date"), "src", "dst", text("first_date"), "hop"
    )


@query(sql(f"""SELECT x.txn_id, CAST(txn_date AS VARCHAR) AS txn_date, src, dst, payment_format, payment_currency, amount_paid, m1_score, m2_score,
 (m1_score >= c1.threshold)::INTEGER AS m1_predicted, (m2_score >= c2.threshold)::INTEGER AS m2_predicted, is_laundering::INTEGER AS actual, features
FROM {_TEST} x, {_CHOSEN} c1, {_CHOSEN.replace("m1_score", "m2_score")} c2 JOIN (SELECT txn_id, string_agg(feature, ',' ORDER BY rn) AS features FROM (
 SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(phi) DESC, feature) AS rn FROM {_LINEAR_SQL}) WHERE rn <= 3 GROUP BY txn_id) t ON t.txn_id = x.txn_id""", "scored"))
def inspector(s):
    scored = s.scored
    for name in ("m1", "m2"):
        chosen = metrics.pick_threshold(s.scored.where("period = 'validation'"), f"{name}_score")
        scored = metrics.apply_threshold(scored, f"{name}_score", chosen).withColumnRenamed("predicted", f"{name}_predicted")
    table = report.inspector(scored, explain.shap_top_k(_linear_shap(s), list(LINEAR), 3))
    return table.select(
        "txn_id", text("txn_date"), "src", "dst", "payment_format", "payment_currency", "amount_paid", "m1_score",
        "m2_score", "m1_predicted", "m2_predicted", "actual",
        F.concat_ws(",", "top_features.feature").alias("features"),
    )


# --- leakage checks -------------------------------------------------------------

@query(sql("""SELECT node_id || '/' || CAST(feature_date AS VARCHAR) AS row_key, 'n_out_rate' AS column_name,
 """ + r("n_out_rate + 1", "value_a") + ", " + r("n_out_rate", "value_b") + " FROM hist WHERE has_history = 1 AND node_id % 7 = 0 AND day(feature_date) % 5 = 0", "hist"))
def strict_date_audit(s):
    """Rates planted one too high; the audit finds these cells and no other."""
    leaky = (F.col("node_id") % 7 == 0) & (F.dayofmonth("feature_date") % 5 == 0)
    history = s.history.withColumn("n_out_rate", F.col("n_out_rate") + leaky.cast("int"))
    found = leakage.strict_date_audit(s.clean, history, s.first_date, s.last_date)
    return found.select("row_key", "column_name", *rounded("value_a", "value_b"))


@query(sql("SELECT src, dst, CAST(d AS VARCHAR) AS feature_date FROM snaps WHERE first_date + INTERVAL 1 DAY = d AND src % 3 = 0", "snaps"))
def snapshot_audit(s):
    """First dates planted a day late in one third of the senders: the first snapshot of each such edge leaks."""
    late = F.date_add("first_date", F.when(F.col("src") % 3 == 0, 1).otherwise(0))
    planted = graph.snapshots(s.edges, s.last_date).withColumn("first_date", late)
    return graph.snapshot_audit(planted).select("src", "dst", text("feature_date"))


@query(sql("""SELECT CAST(txn_id AS VARCHAR) AS row_key, 'g_pair_prior_count_log' AS column_name,
 """ + r("g_pair_prior_count_log + 1", "value_a") + ", " + r("g_pair_prior_count_log", "value_b") + " FROM pair WHERE txn_id % 11 = 0", "pair"))
def pair_audit(s):
    """Counts planted too high; the audit finds these cells and no other."""
    planted = F.col("g_pair_prior_count_log") + (F.col("txn_id") % 11 == 0).cast("int")
    found = leakage.pair_audit(s.clean, s.pair.withColumn("g_pair_prior_count_log", planted))
    return found.select("row_key", "column_name", *rounded("value_a", "value_b"))


@query(sql("""SELECT node_id || '/' || CAST(feature_date AS VARCHAR) AS row_key, 'n_unique_in_log' AS column_name,
 """ + r("ln(1 + n_unique_in) + 1", "value_a") + ", " + r("ln(1 + n_unique_in)", "value_b") + " FROM cp WHERE node_id % 7 = 0 AND day(feature_date) % 5 = 0", "cp"))
def counterparty_audit(s):
    """Counterparties planted too high; the audit finds these cells and no other."""
    leaky = (F.col("node_id") % 7 == 0) & (F.dayofmonth("feature_date") % 5 == 0)
    table = graph.counterparties(s.edges, graph.active_days(s.clean))
    found = leakage.counterparty_audit(
        s.clean, table.withColumn("n_unique_in_log", F.col("n_unique_in_log") + leaky.cast("int"))
    )
    return found.select("row_key", "column_name", *rounded("value_a", "value_b"))


@query(sql("""SELECT node_id || '/' || CAST(txn_date AS VARCHAR) AS row_key, 'max_today' AS column_name,
 """ + r("max(amount_paid)", "value_a") + ", " + r("max(amount_paid) * 7 + 3", "value_b") + """
FROM (SELECT src AS node_id, txn_date, amount_paid FROM full_txn UNION ALL SELECT dst, txn_date, amount_paid FROM full_txn), span
WHERE node_id % 7 = 0 AND txn_date = first + 8 GROUP BY node_id, txn_date""", "full_txn", "span"))
def future_perturbation(s):
    """Account history and counterparties stay; a planted column that sees its own day moves."""
    def build(txn):
        encoded = with_txn_features(txn, s.amount_stats)
        days = graph.active_days(encoded)
        keys = ["node_id", "feature_date"]
        ends = stack([txn.select(F.col(c).alias("node_id"), F.col("txn_date").alias("feature_date"), "amount_paid")
                      for c in ("src", "dst")])
        planted = ends.where("node_id % 7 = 0").groupBy(*keys).agg(F.max("amount_paid").alias("max_today"))
        history = account.account_history(encoded, s.first_date).drop("n_out_today", "n_in_today")
        people = graph.counterparties(checkpoint(graph.build_edges(encoded)), days)
        return history.join(people, keys).join(planted, keys, "left")

    raw = s.clean.select(*s.txn.columns, "src", "dst")
    found = leakage.future_perturbation(raw, s.bounds.test, build, ["node_id", "feature_date"])
    return found.select("row_key", "column_name", *rounded("value_a", "value_b"))


@query(sql("""SELECT CAST(txn_id AS VARCHAR) AS row_key, 'leak' AS column_name, is_laundering::DOUBLE AS value_a,
 1 - is_laundering::DOUBLE AS value_b FROM full_txn WHERE txn_id % 13 = 0""", "full_txn"))
def label_invariance(s):
    """Transaction, account and pair features stay; a planted column made of the label moves."""
    def build(txn):
        encoded = with_txn_features(txn, s.amount_stats)
        history = account.attach_account_history(encoded, account.account_history(encoded, s.first_date))
        pair = graph.pair_history(encoded, checkpoint(graph.build_edges(encoded)))
        planted = F.when(F.col("txn_id") % 13 == 0, F.col("is_laundering"))
        return history.withColumn("leak", planted).drop("is_laundering").join(pair, "txn_id")

    found = leakage.label_invariance(s.clean.select(*s.txn.columns, "src", "dst"), build, ["txn_id"])
    return found.select("row_key", "column_name", *rounded("value_a", "value_b"))


def _moved_stats() -> str:
    x = "ln(1 + amount_paid)"
    y = "ln(1 + amount_paid * 7 + 3)"
    cells = []
    for key, group in (("payment_currency", "GROUP BY payment_currency"), ("''", "")):
        for name, f in (("mean_log", "avg"), ("sd_log", "stddev_samp")):
            cells.append(f"SELECT {key} AS row_key, '{name}' AS column_name, {r(f'{f}({x})', 'value_a')}, "
                         f"{r(f'{f}({y})', 'value_b')} FROM per WHERE period = 'test' {group}")
    return "SELECT * FROM (" + " UNION ALL ".join(cells) + ") WHERE value_a IS DISTINCT FROM value_b"


@query(sql(_moved_stats(), "per"))
def train_only_statistics(s):
    """Amount statistics planted on the test period; every one of them moves."""
    b = s.bounds
    planted = split.Bounds(b.first, b.test, b.tail, b.tail, b.tail)
    found = leakage.train_only_statistics(s.clean, b, planted).where("column_name IN ('mean_log', 'sd_log')")
    return found.select("row_key", "column_name", *rounded("value_a", "value_b"))
