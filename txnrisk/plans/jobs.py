"""The four stages from raw transactions to result tables.

Each stage reads and writes tables in one folder, so a stage can be rerun alone
and a lost executor costs at most the stage at hand.

    data         transactions_clean, node_map, amount_stats, audits
    features     account_history
    graph        edges, graph_node_day, graph_pair_txn
    experiments  feature_matrix, models and results
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.config import Config
from txnrisk.functions.days import first_and_last_date
from txnrisk.functions.scale import stack
from txnrisk.operators import (
    account, assemble, bootstrap, components, explain, graph, leakage, metrics, model, quality, report, split,
    txn_features,
)
from txnrisk.session import checkpoint
from txnrisk.sources import tables


def run_data(spark: SparkSession, txn: DataFrame, out: str, config: Config = Config()) -> None:
    """Validate, audit, split and encode; nothing is dropped, copies are flagged."""
    structural = quality.validate_schema(txn).where("n_rows IS NULL").collect()
    if structural:
        raise ValueError(f"schema: {[(r.column_name, r.issue) for r in structural]}")
    bounds = split.find_bounds(txn, config)
    node_map = graph.build_node_map(txn)
    tables.write_node_map(node_map, f"{out}/node_map")
    nodes = spark.read.parquet(f"{out}/node_map")
    encoded = graph.encode_nodes(txn, nodes)
    clean = quality.flag_duplicates(split.assign_period(encoded, bounds))
    tables.write_clean(clean.select(*S.CLEAN.fieldNames()), f"{out}/transactions_clean")
    stored = tables.read_table(spark, f"{out}/transactions_clean", S.CLEAN)
    split.fit_amount_stats(stored, bounds).write.mode("overwrite").parquet(f"{out}/amount_stats")
    if config.leakage_checks:
        leakage.require_none({"train_only_statistics": leakage.train_only_statistics(stored, bounds)})
    tables.export_results({
        "schema_report": quality.validate_schema(txn),
        "profile": quality.profile(stored, S.SOURCE_COLUMNS),
        "duplicate_audit": quality.duplicate_audit(stored),
        "id_consistency": quality.id_consistency(txn, nodes, {"transactions_clean": stored}),
        "dataset_summary": quality.dataset_summary(stored),
        "daily_volume": quality.daily_volume(stored),
        "period_summary": split.period_summary(stored),
        "class_weight": split.scale_pos_weight(stored, bounds),
    }, f"{out}/results")


def _with_txn_features(spark: SparkSession, out: str) -> DataFrame:
    clean = tables.read_table(spark, f"{out}/transactions_clean", S.CLEAN)
    return txn_features.txn_features(clean, spark.read.parquet(f"{out}/amount_stats"))


def run_features(spark: SparkSession, out: str, config: Config = Config()) -> None:
    """Account history per (node, day); a leak ends the job."""
    txn = _with_txn_features(spark, out)
    first, last = first_and_last_date(txn)
    account.account_history(txn, first).write.mode("overwrite").parquet(f"{out}/account_history")
    if config.leakage_checks:
        history = spark.read.parquet(f"{out}/account_history")
        leakage.require_none({"strict_date_audit": leakage.strict_date_audit(txn, history, first, last)})


def run_graph(spark: SparkSession, out: str, config: Config = Config()) -> None:
    """Edges, node-day and pair tables; a leak ends the job."""
    clean = tables.read_table(spark, f"{out}/transactions_clean", S.CLEAN)
    _, last = first_and_last_date(clean)
    graph.build_edges(clean).write.mode("overwrite").parquet(f"{out}/edges")
    edges = spark.read.parquet(f"{out}/edges")
    forest = components.merge_forest(edges)
    tables.write_node_day(
        assemble.graph_node_day(clean, edges, last, config, forest), f"{out}/graph_node_day"
    )
    tables.write_pair_txn(graph.pair_history(clean, edges), f"{out}/graph_pair_txn")
    pair = tables.read_table(spark, f"{out}/graph_pair_txn", S.GRAPH_PAIR_TXN)
    if config.leakage_checks:
        node_day = tables.read_table(spark, f"{out}/graph_node_day", S.GRAPH_NODE_DAY)
        dates = clean.select("txn_id", "txn_date")

        def dated_pairs(txn: DataFrame) -> DataFrame:
            return graph.pair_history(txn, checkpoint(graph.build_edges(txn))).join(dates, "txn_id")

        leakage.require_none({
            "pair_audit": leakage.pair_audit(clean, pair),
            "counterparty_audit": leakage.counterparty_audit(clean, node_day),
            "future_perturbation": leakage.future_perturbation(
                clean, split.find_bounds(clean, config).test, dated_pairs, ["txn_id"], "txn_date",
                leakage.repeat_from, pair.join(dates, "txn_id"),
            ),
        })
    tables.export_results({
        "network_stats": report.network_stats(edges, last, components.component_summary(edges, last, forest)),
        "degree_distribution": report.degree_distribution(edges),
        "new_pair_analysis": report.new_pair_analysis(clean, pair),
        "graph_id_consistency": quality.id_consistency(
            clean, spark.read.parquet(f"{out}/node_map"), {"graph_pair_txn": pair}
        ),
    }, f"{out}/results")


def build_matrix(spark: SparkSession, out: str) -> DataFrame:
    """Feature matrix from the stage tables; one row per transaction, or an error."""
    txn = _with_txn_features(spark, out)
    assembled = assemble.assemble(
        txn, spark.read.parquet(f"{out}/account_history"),
        tables.read_table(spark, f"{out}/graph_node_day", S.GRAPH_NODE_DAY),
        tables.read_table(spark, f"{out}/graph_pair_txn", S.GRAPH_PAIR_TXN),
    )
    # columnar and by period: a fit reads its columns of the training files only
    assembled.write.mode("overwrite").partitionBy("period").parquet(f"{out}/feature_matrix")
    matrix = spark.read.schema(assembled.schema).parquet(f"{out}/feature_matrix")
    before, after = txn.count(), matrix.count()
    if before != after:
        raise RuntimeError(f"assembly changed the row count from {before} to {after}")
    return matrix


def run_experiments(spark: SparkSession, out: str, config: Config = Config()) -> None:
    """Fit the grid, freeze thresholds on validation, evaluate, explain, export."""
    matrix = build_matrix(spark, out)
    bounds = split.find_bounds(matrix, config)
    pos_weight = split.scale_pos_weight(matrix, bounds).first()["scale_pos_weight"]
    if pos_weight is None:
        raise ValueError("no positive row in the training period")
    scores, fitted = model.run_grid(matrix, pos_weight, config)
    for (name, variant, seed), one in fitted.items():
        model.save_model(one, f"{out}/models/{name}-{variant}-{seed}")
    results = checkpoint(model.grid_results(scores, config))

    # every configuration and seed, at its own threshold from validation
    by = ["model", "variant", "seed"]
    grid_test = scores.where("period = 'test'")
    frozen = checkpoint(metrics.pick_threshold(scores.where("period = 'validation'"), "score", by=by))
    grid_confusion = metrics.confusion(metrics.apply_threshold(grid_test, "score", frozen, by), by=by)
    gains = checkpoint(report.gains(
        grid_test, config.bootstrap_replicates, config.bootstrap_seed, config.confidence))

    seed = config.seeds[0]
    m1, m2 = fitted["M1", "full", seed], fitted["M2", "full", seed]
    scored = checkpoint(model.score(m2, model.score(m1, matrix, "m1_score"), "m2_score"))
    validation = scored.where("period = 'validation'")
    predicted = scored
    confusions = []
    for name in ("m1", "m2"):
        chosen = checkpoint(metrics.pick_threshold(validation, f"{name}_score"))
        predicted = metrics.apply_threshold(predicted, f"{name}_score", chosen).withColumnRenamed(
            "predicted", f"{name}_predicted"
        )
        at = metrics.apply_threshold(scored.where("period = 'test'"), f"{name}_score", chosen)
        confusions.append(metrics.confusion(at).withColumn("model", F.lit(name)))
    test = scored.where("period = 'test'")
    hard = metrics.hard_subset(test)
    long = metrics.unpivot_scores(test, {"m1": "m1_score", "m2": "m2_score"}, ["is_laundering"])

    def interval(df: DataFrame) -> DataFrame:
        return checkpoint(bootstrap.paired_bootstrap(
            df, "m1_score", "m2_score", config.bootstrap_replicates, config.bootstrap_seed,
            confidence=config.confidence,
        ))

    columns = S.feature_set("M2", "full")
    shap = checkpoint(explain.shap_values(m2, test))
    top = explain.shap_top_k(shap, columns, config.shap_top)
    delta = checkpoint(metrics.pr_auc_delta(test, "m1_score", "m2_score"))
    test_interval = interval(test)
    edges = spark.read.parquet(f"{out}/edges")
    numeric = [c for c in columns if c not in S.CATEGORICAL]
    tables.export_results({
        "grid_results": results,
        "seed_summary": model.seed_summary(results),
        "variant_comparison": report.variant_comparison(results),
        "gains": gains,
        "gain_summary": report.gain_summary(gains),
        "grid_pr_curves": metrics.pr_curve(grid_test, "score", by=by),
        "grid_confusion": grid_confusion,
        "pr_curves": metrics.pr_curve(long, "score", by=["model"]),
        "confusion": stack(confusions),
        "delta": delta,
        "interval": test_interval,
        "hard_subset": metrics.pr_auc_delta(hard, "m1_score", "m2_score"),
        "hard_subset_interval": interval(hard),
        "period_metrics": report.period_metrics(scored, ["m1_score", "m2_score"]),
        "feature_drift": report.feature_drift(matrix, numeric),
        "shortcuts": report.shortcut_table(matrix),
        "shap_summary": explain.shap_summary(shap, columns),
        "grouped_permutation": explain.grouped_permutation(
            test, lambda df: model.score(m2, df), S.GROUPS, config.bootstrap_seed
        ),
        "suspicious_subgraph": report.suspicious_subgraph(
            edges, predicted.where("period = 'test' AND m2_predicted = 1"), config.subgraph_hops
        ),
        "overview": report.overview(quality.dataset_summary(matrix), delta, test_interval),
        "inspector": report.inspector(predicted, top).repartitionByRange("txn_id"),
    }, f"{out}/results")
