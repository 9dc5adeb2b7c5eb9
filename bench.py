"""Wall seconds of the headline operators, after one warm run each.

Prints one JSON line. ``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores.
The inputs of each operator (encoded transactions, edges, matrix, model) are
prepared outside the measured time; every measured run computes all rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    from conformance.stages import Stages, surrogate_scores
    from txnrisk import schema as S
    from txnrisk.operators import (
        account, assemble, bootstrap, components, explain, graph, metrics, model, pagerank,
    )
    from txnrisk.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=8 if cpus == "*" else int(cpus), memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    s = Stages(spark, sf_dir)
    clean, edges, config = s.clean, s.edges, s.config
    days = graph.active_days(clean)
    columns = S.feature_set("M2", "full")

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def account_history():
        run(account.attach_account_history(clean, account.account_history(clean, s.first_date)))

    def pair_history():
        run(graph.pair_history(clean, edges))

    def unique_counterparties():
        run(graph.counterparties(edges, days))

    def pagerank_all_dates():
        run(pagerank.pagerank(edges, days, s.last_date, config.damping, config.pagerank_iterations))

    def wcc_all_dates():
        run(components.wcc(edges, days, s.last_date))

    def feature_matrix():
        run(assemble.assemble(
            clean, account.account_history(clean, s.first_date),
            assemble.graph_node_day(clean, edges, s.last_date, config), graph.pair_history(clean, edges),
        ))

    def fit_and_score():
        fitted = model.train(s.matrix, columns, config.seeds[0], s.pos_weight, config)
        run(model.score(fitted, s.matrix.where("period = 'test'")))

    def pr_auc():
        run(metrics.pr_auc_delta(test, "m1_score", "m2_score"))

    def paired_bootstrap():
        run(bootstrap.paired_bootstrap(test, "m1_score", "m2_score", config.bootstrap_replicates))

    def shap_test_rows():
        run(explain.shap_values(fitted, s.matrix.where("period = 'test'")))

    def grouped_permutation():
        run(explain.grouped_permutation(
            s.matrix.where("period = 'test'"), lambda df: model.score(fitted, df), S.GROUPS
        ))

    seconds: dict[str, float] = {}

    def measure(*operators) -> None:
        for operator in operators:
            operator()
            started = time.perf_counter()
            operator()
            seconds[operator.__name__] = round(time.perf_counter() - started, 3)
            print(f"{operator.__name__}: {seconds[operator.__name__]}", file=sys.stderr, flush=True)

    measure(account_history, pair_history, unique_counterparties, pagerank_all_dates, wcc_all_dates,
            feature_matrix, fit_and_score)
    test = s.matrix.withColumns(surrogate_scores()).where("period = 'test'")
    fitted = model.train(s.matrix, columns, config.seeds[0], s.pos_weight, config)
    measure(pr_auc, paired_bootstrap, shap_test_rows, grouped_permutation)
    print(json.dumps({
        "metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1], "cpus": cpus,
        "rows": clean.count(),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
