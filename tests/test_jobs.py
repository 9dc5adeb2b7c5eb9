import json
import subprocess
import sys
from pathlib import Path

import pytest

from conformance.compare import duck, differences
from conformance.queries import ORACLES, QUERIES
from txnrisk import schema as S
from txnrisk.config import Config
from txnrisk.plans import jobs
from txnrisk.sources.events import transactions_from_events

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_all_stages(spark, tmp_path):
    out = str(tmp_path)
    config = Config(tree_rounds=2, tree_depth=2, seeds=(42,), bootstrap_replicates=5,
                    pagerank_iterations=3)
    jobs.run_data(spark, transactions_from_events(spark, SF), out, config)
    jobs.run_features(spark, out)
    jobs.run_graph(spark, out, config)
    jobs.run_experiments(spark, out, config)
    names = {p.name for p in (tmp_path / "results").iterdir()}
    assert {"overview", "inspector", "confusion", "pr_curves", "shap_summary", "grid_results",
            "grouped_permutation", "network_stats", "period_metrics", "suspicious_subgraph"} <= names
    read = lambda name: spark.read.parquet(f"{out}/results/{name}")
    assert read("id_consistency").count() == 0 and read("graph_id_consistency").count() == 0
    assert read("schema_report").count() == 0
    assert read("inspector").count() == spark.read.parquet(f"{out}/feature_matrix").where("period = 'test'").count()
    assert read("grid_results").count() == 4
    assert sorted((r.variant, r.seed) for r in read("gains").collect()) == [("full", 42), ("no_shortcut", 42)]
    assert {r.variant: r.n_seeds for r in read("gain_summary").collect()} == {"full": 1, "no_shortcut": 1}
    per_model = read("grid_confusion").groupBy("model", "variant", "seed").sum("n").collect()
    assert [r["sum(n)"] for r in per_model] == [read("inspector").count()] * 4
    assert read("grid_pr_curves").select("model", "variant", "seed").distinct().count() == 4
    assert len(list((tmp_path / "models").iterdir())) == 4


def test_structural_errors_stop_the_first_stage(spark, tmp_path):
    txn = transactions_from_events(spark, SF).drop("payment_format")
    with pytest.raises(ValueError, match="payment_format"):
        jobs.run_data(spark, txn, str(tmp_path))


def test_checkpoint_folder_comes_from_the_session():
    code = (
        "import sys, tempfile; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "from txnrisk.session import checkpoint\n"
        "d = tempfile.mkdtemp()\n"
        "s = SparkSession.builder.master('local[1]').config('spark.checkpoint.dir', d)"
        ".config('spark.ui.enabled', 'false').getOrCreate()\n"
        "checkpoint(s.range(3))\n"
        "print('FOLDER', s.sparkContext.getCheckpointDir().startswith('file:' + d))\n"
    ) % str(ROOT)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200)
    assert "FOLDER True" in done.stdout, done.stderr[-500:]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    """At the smallest scale here; the comparison tool runs the same at larger ones."""
    assert differences(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) == []


def test_every_query_is_listed_once():
    assert set(ORACLES) <= set(QUERIES)
    assert json.dumps(sorted(QUERIES))
    assert len(S.feature_set("M2", "full")) == 39
