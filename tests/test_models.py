import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.config import Config, load_config
from txnrisk.operators import explain, metrics, model
from txnrisk.session import checkpoint

SMALL = Config(tree_rounds=4, tree_depth=3, seeds=(42, 43))


@pytest.fixture(scope="module")
def matrix(spark):
    from conformance.stages import stages

    return stages(spark, "/root/testdata/sf0.001").matrix


@pytest.fixture(scope="module")
def fitted(matrix):
    return model.train(matrix, S.feature_set("M2", "full"), 42, 20.0, SMALL)


def brute_shap(ensemble_trees, x, n):
    """Shapley values by the definition, over all subsets of the features."""
    def expect(node, known):
        if node.leftChild < 0:
            return node.prediction
        left, right = by_id[node.leftChild], by_id[node.rightChild]
        f = node.split.featureIndex
        if f in known:
            values = node.split.leftCategoriesOrThreshold
            goes_left = x[f] in values if node.split.numCategories >= 0 else x[f] <= values[0]
            return expect(left if goes_left else right, known)
        a, b = left.impurityStats[0], right.impurityStats[0]
        return (a * expect(left, known) + b * expect(right, known)) / (a + b)

    phi = np.zeros(n)
    for by_id, weight in ensemble_trees:
        used = sorted({v.split.featureIndex for v in by_id.values() if v.leftChild >= 0})
        m = len(used)
        for j in used:
            others = [f for f in used if f != j]
            for size in range(m):
                for known in itertools.combinations(others, size):
                    factor = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                    phi[j] += weight * factor * (
                        expect(by_id[0], {*known, j}) - expect(by_id[0], set(known)))
    return phi


def test_shap_equals_definition_and_adds_up(spark, matrix, fitted, tmp_path):
    rows = matrix.where("period = 'test'")
    shap = {r.txn_id: r for r in explain.shap_values(fitted, rows).collect()}
    assert len(shap) == rows.count()
    gbt = fitted.stages[-1]
    gbt.save(str(tmp_path / "gbt"))
    nodes = {}
    for r in spark.read.parquet(str(tmp_path / "gbt" / "data")).collect():
        nodes.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    trees = [(nodes[t], gbt.treeWeights[t]) for t in sorted(nodes)]
    from pyspark.ml.functions import vector_to_array
    inputs = fitted.transform(rows).select(
        "txn_id", vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p")).collect()
    for r in inputs:
        got = shap[r.txn_id]
        assert 1 / (1 + math.exp(-2 * got.margin)) == pytest.approx(r.p, abs=1e-6)
        assert got.base + sum(got.phi) == pytest.approx(got.margin)
    for r in inputs[:12]:
        assert np.allclose(shap[r.txn_id].phi, brute_shap(trees, r.x, gbt.numFeatures), atol=1e-9)


def test_top_features(spark):
    df = spark.createDataFrame([(1, [0.1, -0.5, 0.5, 0.0])], "txn_id long, phi array<double>")
    top = explain.shap_top_k(df, ["a", "c", "b", "d"], 3).first().top_features
    assert [(t.feature, t.phi) for t in top] == [("b", 0.5), ("c", -0.5), ("a", 0.1)]


def test_unseen_category_is_scored(matrix, fitted):
    odd = matrix.limit(5).withColumn("t_payment_format", F.lit("never seen"))
    assert model.score(fitted, odd).where("score IS NULL").count() == 0


def test_save_load_and_parity(matrix, fitted, tmp_path):
    model.save_model(fitted, str(tmp_path / "m"))
    again = model.load_model(str(tmp_path / "m"))
    a, b = model.score(fitted, matrix), model.score(again, matrix)
    assert model.parity(a, b).count() == 0
    assert model.parity(a, b.withColumn("score", F.col("score") + 0.1)).count() == matrix.count()
    unchanged = model.what_if(fitted, matrix, {"t_hour": F.col("t_hour")})
    assert unchanged.where("change <> 0").count() == 0
    with pytest.raises(ValueError):
        model.what_if(fitted, matrix, {"nope": F.lit(1)})


def test_grid(matrix):
    scores, fits = model.run_grid(matrix, 20.0, SMALL)
    assert len(fits) == 8
    results = model.grid_results(scores, SMALL)
    assert results.count() == 8
    assert model.seed_summary(results).count() == 4


def test_grid_reads_the_matrix_twice_and_fits_on_few_partitions(spark, matrix, monkeypatch):
    reads, layouts = spark.sparkContext.accumulator(0), []

    @F.udf("double")
    def counted(x):
        reads.add(1)
        return x

    fit = GBTClassifier._fit

    def watched(self, dataset):
        layouts.append(dataset.rdd.getNumPartitions())
        return fit(self, dataset)

    monkeypatch.setattr(GBTClassifier, "_fit", watched)
    spread = checkpoint(matrix.repartition(40, "txn_id"))
    watched_rows = spread.withColumn("t_log_amount_paid", counted("t_log_amount_paid"))
    one = Config(tree_rounds=2, tree_depth=2, seeds=(42,), parallel_fits=1)
    scores, fits = model.run_grid(watched_rows, 20.0, one)
    assert reads.value <= 2 * matrix.count()
    assert len(layouts) == 4 and max(layouts) <= spark.sparkContext.defaultParallelism
    # every later row, the tail included, with the score that its model gives alone
    later = spread.where("period IN ('validation', 'test', 'tail')")
    for (name, variant, seed), fitted_model in fits.items():
        mine = scores.where((F.col("model") == name) & (F.col("variant") == variant) & (F.col("seed") == seed))
        assert mine.count() == later.count()
        assert model.parity(mine, model.score(fitted_model, later), 0.0).count() == 0
    periods = lambda df: {r.period: r["count"] for r in df.groupBy("period").count().collect()}
    assert periods(scores) == {p: 4 * n for p, n in periods(later).items()}


def test_grid_fits_side_by_side_change_nothing(spark, matrix):
    small = Config(tree_rounds=2, tree_depth=2, seeds=(42,))
    keys = ["txn_id", "period", "is_laundering", "model", "variant", "seed", "score"]
    together, _ = model.run_grid(matrix, 20.0, small)
    spark.conf.set(model.FIT_ROWS_HELD_CONF, "1")
    try:
        alone, _ = model.run_grid(matrix, 20.0, small)
    finally:
        spark.conf.unset(model.FIT_ROWS_HELD_CONF)
    assert alone.select(keys).exceptAll(together.select(keys)).isEmpty()
    assert alone.count() == together.count() > 0


def test_permutation_keeps_rows_and_values(matrix):
    mixed = explain.permuted_groups(matrix, {"P": S.PAIR_HISTORY}, 42)
    assert mixed.count() == matrix.count()
    for c in S.PAIR_HISTORY:
        a = sorted(r[0] for r in mixed.select(f"donor.{c}").collect())
        assert a == sorted(r[0] for r in matrix.select(c).collect())
    # a score that ignores the group does not move
    flat = explain.grouped_permutation(
        matrix, lambda df: df.withColumn("score", F.round("t_log_amount_paid", 3)), S.GROUPS)
    assert all(r.importance == 0 for r in flat.collect())


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("tree_rounds: 7\nseeds: [1, 2]\n")
    assert load_config(str(path)) == Config(tree_rounds=7, seeds=(1, 2))
    path.write_text("no_such: 1\n")
    with pytest.raises(ValueError):
        load_config(str(path))
    from pathlib import Path
    assert load_config(str(Path(__file__).resolve().parents[1] / "configs" / "config.yaml")) == Config()
