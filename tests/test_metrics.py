import random

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import bootstrap, metrics, report


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, s, y, *more) for i, (s, y, *more) in enumerate(rows)],
        "txn_id long, score double, is_laundering int" + (", other double" if len(rows[0]) > 2 else ""))


def brute_ap(rows):
    total = sum(y for _, y in rows)
    out = 0.0
    for s in {s for s, _ in rows}:
        at = sum(y for t, y in rows if t == s)
        above = [y for t, y in rows if t >= s]
        out += at / total * sum(above) / len(above)
    return out


def brute_roc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


@pytest.mark.parametrize("seed,levels", [(1, 3), (2, 40), (3, 5000)])
def test_against_brute_force(spark, seed, levels):
    rng = random.Random(seed)
    rows = [(rng.randint(0, levels) / 10, int(rng.random() < 0.2)) for _ in range(400)]
    df = frame(spark, rows)
    assert metrics.pr_auc(df, "score").first().pr_auc == pytest.approx(brute_ap(rows))
    assert metrics.roc_auc(df, "score").first().roc_auc == pytest.approx(brute_roc(rows))
    # unchanged by a monotone map of the scores
    moved = df.withColumn("score", F.exp("score"))
    assert metrics.pr_auc(moved, "score").first().pr_auc == pytest.approx(brute_ap(rows))
    for k in (1, 7, 100, 400):
        top = sorted(enumerate(rows), key=lambda e: (-e[1][0], e[0]))[:k]
        got = metrics.recall_at_budget(df, "score", k).first()
        assert (got.n_alerts, got.n_hits) == (k, sum(y for _, (_, y) in top))


def test_all_scores_equal(spark):
    df = frame(spark, [(0.5, 1), (0.5, 0), (0.5, 0), (0.5, 0)])
    assert metrics.pr_auc(df, "score").first().pr_auc == 0.25
    assert metrics.roc_auc(df, "score").first().roc_auc == 0.5
    assert metrics.recall_at_budget(df, "score", 2).first().n_hits == 1


def test_one_class_only(spark):
    df = frame(spark, [(0.1, 0), (0.2, 0)])
    assert metrics.pr_auc(df, "score").first().pr_auc is None
    assert metrics.roc_auc(df, "score").first().roc_auc is None
    assert metrics.pr_curve(df, "score").select("recall").distinct().collect()[0].recall is None
    hit = metrics.apply_threshold(df, "score", 0.15)
    assert metrics.threshold_metrics(hit).first().recall is None


def test_threshold_ties_take_the_highest(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 0), (0.6, 1), (0.5, 0)]
    df = frame(spark, rows)
    f1 = {s: 2 * sum(y for t, y in rows if t >= s) / (sum(t >= s for t, _ in rows) + 2) for s, _ in rows}
    best = max(f1, key=lambda s: (f1[s], s))
    assert metrics.pick_threshold(df, "score").first().threshold == best


def test_confusion_has_all_cells(spark):
    df = metrics.apply_threshold(frame(spark, [(0.9, 1), (0.8, 1)]), "score", 0.5)
    cells = {(r.predicted, r.actual): r.n for r in metrics.confusion(df).collect()}
    assert cells == {(1, 1): 2, (1, 0): 0, (0, 1): 0, (0, 0): 0}


def test_bootstrap(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(150)]
    df = frame(spark, rows)
    same = bootstrap.paired_bootstrap(df, "score", "score", 20).first()
    assert (same.n_replicates, same.mean_delta, same.ci_low, same.ci_high) == (20, 0, 0, 0)
    got = {r.replicate: r for r in bootstrap.bootstrap_replicates(df, "score", "other", 3).collect()}
    import hashlib
    for b in range(3):
        m1, m2 = [], []
        for i, (s, y, o) in enumerate(rows):
            u = int(hashlib.md5(f"42|{b}|{i}".encode()).hexdigest()[:8], 16) / 2 ** 32
            w = sum(u >= x for x in bootstrap.POISSON_BOUNDS)
            m1 += [(s, y)] * w
            m2 += [(o, y)] * w
        assert got[b].pr_auc_m1 == pytest.approx(brute_ap(m1))
        assert got[b].delta == pytest.approx(brute_ap(m2) - brute_ap(m1))


def test_drift_of_equal_and_of_shifted_data(spark):
    rows = [("train", float(i)) for i in range(100)] + [("tail", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "period string, x double")
    row = report.feature_drift(df, ["x"]).first()
    assert row.n_bins == 10 and row.psi == pytest.approx(0)
    moved = df.withColumn("x", F.when(F.col("period") == "tail", F.col("x") + 50).otherwise(F.col("x")))
    assert report.feature_drift(moved, ["x"]).first().psi > 1
