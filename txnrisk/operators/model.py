"""Gradient-boosted trees: encoding, training, scoring, the experiment grid."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import or_

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.config import Config
from txnrisk.operators.metrics import (
    apply_threshold, pick_threshold, pr_auc, recall_at_budget, roc_auc, threshold_metrics,
)
from txnrisk.session import checkpoint, ensure_checkpoint_dir

FIT_ROWS_CONF = "spark.txnrisk.fitRows"
FIT_ROWS_DEFAULT = 200_000
FIT_ROWS_HELD_CONF = "spark.txnrisk.fitRowsHeld"
FIT_ROWS_HELD_DEFAULT = 4_000_000


def feature_pipeline(columns: Sequence[str]) -> Pipeline:
    """Index categories as seen in training and assemble one vector.

    Values that training has not seen get an index of their own. The vector keeps
    the order of ``columns``.
    """
    texts = [c for c in columns if c in S.CATEGORICAL]
    stages = []
    if texts:
        stages.append(StringIndexer(
            inputCols=texts, outputCols=[f"{c}_index" for c in texts], handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ))
    inputs = [f"{c}_index" if c in texts else c for c in columns]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    return Pipeline(stages=stages)


def train(
    matrix: DataFrame, columns: Sequence[str], seed: int, pos_weight: float, config: Config = Config(),
) -> PipelineModel:
    """Fit on the training period; a positive row weighs ``pos_weight``.

    Every category needs a bin of its own, so there are at least as many bins as the
    widest categorical column has values in training, unseen ones included. A null
    number stops the fit before it starts, with the number of rows that have one.
    """
    ensure_checkpoint_dir(matrix.sparkSession)
    rows = _training_rows(matrix, columns, pos_weight)
    return _fit(rows, *_encoder(rows, columns, config), seed, config)


def _training_rows(matrix: DataFrame, columns: Sequence[str], pos_weight: float) -> DataFrame:
    return matrix.where("period = 'train'").select(
        *columns, F.col("is_laundering").cast("double").alias("label"),
        F.when(F.col("is_laundering") == 1, F.lit(float(pos_weight))).otherwise(1.0).alias("weight"),
    )


def _encoder(rows: DataFrame, columns: Sequence[str], config: Config) -> tuple[PipelineModel, int]:
    """The fitted feature stages of ``columns`` and the number of bins; the same for all seeds."""
    texts = [c for c in columns if c in S.CATEGORICAL]
    empty = reduce(or_, (F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns if c not in texts), F.lit(False))
    facts = rows.agg(
        F.count(F.when(empty, 1)).alias("_empty"), *[F.count_distinct(c).alias(c) for c in texts]
    ).first()
    if facts["_empty"]:
        raise ValueError(f"{facts['_empty']} training rows have a feature without a number")
    return feature_pipeline(columns).fit(rows), max([config.tree_bins, *(facts[c] + 1 for c in texts)])


def _fit(rows: DataFrame, encoder: PipelineModel, bins: int, seed: int, config: Config) -> PipelineModel:
    estimator = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", seed=seed,
        maxDepth=config.tree_depth, maxIter=config.tree_rounds,
        maxBins=bins, subsamplingRate=config.subsampling,
    )
    return PipelineModel([*encoder.stages, estimator.fit(encoder.transform(rows))])


def score(model: PipelineModel, df: DataFrame, out: str = "score", digits: int | None = None) -> DataFrame:
    """Add the probability of a positive; rounded only if ``digits`` are given."""
    added = [c for c in model.transform(df.limit(0)).columns if c not in df.columns]
    probability = vector_to_array("probability")[1]
    if digits is not None:
        probability = F.round(probability, digits)
    return model.transform(df).withColumn(out, probability).drop(*added)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def run_grid(
    matrix: DataFrame, pos_weight: float, config: Config = Config(),
    models: Sequence[str] = ("M1", "M2"), variants: Sequence[str] = ("full", "no_shortcut"),
) -> tuple[DataFrame, dict[tuple[str, str, int], PipelineModel]]:
    """Fit each configuration for each seed and score all validation, test and tail rows.

    Returns ``(txn_id, period, is_laundering, model, variant, seed, score)`` and the
    fitted models. ``matrix`` is read twice. Its training rows are stored once with the
    columns of all configurations. A tree level is a job over all partitions, some
    250 levels a fit, so the fits read them in no more partitions than there are cores
    or ``spark.txnrisk.fitRows`` (200,000) ask for. A few fits are submitted side by side,
    so that one fills the gaps of another, as long as the rows that they hold in memory
    stay within ``spark.txnrisk.fitRowsHeld`` (4,000,000) together. All models score a row
    in one pass; the scores are stored with a row per transaction, by period.
    """
    spark = matrix.sparkSession
    grid = [(m, v, s) for m in models for v in variants for s in config.seeds]
    sets = {(m, v): S.feature_set(m, v) for m in models for v in variants}
    columns = list(dict.fromkeys(c for names in sets.values() for c in names))
    rows = checkpoint(_training_rows(matrix, columns, pos_weight))
    n_rows = rows.count()
    per_task = int(spark.conf.get(FIT_ROWS_CONF, str(FIT_ROWS_DEFAULT)))
    held = int(spark.conf.get(FIT_ROWS_HELD_CONF, str(FIT_ROWS_HELD_DEFAULT)))
    # never more partitions than there are, and neither a shuffle nor another order of rows
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-n_rows // per_task)))

    def encoder(key: tuple[str, str]) -> tuple[PipelineModel, int]:
        return _encoder(rows, sets[key], config)

    def fit(key: tuple[str, str, int]) -> PipelineModel:
        name, variant, seed = key
        return _fit(rows, *encoders[name, variant], seed, config)

    def side_by_side(work, keys: Sequence) -> dict:
        with ThreadPoolExecutor(max(1, min(config.parallel_fits, held // max(1, n_rows)))) as pool:
            jobs = [pool.submit(inheritable_thread_target(spark)(work), key) for key in keys]
            return dict(zip(keys, [job.result() for job in jobs]))

    encoders = side_by_side(encoder, list(sets))
    fitted = side_by_side(fit, grid)
    later = matrix.where("period IN ('validation', 'test', 'tail')").select(
        "txn_id", "period", "is_laundering", *columns
    )
    for (name, variant), (encode, _) in encoders.items():
        later = _seed_scores(later, encode, {
            f"_score_{i}": fitted[key] for i, key in enumerate(grid) if key[:2] == (name, variant)
        })
    wide = _stored_by_period(later.drop(*columns))
    scores = F.array(*[
        F.struct(F.lit(name).alias("model"), F.lit(variant).alias("variant"),
                 F.lit(seed).alias("seed"), F.col(f"_score_{i}").alias("score"))
        for i, (name, variant, seed) in enumerate(grid)
    ])
    return wide.select("txn_id", "period", "is_laundering", F.inline(scores)), fitted


def _seed_scores(df: DataFrame, encoder: PipelineModel, fits: Mapping[str, PipelineModel]) -> DataFrame:
    """Add the scores of fits with the same feature stages; a row is encoded once for all."""
    scored = encoder.transform(df)
    for out, fit in fits.items():
        scored = score(PipelineModel([fit.stages[-1]]), scored, out)
    return scored.select(*df.columns, *fits)


def _stored_by_period(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a period is read alone."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/scores-{uuid.uuid4().hex}"
    df.write.partitionBy("period").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def grid_results(scores: DataFrame, config: Config = Config()) -> DataFrame:
    """Test metrics per model, variant and seed, at the threshold frozen on validation."""
    by = ["model", "variant", "seed"]
    test = scores.where("period = 'test'")
    chosen = checkpoint(pick_threshold(scores.where("period = 'validation'"), "score", by=by))
    at_threshold = threshold_metrics(apply_threshold(test, "score", chosen, by), by=by)
    budget = recall_at_budget(test, "score", share=config.alert_budget, by=by)
    parts = [
        roc_auc(test, "score", by=by), chosen.select(*by, "threshold"),
        at_threshold.select(*by, "precision", "recall", "f1", "accuracy"),
        budget.select(*by, F.col("recall").alias("recall_at_budget")),
    ]
    results = pr_auc(test, "score", by=by)
    for part in parts:  # one row per configuration on both sides
        results = results.join(part, by)
    return results


def seed_summary(results: DataFrame, value: str = "pr_auc") -> DataFrame:
    """Mean and spread over seeds."""
    return results.groupBy("model", "variant").agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lowest"), F.max(value).alias("highest"),
    )


def what_if(
    model: PipelineModel, df: DataFrame, overrides: Mapping[str, Column], stored: DataFrame | None = None,
) -> DataFrame:
    """Score rows with some features replaced, next to their unchanged score.

    ``stored`` holds the batch scores (txn_id, score) of the same rows; if the scores
    of now differ from them, nothing is returned but an error.
    """
    unknown = set(overrides) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    before = score(model, df, "score_before")
    if stored is not None:
        now = before.select("txn_id", F.col("score_before").alias("score"))
        if not parity(now, stored).isEmpty():
            raise ValueError("the model does not give the stored scores")
    changed = before.withColumns(dict(overrides))
    return score(model, changed, "score_after").withColumn(
        "change", F.col("score_after") - F.col("score_before")
    )


def parity(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Transactions whose two scores differ or that only one side has.

    Must be empty before what-if results are shown.
    """
    left = a.select("txn_id", F.col("score").alias("score_a"))
    right = b.select("txn_id", F.col("score").alias("score_b"))
    differs = F.abs(F.col("score_a") - F.col("score_b")) > tolerance
    return left.join(right, "txn_id", "full").where(
        F.col("score_a").isNull() | F.col("score_b").isNull() | differs
    )
