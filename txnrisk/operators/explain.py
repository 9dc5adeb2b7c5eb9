"""SHAP values of the tree ensemble and grouped permutation importance."""

from __future__ import annotations

import dataclasses
import math
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions.scale import global_index, stack
from txnrisk.operators.metrics import pr_auc
from txnrisk.session import checkpoint, ensure_checkpoint_dir


@dataclasses.dataclass
class Leaf:
    """A leaf as a product of per-feature conditions.

    ``tests``   per distinct feature of the path: (feature, node positions, sides)
    ``effect``  contribution of each feature for each pattern of met conditions
    """

    tests: list[tuple[int, list[int], list[bool]]]
    effect: np.ndarray


@dataclasses.dataclass
class Ensemble:
    """Splits and leaves of all trees; at most trees x 2^depth leaves."""

    splits: list[tuple[int, float, frozenset[float] | None]]
    leaves: list[Leaf]
    base: float
    n_features: int


def _effects(value: float, shares: Sequence[float]) -> np.ndarray:
    """Shapley values of ``value * prod(met or share)`` for every pattern of met tests.

    For feature j, the product of (share + met x) over the other features has at x^k
    the sum over all known sets of size k; each size has one Shapley factor.
    """
    m = len(shares)
    met = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    factors = np.array([
        math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)
    ])
    effect = np.empty((1 << m, m))
    for j in range(m):
        by_size = np.zeros((1 << m, m))
        by_size[:, 0] = 1.0
        for i in range(m):
            if i != j:
                grown = by_size * shares[i]
                grown[:, 1:] += by_size[:, :-1] * met[:, [i]]
                by_size = grown
        effect[:, j] = value * (met[:, j] - shares[j]) * (by_size @ factors)
    return effect


def read_ensemble(model: PipelineModel) -> Ensemble:
    """Trees of a fitted pipeline, from the node table that Spark saves.

    The table has at most trees x 2^(depth + 1) rows, so the driver takes it whole.
    """
    from pyspark.sql import SparkSession

    gbt = model.stages[-1]
    if not isinstance(gbt, GBTClassificationModel):
        raise TypeError("SHAP values need a Spark gradient-boosted tree model")
    spark = SparkSession.active()
    folder = f"{ensure_checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    gbt.write().overwrite().save(folder)
    tree_weights = gbt.treeWeights
    nodes: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{folder}/data").collect():
        nodes.setdefault(row.treeID, {})[row.nodeData.id] = row.nodeData
    ensemble = Ensemble([], [], 0.0, gbt.numFeatures)
    for tree, by_id in sorted(nodes.items()):
        _add_tree(ensemble, by_id, tree_weights[tree])
    return ensemble


def _add_tree(ensemble: Ensemble, by_id: Mapping[int, object], weight: float) -> None:
    # (node, path); a path entry is (feature, split position, goes left, share of rows)
    todo = [(by_id[0], [])]
    while todo:
        node, path = todo.pop()
        if node.leftChild < 0:
            features = list(dict.fromkeys(step[0] for step in path))
            tests, shares = [], []
            for f in features:
                mine = [step for step in path if step[0] == f]
                tests.append((f, [s[1] for s in mine], [s[2] for s in mine]))
                shares.append(math.prod(s[3] for s in mine))
            value = weight * node.prediction
            ensemble.base += value * math.prod(shares)
            if features:
                ensemble.leaves.append(Leaf(tests, _effects(value, shares)))
            continue
        split = node.split
        values = split.leftCategoriesOrThreshold
        categories = frozenset(values) if split.numCategories >= 0 else None
        ensemble.splits.append((split.featureIndex, values[0] if values else 0.0, categories))
        position = len(ensemble.splits) - 1
        for child, left in ((by_id[node.leftChild], True), (by_id[node.rightChild], False)):
            # rows weighted as in training
            share = child.impurityStats[0] / node.impurityStats[0]
            todo.append((child, [*path, (split.featureIndex, position, left, share)]))


def ensemble_shap(ensemble: Ensemble, x: np.ndarray) -> np.ndarray:
    """SHAP values of a batch, rows x features."""
    left = [
        np.isin(x[:, f], list(categories)) if categories is not None else x[:, f] <= threshold
        for f, threshold, categories in ensemble.splits
    ]
    phi = np.zeros((len(x), ensemble.n_features))
    for leaf in ensemble.leaves:
        pattern = np.zeros(len(x), dtype=np.int64)
        for bit, (_, positions, sides) in enumerate(leaf.tests):
            met = np.ones(len(x), dtype=bool)
            for position, side in zip(positions, sides):
                met &= left[position] if side else ~left[position]
            pattern |= met.astype(np.int64) << bit
        effect = leaf.effect[pattern]
        for bit, (feature, _, _) in enumerate(leaf.tests):
            phi[:, feature] += effect[:, bit]
    return phi


def shap_values(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``(txn_id, base, margin, phi)``: exact path-dependent values on the margin.

    ``phi`` has one entry per input column, in the order of the feature set. The
    work is one narrow stage: a batch of rows in, the same rows out.
    """
    ensemble = read_ensemble(model)
    rows = model.transform(df).select("txn_id", vector_to_array("features").alias("x"))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            phi = ensemble_shap(ensemble, np.stack(batch["x"].to_numpy()))
            yield pd.DataFrame({
                "txn_id": batch["txn_id"], "base": ensemble.base,
                "margin": ensemble.base + phi.sum(axis=1), "phi": list(phi),
            })

    return rows.mapInPandas(explain, "txn_id long, base double, margin double, phi array<double>")


def shap_long(shap: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(txn_id, feature, phi)`` from the array form."""
    names = F.array(*[F.lit(c) for c in columns])
    pairs = F.arrays_zip(names.alias("feature"), F.col("phi"))
    return shap.select("txn_id", F.inline(pairs)).toDF("txn_id", "feature", "phi")


def shap_summary(shap: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean absolute value per feature."""
    return shap_long(shap, columns).groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("mean_abs_phi"), F.count(F.lit(1)).alias("n_rows")
    )


def shap_top_k(shap: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k strongest features per transaction, as an array within the row.

    Sorting happens inside the row, so nothing is shuffled. Ties go by name.
    """
    names = F.array(*[F.lit(c) for c in columns])
    entries = F.zip_with("phi", names, lambda p, n: F.struct(
        (-F.abs(p)).alias("order"), n.alias("feature"), p.alias("phi")
    ))
    ranked = F.slice(F.array_sort(entries), 1, k)
    return shap.select(
        "txn_id",
        F.transform(ranked, lambda e: F.struct(e["feature"].alias("feature"), e["phi"].alias("phi")))
        .alias("top_features"),
    )


def permuted_groups(
    df: DataFrame, groups: Mapping[str, Sequence[str]], seed: int
) -> DataFrame:
    """Each row with ``donor``, the group columns of another row.

    Both orders of the rows, by id and by seeded hash, are numbered with range
    partitions; equal numbers meet in an equi-join. Every row donates once.
    """
    columns = list(dict.fromkeys(c for names in groups.values() for c in names))
    shuffled = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("txn_id").cast("string")))
    receivers = global_index(df, ["txn_id"], "_idx")
    donors = global_index(
        df.select(F.struct(*columns).alias("donor"), shuffled.alias("_h"), "txn_id"),
        ["_h", "txn_id"], "_idx",
    ).select("_idx", "donor")
    return receivers.join(donors, "_idx").drop("_idx")


def grouped_permutation(
    df: DataFrame, score: Callable[[DataFrame], DataFrame],
    groups: Mapping[str, Sequence[str]], seed: int = 42, label: str = "is_laundering",
) -> DataFrame:
    """Loss of average precision when the columns of a group are permuted together.

    ``score`` adds a column ``score``. All groups use the same donor rows and are
    evaluated in one pass over (group, score).
    """
    mixed = permuted_groups(df, groups, seed)
    parts = [score(df).select(F.lit("none").alias("group"), label, "score")]
    for name, columns in groups.items():
        swapped = mixed.withColumns({c: F.col(f"donor.{c}") for c in columns})
        parts.append(score(swapped).select(F.lit(name).alias("group"), label, "score"))
    aucs = checkpoint(pr_auc(stack(parts), "score", label, ["group"]))
    base = aucs.where(F.col("group") == "none").select("pr_auc").scalar()
    return aucs.where(F.col("group") != "none").withColumn("pr_auc_base", base).select(
        "group", "n_rows", "pr_auc_base", F.col("pr_auc").alias("pr_auc_permuted"),
        (F.col("pr_auc_base") - F.col("pr_auc")).alias("importance"),
    )
