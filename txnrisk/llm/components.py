"""Connected components of a graph given by its links, by repeated contraction.

Each round hooks every node to its smallest neighbour if that is smaller than the
node, follows the hooks to their ends by doubling, and replaces the ends of all
links. Links within a group vanish, so a hub is gone after the round that hooks its
neighbours. Every table stays distributed; lineage is cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions.scale import counted_keys, hot_rows, salted_join
from txnrisk.session import checkpoint


def _replace(rows: DataFrame, column: str, spread: list[str], parents: DataFrame, n: int) -> DataFrame:
    """``rows`` with the parent of ``column`` in its place, if it has one; ``rows`` has ``n`` rows."""
    parents = parents.select(F.col("node").alias(column), F.col("parent").alias("_up"))
    if n > hot_rows(rows.sparkSession):
        parents = counted_keys(rows, parents, [column], "_n")
    else:
        parents = parents.withColumn("_n", F.lit(1))
    joined = salted_join(rows, parents, [column], spread, "_n", rows=n)
    return joined.withColumn(column, F.coalesce("_up", column)).drop("_up")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node with a link.

    ``links`` has columns a and b of type long; repeated, reversed and self links
    are allowed, rows with a null end are ignored. No link gives an empty table.
    """
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = checkpoint(links.distinct())
    n_links = links.count()
    labels, n_labels = None, 0
    while n_links:
        # every hook goes to a smaller node, so hooks form a forest
        hooks = checkpoint(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        n_hooks = hooks.count()
        while True:
            after = checkpoint(_jump(hooks, n_hooks))
            moved = after.where("moved").limit(1).count()
            hooks = after.drop("moved")
            if not moved:
                break
        if labels is None:
            labels = hooks.select("node", F.col("parent").alias("root"))
        else:
            old = _replace(labels, "root", ["node"], hooks, n_labels)
            labels = old.unionByName(hooks.select("node", F.col("parent").alias("root")))
        labels = checkpoint(labels)
        n_labels = labels.count()
        links = _replace(links, "a", ["b"], hooks, n_links)
        links = _replace(links, "b", ["a"], hooks, n_links)
        links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = checkpoint(links.distinct())
        n_links = links.count()
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = labels.select(F.col("root").alias("node"), "root").distinct()
    return labels.unionByName(roots)


def _jump(hooks: DataFrame, n: int) -> DataFrame:
    """Each parent replaced by its own parent; ``moved`` where that is another node."""
    before = hooks.select("node", "parent", F.col("parent").alias("_was"))
    after = _replace(before, "parent", ["node"], hooks, n)
    return after.select("node", "parent", (F.col("parent") != F.col("_was")).alias("moved"))
