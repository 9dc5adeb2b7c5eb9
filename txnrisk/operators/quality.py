"""Validation and audit of the transaction table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk import schema as S
from txnrisk.functions.scale import small_join
from txnrisk.session import checkpoint

_REPORT = "column_name string, issue string, n_rows long"


def default_domains() -> dict[str, Column]:
    """Conditions that valid values meet, by column."""
    return {
        "amount_paid": F.col("amount_paid") >= 0,
        "amount_received": F.col("amount_received") >= 0,
        "is_laundering": F.col("is_laundering").isin(0, 1),
    }


def validate_schema(
    df: DataFrame,
    schema: T.StructType = S.TXN,
    domains: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Report of missing, extra and wrong-typed columns, nulls and domain violations.

    Structure comes from the schema object; nulls and domains from one pass.
    ``n_rows`` is null for structural issues. No row means the table is valid.
    """
    expected = {f.name: f.dataType for f in schema.fields}
    actual = {f.name: f.dataType for f in df.schema.fields}
    structural = (
        [(c, "missing", None) for c in expected if c not in actual]
        + [(c, "extra", None) for c in actual if c not in expected]
        + [
            (c, f"type {actual[c].simpleString()}, expected {t.simpleString()}", None)
            for c, t in expected.items()
            if c in actual and actual[c] != t
        ]
    )
    report = df.sparkSession.createDataFrame(structural, _REPORT)
    usable = [c for c in expected if c in actual and actual[c] == expected[c]]
    checks = [(c, "null", F.col(c).isNull()) for c in usable]
    for c, valid in (default_domains() if domains is None else domains).items():
        if c in usable:
            checks.append((c, "domain", F.col(c).isNotNull() & ~valid))
    if not checks:
        return report
    counts = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(checks)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(issue).alias("issue"), F.col(f"c{i}").alias("n_rows"))
        for i, (c, issue, _) in enumerate(checks)
    ])
    content = counts.select(F.inline(rows)).where("n_rows > 0")
    return report.unionByName(content)


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Rows, nulls and distinct values per column.

    ``exact=False`` counts distinct values with a sketch and needs no shuffle of
    the values.
    """
    columns = list(columns or df.columns)
    distinct = F.count_distinct if exact else F.approx_count_distinct
    wide = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(columns)],
        *[distinct(F.col(c)).alias(f"dist_{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.col("n_rows"),
            F.col(f"null_{i}").alias("n_null"), F.col(f"dist_{i}").alias("n_distinct"),
        )
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(rows))


def duplicate_audit(txn: DataFrame, columns: Sequence[str] = tuple(S.SOURCE_COLUMNS)) -> DataFrame:
    """Groups of rows that are identical in ``columns``, with their surplus copies.

    The id is not part of the key; the smallest id counts as the original. Copies
    are counted before the shuffle, so a large group stays small on the wire.
    """
    return (
        txn.groupBy(*columns)
        .agg(F.min("txn_id").alias("first_txn_id"), F.count(F.lit(1)).alias("n_copies"))
        .where("n_copies > 1")
        .withColumn("n_surplus", F.col("n_copies") - 1)
    )


def flag_duplicates(txn: DataFrame, columns: Sequence[str] = tuple(S.SOURCE_COLUMNS)) -> DataFrame:
    """Add ``is_exact_dup`` to every copy but the first; no row is dropped.

    The groups with copies are usually few and then travel to the rows; beyond the
    broadcast limit the rows of large groups are split.
    """
    groups = checkpoint(duplicate_audit(txn, columns)).select(
        *columns, "first_txn_id", F.col("n_copies").alias("_copies")
    )
    joined = small_join(txn, groups, columns, "txn_id", "_copies", null_safe=True)
    surplus = F.col("first_txn_id").isNotNull() & (F.col("txn_id") != F.col("first_txn_id"))
    return joined.withColumn("is_exact_dup", surplus).drop("first_txn_id")


def id_consistency(
    txn: DataFrame, node_map: DataFrame, tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Violations ``(check_name, entity, n)``; empty when all ids agree.

    Checks that each endpoint is in the node map, node ids and accounts are unique
    there, transaction ids are unique, and that each of ``tables`` holds every
    transaction exactly once.
    """
    def label(name: str) -> Column:
        return F.lit(name).alias("check_name")

    def entity(*cols: str) -> Column:
        return F.concat_ws("/", *[F.col(c).cast("string") for c in cols]).alias("entity")

    ends = txn.select(F.explode(F.array(
        F.struct(F.col("from_bank").alias("bank"), F.col("from_account").alias("account")),
        F.struct(F.col("to_bank").alias("bank"), F.col("to_account").alias("account")),
    )).alias("e")).groupBy("e.bank", "e.account").agg(F.count(F.lit(1)).alias("n"))
    found = [
        ends.join(node_map, ["bank", "account"], "left_anti")
        .select(label("endpoint_not_in_node_map"), entity("bank", "account"), "n"),
        node_map.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(label("node_id_repeated"), entity("node_id"), "n"),
        node_map.groupBy("bank", "account").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(label("account_repeated"), entity("bank", "account"), "n"),
        txn.groupBy("txn_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(label("txn_id_repeated"), entity("txn_id"), "n"),
    ]
    for name, table in (tables or {}).items():
        counts = (
            txn.select("txn_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(table.select("txn_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
            .groupBy("txn_id").agg(F.sum("a").alias("a"), F.sum("b").alias("n"))
        )
        found.append(
            counts.where("a > 0 AND n = 0").select(label(f"missing_in_{name}"), entity("txn_id"), "n")
        )
        found.append(
            counts.where("n > 0 AND (a = 0 OR n > 1)")
            .select(label(f"unexpected_in_{name}"), entity("txn_id"), "n")
        )
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def dataset_summary(txn: DataFrame, columns: Sequence[str] = tuple(S.SOURCE_COLUMNS)) -> DataFrame:
    """Rows, positives, prevalence, number of core columns, surplus exact copies."""
    surplus = F.coalesce(
        duplicate_audit(txn, columns).select(F.sum("n_surplus")).scalar(), F.lit(0)
    )
    return txn.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("is_laundering").alias("n_positive"),
        F.avg("is_laundering").alias("prevalence"),
        F.min("txn_date").alias("first_date"),
        F.max("txn_date").alias("last_date"),
    ).withColumns({
        "n_columns": F.lit(len(columns)).cast("long"),
        "n_exact_duplicates": surplus,
    })


def daily_volume(txn: DataFrame) -> DataFrame:
    """Transactions and positives per day."""
    return txn.groupBy("txn_date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("is_laundering").alias("n_positive")
    )
