"""Reading transactions; reading and writing the hand-off tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk import schema as S
from txnrisk.functions.scale import global_index


def read_transactions(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType = S.TXN,
    **options: str,
) -> DataFrame:
    """Read transactions with a fixed schema, never an inferred one.

    A source that delivers only the eleven original columns is read with
    ``source_schema()`` and completed by ``with_ids``.
    """
    if fmt == "csv":
        # the header of every file is held against the schema
        options = {"header": "true", "mode": "FAILFAST", "enforceSchema": "false", **options}
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def _faults(found: T.StructType, schema: T.StructType) -> list[tuple[str, str]]:
    """Columns of ``schema`` that ``found`` lacks or has with another type."""
    actual = {f.name: f.dataType for f in found.fields}
    return [(f.name, "missing") for f in schema.fields if f.name not in actual] + [
        (f.name, f"type {actual[f.name].simpleString()}, expected {f.dataType.simpleString()}")
        for f in schema.fields if f.name in actual and actual[f.name] != f.dataType
    ]


def source_report(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = S.TXN
) -> DataFrame:
    """What the files of a Parquet or ORC source have against ``schema``.

    ``(column_name, issue, file)``; no row means none. Reading under a fixed schema
    fills a missing column with nulls and drops an extra one, so the files are asked
    first. Spark merges the schemas of all files (two types of one column end the
    read); ``file`` is null for faults of the merged schema. A column without a
    value in a file that has rows is reported with the file: it is missing there,
    or null throughout. That costs one scan, aggregated to a row per file. An empty
    source has no faults but those of its schema.
    """
    merged = spark.read.format(fmt).option("mergeSchema", "true").load(path)
    names = set(schema.fieldNames())
    structural = _faults(merged.schema, schema) + [
        (c, "extra") for c in merged.columns if c not in names
    ]
    report = spark.createDataFrame(
        [(c, issue, None) for c, issue in structural], "column_name string, issue string, file string"
    )
    asked = [c for c in merged.columns if c in names]
    if not asked:
        return report
    file = F.col("_metadata.file_path").alias("file")
    per_file = merged.select(file, *asked).groupBy("file").agg(
        F.array_compact(F.array(*[F.when(F.count(c) == 0, F.lit(c)) for c in asked])).alias("empty")
    )
    return report.unionByName(per_file.select(
        F.explode("empty").alias("column_name"), F.lit("no value in file").alias("issue"), "file"
    ))


def check_source(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = S.TXN
) -> None:
    """Refuse a source with faults. CSV files are checked by their headers as they are read."""
    if fmt == "csv":
        return
    some = source_report(spark, path, fmt, schema).limit(20).collect()
    if some:
        raise ValueError(f"schema of {path}: {[tuple(r) for r in some]}")


def source_schema(key_type: T.DataType = T.LongType()) -> T.StructType:
    """The schema without the two derived columns."""
    by_name = {f.name: f for f in S.transaction_schema(key_type).fields}
    return T.StructType([by_name[c] for c in S.SOURCE_COLUMNS])


def with_ids(raw: DataFrame) -> DataFrame:
    """Add ``txn_date`` and a dense, reproducible ``txn_id``.

    Ids follow the order of all source columns, so that a rerun assigns the same
    ones; exact copies are interchangeable. The last sort key splits large groups
    of copies over several range partitions.
    """
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096))
    keyed = raw.withColumn("_spread", spread)
    indexed = global_index(keyed, [*S.SOURCE_COLUMNS, "_spread"], "txn_id")
    return indexed.withColumn("txn_date", F.to_date("txn_ts")).select(*S.TXN.fieldNames())


def write_clean(df: DataFrame, path: str) -> None:
    """``transactions_clean``, partitioned by day so that day filters prune files.

    The repartition key adds a hash of the id: a day is written by several tasks.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        df.withColumn("_slice", F.pmod(F.xxhash64("txn_id"), F.lit(max(1, parts // 8))))
        .repartition("txn_date", "_slice").drop("_slice")
        .write.mode("overwrite").partitionBy("txn_date").parquet(path)
    )


def write_node_map(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_node_day(df: DataFrame, path: str) -> None:
    """``graph_node_day``, partitioned by feature date."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        df.withColumn("_slice", F.pmod(F.xxhash64("node_id"), F.lit(max(1, parts // 8))))
        .repartition("feature_date", "_slice").drop("_slice")
        .write.mode("overwrite").partitionBy("feature_date").parquet(path)
    )


def write_pair_txn(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a hand-off table back under its contract, in contract column order.

    A table that lacks a column of the contract or has it with another type is
    refused. A table without any file is empty.
    """
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        found = schema
    faults = _faults(found, schema)
    if faults:
        raise ValueError(f"contract of {path}: {faults}")
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def export_results(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Write each result table to ``folder/name``."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unsupported format {fmt!r}")
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")
