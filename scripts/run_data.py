"""Validate, split and encode transactions. Run with spark-submit."""

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from txnrisk import schema as S
from txnrisk.config import load_config
from txnrisk.plans import jobs
from txnrisk.sources import tables


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--out", required=True, help="folder of the stage tables")
    parser.add_argument("--config", help="YAML or JSON file with settings")
    parser.add_argument("--input", required=True, help="transactions with the fixed schema")
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv", "orc"])
    parser.add_argument("--without-ids", action="store_true", help="the source has the eleven original columns only")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("txnrisk-data").config(
        "spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    schema = tables.source_schema() if args.without_ids else S.TXN
    tables.check_source(spark, args.input, args.format, schema)
    if args.without_ids:
        txn = tables.with_ids(tables.read_transactions(spark, args.input, args.format, schema))
    else:
        txn = tables.read_transactions(spark, args.input, args.format)
    jobs.run_data(spark, txn, args.out, load_config(args.config))


if __name__ == "__main__":
    main()
