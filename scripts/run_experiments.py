"""Train, evaluate, explain and export. Run with spark-submit."""

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from txnrisk.config import load_config
from txnrisk.plans import jobs


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--out", required=True, help="folder of the stage tables")
    parser.add_argument("--config", help="YAML or JSON file with settings")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("txnrisk-experiments").config(
        "spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    jobs.run_experiments(spark, args.out, load_config(args.config))


if __name__ == "__main__":
    main()
