"""Reading the text tables and choosing how widely to spread them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of documents, a null text as the empty one."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo 3; rows of remainder 1 are never learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def sample(rows: DataFrame, n: int, eligible: int) -> DataFrame:
    """About ``n`` rows (at most) with the smallest hashes of doc_id.

    ``eligible`` is about the number of rows; it sets a bound on the hash that some
    2 ``n`` of them meet, so that no more than these reach the driver's sort.
    """
    scale = 1 << 30
    bound = min(scale, math.ceil(2 * n * scale / max(1, eligible)))
    near = F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < bound
    return rows.where(near).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(scale)), "doc_id").limit(n)


def spread(spark: SparkSession, n_bytes: int | None, target: int) -> int:
    """Partitions of about ``target`` bytes, at least the session's shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil((n_bytes or 0) / target))
