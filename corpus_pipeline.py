"""From documents to packed training sequences, in four stages.

Each stage is one operator of ``txnrisk.llm`` over all rows that the stage before
kept. ``run`` writes the rows of each stage as Parquet to the shared checkpoint
folder and reads them again as the documents of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.functions.scale import counted_keys, salted_join
from txnrisk.llm import language, near_text, packing, quality, rans
from txnrisk.llm.queries import BYTE_BPE
from txnrisk.llm.tables import read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score of the predicted language of a document that stays.
LANGUAGE_SCORE = 0.3


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``decided``; a repeated id is decided once for all its rows.

    A null id never stays.
    """
    ids = decided.select("doc_id").where("doc_id is not null").groupBy("doc_id").agg(F.lit(1).alias("_ok"))
    counted = counted_keys(docs.select("doc_id"), ids, ["doc_id"], "_n")
    return salted_join(docs, counted, ["doc_id"], ["doc_id", "text"], "_n").where("_ok = 1").select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is usual for their language."""
    decided = quality.quality(docs, read(spark, sf_dir, "labels"))
    return _keep(docs, decided.where("kept")).select(*COLUMNS)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and texts without a letter go."""
    decided = language.languages(docs).where(F.col("lang_pred") != language.UNKNOWN)
    return _keep(docs, decided.where(F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies.

    Candidates come from the SimHash components of operator 7 and from keys of minima, which
    reach further; a link counts if its five-word Jaccard similarity is 0.8 or more.
    """
    return near_text.survivors(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [("quality", quality_filter), ("language", language_filter), ("near_dedup", near_dedup), ("packing", pack)]
#: No stage can be written in SQL; tests compare ``run`` with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows of the last."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = rans.new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
