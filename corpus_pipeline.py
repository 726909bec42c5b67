"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Toxic documents go; lines that repeat an earlier line but for one word go, and
their documents stay, if empty; of near-duplicate documents the one with the
smallest id stays; personal data is replaced by its kind; what is left is packed.
Documents with a null id pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import pii, toxicity
from cliploom.llm.common import table, written
from cliploom.llm.linededup import dedup_lines
from cliploom.llm.neardup import near_duplicates
from cliploom.llm.op03_toxicity import THRESHOLD, fitted
from cliploom.llm.op08_packing import pack_documents


def counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs, fitted(spark, docs, sf_dir), to="__score", threshold=THRESHOLD)
    return scored.where(F.col("__score") < THRESHOLD).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(dedup_lines(docs).select(*docs.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(pii.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: No SQL expresses the network of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
