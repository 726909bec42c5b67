"""Query op3: toxicity of documents, learned from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import toxicity
from cliploom.llm.common import id_remainder, table

THRESHOLD = 0.7


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Network:
    """The network learned from labels outside the held-out third of the ids."""
    labels = table(spark, sf_dir, "labels").where(id_remainder("doc_id", 3) != 1)
    return toxicity.train(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, fitted(spark, docs, sf_dir), threshold=THRESHOLD)
    return scored.select(
        "doc_id",
        (id_remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
