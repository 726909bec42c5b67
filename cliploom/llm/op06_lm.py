"""Query op6: language-model scores of documents, learned from nine tenths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import ppm
from cliploom.llm.common import id_remainder, table


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = ppm.count_strings(docs.where(id_remainder("doc_id", 10) != 0))
    words, rare = ppm.build_words(counts)
    scored = ppm.score(docs, words, rare, ppm.build_strings(counts))
    return scored.select(
        "doc_id",
        (id_remainder("doc_id", 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


QUERIES = {"op6_lm": op6_lm}
ORACLE_SQL: dict[str, str] = {}
