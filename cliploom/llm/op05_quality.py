"""Query op5: base measures of documents, and the verdict of weak supervision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import quality
from cliploom.llm.common import table, written

CUT = 0.5


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    voted = quality.votes(written(quality.features(docs), "measures"))
    judged = quality.judge(voted, *quality.estimate(voted))
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("quality") >= CUT)).alias("kept"),
        "quality",
    )


QUERIES = {"op5_quality": op5_quality}
ORACLE_SQL: dict[str, str] = {}
