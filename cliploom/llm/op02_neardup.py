"""Query op2: near-duplicate documents by 4-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliploom.llm.common import table
from cliploom.llm.neardup import near_duplicates


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


QUERIES = {"op2_neardup": op2_neardup}
ORACLE_SQL: dict[str, str] = {}
