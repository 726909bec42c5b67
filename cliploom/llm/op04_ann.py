"""Query op4: the 20 nearest vectors of every twentieth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliploom.llm.ann import nearest
from cliploom.llm.common import table


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


QUERIES = {"op4_ann": op4_ann}
ORACLE_SQL: dict[str, str] = {}
