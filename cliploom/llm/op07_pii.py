"""Query op7: personal data in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import pii
from cliploom.llm.common import table


def spelled(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, pii.KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


QUERIES = {"op7_pii": op7_pii}
ORACLE_SQL: dict[str, str] = {}
