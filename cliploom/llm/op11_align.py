"""Query op11: tokens of two tokenizers aligned over documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import alignment
from cliploom.llm.common import table


def align_documents(docs: DataFrame) -> DataFrame:
    a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = alignment.groups(docs, a_path, b_path)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    rows = rows.withColumn("groups_sha256", digest).drop("groups")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return alignment.counted(rows, len(alignment.Pieces(b_path).size)).select(*names)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op11_align": op11_align}
ORACLE_SQL: dict[str, str] = {}
