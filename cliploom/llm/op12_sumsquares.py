"""Query op12: documents packed into as few sequences of 2048 tokens as can be.

A null or empty text is its end id alone; repeated rows are packed once each; an
empty table packs to no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import packing
from cliploom.llm.common import table
from cliploom.llm.sumsquares import sum_of_squares

CAPACITY, END_ID = 2048, 0


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.windows(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, END_ID)
    slim = pieces.select("doc_id", (F.col("start") / CAPACITY).cast("int").alias("piece"), "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(slim, CAPACITY, sum_of_squares).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_sumsquares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op12_sumsquares": op12_sumsquares}
ORACLE_SQL: dict[str, str] = {}
