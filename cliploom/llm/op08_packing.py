"""Query op8: documents packed into sequences of 4096 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import packing
from cliploom.llm.common import table

CAPACITY, END_ID = 4096, 2


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.windows(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, END_ID)
    slim = pieces.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"))
    return packing.place(slim, CAPACITY).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
