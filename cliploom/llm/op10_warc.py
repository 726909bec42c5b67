"""Query op10: pages written as WARC records and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import warc
from cliploom.llm.common import scratch, table


def digest_of(payload):
    """Not stated but computed, where the record holds its payload."""

    @F.pandas_udf("string")
    def run(data):
        return data.map(lambda x: None if x is None else warc.base32_sha1(bytes(x)))

    return run(payload)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    read = warc.read_archives(spark, archives)
    id_of = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return read.select(
        id_of("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce(digest_of(F.col("payload")), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", id_of("refers_to")).alias("refers_to"),
    )


QUERIES = {"op10_warc": op10_warc}
ORACLE_SQL: dict[str, str] = {}
