import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from cliploom.llm import warc
from cliploom.llm.common import scratch
from cliploom.llm.op10_warc import op10_warc


def expected(pages):
    newest = {}
    for k, html in pages:
        newest[html or ""] = max(k, newest.get(html or "", k))
    out = []
    for k, html in pages:
        data = (html or "").encode()
        n = newest[html or ""]
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if k < n else "response", n if k < n else None))
    return sorted(out)


def test_query(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted(map(tuple, op10_warc(spark, sf_dir).collect())) == expected(pages)


def test_ranges_of_any_size_find_each_record_once(spark):
    rnd = random.Random(4)
    pages = [(i, "".join(rnd.choices("ab\x1f\x8b\x08é", k=rnd.choice([0, 5, 300, 4000])))) for i in range(60)]
    pages += [(100, None), (101, ""), (102, pages[5][1]), (103, "x" * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit("http://a\r\nb")).withColumn("digest", F.lit(1)).repartition(3)
    archives = warc.write_archives(df, scratch(spark, "warc"))
    whole = sorted((r.record_id, r.payload_bytes, r.record_type, r.refers_to, r.payload) for r in warc.read_archives(spark, archives).collect())
    assert len(whole) == len(pages)
    for size in (97, 1000, 5000):
        assert whole == sorted((r.record_id, r.payload_bytes, r.record_type, r.refers_to, r.payload) for r in warc.read_archives(spark, archives, size).collect())
    texts = dict(pages)
    for rid, n, kind, _, payload in whole:
        text = (texts[int(rid.split(":")[-1])] or "").encode()
        assert n == len(text) and (bytes(payload) == text if kind == "response" else payload is None)


def test_members_are_plain_gzip_and_magic_inside_is_no_record():
    inner = gzip.compress(b"WARC/1.1\r\nno record of this archive")
    data = warc.record(1, "u", inner) + warc.record(2, None, b"") + warc.record(3, "u", b"", refers_to=2)
    assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == 3
    got = [r["warc-record-id"] for _, r in warc.records_of(io.BytesIO(data), 0, len(data))]
    assert got == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(data[:-10]), 0, len(data)))


def test_null_ids(spark, tmp_path):
    spark.createDataFrame([(None, None, "x"), (1, None, "x")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = op10_warc(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in rows) == [(0, "response"), (1, "response")]


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "x")] * 3, "page_id long, url string, html string")
    rows = warc.read_archives(spark, warc.write_archives(df, scratch(spark, "warc"))).collect()
    assert [r.record_type for r in rows] == ["response"] * 3
    assert warc.read_archives(spark, warc.write_archives(df.limit(0), scratch(spark, "warc"))).count() == 0
