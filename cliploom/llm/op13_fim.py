"""Query op13: fill-in-middle over documents, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import fim
from cliploom.llm.common import table


def fill_in_middle(docs: DataFrame) -> DataFrame:
    made = fim.transform(docs.select("doc_id", "text"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"))


SQL = r"""
with t as (
    select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents
), u as (
    select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
        ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
        ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4
    from t
), c as (
    select doc_id, text, units, len(units) as n,
        least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as j,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
            when h4 % 100 < 80 then 'spm' else 'psm' end as form
    from u
), p as (
    select doc_id, text, n, form, coalesce(array_to_string(units[1:i], ''), '') as prefix,
        coalesce(array_to_string(units[i + 1:j], ''), '') as middle, coalesce(array_to_string(units[j + 1:n], ''), '') as suffix
    from c
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
    case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(text) as restored_sha256
from p
"""

QUERIES = {"op13_fim": op13_fim}
ORACLE_SQL = {"op13_fim": SQL}
