"""Query op9: lines of documents that repeat an earlier line but for one word go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import table
from cliploom.llm.linededup import dedup_lines

MIN_WORDS = 8


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, MIN_WORDS).select("doc_id", "n_lines", "n_equal", "n_near", F.sha2("text", 256).alias("kept_sha256"))


#: All pairs of lines that share the first or last half of their words are compared word by word.
SQL = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as number
  from documents),
split as (
  select doc_id, number, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from lines),
worded as (select doc_id, number, words, len(words) as n from split where len(words) > 0),
classes as (select words, n, min((doc_id, number)) as first from worded group by words, n),
halves as (
  select words, n, first, m, m // 2 as h from classes, lateral (select unnest([n, n - 1]) as m) where n >= 8),
pairs as (
  select distinct a.words as x, b.words as y from halves a join halves b on a.m = b.m and a.words[1:a.h] = b.words[1:b.h]
    and abs(a.n - b.n) <= 1 and b.first < a.first
  union
  select distinct a.words as x, b.words as y from halves a join halves b on a.m = b.m
    and a.words[a.n - a.h + 1:a.n] = b.words[b.n - b.h + 1:b.n] and abs(a.n - b.n) <= 1 and b.first < a.first),
near as (
  select distinct x from pairs where
    coalesce(list_min(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: x[i] is distinct from y[i])) - 1, len(x))
    + coalesce(list_min(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: (list_reverse(x))[i] is distinct from (list_reverse(y))[i])) - 1, len(x))
    >= greatest(len(x), len(y)) - 1),
marked as (
  select w.doc_id, w.number, (w.doc_id, w.number) > c.first as same, n.x is not null as near
  from worded w join classes c on w.words = c.words left join near n on n.x = w.words),
counts as (
  select doc_id, count(*) as n_lines, count(*) filter (same) as n_equal, count(*) filter (near and not same) as n_near
  from marked group by doc_id),
kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.number) as body
  from lines l left join marked m on m.doc_id = l.doc_id and m.number = l.number
  where m.number is null or not (m.same or m.near) group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_equal, 0) as n_equal, coalesce(n_near, 0) as n_near,
  sha256(coalesce(k.body, '')) as kept_sha256
from documents d left join counts c on c.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""

QUERIES = {"op9_linededup": op9_linededup}
ORACLE_SQL = {"op9_linededup": SQL}
