"""Inputs of the queries, made from the driver tables: clips, utterances and radio texts.

Each view is written twice, as DataFrame functions and as SQL for DuckDB; with_sql()
puts the SQL before a query's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions.draws import draw, draw_sql, drawn_below, order_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, clip_id, station, ts, duration: an event as a recorded clip; every 97th name can't be parsed."""
    e = table(spark, sf_dir, "events")
    station = F.concat(F.lit("ST"), (F.col("user_id") % 6).cast("string"), F.lit("_TOWER"))
    name = F.concat_ws("_", station, F.date_format("ts", "yyyyMMdd_HHmmss"))
    return e.select(
        F.col("event_id").alias("row_idx"),
        F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("misc-"), F.col("event_id").cast("string"))).otherwise(name).alias("clip_id"),
        station.alias("station"),
        F.date_trunc("second", "ts").alias("ts"),
        F.col("value").alias("duration"),
    )


CLIPS = """
clips as (
  select event_id as row_idx,
    case when event_id % 97 = 0 then 'misc-' || event_id
      else 'ST' || (user_id % 6) || '_TOWER_' || strftime(ts, '%Y%m%d_%H%M%S') end as clip_id,
    'ST' || (user_id % 6) || '_TOWER' as station, date_trunc('second', ts) as ts, value as duration
  from events)"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, category, source, duration, reference, hyp_a (words deleted), hyp_b (words replaced); every 33rd has no words."""
    d = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\s']|\s+", " "), " "), lambda w: w != "")
    words = F.when(F.col("doc_id") % 33 == 0, F.array().cast("array<string>")).otherwise(words)

    def below(share: float, side: str, i: Column) -> Column:
        return drawn_below(share, side, F.col("doc_id"), i + 1)

    d = d.select("doc_id", "lang", "source", "n_chars", words.alias("w"))
    hyp_a = F.filter("w", lambda w, i: ~below(0.1, "a", i))
    hyp_b = F.transform("w", lambda w, i: F.when(below(0.15, "b", i), "zz").otherwise(w))
    return d.select(
        F.col("doc_id").alias("row_idx"),
        F.col("lang").alias("category"),
        "source",
        (F.col("n_chars") / 100.0).alias("duration"),
        F.array_join("w", " ").alias("reference"),
        F.array_join(hyp_a, " ").alias("hyp_a"),
        F.array_join(hyp_b, " ").alias("hyp_b"),
    )


UTT = rf"""
utt_words as (
  select doc_id, lang, source, n_chars, case when doc_id % 33 = 0 then []::varchar[] else list_filter(string_split(
    regexp_replace(lower(text), '[^\p{{L}}\s'']|\s+', ' ', 'g'), ' '), lambda w: w <> '') end as w from documents),
utt as (
  select doc_id as row_idx, lang as category, source, n_chars / 100.0 as duration, array_to_string(w, ' ') as reference,
    coalesce(array_to_string(list_filter(w, lambda x, i: {draw_sql("'a'", "doc_id", "i")} >= 0.1), ' '), '') as hyp_a,
    array_to_string(list_transform(w, lambda x, i: case when {draw_sql("'b'", "doc_id", "i")} < 0.15 then 'zz' else x end), ' ') as hyp_b
  from utt_words)"""

DIGITS = "zero one two three four five six seven eight nine".split()


def spelled(digits: Column) -> Column:
    """The digits of a string, in words."""
    names = F.array(*map(F.lit, DIGITS))
    each = F.filter(F.split(digits, ""), lambda c: c != "")
    return F.array_join(F.transform(each, lambda c: F.element_at(names, c.cast("int") + 1)), " ")


def spelled_sql(x: str) -> str:
    names = "[" + ", ".join(f"'{d}'" for d in DIGITS) + "]"
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: {names}[c::int + 1]), ' ')"


def radio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, kind, category, ident, heading, level, text: an order as an instruction with three known slots."""
    o = table(spark, sf_dir, "orders")
    ident = (100 + F.col("o_custkey") % 900).cast("string")
    heading = F.lpad((1 + F.col("o_custkey") % 360).cast("string"), 3, "0")
    level = F.lpad((10 + F.col("o_orderkey") % 440).cast("string"), 3, "0")
    o = o.select(
        F.col("o_orderkey").alias("row_idx"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("category"), ident.alias("ident"), heading.alias("heading"), level.alias("level")
    )
    text = F.concat(F.lit("csa "), spelled(F.col("ident")), F.lit(" turn heading "), spelled(F.col("heading")), F.lit(" climb flight level "), spelled(F.col("level")))
    return o.withColumn("text", text)


ATC = f"""
atc_slots as (
  select o_orderkey as row_idx, o_orderpriority as kind, o_orderstatus as category, (100 + o_custkey % 900)::varchar as ident,
    lpad((1 + o_custkey % 360)::varchar, 3, '0') as heading, lpad((10 + o_orderkey % 440)::varchar, 3, '0') as level from orders),
atc as (
  select *, 'csa ' || {spelled_sql("ident")} || ' turn heading ' || {spelled_sql("heading")} || ' climb flight level ' || {spelled_sql("level")} as text
  from atc_slots)"""


def with_sql(*views: str, select: str) -> str:
    return "with " + ",".join(views) + "\n" + select


def order(purpose: str, *columns: str) -> str:
    """SQL of the hash that replaces a seeded shuffle."""
    return order_sql(f"'{purpose}'", *columns)
