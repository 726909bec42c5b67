"""Queries of corpus checks, quotas, vocabulary and user models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.functions import text as T
from cliploom.operators import corpus as C
from cliploom.operators import fidelity as D
from cliploom.operators import splits as S
from cliploom.plans import views as V
from cliploom.plans.q_splits import BLOCKS
from cliploom.plans.q_stats import ARMS, arms
from cliploom.plans.registry import query


#: Brands have a known code, types and makers a minted one.
@query("FN-13", """select p_partkey, key, case key when 'brand' then 'BRD' else upper(substr(key, 1, 3)) end as code from (
  select p_partkey, regexp_replace(lower(case p_partkey % 3 when 0 then p_brand when 1 then p_type else p_name end), '[^a-z]', '', 'g') as key from part)""")  # fmt: skip
def fn13(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise(F.col("p_name"))
    return V.table(spark, sf_dir, "part").select("p_partkey", C.telephony_key(name).alias("key"), C.telephony_code(name, {"brand": "BRD"}).alias("code"))


@query("FN-14", V.with_sql(V.ATC, select="""select row_idx, coalesce(category, 'routine') as category, role, list_filter([case when row_idx % 50 = 0 then 'no_text' end, case when row_idx % 30 = 0 then 'weight' end, case when row_idx % 70 = 0 then 'reserved_lineage' end,
  case when row_idx % 11 = 0 then 'entity_heading_out_of_range' end, case when row_idx % 13 = 0 then 'entity_flight_level_malformed' end], lambda x: x is not null)::varchar as problems
  from (select row_idx, case when row_idx % 3 > 0 then category end as category, 'unknown' as role from atc)"""))  # fmt: skip
def fn14(spark, sf_dir):
    i = F.col("row_idx")
    slot = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    slots = F.array(slot("heading", F.when(i % 11 == 0, "777").otherwise(F.col("heading"))), slot("flight_level", F.concat(F.when(i % 13 == 0, "F").otherwise("FL"), "level")))
    a = V.radio(spark, sf_dir).select("row_idx", F.when(i % 50 == 0, " ").otherwise(F.col("text")).alias("text"), F.when(i % 30 == 0, 0.0).alias("weight"), F.when(i % 70 == 0, "x").alias("lineage"), F.when(i % 3 > 0, F.col("category")).alias("category"), slots.alias("entities"))
    return C.validate_text_records(a).select("row_idx", "category", "role", F.concat(F.lit("["), F.array_join("problems", ", "), F.lit("]")).alias("problems"))


@query("FN-24", V.with_sql(V.ATC, select="select case when row_idx % 2 = 0 then 'with' else 'without' end as cohort, count(*) as n from atc group by 1"))
def fn24(spark, sf_dir):
    a = V.radio(spark, sf_dir).withColumn("steps", F.when(F.col("row_idx") % 2 == 0, F.array(F.lit("gain"), F.lit("residual_translate"))).otherwise(F.array(F.lit("gain"))))
    return C.cohort_by_step(a, "steps", "residual_translate").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@query("AGG-2", V.with_sql(V.ATC, """r as (select case when row_idx % 20 = 0 then 'noise' else category end as category from atc), n as (select category, count(*) as n from r group by 1),
x as (select *, case when category = 'noise' then n / sum(n) over () else n / sum(case when category <> 'noise' then n end) over () end as share, case category when 'O' then 0.4 when 'F' then 0.5 end as target from n)""", select="select category, n, share, target, share - target as gap from x"))  # fmt: skip
def agg2(spark, sf_dir):
    a = V.radio(spark, sf_dir).withColumn("text", F.when(F.col("row_idx") % 20 == 0, "").otherwise(F.col("text")))
    return C.run_stats(a, {"O": 0.4, "F": 0.5})


@query("STA-6", f"with {ARMS}, w as (select max(case when arm = 'N' then w end) as a, max(case when arm = 'R' then w end) as b from (select arm, avg(reward) as w from arms group by 1)) select b - a as gap, b - a <= 0.015 as close, b < a as wins from w")
def sta6(spark, sf_dir):
    return C.matrix_verdicts(arms(spark, sf_dir).groupBy("arm").agg(F.avg("reward").alias("wer")), "N", "R")


#: A verdict for each line number: shares of 1 in 6 to 1 in 12 are discarded, the fifth has a value out of range, the sixth is told apart, the seventh has no comparison.
@query("FID-8", """select l_linenumber as set_id, rate, case when l_linenumber < 7 then in_range end as in_range, accuracy,
  case when l_linenumber = 7 then 'incomplete' when rate < 0.15 and in_range and accuracy <= 0.65 then 'pass' else 'fail' end as verdict from (
  select l_linenumber, count(*) filter (l_suppkey % (l_linenumber + 5) = 0) / count(*) as rate, l_linenumber <> 5 and bool_and(l_discount <= 0.1) as in_range, avg(l_discount::double) * case when l_linenumber = 6 then 20 else 10 end as accuracy
  from lineitem group by 1)""")  # fmt: skip
def fid8(spark, sf_dir):
    out = None
    for k in range(1, 8):
        x = V.table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == k)
        rate = x.agg((F.count_if(F.col("l_suppkey") % (k + 5) == 0) / F.count(F.lit(1))).alias("rate"))
        compared = x.select(((F.col("l_discount") <= 0.1) & F.lit(k != 5)).alias("in_range")).where(F.lit(k < 7))
        accuracy = x.agg((F.avg(F.col("l_discount").cast("double")) * (20 if k == 6 else 10)).alias("accuracy"))
        own = D.fidelity_verdict(rate, compared, accuracy).withColumn("set_id", F.lit(k).cast("long"))
        out = own if out is None else out.unionByName(own)
    return out


@query("FID-9", V.with_sql(V.CLIPS, BLOCKS, "sizes as (select block_id, count(*) as n from blocks group by 1)", select="""select block_id, n, case when n >= 3 then block_id
  when (select sum(n) from sizes where n < 3) = 1 and exists (select 1 from sizes where n >= 3) then (select min(block_id) from sizes where n >= 3) else 'pool' end as fold from sizes"""))  # fmt: skip
def fid9(spark, sf_dir):
    b = S.capture_blocks(V.clips(spark, sf_dir), 15).groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    return D.validation_folds(b, 3)


@query("WIN-3", V.with_sql(V.CLIPS, BLOCKS, f"b as (select station, block_id, count(*) as n from blocks group by 1, 2), o as (select *, {V.order('val', 'block_id')} as h, count(*) over (partition by station) as many, sum(n) over (partition by station) as total from b)", select="""select block_id,
  coalesce(sum(n) over (partition by station order by h, block_id rows between unbounded preceding and 1 preceding), 0) < greatest(round_even(total * 0.1, 0), 1) and row_number() over (partition by station order by h, block_id) < many as val from o"""))  # fmt: skip
def win3(spark, sf_dir):
    b = S.capture_blocks(V.clips(spark, sf_dir), 15).groupBy("station", "block_id").agg(F.count(F.lit(1)).alias("n"))
    return C.pick_val_blocks(b, 0.1, "val").select("block_id", "val")


POOL = "p as (select p_brand as category, p_partkey as item, p_retailprice::double as weight from part)"


@query("SMP-3", f"""with {POOL}, s as (select category, sum(weight) / (select sum(weight) from p) as share from p group by 1), e as (select *, sum(share) over (order by category rows unbounded preceding) as hi, sum(share) over () as total from s),
i as (select *, sum(weight) over (partition by category order by item rows unbounded preceding) as hi, sum(weight) over (partition by category) as total from p),
d as (select range as draw, {V.draw_sql("'q'", "'c'", "range")} as u, {V.draw_sql("'q'", "'i'", "range")} as v from range(1000) where (select count(*) from part) > 0)
select d.draw, e.category, i.item from d join e on u * e.total >= e.hi - share and u * e.total < e.hi join i on i.category = e.category and v * i.total >= i.hi - i.weight and v * i.total < i.hi""")
def smp3(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("item"), F.col("p_retailprice").cast("double").alias("weight"))
    return C.sample_quota(p, 1000, {"none": 0.0}, "q", "item")


@query("SMP-4", "select q.c as category, least(1.0, greatest(0.0, (q.q * 30000 - coalesce(n, 0)) / (30000 - (select count(*) from orders)))) as quota from (values ('O', 0.4), ('F', 0.2), ('Z', 0.1)) q(c, q) left join (select o_orderstatus as c, count(*) as n from orders group by 1) n on n.c = q.c")
def smp4(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("category"))
    return C.synthetic_quotas(o, {"O": 0.4, "F": 0.2, "Z": 0.1}, 30000)


@query("SMP-5", V.with_sql(V.ATC, select=f"""select row_idx, 'real' as origin from atc where category <> 'O' and row_idx % 10 <> 0 union all select * from (select row_idx, 'synthetic' from atc where category = 'O' order by {V.order('s5', 'row_idx')}, row_idx
  limit (select greatest(0, (select count(*) from atc) // 2 - count(*)) from atc where category <> 'O' and row_idx % 10 <> 0))"""))  # fmt: skip
def smp5(spark, sf_dir):
    a = V.radio(spark, sf_dir).select("row_idx", "category")
    real = a.where("category <> 'O'").withColumn("held", F.col("row_idx") % 10 == 0)
    return C.expand_corpus(real, a.where("category = 'O'"), a.count() // 2, "held", "s5", "row_idx").select("row_idx", "origin")


@query("SMP-10", V.with_sql(V.ATC, select=f"""select row_idx, arm from (select row_idx, case when category = 'P' then 'selected' else 'uniform' end as arm, row_number() over (partition by category = 'P' order by {V.order('s10', 'row_idx')}, row_idx) as r from atc)
  where r <= (select least(count(*) filter (category = 'P'), count(*) filter (category <> 'P')) from atc)"""))  # fmt: skip
def smp10(spark, sf_dir):
    a = V.radio(spark, sf_dir).select("row_idx", "category")
    return C.balanced_arms(a.where("category = 'P'"), a.where("category <> 'P'"), "s10", "row_idx", 8).select("row_idx", "arm")


@query("SMP-11", f"""with n as (select p_brand as station, count(*) as many from part group by 1), e as (select *, sum(many) over (order by station rows unbounded preceding) as hi, sum(many) over () as total from n),
p as (select p_brand as station, p_partkey as preset, row_number() over (partition by p_brand order by p_partkey) - 1 as slot from part), r as (select o_orderkey as id, {V.draw_sql("'d11'", "o_orderkey")} as u, {V.draw_sql("'d11'", "'slot'", "o_orderkey")} as v from orders)
select r.id, e.station, p.preset from r join e on u * total >= hi - many and u * total < hi join p on p.station = e.station and p.slot = floor(v * many)::int""")
def smp11(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_brand").alias("station"), F.col("p_partkey").alias("preset"))
    return C.draw_presets(V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), p, "d11", "id")


@query("TOP-4", """with m as (select p_partkey as trial, unnest(['price', 'size']) as knob, unnest([abs(p_retailprice::double - 1000) / 2000, abs(p_size - 25) / 50.0]) as move from part)
select trial, rank, knob, move from (select *, row_number() over (partition by trial order by move desc, knob) as rank from m where move >= 0.01) where rank <= 1""")
def top4(spark, sf_dir):
    t = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial"), F.create_map(F.lit("price"), F.col("p_retailprice").cast("double"), F.lit("size"), F.col("p_size").cast("double")).alias("knobs"))
    r = spark.createDataFrame([("price", 0.0, 2000.0, 1000.0), ("size", 0.0, 50.0, 25.0)], "knob string, low double, high double, default double")
    return C.top_deviations(t, r, 1)


def vocabulary(spark, sf_dir):
    """Names in transmissions; "bluebird one two one decimal five" only looks like a callsign."""
    i = F.col("row_idx")
    carrier = F.when(i % 3 == 0, "sky travel").when(i % 3 == 1, "csa").otherwise("euro wings")
    tail = F.when(i % 4 == 0, " contact praha radar one two one decimal five").when(i % 4 == 1, " direct to ralud").when(i % 4 == 2, " bluebird one two one decimal five").otherwise(" contact tower")
    a = V.radio(spark, sf_dir).select(T.tokenize_spoken(F.concat(carrier, F.lit(" "), V.spelled(F.col("ident")), F.lit(" heading "), V.spelled(F.col("heading")), tail)).alias("tokens"))
    return C.harvest_vocab(a, 10)


VOCAB = """voc as (select row_idx % 3 as c, row_idx % 4 as t from atc),
names as (select 'airline' as kind, unnest(case c when 0 then ['sky travel', 'travel'] when 1 then ['csa'] else ['euro wings', 'wings'] end) as phrase from voc
  union all select case t when 1 then 'waypoint' else 'station' end, case t when 0 then 'praha radar' when 1 then 'ralud' else 'tower' end from voc where t <> 2),
counts as (select kind, phrase, count(*) as n from names group by 1, 2)"""


@query("VOC-1", V.with_sql(V.ATC, VOCAB, select="select * from counts"))
def voc1(spark, sf_dir):
    return vocabulary(spark, sf_dir)


@query("VOC-2", V.with_sql(V.ATC, VOCAB, select="select phrase, n from counts where phrase in ('sky travel', 'euro wings')"))
def voc2(spark, sf_dir):
    return C.prune_airlines(vocabulary(spark, sf_dir).where("kind = 'airline'").drop("kind"), ["praha", "radar"], ["sky travel"])


@query("VOC-3", V.with_sql(V.ATC, VOCAB, select="select phrase, n, case phrase when 'sky travel' then 'SKV' when 'travel' then 'TRA' when 'csa' then 'CSA' when 'wings' then 'WIN' else 'EUR' end as code from counts where kind = 'airline'"))
def voc3(spark, sf_dir):
    return C.assign_codes(vocabulary(spark, sf_dir).where("kind = 'airline'"), {"sky travel": "SKV"})


@query("UDF-1", "select vec_id, t as teacher, t || len(embedding) as hypothesis from embeddings, (values ('a'), ('b')) v(t)")
def udf1(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    models = {"a": lambda xs: [f"a{len(x)}" for x in xs], "b": lambda xs: [f"b{len(x)}" for x in xs]}
    return C.transcribe_with(e, models, "vec_id", "embedding").drop("seconds")


@query("UDF-2", "select vec_id, list_sum(list_transform(embedding[1:4], lambda x: x::double)) as total from embeddings")
def udf2(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    v = C.embed_with(e, lambda x: x[:4], "vec_id", "embedding")
    return v.select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query("FID-7", None)
def fid7(spark, sf_dir):
    """Three layers: the vectors, draws that tell nothing, and the vectors with a place that tells the sets apart."""
    e = V.table(spark, sf_dir, "embeddings").withColumn("in_a", F.col("label") < 5)
    x = F.col("embedding").cast("array<double>")
    noise = F.transform(x, lambda v, i: V.draw("layer", F.col("vec_id"), i))
    plain = F.transform(x, lambda v, i: v + F.when((i == 0) & F.col("in_a"), 0.5).otherwise(0.0))
    return D.separability_probe(e.select("vec_id", "in_a", F.array(x, noise, plain).alias("layers")), "layers", "in_a", "vec_id", folds=3)


@query("FID-4", None)
def fid4(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("samples"), (F.col("label") % 2).alias("cohort"))
    return D.cohort_ltas(e, "samples", "cohort", 32)
