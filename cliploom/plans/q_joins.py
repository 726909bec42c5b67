"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.operators import joins as J
from cliploom.plans import views as V
from cliploom.plans.registry import query

SNAPSHOT = """
snap as (select d.doc_id as row_idx, coalesce(l.toxic, 0) = 1 as suspect, case when d.doc_id % 40 = 0 then '' when d.doc_id % 41 = 0 then '[static]' else d.text end as text,
  case when d.doc_id % 10 = 0 then 'old' || d.doc_id % 400 when d.doc_id % 11 = 0 then 'gone' || d.doc_id else 'clip' || d.doc_id % 400 end as audio
  from documents d left join labels l on l.doc_id = d.doc_id),
joined as (select row_idx, case when audio like 'clip%' then audio when audio like 'old%' then replace(audio, 'old', 'clip') end as clip, audio like 'clip%' as direct,
  case when suspect then 'suspect' when trim(text) = '' then 'empty' when trim(text) like '[%]' then 'bracket' when audio like 'gone%' then 'no_local_audio' end as reason from snap),
outcomes as (select row_idx, clip, coalesce(reason, case when row_number() over (partition by clip, reason is null order by row_idx) > 1 then 'duplicate' when direct then 'direct' else 'renamed' end) as outcome from joined)"""


def snapshot(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    i = F.col("doc_id")
    text = F.when(i % 40 == 0, "").when(i % 41 == 0, "[static]").otherwise(F.col("text"))
    audio = F.when(i % 10 == 0, F.concat(F.lit("old"), (i % 400).cast("string"))).when(i % 11 == 0, F.concat(F.lit("gone"), i.cast("string"))).otherwise(F.concat(F.lit("clip"), (i % 400).cast("string")))
    return d.select(i.alias("row_idx"), (F.coalesce("toxic", F.lit(0)) == 1).alias("suspect"), text.alias("text"), audio.alias("audio"))


def joined(spark, sf_dir):
    n = V.table(spark, sf_dir, "documents").select((F.col("doc_id") % 400).cast("string").alias("n")).distinct()
    clips = n.select(F.concat(F.lit("clip"), "n").alias("clip"))
    renames = n.select(F.concat(F.lit("old"), "n").alias("old"), F.concat(F.lit("clip"), "n").alias("new"))
    return J.join_transcripts(clips, snapshot(spark, sf_dir), renames)


@query("JOIN-1", V.with_sql(SNAPSHOT, select="select row_idx, clip, outcome from outcomes"))
def join1(spark, sf_dir):
    return joined(spark, sf_dir).select("row_idx", "clip", "outcome")


@query("FN-7", V.with_sql(SNAPSHOT, select="""select coalesce(case when suspect then 'suspect' when trim(text) = '' then 'empty' when trim(text) like '[%]' then 'bracket' end, 'clean') as reason, count(*) as n from snap group by 1"""))
def fn7(spark, sf_dir):
    s = snapshot(spark, sf_dir)
    return J.tally(s.withColumn("reason", F.coalesce(J.clean_label_reason(F.col("text"), F.col("suspect")), F.lit("clean"))), "reason")


MANIFEST = """man as (select row_idx, case when row_idx % 500 = 1 then 'a1' else 'a' || row_idx end as audio, case when row_idx % 20 = 0 then '' else text end as text from atc),
gated as (select 'a' || row_idx as audio, case when row_idx % 301 = 0 then 'bronze' else 'gold' end as tier from atc where row_idx % 20 <> 0 and row_idx % 203 <> 0 union all select 'b' || row_idx, 'silver' from atc where row_idx % 1000 = 7)"""


def manifest(spark, sf_dir):
    a = V.radio(spark, sf_dir)
    i = F.col("row_idx")
    rows = a.select("row_idx", F.when(i % 500 == 1, "a1").otherwise(F.concat(F.lit("a"), i.cast("string"))).alias("audio"), F.when(i % 20 == 0, "").otherwise(F.col("text")).alias("text"))
    gated = a.where("row_idx % 20 <> 0 and row_idx % 203 <> 0").select(F.concat(F.lit("a"), i.cast("string")).alias("audio"), F.when(i % 301 == 0, "bronze").otherwise("gold").alias("tier"))
    return rows, gated.unionByName(a.where("row_idx % 1000 = 7").select(F.concat(F.lit("b"), i.cast("string")).alias("audio"), F.lit("silver").alias("tier")))


@query("JOIN-2", V.with_sql(V.ATC, MANIFEST, select="""select audio, 'duplicate_row' as problem from man group by audio having count(*) > 1 union all select audio, 'duplicate_gated' from gated group by audio having count(*) > 1
  union all select audio, 'invalid_tier' from gated where tier = 'bronze' union all select audio, 'missing' from man where text <> '' and audio not in (select audio from gated)
  union all select audio, 'extra' from gated where audio not in (select audio from man where text <> '')"""))  # fmt: skip
def join2(spark, sf_dir):
    return J.join_tiers_exact(*manifest(spark, sf_dir))


@query("JOIN-3", V.with_sql(V.CLIPS, select="""select name, clip_id, failure from (select 'p' || row_idx as name, case when row_idx % 50 = 0 then 'none' || row_idx else row_idx::varchar end as clip_id,
   unnest(list_filter([case when row_idx % 50 = 0 then 'unknown_clip' when row_idx % 9 = 0 then 'clip_outside_split' end, case when row_idx % 70 = 0 then 'own_label' end, case when row_idx % 50 <> 0 and row_idx % 33 = 0 then 'digest' end], lambda x: x is not null)) as failure from clips)"""))  # fmt: skip
def join3(spark, sf_dir):
    c, i = V.clips(spark, sf_dir), F.col("row_idx")
    corpus = c.select(i.cast("string").alias("clip_id"), F.when(i % 9 == 0, "channel_val").otherwise("channel_train").alias("split"), F.md5(i.cast("string")).alias("digest"))
    made = c.select(
        F.concat(F.lit("p"), i.cast("string")).alias("name"),
        F.when(i % 50 == 0, F.concat(F.lit("none"), i.cast("string"))).otherwise(i.cast("string")).alias("clip_id"),
        F.when(i % 70 == 0, "other").otherwise("channel_train").alias("split"),
        F.when(i % 33 == 0, "x").otherwise(F.md5(i.cast("string"))).alias("digest"),
    )
    return J.audit_leakage(corpus, made)


def thinned(spark, sf_dir, name):
    return V.radio(spark, sf_dir).select("row_idx").where(V.draw(name, F.col("row_idx")) < 0.8)


def thin(name):
    return V.draw_sql(f"'{name}'", "o_orderkey") + " < 0.8"


@query("JOIN-4", f"select o_orderkey as row_idx from orders where {thin('v1')} and {thin('v2')} and {thin('v3')}")
def join4(spark, sf_dir):
    return J.common_support({v: thinned(spark, sf_dir, v) for v in ("v1", "v2", "v3")}, "row_idx")


@query("JOIN-5", f"""select o_orderkey as row_idx, case when not ({thin('v1')}) then 'missing' when o_orderkey % 100 = 3 then 'repeated' else 'digest' end as mismatch from orders
  where not ({thin('v1')}) or o_orderkey % 100 = 3 or o_orderkey % 101 = 0""")  # fmt: skip
def join5(spark, sf_dir):
    base = V.radio(spark, sf_dir).select("row_idx", F.md5(F.col("row_idx").cast("string")).alias("sha"))
    made = thinned(spark, sf_dir, "v1").select("row_idx", F.when(F.col("row_idx") % 101 == 0, "x").otherwise(F.md5(F.col("row_idx").cast("string"))).alias("sha"))
    return J.align_views(base, made.unionByName(made.where("row_idx % 100 = 3")), "row_idx", "sha")


@query("JOIN-6", V.with_sql(V.UTT, select="select row_idx, reference, hyp_a, hyp_b from utt where reference <> '' and row_idx % 10 <> 0"))
def join6(spark, sf_dir):
    u = V.utterances(spark, sf_dir)
    other = F.when(F.col("row_idx") % 10 == 0, F.concat(F.lit("x "), "reference")).otherwise(F.col("reference"))
    a, b = u.select("row_idx", "reference", "hyp_a"), u.select("row_idx", other.alias("reference"), "hyp_b")
    return J.pair_hypotheses(a, b, "row_idx").select("row_idx", "reference", "hyp_a", "hyp_b")


@query("JOIN-7", """with n as (select o_orderstatus as type, o_custkey % 50 as value, count(*) filter (o_orderkey % 2 = 0) as a, count(*) filter (o_orderkey % 3 = 0) as b from orders group by 1, 2)
select type, value, k, k <= a as in_a, k <= b as in_b from (select *, unnest(range(1, greatest(a, b) + 1)) as k from n)""")
def join7(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("type"), (F.col("o_custkey") % 50).alias("value"))
    return J.multiset_match(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), ["type", "value"])


@query("JOIN-9", V.with_sql(V.CLIPS, f"""noise as (select o_orderkey as segment, 'ST' || (o_custkey % 5) || '_TOWER' as station from orders),
numbered as (select *, row_number() over (partition by station order by segment) - 1 as slot, count(*) over (partition by station) as many from noise),
s as (select station, coalesce(lead(station) over (order by station), min(station) over ()) as next from (select distinct station from noise)),
p as (select c.row_idx as name, c.station, case when s.next is null then (select min(station) from s) when {V.draw_sql("'n'", 'c.row_idx')} < 0.3 then s.next else c.station end as from_station from clips c left join s on s.station = c.station)""",
  select="select p.name, p.station, p.from_station, n.segment from p join numbered n on n.station = p.from_station and n.slot = ('0x' || substr(md5('slot:' || p.name), 1, 8))::bigint % n.many"))
def join9(spark, sf_dir):
    c = V.clips(spark, sf_dir)
    station = F.concat(F.lit("ST"), (F.col("o_custkey") % 5).cast("string"), F.lit("_TOWER"))
    noise = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment"), station.alias("station"))
    return J.pair_noise(c.select(F.col("row_idx").alias("name"), "station"), noise, 0.3, V.draw("n", F.col("name")))


RANGES = [("dev", 0, 1000), ("test", 1000, 2500), ("extra", 2400, 3000), ("train", 3000, None)]
RANGES_SQL = "ranges as (select * from (values " + ", ".join(f"('{n}', {a}, {'null' if b is None else b})" for n, a, b in RANGES) + ") t(name, start, stop))"


def cut(spark, sf_dir):
    """The named ranges, over a manifest as long as lineitem."""
    most = V.table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("size"))
    r = spark.createDataFrame(RANGES, "name string, start long, stop long")
    return r.crossJoin(F.broadcast(most)).where(F.col("start") < F.col("size")).drop("size")


@query("JOIN-10", """with b as (select 'b' || o_orderkey // 1000 as name, min(o_orderkey) as start, max(o_orderkey) + 1 + sum(o_custkey)::bigint % 1500 as stop from orders group by 1)
select a.name, b.name as other from b a join b on a.name < b.name and a.start < b.stop and b.start < a.stop""")
def join10(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("b"), F.expr("o_orderkey div 1000").cast("string")).alias("name"))
    stop = F.max("o_orderkey") + 1 + F.sum("o_custkey") % 1500
    return J.overlapping(o.agg(F.min("o_orderkey").alias("start"), stop.alias("stop")))


@query("JOIN-13", f"with {RANGES_SQL} select o_orderkey as row_idx, name from orders left join ranges on o_orderkey >= start and (stop is null or o_orderkey < stop)")
def join13(spark, sf_dir):
    return J.window_cover(V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx")), cut(spark, sf_dir), "row_idx")


@query("SRC-7", "select o_orderkey as row_idx from orders where o_orderkey >= 1000 and o_orderkey < 2500")
def src7(spark, sf_dir):
    from cliploom.sources.readers import read_split

    return read_split(V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx")), "test", {n: (a, b) for n, a, b in RANGES})


@query("JOIN-11", """with m as (select l_returnflag as metric, sum(l_quantity::double) filter (l_linenumber <= 3) as old, sum(l_quantity::double) filter (l_linenumber > 3 and l_returnflag <> 'N') as new from lineitem group by 1)
select metric, old, new, new - old as delta from m""")
def join11(spark, sf_dir):
    x = V.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("metric"), "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    of = lambda c: x.where(c).groupBy("metric").agg(F.sum("q").alias("value"))
    return J.diff_metrics(of("l_linenumber <= 3"), of("l_linenumber > 3 and metric <> 'N'"))


@query("JOIN-12", V.with_sql(V.CLIPS, select="select row_idx from clips where row_idx % 41 = 0"))
def join12(spark, sf_dir):
    c = V.clips(spark, sf_dir).select("row_idx")
    return J.missing_audio(c, c.where("row_idx % 41 <> 0"), "row_idx")
