"""Queries of capture blocks, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.operators import sampling as P
from cliploom.operators import splits as S
from cliploom.plans import views as V
from cliploom.plans.registry import query

BLOCKS = """
gaps as (select *, lag(ts) over w as before from clips window w as (partition by station order by ts, row_idx)),
blocks as (select row_idx, station, ts, duration, clip_id, station || '/b' || case when b < 10 then '0' || b else b::varchar end as block_id from (
  select *, sum(case when before is null or epoch_us(ts) - epoch_us(before) > 900000000 then 1 else 0 end) over (partition by station order by ts, row_idx rows unbounded preceding)::bigint - 1 as b from gaps))"""


def blocks(spark, sf_dir):
    return S.capture_blocks(V.clips(spark, sf_dir), 15)


@query("WIN-1", V.with_sql(V.CLIPS, BLOCKS, select="select row_idx, block_id from blocks"))
def win1(spark, sf_dir):
    return blocks(spark, sf_dir).select("row_idx", "block_id")


#: A gap of fifty hours ends a user's block, so that some have one block and others more.
@query("WIN-2", """with e as (select event_id as row_idx, user_id as station, date_trunc('second', ts) as ts from events where user_id is not null),
g as (select *, row_number() over w as r, epoch_us(ts) - epoch_us(lag(ts) over w) as gap from e window w as (partition by station order by ts, row_idx)),
c as (select station, arg_max(r, (gap, -r)) as cut, max(gap) as widest from g where gap is not null group by station)
select row_idx, case when c.cut is not null and widest <= 180000000000 and r >= cut then 1 else 0 end as part, c.cut is not null and widest <= 180000000000 as pseudo from g left join c using (station)""")
def win2(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").where("user_id is not null").select(F.col("event_id").alias("row_idx"), F.col("user_id").alias("station"), F.date_trunc("second", "ts").alias("ts"))
    return S.pseudo_split(S.capture_blocks(e, 50 * 60)).select("row_idx", "part", "pseudo")


@query("WIN-4", "select doc_id as row_idx, row_number() over (partition by sha256(text) order by doc_id) > 1 as duplicate from documents")
def win4(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.sha2("text", 256).alias("h"))
    return S.first_of(d, "h", ["row_idx"]).select("row_idx", "duplicate")


@query("WIN-5", V.with_sql(V.CLIPS, select="select row_idx, case when r = 1 then clip_id else clip_id || '_' || r end as clip_id from (select *, row_number() over (partition by clip_id order by row_idx) as r from clips)"))
def win5(spark, sf_dir):
    c = V.clips(spark, sf_dir).select("row_idx", F.col("clip_id").alias("name"))
    return S.unique_ids(c, "name", "row_idx").select("row_idx", "clip_id")


@query("WIN-6", V.with_sql(V.CLIPS, select=f"select station, row_idx from clips qualify row_number() over (partition by station order by {V.order('cap', 'row_idx')}, row_idx) <= 100"))
def win6(spark, sf_dir):
    return S.cap_per_group(V.clips(spark, sf_dir), "station", 100, "cap", "row_idx").select("station", "row_idx")


@query("WIN-7", V.with_sql(V.CLIPS, select="""select row_idx, station, row_number() over (order by r, station, row_idx) - 1 as position from (
  select *, row_number() over (partition by station order by row_idx) as r from clips) where r <= 50 qualify position < 200"""))  # fmt: skip
def win7(spark, sf_dir):
    return S.interleave(V.clips(spark, sf_dir), "station", "row_idx", 50, 200).select("row_idx", "station", "position")


@query("WIN-8", V.with_sql(V.CLIPS, select=f"""select row_idx, row_number() over (partition by station order by {V.order('hold', 'row_idx')}, row_idx) <= least(greatest(round_even(n * 0.1, 0), 1), n - 1) as held_out
  from (select *, count(*) over (partition by station) as n from clips)"""))  # fmt: skip
def win8(spark, sf_dir):
    return S.group_holdout(V.clips(spark, sf_dir), "station", 0.1, "hold", "row_idx").select("row_idx", "held_out")


@query("WIN-9", V.with_sql(V.ATC, f"""g as (select kind, text, count(*) as n from atc group by 1, 2),
o as (select *, coalesce(sum(n) over (partition by kind order by {V.order('split', 'kind', 'text')}, text rows between unbounded preceding and 1 preceding), 0) + n / 2 > 0.02 * sum(n) over (partition by kind) as bad,
  {V.order('split', 'kind', 'text')} as h from g),
k as (select kind, text, not bool_or(bad) over (partition by kind order by h, text rows unbounded preceding) as held_out from o)""", select="select row_idx, held_out from atc join k using (kind, text)"))  # fmt: skip
def win9(spark, sf_dir):
    return S.transcript_split(V.radio(spark, sf_dir), 0.02, "split").select("row_idx", "held_out")


DAYS = "days as (select row_idx, strftime(ts, '%Y%m%d') as day from clips), ends as (select min(day) as a, max(day) as b from days)"


@query("WIN-10", V.with_sql(V.CLIPS, DAYS, f"dev as (select row_idx from days, ends where day = a order by {V.order('dev', 'row_idx')}, row_idx limit 20)", select="""select row_idx,
  case when day = b then 'locked' when row_idx in (select row_idx from dev) then 'dev' when day = a then 'heldout' else 'train' end as split from days, ends"""))  # fmt: skip
def win10(spark, sf_dir):
    d = V.clips(spark, sf_dir).select("row_idx", F.date_format("ts", "yyyyMMdd").alias("day"))
    a, b = d.agg(F.min("day"), F.max("day")).first()
    return S.day_split(d, "day", a, b, 20, "dev", "row_idx").select("row_idx", "split")


@query("SMP-1", V.with_sql(V.ATC, select=f"""select 'u' || lpad(row_idx::varchar, 8, '0') as base_id, v as view_index, {V.order('views', 'row_idx', 'v')} as shuffle from atc, (select unnest(range(3)) as v)"""))
def smp1(spark, sf_dir):
    return P.expand_views(V.radio(spark, sf_dir).select("row_idx"), 3, "views").select("base_id", "view_index", "shuffle")


QUOTAS = {"O": 0.3, "F": 0.2, "absent": 0.1}


@query("SMP-2", """with c as (select o_orderstatus as category, sum(o_totalprice::double) as w from orders group by 1),
q as (select category, w, case category when 'O' then 0.3 when 'F' then 0.2 end as quota from c)
select category, coalesce(quota, w / (select sum(w) from q where quota is null) * (1 - (select sum(quota) from q))) as share from q""")
def smp2(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("category"), F.col("o_totalprice").cast("double").alias("weight"))
    return P.category_distribution(o, QUOTAS)


@query("SMP-6", V.with_sql(V.ATC, select=f"""select row_idx, category = 'F' as is_real from atc, (select count(*) filter (category = 'F') as r, count(*) filter (category <> 'F') as s from atc),
  lateral (select least(r, floor(s * 0.25 / 0.75)) as kr) x, lateral (select floor(kr * 0.75 / 0.25) as ks) y
  qualify row_number() over (partition by category = 'F' order by {V.order('mix', 'row_idx')}, row_idx) <= case when category = 'F' then kr else ks end"""))  # fmt: skip
def smp6(spark, sf_dir):
    a = V.radio(spark, sf_dir)
    real, other = a.where("category = 'F'"), a.where("category <> 'F'")
    return P.mix_ratio(real, other, 0.25, "mix", "row_idx").select("row_idx", "is_real")


@query("SMP-7", V.with_sql(V.ATC, select="""select row_idx, unnest(range(case when category = 'P' then greatest(1, round_even((select count(*) filter (category <> 'P') / count(*) filter (category = 'P') from atc), 0))::int else 1 end)) as copy from atc"""))
def smp7(spark, sf_dir):
    a = V.radio(spark, sf_dir)
    return P.mix_upsample(a.where("category <> 'P'"), a.where("category = 'P'")).select("row_idx", "copy")


@query("SMP-8", V.with_sql(V.ATC, select=f"select row_idx, category as region from atc qualify row_number() over (partition by category order by {V.order('reg', 'row_idx')}, row_idx) <= 200"))
def smp8(spark, sf_dir):
    a = V.radio(spark, sf_dir)
    return P.balanced_regions({c: a.where(F.col("category") == c) for c in "OFP"}, 200, "reg", "row_idx").select("row_idx", "region")


@query("SMP-9", V.with_sql(V.CLIPS, select=f"select row_idx from clips order by {V.order('s9', 'row_idx')}, row_idx limit 500"))
def smp9(spark, sf_dir):
    return S.exact_sample(V.clips(spark, sf_dir), 500, "s9", "row_idx").select("row_idx")


@query("SMP-12", V.with_sql(V.CLIPS, select=f"select row_idx from clips order by {V.order('s12', 'row_idx')}, row_idx limit (select ceil(count(*) * 0.05)::bigint from clips)"))
def smp12(spark, sf_dir):
    return P.random_holdout(V.clips(spark, sf_dir), 0.05, "s12", "row_idx").select("row_idx")


TIERS = f"tiers as (select row_idx, kind, category, case when u < 0.4 then 'gold' when u < 0.7 then 'silver' when u < 0.9 then 'adversarial' else 'rejected' end as tier from (select *, {V.draw_sql(chr(39) + 't' + chr(39), 'row_idx')} as u from atc))"


def tiers(spark, sf_dir):
    u = V.draw("t", F.col("row_idx"))
    return V.radio(spark, sf_dir).withColumn("tier", F.when(u < 0.4, "gold").when(u < 0.7, "silver").when(u < 0.9, "adversarial").otherwise("rejected"))


@query("SMP-13", V.with_sql(V.ATC, TIERS, select=f"""select row_idx, 'real' as origin from tiers where category = 'P' union all select * from (select row_idx, 'synthetic' from tiers where category <> 'P' and tier in ('gold', 'silver')
  order by {V.order('s13', 'row_idx')}, row_idx limit (select (count(*) * 3)::bigint from tiers where category = 'P'))"""))  # fmt: skip
def smp13(spark, sf_dir):
    t = tiers(spark, sf_dir)
    return P.synthetic_for_real(t.where("category = 'P'"), t.where("category <> 'P'"), 0.25, "s13", "row_idx").select("row_idx", "origin")


@query("GATE-7", V.with_sql(V.ATC, TIERS, "n as (select count(*) as others from tiers where tier in ('gold', 'silver'))", select="""select row_idx, tier from tiers where tier in ('gold', 'silver')
  union all select * from (select row_idx, tier from tiers where tier = 'adversarial' order by row_idx limit (select (others * 0.05 / 0.95)::double::bigint from n))""".replace("(others * 0.05 / 0.95)::double::bigint", "floor(others * 0.05 / 0.95)::bigint")))  # fmt: skip
def gate7(spark, sf_dir):
    return P.select_tiers(tiers(spark, sf_dir), ["gold", "silver", "adversarial"], 0.05, "row_idx").select("row_idx", "tier")


POOL = """pool as (select p_brand as grp, p_partkey as item, sum(p_retailprice::double) over w as hi, sum(p_retailprice::double) over (partition by p_brand) as total,
  p_retailprice::double as weight from part window w as (partition by p_brand order by p_partkey rows unbounded preceding))"""


@query("TOP-2", "select p_brand as value, count(*) as n from part group by 1 order by 2 desc, 1 limit 10")
def top2(spark, sf_dir):
    return P.most_common(V.table(spark, sf_dir, "part"), "p_brand", 10)


@query("TOP-3", "select p_partkey as trial, p_retailprice::double as reward from part where p_partkey % 50 <> 0 order by p_retailprice desc, p_partkey limit 1")
def top3(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial"), F.col("p_retailprice").cast("double").alias("reward"), F.when(F.col("p_partkey") % 50 == 0, "broken").alias("error"))
    return P.best_trial(p).select("trial", "reward")


@query("SET-2", V.with_sql(V.ATC, select="""select 'missing' as part, count(*) as n from atc where row_idx % 5 = 0 and row_idx % 7 <> 0 union all select 'extra', count(*) from atc where row_idx % 7 = 0 and row_idx % 5 <> 0
  union all select 'common', count(*) from atc where row_idx % 35 = 0"""))  # fmt: skip
def set2(spark, sf_dir):
    a = V.radio(spark, sf_dir).select("row_idx")
    return P.set_report(a.where("row_idx % 5 = 0"), a.where("row_idx % 7 = 0"), "row_idx")


@query("SET-1", V.with_sql(V.ATC, select="select row_idx, category as run, case when category <> 'F' then category end as category from atc"))
def set1(spark, sf_dir):
    a = V.radio(spark, sf_dir).select("row_idx", "category")
    runs = {c: a.where(F.col("category") == c) for c in "OFP"}
    return P.merge_runs(runs | {"F": runs["F"].drop("category")}, "row_idx").select("row_idx", "run", "category")


@query("JOIN-8", "with " + POOL + f""" select r.id as request, r.grp, p.item from (select o_orderkey as id, 'Brand#' || (1 + o_orderkey % 5) || (1 + o_custkey % 5) as grp, {V.draw_sql(chr(39) + 'd' + chr(39), 'o_orderkey')} as u from orders) r
  join pool p on p.grp = r.grp and r.u * p.total >= p.hi - p.weight and r.u * p.total < p.hi""")  # fmt: skip
def join8(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.concat(F.lit("Brand#"), (1 + F.col("o_orderkey") % 5).cast("string"), (1 + F.col("o_custkey") % 5).cast("string")).alias("grp"))
    pool = V.table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("item"), F.col("p_retailprice").cast("double").alias("weight"))
    return P.weighted_draw(o, pool, "d", "request", "grp", "item").select("request", "grp", "item")
