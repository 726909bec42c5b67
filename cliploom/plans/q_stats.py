"""Queries of statistics, fidelity, waveforms, writers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.functions import waveform as W
from cliploom.operators import corpus as C
from cliploom.operators import fidelity as D
from cliploom.operators import stats as S
from cliploom.plans import views as V
from cliploom.plans.registry import query
from cliploom.sources import readers as R
from cliploom.sources import writers as O
from cliploom.sources.shared import scratch
from cliploom.streaming import jobs as M

ARMS = "arms as (select l_returnflag as arm, l_linenumber as seed, avg(l_discount::double) as reward from lineitem group by 1, 2)"


def arms(spark, sf_dir):
    x = V.table(spark, sf_dir, "lineitem")
    return x.groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("seed")).agg(F.avg(F.col("l_discount").cast("double")).alias("reward"))


@query("STA-1", f"""with {ARMS}, a as (select arm, count(*) as n, avg(reward) as mean, stddev_samp(reward) as sd from arms group by 1)
select arm, n, mean, sd, avg(sd) over () as pooled, mean - max(case when arm = 'N' then mean end) over () as gap, (mean - max(case when arm = 'N' then mean end) over ()) / avg(sd) over () as separation from a""")
def sta1(spark, sf_dir):
    return S.arm_summary(arms(spark, sf_dir), "N")


PAIRED = "d as (select a.arm, b.reward - a.reward as d from arms a join arms b on b.seed = a.seed and b.arm = 'N' where a.arm <> 'N')"


#: The last rows take the arms A and B, of which B is A under other seeds, as parts of R.
@query("STA-2", f"""with {ARMS}, {PAIRED}, e as (select avg(d) filter (arm = 'A') as a, avg(d) filter (arm = 'R') as r from d)
select arm, count(*) as n, avg(d) as mean, stddev_samp(d) as sd, count(*) filter (d > 0) as positive, stddev_samp(d) / sqrt(count(*)) as se, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t, count(*) - 1 as df, case arm when 'A' then 0.5::double end as share from d group by 1
union all select 'B', null, a, null, null, null, null, null, 0.5 from e union all select 'sum', null, 2 * a, null, null, null, null, null, null from e union all select 'residual', null, 2 * a - r, null, null, null, null, null, null from e""")
def sta2(spark, sf_dir):
    a = arms(spark, sf_dir)
    three = a.unionByName(a.where("arm = 'A'").withColumn("arm", F.lit("B")))
    parts = S.additivity(three, "N", ["A", "B"], "R")
    paired = S.paired_by_seed(a, "N").join(parts.select("arm", "share"), "arm", "left")
    more = parts.where("arm in ('B', 'sum', 'residual')").withColumnRenamed("effect", "mean")
    return paired.unionByName(more, allowMissingColumns=True)


@query("STA-4", f"""with {ARMS}, a as (select arm, count(*) as n, avg(reward) as mean, var_samp(reward) as v from arms group by 1)
select arm, n, mean, sqrt(sum((n - 1) * v) over () / sum(n - 1) over ()) as pooled, (mean - max(case when arm = 'N' then mean end) over ()) / sqrt(sum((n - 1) * v) over () / sum(n - 1) over ()) as gap from a""")
def sta4(spark, sf_dir):
    return S.pooled_gap(arms(spark, sf_dir), "N")


@query("STA-5", """with b as (select l_suppkey % 5 as block, l_returnflag as arm, l_linenumber as seed, avg(l_tax::double) as wer from lineitem group by 1, 2, 3)
select x.block, x.arm, count(*) as n, avg(x.wer - y.wer) as delta, count(*) filter (x.wer < y.wer) as lower from b x join b y on x.block = y.block and x.seed = y.seed and y.arm = 'N' where x.arm <> 'N' group by 1, 2""")
def sta5(spark, sf_dir):
    x = V.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("block"), F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("seed")).agg(F.avg(F.col("l_tax").cast("double")).alias("wer"))
    return S.block_deltas(x, "N")


@query("STA-7", """with p as (select p_partkey, p_retailprice::double as v from part), m as (select quantile_cont(v, 0.5) as m from p), d as (select m, quantile_cont(abs(v - m), 0.5) as d from p, m group by m)
select p_partkey, v from p, d where v <= m + 1.0 * greatest(d, 1e-6)""")
def sta7(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v"))
    return S.mad_filter(p, "v", 1.0)


@query("STA-8", """with long as (select unnest(['all', label::varchar]) as station, embedding as e from embeddings),
fields as (select station, unnest(['drive', 'noise_gain']) as field, unnest([e[1]::double, e[2]::double]) as x from long)
select station, field, count(*) as n, avg(x) as mean, quantile_cont(x, 0.1) as p10, quantile_cont(x, 0.5) as p50, quantile_cont(x, 0.9) as p90, max(x) as max from fields group by 1, 2
union all select station, 'band_' || lpad((i - 1)::varchar, 2, '0'), count(*), avg(e[i]::double), null, null, null, null from (select *, unnest(range(1, 33)) as i from long) group by 1, 2""")
def sta8(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("station"), F.slice("embedding", 1, 32).alias("band_gains_db"), F.col("embedding")[0].alias("drive"), F.col("embedding")[1].alias("noise_gain"))
    return S.preset_summary(e, ["drive", "noise_gain"])


PULLS = f"""pulls as (select dense_rank() over (order by date_trunc('day', ts)) as pull, event_type as arm, {V.draw_sql("'t'", 'event_id')} * 1.5 as teacher, {V.draw_sql("'s'", 'event_id')} * 1.5 as student from events),
routed as (select *, case when teacher >= 0.5 then 'dropped' when student <= 0.2 or student >= 1.0 then 'spillover' else 'selected' end as route,
  case when teacher >= 0.5 then 'teacher_untrusted' when student <= 0.2 then 'too_easy' when student >= 1.0 then 'too_hard' else 'in_window' end as reason from pulls)"""


def routed(spark, sf_dir):
    from cliploom.functions.text import hardness_route

    e = V.table(spark, sf_dir, "events")
    days = e.select(F.to_date("ts").alias("day")).distinct()
    from pyspark.sql import Window

    days = days.withColumn("pull", F.row_number().over(Window.orderBy("day")))
    e = e.withColumn("day", F.to_date("ts")).join(F.broadcast(days), "day")
    e = e.select("pull", F.col("event_type").alias("arm"), (V.draw("t", F.col("event_id")) * 1.5).alias("teacher"), (V.draw("s", F.col("event_id")) * 1.5).alias("student"))
    return e.select("*", hardness_route(F.col("teacher"), F.col("student"), 0.5, 0.2, 1.0).alias("r")).select("*", "r.route", "r.reason").drop("r")


@query("STA-9", f"""with {PULLS}, s as (select arm, count(*) filter (route = 'selected') as s, count(*) filter (route <> 'selected') as f from routed group by 1)
select arm, s + 1.0 as alpha, f + 1.0 as beta, (s + 1) / (s + f + 2) as mean, sqrt((s + 1.0) * (f + 1.0) / ((s + f + 2.0) * (s + f + 2.0) * (s + f + 3.0))) as sd, s + f as observations from s""")
def sta9(spark, sf_dir):
    p = routed(spark, sf_dir).select("arm", (F.col("route") == "selected").cast("long").alias("successes"), (F.col("route") != "selected").cast("long").alias("failures"))
    return S.beta_posteriors(p)


@query("STA-10", f"""with {PULLS}, told as (select pull, string_agg(reason || '=' || k, ',' order by reason) as reasons from (select pull, reason, count(*) as k from routed where reason is not null group by 1, 2) group by 1)
select r.pull, any_value(coalesce(told.reasons, '')) as reasons, count(teacher) as n_rated, count(*) as n, count(*) filter (route = 'selected') as selected, count(*) filter (route = 'spillover') as spillover, count(*) filter (route = 'dropped') as dropped, avg(teacher) as mean,
  quantile_cont(teacher, 0.5) as p50, quantile_cont(teacher, 0.9) as p90 from routed r left join told using (pull) group by 1""")
def sta10(spark, sf_dir):
    reasons = F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return S.pull_summary(routed(spark, sf_dir)).withColumn("reasons", F.array_join(reasons, ","))


@query("WIN-12", f"""with {PULLS}, p as (select pull, count(*) filter (route = 'selected') as a, count(*) filter (route = 'spillover') as b, count(*) filter (route = 'dropped') as c from routed group by 1),
r as (select pull, sum(a) over w::bigint as selected, sum(b) over w::bigint as spillover, sum(c) over w::bigint as dropped from p window w as (order by pull rows unbounded preceding))
select *, (selected + 1) / (selected + spillover + dropped + 2) as posterior_mean from r""".replace("over w::bigint", "over w"))
def win12(spark, sf_dir):
    return S.running_totals(routed(spark, sf_dir).groupBy("pull").agg(*S.route_counts()))


@query("AGG-3", """with b(bin, low, high) as (values (0, 0.0, 10.0), (1, 10.0, 50.0), (2, 50.0, 100.0), (3, 1000000.0, 2000000.0))
select b.bin, low::double as low, high::double as high, count(value) as n from b left join events on value >= low and (value < high or (b.bin = 3 and value = high)) where b.bin < 3 or true group by 1, 2, 3""".replace("(2, 50.0, 100.0), (3, 1000000.0, 2000000.0)", "(2, 50.0, 100.0), (3, 100.0, 1000000.0)"))
def agg3(spark, sf_dir):
    return S.histogram(V.table(spark, sf_dir, "events"), "value", [0, 10, 50, 100, 1_000_000])


@query("AGG-4", "select event_type, count(value) as n, avg(value) as mean, quantile_cont(value, 0.1) as p10, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.9) as p90, max(value) as max from events group by 1")
def agg4(spark, sf_dir):
    return S.distribution(V.table(spark, sf_dir, "events"), "value", ["event_type"])


REASON = "case when duration < 20 then 'short' when duration > 150 then 'long' end"


@query("AGG-1", V.with_sql(V.CLIPS, f"judged as (select *, {REASON} as reason, row_idx % 3 = 0 as resampled, row_idx % 4 = 0 as mixed, case when row_idx % 10 = 0 then 'holdout' else 'train' end as split from clips)", select="""
  select part, value, count(*) as n from (select 'kept' as part, 'all' as value from judged where reason is null union all select 'dropped', reason from judged where reason is not null
  union all select 'kept', 'resampled' from judged where reason is null and resampled union all select 'kept', 'mixed' from judged where reason is null and mixed
  union all select 'station', station from judged where reason is null union all select 'split', split from judged where reason is null) group by 1, 2"""))  # fmt: skip
def agg1(spark, sf_dir):
    i = F.col("row_idx")
    c = V.clips(spark, sf_dir).withColumns({"reason": F.expr(REASON), "resampled": i % 3 == 0, "mixed": i % 4 == 0, "split": F.when(i % 10 == 0, "holdout").otherwise("train")})
    return C.corpus_stats(c)


@query("AGG-5", V.with_sql(V.CLIPS, f"judged as (select {REASON} as reason from clips)", select="""select part, value, count(*) as n, count(*) / (select count(*) from judged) as rate from (select 'all' as part, 'total' as value from judged
  union all select 'all', case when reason is null then 'kept' else 'discarded' end from judged union all select 'reason', reason from judged where reason is not null) group by 1, 2"""))  # fmt: skip
def agg5(spark, sf_dir):
    return C.qc_tally(V.clips(spark, sf_dir).select(F.expr(REASON).alias("reason")))


#: Statistics of each vector, made louder by its id, as a clip of one second at 64 Hz: spectrum over segments of 32 samples, frames of 8 samples every 4, 8 bands from 1.5 to 31 Hz.
CLIP_SQL = """
samples as (select vec_id, label >= 5 as is_real, i - 1 as t, embedding[i]::double * (1 + vec_id % 5) as x from (select vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)),
levels as (select vec_id, any_value(is_real) as is_real, count(*) / 64.0 as duration, 10 * log10(greatest(avg(x * x), 1e-9)) as rms_db, 10 * log10(greatest(max(x * x), 1e-9)) as peak_db from samples group by 1),
segments as (select vec_id, s, t - 16 * s as k, (x - avg(x) over (partition by vec_id, s)) * (0.5 - 0.5 * cos(2 * pi() * (t - 16 * s) / 32)) as y from samples, (select range as s from range(3)) where t between 16 * s and 16 * s + 31),
waves as (select vec_id, s, f, pow(sum(y * cos(2 * pi() * f * k / 32)), 2) + pow(sum(y * sin(2 * pi() * f * k / 32)), 2) as e from segments, (select range as f from range(17)) group by 1, 2, 3),
powers as (select vec_id, f, avg(e) * case when f in (0, 16) then 1 else 2 end / 256.0 as p from waves group by 1, 2),
shares as (select vec_id, f, p / sum(p) over (partition by vec_id) as share, sum(p) over (partition by vec_id order by f) / sum(p) over (partition by vec_id) as upto from powers),
edges as (select vec_id, min(f) filter (upto >= 0.02) * 2.0 as low_hz, min(f) filter (upto >= 0.98) * 2.0 as edge_hz from shares group by 1),
bands as (select range as band, 1.5 * pow(31 / 1.5, range / 8.0) as low, 1.5 * pow(31 / 1.5, (range + 1) / 8.0) as high from range(8)),
ltas as (select vec_id, band, 10 * log10(greatest(coalesce(sum(share) filter (f * 2 >= low and f * 2 < high), 0), 1e-9)) as db from shares, bands group by 1, 2),
frames as (select vec_id, i, avg(x * x) as p from samples, (select range as i from range(15)) where t between 4 * i and 4 * i + 7 group by 1, 2),
noise as (select vec_id, 10 * log10(greatest(quantile_cont(p, 0.9) - quantile_cont(p, 0.15), 1e-9)) - 10 * log10(greatest(quantile_cont(p, 0.15), 1e-9)) as snr_db from frames group by 1),
hulls as (select vec_id, i, (sqrt(p) - avg(sqrt(p)) over (partition by vec_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 14)) as y from frames),
turns as (select vec_id, f, pow(sum(y * cos(2 * pi() * f * i / 15)), 2) + pow(sum(y * sin(2 * pi() * f * i / 15)), 2) as e from hulls, (select range as f from range(8)) group by 1, 2),
mods as (select vec_id, sum(e) filter (f >= 2) / sum(e) filter (f >= 1) as mod_share from turns group by 1),
stats as (select * from levels join edges using (vec_id) join noise using (vec_id) join mods using (vec_id)),
stat_rows as (select vec_id, is_real, unnest(['duration', 'rms_db', 'peak_db', 'low_hz', 'edge_hz', 'snr_db', 'mod_share']) as stat, unnest([duration, rms_db, peak_db, low_hz, edge_hz, snr_db, mod_share]) as x from stats),
ltas_rows as (select is_real, 'ltas_' || lpad(band::varchar, 2, '0') as stat, avg(db) as mean, count(*) as n from ltas join levels using (vec_id) group by 1, 2)"""


def clip_rows(spark, sf_dir):
    """vec_id, is_real and stats of each vector as a clip."""
    e = V.table(spark, sf_dir, "embeddings")
    samples = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5))
    stats = W.clip_stats(32, 8 / 64, 4 / 64, 1.5, 31, 8)(samples, F.lit(64))
    return e.select("vec_id", (F.col("label") >= 5).alias("is_real"), stats.alias("stats"))


@query("WAV-8", V.with_sql(CLIP_SQL, select="select vec_id, duration, rms_db, peak_db, low_hz, edge_hz, snr_db, mod_share, ltas from stats join (select vec_id, string_agg(printf('%.6f', db + 0.0), ',' order by band) as ltas from ltas group by 1) using (vec_id)"))
def wav8(spark, sf_dir):
    ltas = F.array_join(F.transform("stats.ltas_db", lambda x: F.format_string("%.6f", x)), ",")
    return clip_rows(spark, sf_dir).select("vec_id", *(F.col(f"stats.{n}") for n in W.CLIP_STATS), ltas.alias("ltas"))


@query("FID-1", V.with_sql(CLIP_SQL, select="select is_real, stat, count(*) as n, avg(x) as mean, quantile_cont(x, 0.1) as p10, quantile_cont(x, 0.5) as p50, quantile_cont(x, 0.9) as p90 from stat_rows group by 1, 2 union all select is_real, stat, n, mean, null, null, null from ltas_rows"))
def fid1(spark, sf_dir):
    return D.channel_set_stats(clip_rows(spark, sf_dir), ["is_real"])


MEDIANS = """medians as (select stat, quantile_cont(x, 0.5) filter (not is_real) as p50, quantile_cont(x, 0.1) filter (is_real) as real_p10, quantile_cont(x, 0.9) filter (is_real) as real_p90 from stat_rows group by 1),
tallies as (select stat, x, count(*) filter (is_real) as a, count(*) filter (not is_real) as b from stat_rows group by 1, 2),
gaps as (select stat, abs(sum(a) over w / sum(a) over (partition by stat) - sum(b) over w / sum(b) over (partition by stat)) * (lead(x) over (partition by stat order by x) - x) as part from tallies window w as (partition by stat order by x)),
distances as (select stat, coalesce(sum(part), 0) as distance from gaps group by 1)"""


@query("FID-2", V.with_sql(CLIP_SQL, MEDIANS, select="""
  select stat, distance, case when real_p90 > real_p10 then distance / (real_p90 - real_p10) end as normalized, p50, real_p10, real_p90, p50 between real_p10 and real_p90 as in_range from medians join distances using (stat)
  union all select 'ltas', avg(abs(a.mean - b.mean)), null, null, null, null, null from ltas_rows a join ltas_rows b on a.stat = b.stat and a.is_real and not b.is_real
  union all select 'all', null, null, null, null, null, bool_and(p50 between real_p10 and real_p90) from medians"""))  # fmt: skip
def fid2(spark, sf_dir):
    return D.compare_sets(clip_rows(spark, sf_dir), "is_real")


@query("FID-3", "select event_type as metric, min(p10) as p10, max(p90) as p90 from (select event_type, user_id % 4 as report, quantile_cont(value, 0.1) as p10, quantile_cont(value, 0.9) as p90 from events group by 1, 2) group by 1")
def fid3(spark, sf_dir):
    return envelope(spark, sf_dir)


def envelope(spark, sf_dir):
    return D.measure_envelope(V.table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("report"), "value"), "event_type", "report", "value")


@query("FN-23", """with e as (select event_type as metric, min(p10) as p10, max(p90) as p90 from (select event_type, user_id % 4 as report, quantile_cont(value, 0.1) as p10, quantile_cont(value, 0.9) as p90 from events group by 1, 2) group by 1),
r as (select event_type as metric, min(value) as low, avg(value) as high from events group by 1)
select metric, 'low' as side from e join r using (metric) where low < p10 - 0.5 union all select metric, 'high' from e join r using (metric) where high > p90 + 0.5""")
def fn23(spark, sf_dir):
    r = V.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.min("value").alias("low"), F.avg("value").alias("high"))
    return D.envelope_check(r, envelope(spark, sf_dir), 0.5)


@query("FID-5", None)
def fid5(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).alias("in_a"))
    return D.kid(e, "embedding", "in_a", "vec_id")


@query("FID-6", None)
def fid6(spark, sf_dir):
    return D.frechet(V.table(spark, sf_dir, "embeddings").select("embedding", (F.col("label") < 5).alias("in_a")), "embedding", "in_a")


@query("STA-12", """with e as (select l_linenumber as step, l_suppkey % 7 as fold, avg(l_discount::double) as value, l_linenumber <> 3 as gates_ok from lineitem group by 1, 2), ok as (select * from e where gates_ok),
best as (select step from ok group by step order by avg(value), step limit 1), d as (select a.step, a.value - b.value as d from ok a join ok b on a.fold = b.fold and b.step = (select step from best)),
s as (select step, avg(d) as diff, stddev_samp(d) / sqrt(count(*)) as se from d group by 1) select step, diff from s where diff <= coalesce(se, 0) or diff = 0 order by step limit 1""")
def sta12(spark, sf_dir):
    e = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("step"), (F.col("l_suppkey") % 7).alias("fold")).agg(F.avg(F.col("l_discount").cast("double")).alias("value"))
    return D.select_candidate(e.withColumn("gates_ok", F.col("step") != 3))


CLIP64 = "c as (select vec_id, embedding as e from embeddings)"


@query("WAV-4", f"""with {CLIP64}, m as (select vec_id, len(e) / 64.0 as seconds, vec_id % 31 = 0 as bad, vec_id % 5 = 0 as garbled, list_transform(e, lambda x: x::double * case vec_id % 4 when 0 then 1e-4 when 1 then 0.02 else 1 end) as x from c),
l as (select vec_id, seconds, bad, garbled, 10 * log10(greatest(list_sum(list_transform(x, lambda v: v * v)) / len(x), 1e-12)) as rms, list_max(list_transform(x, lambda v: abs(v))) as peak from m)
select vec_id, seconds, case when not bad then rms end as rms, case when not bad then peak end as peak,
  case when bad then 'nonfinite' when rms < -60 then 'silence' when rms not between -40 and -8 then 'level' when garbled then 'roundtrip' end as reason from l""")
def wav4(spark, sf_dir):
    i = F.col("vec_id")
    gain = F.when(i % 4 == 0, 1e-4).when(i % 4 == 1, 0.02).otherwise(1.0)
    samples = F.transform("embedding", lambda x, k: F.when((i % 31 == 0) & (k == 3), float("nan")).otherwise(x.cast("double") * gain))
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", samples.alias("samples"), F.lit(64).alias("sr"), F.when(i % 5 == 0, 0.6).when(i % 5 == 1, 0.5).alias("wer"))
    bad = F.coalesce(F.col("reason") == "nonfinite", F.lit(False))
    return W.clip_qc(e, wer="wer").select("vec_id", "seconds", *(F.when(~bad, F.col(c)).alias(c) for c in ("rms", "peak")), "reason")


@query("WAV-3", f"""with {CLIP64} select vec_id, i // 8 as frame, 10 * log10(greatest(list_sum(list_transform(e[i + 1:i + 16], lambda x: x::double * x::double)) / 16, 1e-12)) as db from (select *, unnest(range(0, 49, 8)) as i from c)""")
def wav3(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(W.frame_db(16, 8)("embedding")).alias("frame", "db"))
    return e.select("vec_id", F.col("frame").cast("long").alias("frame"), "db")


@query("WAV-12", f"""with {CLIP64}, k as (select vec_id, e, list_max(list_transform(e, lambda x: abs(x::double))) as top from c where vec_id % 9 <> 0 order by {V.order('domain', 'vec_id')}, vec_id limit 300)
select vec_id, list_sum(list_transform(e, lambda x: x::double)) * 0.9 / top as total, 0.9::double as peak, len(e)::int as n from k where top >= 1e-4""")
def wav12(spark, sf_dir):
    samples = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 40)).otherwise(F.col("embedding"))  # too short
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", samples.alias("samples"), F.lit(32).alias("sr"))
    e = W.domain_filter(e, 1.5, 12, most=300, key="vec_id")
    return e.select("vec_id", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total"), W.peak(F.col("samples")).alias("peak"), F.size("samples").alias("n"))


@query("WAV-14", f"""with {CLIP64} select vec_id, case when vec_id % 11 = 0 then 'empty' when vec_id % 5 = 0 then 'length' when vec_id % 13 = 0 then 'nonfinite' when vec_id % 7 = 0 then 'level' end as problem from c""")
def wav14(spark, sf_dir):
    x, i = F.col("embedding").cast("array<double>"), F.col("vec_id")
    out = F.when(i % 11 == 0, F.array().cast("array<double>")).when(i % 5 == 0, F.slice(x, 1, 60)).when(i % 13 == 0, F.transform(x, lambda v, k: F.when(k == 9, float("inf")).otherwise(v))).when(i % 7 == 0, F.transform(x, lambda v: v * 0.1)).otherwise(x)
    return W.compare_pairs(V.table(spark, sf_dir, "embeddings").select("vec_id", x.alias("a"), out.alias("b")), "a", "b").select("vec_id", "problem")


@query("WAV-2", None)
def wav2(spark, sf_dir):
    return V.table(spark, sf_dir, "embeddings").select("vec_id", W.audio_hash("embedding").alias("audio_hash"))


@query("WAV-7", None)
def wav7(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", W.repeat_score(8, 4, 2)("embedding").alias("score"))
    return e.withColumn("looped", F.col("score") > W.LOOPED)


def gated(spark, sf_dir):
    from cliploom.plans.q_splits import tiers

    t = tiers(spark, sf_dir)
    return t.select("row_idx", F.concat(F.lit("a"), F.col("row_idx").cast("string"), F.lit(".wav")).alias("audio"), "text", "tier")


@query("SNK-1", V.with_sql(V.ATC, select="select row_idx, 'a' || row_idx || '.wav' as audio, text from atc"))
def snk1(spark, sf_dir):
    path = scratch(spark, "manifest")
    O.write_manifest(gated(spark, sf_dir), path)
    m = R.read_manifest(spark, path, training=True)
    return m.select("row_idx", R.basename(F.col("audio")).alias("audio"), "text")


@query("SNK-2", V.with_sql(V.ATC, select="select 'a' || row_idx || '.wav' as audio, text, false as suspect from atc"))
def snk2(spark, sf_dir):
    path = scratch(spark, "csv")
    O.write_corpus_csv(gated(spark, sf_dir), path)
    return R.read_versioned_snapshot(spark, {"train": path}).select("audio", "text", "suspect")


@query("SNK-3", V.with_sql(V.ATC, select="select row_idx, (row_idx % 7)::int as shard from atc"))
def snk3(spark, sf_dir):
    path = scratch(spark, "shards")
    O.write_shards(gated(spark, sf_dir).select("row_idx", "text"), 7, path)
    return spark.read.json(path).select("row_idx", "shard")


@query("SNK-4", f"with {PULLS} select pull, count(*) as n from routed group by 1")
def snk4(spark, sf_dir):
    path, p = scratch(spark, "log"), routed(spark, sf_dir).groupBy("pull").agg(F.count(F.lit(1)).alias("n"))
    M.append_once(p.where("pull <= 3"), path, "pull")
    M.append_once(p, path, "pull")
    M.append_once(p, path, "pull")
    return spark.read.parquet(path)


def arriving(spark, sf_dir):
    schema = V.table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("STR-3", f"with {PULLS} select arm, count(*) filter (route = 'selected') as successes, count(*) filter (route <> 'selected') as failures, (count(*) filter (route = 'selected') + 1) / (count(*) + 2) as mean from routed group by 1")
def str3(spark, sf_dir):
    """Pulls arrive in four files, some in two of them; the last two are merged again, by a query that starts anew."""
    from cliploom.functions.text import hardness_route

    i = F.col("event_id")
    pulls = V.table(spark, sf_dir, "events").select(i.alias("pull"), F.col("event_type").alias("arm"), (hardness_route(V.draw("t", i) * 1.5, V.draw("s", i) * 1.5, 0.5, 0.2, 1.0)["route"] == "selected").cast("long").alias("successes"))
    pulls = pulls.withColumn("failures", 1 - F.col("successes"))
    source, log = scratch(spark, "pulls"), scratch(spark, "log")
    for n in range(4):
        pulls.where((F.col("pull") % 4 == n) | ((F.col("pull") % 16 == 0) & F.lit(n == 3))).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(pulls.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for state in ("first", "again"):
        M.stream_posteriors(arriving, log, f"{log}-{state}")
    return M.log_posteriors(spark, log)


@query("STR-1", """with g as (select 'ST' || user_id % 6 as station, ts, lag(ts) over (partition by user_id % 6 order by ts) as before from events),
s as (select station, ts, sum(case when before is null or ts - before > interval 15 minutes then 1 else 0 end) over (partition by station order by ts rows unbounded preceding) as b from g),
w as (select station, min(ts) as a, max(ts) + interval 15 minutes as b, count(*) as n from s group by station, s.b)
select station, strftime(a, '%Y-%m-%d %H:%M:%S') as start, strftime(b, '%Y-%m-%d %H:%M:%S') as "end", n from w where b <= (select max(ts) - interval 1 hour from events)""")
def str1(spark, sf_dir):
    e = arriving(spark, sf_dir).select("ts", F.concat(F.lit("ST"), (F.col("user_id") % 6).cast("string")).alias("station"))
    path = scratch(spark, "stream")
    M.run_available(M.stream_capture_blocks(e), path, path + "-state")
    return spark.read.parquet(path).select("station", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")), "n")


@query("STR-4", """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, case when value < 20 then 'short' when value > 150 then 'long' else 'kept' end as reason, count(*) as n from events
  where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from events) group by 1, 2""")
def str4(spark, sf_dir):
    e = arriving(spark, sf_dir).select("ts", F.expr("case when value < 20 then 'short' when value > 150 then 'long' else 'kept' end").alias("reason"))
    path = scratch(spark, "stream")
    M.run_available(M.stream_qc_tally(e), path, path + "-state")
    return spark.read.parquet(path).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "reason", "n")


@query("STR-2", "select distinct md5(user_id::varchar) as audio_hash from events")
def str2(spark, sf_dir):
    e = arriving(spark, sf_dir).select("ts", F.md5(F.col("user_id").cast("string")).alias("audio_hash"))
    path = scratch(spark, "stream")
    M.run_available(M.stream_dedup(e), path, path + "-state")
    return spark.read.parquet(path).select("audio_hash")
