"""Queries of slots and the verification gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions import entities as E
from cliploom.functions import text as T
from cliploom.operators import corpus as C
from cliploom.operators import gate as G
from cliploom.operators import wer
from cliploom.plans import views as V
from cliploom.plans.registry import query

AIRLINES = {"csa": "CSA", "sky travel": "SKV"}
#: Transmissions of one of six forms for each order; n gives their numbers.
BASE = "base as (select row_idx, ident, row_idx % 6 as form, row_idx % 9973 as n from atc)"


def call_sql(name: str, n: str = "n", kept: str = "true") -> str:
    """name and name_slots: transmissions whose numbers come from n, and the legal slots that they hold, of all kinds; kept tells which have any."""
    return f"""{name} as (select *, lpad((n % 400 + 1)::varchar, 3, '0') as n3, lpad((n * 7 % 10000)::varchar, 4, '0') as n4 from (select row_idx, ident, form, {n} as n, {kept} as kept from base)),
{name}_slots as (select * from (
  select row_idx, 'callsign' as type, case form when 0 then 'N' || ident || 'AB' when 2 then 'SKV' || ident else 'CSA' || ident end as value from {name} where kept and form <> 4 union all
  select row_idx, 'runway', lpad((n % 40)::varchar, 2, '0') || 'L' from {name} where kept and form = 0 and n % 40 between 1 and 36 union all
  select row_idx, 'altitude', (1 + n % 9) || '500ft' from {name} where kept and form = 1 union all
  select row_idx, 'atis', 'C' from {name} where kept and form = 2 union all
  select row_idx, 'altimeter', 'A' || n4 from {name} where kept and form = 2 and n4::int between 2800 and 3150 union all
  select row_idx, 'speed', n3::int::varchar from {name} where kept and form = 3 and n3::int between 60 and 350 union all
  select row_idx, 'squawk', n4 from {name} where kept and form = 3 and not regexp_matches(n4, '[89]') union all
  select row_idx, 'frequency', '1' || (18 + n % 25) || '.500' from {name} where kept and form = 4 and n % 25 <= 18 union all
  select row_idx, 'waypoint', 'RALUD' from {name} where kept and form = 4 union all
  select row_idx, 'heading', n3 from {name} where kept and form = 5 and n3::int <= 360 union all
  select row_idx, 'flight_level', 'FL' || n3 from {name} where kept and form = 5 and n3::int >= 10))"""


CALLS = f"{BASE},\n{call_sql('call')}"
UNCRITICAL = "('waypoint', 'atis')"
TENS = "zero ten twenty thirty forty".split()


def said(ident: Column, form: Column, n: Column) -> Column:
    """The transmission of a form."""
    ident, digits = V.spelled(ident), lambda n, width: V.spelled(F.lpad(n.cast("string"), width, "0"))
    n3, n4 = digits(n % 400 + 1, 3), digits(n * 7 % 10000, 4)
    whole = 18 + n % 25
    tens = F.element_at(F.array(*map(F.lit, TENS)), F.floor(whole / 10).cast("int") + 1)
    teens = F.element_at(F.array(*map(F.lit, T.TEENS)), (whole % 10).cast("int") + 1)
    ones = F.when(whole % 10 > 0, F.concat(F.lit(" "), digits(whole % 10, 1))).otherwise("")
    forms = [
        ("november ", ident, " alpha bravo cleared to land runway ", digits(n % 40, 2), " left"),
        ("csa ", ident, " climb and maintain ", digits(1 + n % 9, 1), " thousand five hundred"),
        ("skytravel ", ident, " information charlie is current, altimeter ", n4),
        ("csa ", ident, ", reduce speed to ", n3, ", squawk ", n4),
        ("contact one ", F.when(whole < 20, teens).otherwise(F.concat(tens, ones)), " decimal five and proceed direct to ralud"),
        ("csa ", ident, " turn left heading ", n3, " climb flight level ", n3),
    ]
    text = F.lit(None)
    for i, parts in enumerate(forms):
        text = F.when(form == i, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise(text)
    return text


def heard_sql(name: str) -> str:
    """What a teacher hears: other numbers in some rows, nothing in some, and levels like "3.4" in some.

    Such a level is a slot of the normalized text alone: name_all holds it, name_said doesn't.
    """
    u = lambda what: V.draw_sql(f"'{name}{what}'", "row_idx")
    return f"""{call_sql(name, f"case when {u('n')} < 0.1 then (n + 7) % 9973 else n end", f"{u('s')} >= 0.05")},
{name}_dots as (select row_idx, 'flight_level' as type, 'FL0' || (1 + n % 9) || (n % 10) as value from {name} where kept and form = 5 and {u('d')} < 0.3),
{name}_said as (select * from {name}_slots where type <> 'flight_level' or row_idx not in (select row_idx from {name}_dots)),
{name}_all as (select * from {name}_said union all select * from {name}_dots)"""


TEACHERS = (V.ATC, CALLS, heard_sql("t1"), heard_sql("t2"))


def heard(df: DataFrame, name: str) -> Column:
    u = lambda what: V.draw(f"{name}{what}", F.col("row_idx"))
    n = F.when(u("n") < 0.1, (F.col("n") + 7) % 9973).otherwise(F.col("n"))
    text = said(F.col("ident"), F.col("form"), n)
    dots = F.concat(F.regexp_extract(text, "^(.* level) ", 1), F.lit(" "), (1 + n % 9).cast("string"), F.lit("."), (n % 10).cast("string"))
    text = F.when((F.col("form") == 5) & (u("d") < 0.3), dots).otherwise(text)
    return F.when(u("s") < 0.05, "roger").otherwise(text)


def calls(spark, sf_dir):
    """row_idx, ident, text of a transmission, and what the teachers t1 and t2 hear."""
    n = F.col("row_idx") % 9973
    a = V.radio(spark, sf_dir).select("row_idx", "ident", (F.col("row_idx") % 6).alias("form"), n.alias("n"))
    return a.select("row_idx", "ident", said(F.col("ident"), F.col("form"), F.col("n")).alias("text"), heard(a, "t1").alias("t1"), heard(a, "t2").alias("t2"))


def gated(spark, sf_dir):
    """Transmissions with their slots, both teachers', the verdicts and totals; all by row."""
    a = calls(spark, sf_dir).withColumns({"w1": V.draw("wa", F.col("row_idx")), "w2": V.draw("wb", F.col("row_idx"))})
    return G.verify_entities(G.teacher_slots(a, {"t1": "t1", "t2": "t2"}, AIRLINES, {"t1": "w1", "t2": "w2"}, {"text": "entities"}))


def panel(spark, sf_dir):
    """row_idx, and ref and hyp: slots of the transmissions and of what t1 hears, as written."""
    parse = E.extract_entities(AIRLINES)
    return calls(spark, sf_dir).select("row_idx", parse(F.col("text")).alias("ref"), parse(F.col("t1")).alias("hyp"))


@query("FN-10", V.with_sql(V.ATC, select="select row_idx, unnest([ident, heading, level]) as digits from atc"))
def fn10(spark, sf_dir):
    a = V.radio(spark, sf_dir).select("row_idx", F.explode(E.scan_numbers()(T.tokenize_spoken(F.col("text")))).alias("r"))
    return a.select("row_idx", "r.digits")


@query("FN-12", V.with_sql(V.ATC, CALLS, select=f"select row_idx, type, value, type not in {UNCRITICAL} as critical from call_slots"))
def fn12(spark, sf_dir):
    a = calls(spark, sf_dir).select("row_idx", F.inline(E.extract_entities(AIRLINES)(F.col("text"))))
    return a.select("row_idx", "type", "value", "critical")


@query("FN-15", V.with_sql(V.ATC, f"texts as (select row_idx, heading, level, {V.spelled_sql('heading')} as spoken, 'csa ' || {V.spelled_sql('ident')} || ' turn climb flight level ' || {V.spelled_sql('level')} as cut from atc)", select="""
  select row_idx, 'heading' as type, heading as value, 'lost' as problem from texts where row_idx % 50 = 0 union all
  select row_idx, 'heading', heading, 'not_spoken' from texts where row_idx % 50 = 0 and not contains(cut, spoken) union all
  select row_idx, 'flight_level', 'FL' || level, 'unlabelled' from texts where row_idx % 50 = 1 union all
  select row_idx, 'heading', '999', unnest(['out_of_range', 'lost']) from texts where row_idx % 50 = 2 union all
  select row_idx, 'heading', heading, 'unlabelled' from texts where row_idx % 50 = 2"""))  # fmt: skip
def fn15(spark, sf_dir):
    a = V.radio(spark, sf_dir).withColumn("case", F.col("row_idx") % 50)
    slot = lambda kind, value, spoken: F.struct(F.lit(kind).alias("type"), value.alias("value"), spoken.alias("spoken"), F.lit(True).alias("critical"))
    heading = F.when(F.col("case") == 2, "999").otherwise(F.col("heading"))
    label = F.array(slot("callsign", F.concat(F.lit("CSA"), "ident"), F.concat(F.lit("csa "), V.spelled(F.col("ident")))), slot("heading", heading, V.spelled(F.col("heading"))))
    level = F.array(slot("flight_level", F.concat(F.lit("FL"), "level"), V.spelled(F.col("level"))))
    text = F.when(F.col("case") == 0, F.regexp_replace("text", "heading [a-z ]+ climb", "climb")).when(F.col("case") == 3, F.concat("text", F.lit(" direct to ralud"))).otherwise(F.col("text"))
    a = a.select("row_idx", text.alias("text"), F.when(F.col("case") == 1, label).otherwise(F.concat(label, level)).alias("entities"))
    return C.validate_labels(a, AIRLINES).select("row_idx", F.inline("problems"))


@query("FN-16", V.with_sql(V.ATC, select="select row_idx, substr(ident, 2) = right(ident, 2) and row_idx % 4 <> 0 as consistent from atc"))
def fn16(spark, sf_dir):
    a = V.radio(spark, sf_dir)
    full = F.concat(F.lit("CSA"), "ident")
    short = F.when(F.col("row_idx") % 4 == 0, F.concat(F.lit("SKV"), "ident")).otherwise(F.concat(F.lit("CSA"), F.substring("ident", 2, 2)))
    return a.select("row_idx", callsigns_consistent(full, short).alias("consistent"))


def callsigns_consistent(a, b):
    """Same letters before the first digit, and one ident ends with the other."""
    letters = lambda c: F.regexp_extract(c, r"^([A-Z]+)", 1)
    ident = lambda c: F.regexp_extract(c, r"^[A-Z]+(.*)$", 1)
    return (letters(a) == letters(b)) & (ident(a).endswith(ident(b)) | ident(b).endswith(ident(a)))


#: One value of a type in each row, so that a teacher that asserts another one strays.
VERDICTS = """heard as (select *, 't1' as teacher from t1_all union all select *, 't2' from t2_all), told as (select *, 't1' as teacher from t1_said union all select *, 't2' from t2_said),
v as (select s.row_idx, s.type, s.value, (select string_agg(teacher, ',' order by teacher) from heard h where h.row_idx = s.row_idx and h.type = s.type and h.value = s.value) as verified_by,
  (select string_agg(teacher || ' ' || value, ',' order by teacher) from told h where h.row_idx = s.row_idx and h.type = s.type) as told from call_slots s),
judged as (select row_idx, type, value, coalesce(verified_by, '') as verified_by, case when verified_by is not null then 'verified' when told is not null then 'substituted' else 'missed' end as verdict,
  case when verified_by is null then coalesce(told, '') else '' end as heard from v)"""


@query("GATE-1", V.with_sql(*TEACHERS, select="""select row_idx, 't1' as teacher, 15::bigint as ref_words, (5 + case when heading is null then 0 else 4 end + 1 + case when level is null then 0 else 5 end)::bigint as words
  from (select row_idx, case when """ + V.draw_sql("'t1h'", "row_idx") + """ >= 0.1 then heading end as heading, case when """ + V.draw_sql("'t1f'", "row_idx") + """ >= 0.1 then level end as level from atc)"""))  # fmt: skip
def gate1(spark, sf_dir):
    a = V.radio(spark, sf_dir)
    heading = F.when(V.draw("t1h", F.col("row_idx")) >= 0.1, F.concat(F.lit(" turn heading "), V.spelled(F.col("heading")))).otherwise(F.lit(" turn"))
    level = F.when(V.draw("t1f", F.col("row_idx")) >= 0.1, F.concat(F.lit(" climb flight level "), V.spelled(F.col("level")))).otherwise(F.lit(" climb"))
    a = a.select("row_idx", F.col("text").alias("reference"), F.concat(F.lit("csa "), V.spelled(F.col("ident")), heading, level).alias("hypothesis"))
    return wer.wer_counts(a).select("row_idx", F.lit("t1").alias("teacher"), "ref_words", F.size(T.words(T.normalize_atc(F.col("hypothesis")))).cast("long").alias("words"))


@query("GATE-2", V.with_sql(*TEACHERS, select="select row_idx, type, value, row_idx not in (select row_idx from t2_dots) or type <> 'flight_level' as asserted from t2_all"))
def gate2(spark, sf_dir):
    a = G.teacher_slots(calls(spark, sf_dir), {"t2": "t2"}, AIRLINES).select("row_idx", F.col("teachers")[0].alias("t"))
    each = F.transform("t.entities", lambda e: F.struct(e["type"], e["value"], (G.times(F.col("t.asserted"), e) > 0).alias("asserted")))
    return a.select("row_idx", F.inline(each))


@query("GATE-3", V.with_sql(*TEACHERS, VERDICTS, select="select * from judged"))
def gate3(spark, sf_dir):
    def told(v: Column) -> Column:
        heard = F.transform(v["heard"], lambda x: F.concat(x["teacher"], F.lit(" "), F.array_join(x["values"], " ")))
        return F.struct(v["type"], v["value"], F.array_join(v["verified_by"], ",").alias("verified_by"), v["verdict"], F.array_join(heard, ",").alias("heard"))

    # of the transformed array Spark infers no filter, which would work the verdicts out once more
    return gated(spark, sf_dir).select("row_idx", F.inline(F.transform("verdicts", told)))


@query("GATE-4", V.with_sql(V.ATC, select=f"""select row_idx, (a > 2)::int + (b > 2)::int as loud, a > 2 and b > 2 as rejected from (select row_idx, floor({V.draw_sql("'na'", 'row_idx')} * 5) as a, floor({V.draw_sql("'nb'", 'row_idx')} * 5) as b from atc)"""))
def gate4(spark, sf_dir):
    a = V.radio(spark, sf_dir).select("row_idx")
    part = lambda n: a.withColumns({"teacher": F.lit(n), "words": F.floor(V.draw(n, F.col("row_idx")) * 5)})
    return G.noise_verdict(part("na").unionByName(part("nb"))).select("row_idx", F.col("loud").cast("int").alias("loud"), "rejected")


TOTALS = f"""totals as (select b.row_idx, count(*) filter (verdict = 'verified') as verified, count(*) filter (verdict = 'substituted') as critical_substituted, count(type) as critical_total
  from base b left join (select * from judged where type not in {UNCRITICAL}) j on j.row_idx = b.row_idx group by 1),
gate_rows as (select *, case when critical_total > 0 then verified / critical_total else 1.0 end as recall, least(w1, w2) as best_wer, case when w1 <= w2 then 't1' else 't2' end as best_teacher, row_idx % 29 <> 0 as audio_ok
  from (select *, {V.draw_sql("'wa'", 'row_idx')} as w1, {V.draw_sql("'wb'", 'row_idx')} as w2 from totals)),
tiered as (select *, case when not audio_ok or critical_substituted > 0 or best_wer > 0.9 or (best_wer > 0.5 and recall < 0.5) then 'rejected' when best_wer <= 0.25 and recall >= 0.5 then 'gold' when best_wer <= 0.5 then 'silver' else 'adversarial' end as tier from gate_rows)"""


def gate_rows(spark, sf_dir):
    return G.with_best_teacher(gated(spark, sf_dir)).withColumn("audio_ok", F.col("row_idx") % 29 != 0)


@query("GATE-5", V.with_sql(*TEACHERS, VERDICTS, TOTALS, select="select row_idx, recall, critical_total, critical_substituted, best_teacher, best_wer, tier from tiered"))
def gate5(spark, sf_dir):
    return G.tier_rows(gate_rows(spark, sf_dir)).select("row_idx", "recall", "critical_total", "critical_substituted", "best_teacher", "best_wer", "tier")


@query("GATE-6", V.with_sql(*TEACHERS, VERDICTS, TOTALS, select="""select config, case when not audio_ok or critical_substituted > 0 or best_wer > c.ceiling or (best_wer > c.silver and recall < c.need) then 'rejected' when best_wer <= c.gold and recall >= c.need then 'gold'
  when best_wer <= c.silver then 'silver' else 'adversarial' end as tier, count(*) as n from gate_rows, (values ('a', 0.25, 0.5, 0.9, 0.5), ('b', 0.1, 0.3, 0.8, 1.0)) c(config, gold, silver, ceiling, need) group by 1, 2"""))  # fmt: skip
def gate6(spark, sf_dir):
    configs = spark.createDataFrame([("a", 0.25, 0.5, 0.9, 0.5), ("b", 0.1, 0.3, 0.8, 1.0)], "config string, gold double, silver double, ceiling double, recall double")
    return G.retier(gate_rows(spark, sf_dir), configs)


@query("AGG-6", V.with_sql(*TEACHERS, VERDICTS, TOTALS, select="""select part, value, count(*) as n, count(*) / (select count(*) from tiered) as share, avg(wer) as mean, quantile_cont(wer, 0.1) as p10, quantile_cont(wer, 0.5) as p50, quantile_cont(wer, 0.9) as p90
  from (select 'tier' as part, tier as value, null::double as wer from tiered union all select 'reason', 'audio', null from tiered where not audio_ok
  union all select 'reason', 'critical_substitution', null from tiered where critical_substituted > 0 union all select 'reason', 'teacher_wer_above_ceiling', null from tiered where best_wer > 0.9
  union all select 'reason', 'low_recall', null from tiered where best_wer <= 0.9 and best_wer > 0.5 and recall < 0.5 union all select 'best_teacher', best_teacher, null from tiered
  union all select 'teacher_wer', 't1', w1 from tiered union all select 'teacher_wer', 't2', w2 from tiered union all select 'teacher_wer', 'best', best_wer from tiered) group by 1, 2"""))  # fmt: skip
def agg6(spark, sf_dir):
    return G.gate_stats(G.tier_rows(gate_rows(spark, sf_dir)))


@query("AGG-7", V.with_sql(*TEACHERS, VERDICTS, select="""select coalesce(type, 'all') as type, count(*) as n, count(*) filter (verdict = 'verified') as verified, count(*) filter (verdict = 'substituted') as substituted, count(*) filter (verdict = 'missed') as missed,
  count(*) filter (verdict = 'verified') / count(*) as rate from judged group by rollup (type)"""))  # fmt: skip
def agg7(spark, sf_dir):
    return G.entity_recovery(gated(spark, sf_dir))


@query("WIN-11", V.with_sql(V.ATC, select=f"select row_idx, case when a <= b then 'wa' else 'wb' end as best_teacher, least(a, b) as best_wer from (select row_idx, {V.draw_sql(chr(39) + 'wa' + chr(39), 'row_idx')} as a, {V.draw_sql(chr(39) + 'wb' + chr(39), 'row_idx')} as b from atc)"))
def win11(spark, sf_dir):
    a = V.radio(spark, sf_dir).select("row_idx")
    part = lambda n, o: a.withColumns({"teacher": F.lit(n), "ord": F.lit(o), "wer": V.draw(n, F.col("row_idx"))})
    return G.best_teacher(part("wa", 0).unionByName(part("wb", 1)))


SCORED = """scored as (select coalesce(s.row_idx, h.row_idx) as row_idx, coalesce(s.type, h.type) as type, s.value as ref_value, h.value as hyp_value from call_slots s full join t1_said h on h.row_idx = s.row_idx and h.type = s.type),
counts as (select row_idx, type, (ref_value = hyp_value)::int::bigint as tp, 0::bigint as fp, 0::bigint as fn, (ref_value <> hyp_value)::int::bigint as sub from scored where ref_value is not null and hyp_value is not null
  union all select row_idx, type, 0, (ref_value is null)::int, (hyp_value is null)::int, 0 from scored where ref_value is null or hyp_value is null)"""


@query("ENT-1", V.with_sql(*TEACHERS, SCORED, select="select * from counts"))
def ent1(spark, sf_dir):
    return G.score_entities(panel(spark, sf_dir)).select("row_idx", F.inline("scores"))


@query("ENT-2", V.with_sql(*TEACHERS, SCORED, select="""select coalesce(type, 'all') as type, case when sum(tp + fp + sub) > 0 then sum(tp) / sum(tp + fp + sub) end as precision, case when sum(tp + fn + sub) > 0 then sum(tp) / sum(tp + fn + sub) end as recall,
  case when sum(2 * tp + fp + fn + 2 * sub) > 0 then 2 * sum(tp) / sum(2 * tp + fp + fn + 2 * sub) end as f1, sum(tp + fn + sub)::bigint as support
  from counts where row_idx in (select row_idx from call_slots) group by rollup (type)"""))  # fmt: skip
def ent2(spark, sf_dir):
    return G.entity_panel(G.score_entities(panel(spark, sf_dir)))


@query("ENT-3", V.with_sql(*TEACHERS, SCORED, select="select row_idx, type, ref_value, hyp_value, case when ref_value is null then 'spurious' when hyp_value is null then 'missed' else 'substituted' end as outcome from scored where ref_value is null or hyp_value is null or ref_value <> hyp_value"))
def ent3(spark, sf_dir):
    return G.entity_diff(panel(spark, sf_dir)).select("row_idx", F.inline("diff")).select("row_idx", "type", "ref_value", "hyp_value", "outcome")


@query("TOP-1", V.with_sql(*TEACHERS, SCORED, select="select b.row_idx, coalesce(sum(sub), 0)::bigint as sub, coalesce(sum(fn + fp), 0)::bigint as other from base b left join counts c on c.row_idx = b.row_idx group by 1 order by 2 desc, 3 desc, 1 limit 20"))
def top1(spark, sf_dir):
    return G.worst_examples(G.score_entities(panel(spark, sf_dir)), 20)
