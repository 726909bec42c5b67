"""Queries of text functions and word error rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.functions import text as T
from cliploom.functions.entities import extract_entities
from cliploom.operators import wer
from cliploom.plans import views as V
from cliploom.plans.registry import query

CLIP_PARTS = r"""
parts as (select *, regexp_extract(clip_id, '^(.+)_[0-9]{8}_[0-9]{6}$', 1) as s, try_strptime(nullif(regexp_extract(clip_id, '_([0-9]{8}_[0-9]{6})$', 1), ''), '%Y%m%d_%H%M%S') as t from clips)"""


@query("FN-1", V.with_sql(V.CLIPS, CLIP_PARTS, select="select row_idx, case when s = '' then 'unknown' else s end as parsed from parts"))
def fn1(spark, sf_dir):
    return V.clips(spark, sf_dir).select("row_idx", T.parse_station(F.col("clip_id")).alias("parsed"))


@query("FN-2", V.with_sql(V.CLIPS, CLIP_PARTS, select="select row_idx, strftime(t, '%Y-%m-%d %H:%M:%S') as ts from parts"))
def fn2(spark, sf_dir):
    return V.clips(spark, sf_dir).select("row_idx", F.date_format(T.parse_capture_ts(F.col("clip_id")), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("FN-3", V.with_sql(V.CLIPS, CLIP_PARTS, select="""select row_idx, strftime(t, '%Y%m%d') as day, case when t is null then 'unknown' when hour(t) < 4 then '00-03'
  when hour(t) < 12 then '04-11' when hour(t) < 16 then '12-15' when hour(t) < 20 then '16-19' else '20-23' end as block from parts"""))  # fmt: skip
def fn3(spark, sf_dir):
    c = F.col("clip_id")
    return V.clips(spark, sf_dir).select("row_idx", T.capture_day(c).alias("day"), T.hour_block(c).alias("block"))


@query("FN-4", "select doc_id as row_idx, case when n_chars / 100.0 < 3 then '<3s' when n_chars / 100.0 < 6 then '3-6s' else '>6s' end as band from documents")
def fn4(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), T.duration_band(F.col("n_chars") / 100.0).alias("band"))


def normalize_sql(c: str) -> str:
    digits = "[" + ", ".join(f"'{v}'" for v in T.DIGITS.values()) + "]"
    fold = "case w " + " ".join(f"when '{k}' then '{v}'" for k, v in T.FOLD.items()) + " else w end"
    tokens = rf"list_filter(regexp_split_to_array(regexp_replace(replace(lower({c}), '-', ' '), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '\s+'), lambda t: t <> '')"
    apart = f"flatten(list_transform({tokens}, lambda t: case when regexp_matches(t, '[0-9]') then list_transform(string_split(t, ''), lambda x: case when x between '0' and '9' then ({digits})[x::int + 1] else x end) else [t] end))"
    return f"coalesce(array_to_string(list_transform({apart}, lambda w: {fold}), ' '), '')"


@query("FN-5", f"select doc_id as row_idx, md5({normalize_sql('text')}) as normalized from documents")
def fn5(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.md5(T.normalize_atc(F.col("text"))).alias("normalized"))


@query("FN-6", r"select doc_id as row_idx, md5(trim(regexp_replace(translate(text, ',.!?;:', ''), '\s+', ' ', 'g'))) as form from documents")
def fn6(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.md5(T.transcript_form(F.col("text"))).alias("form"))


TOKENS = r"""
found as (select doc_id as row_idx, list_transform(regexp_extract_all(replace(lower(text), '-', ' '), '[0-9]+(?:\.[0-9]+)?(?:st|nd|rd|th)?|[a-z]+'),
  lambda t: regexp_replace(t, '^([0-9.]+)(st|nd|rd|th)$', '\1')) as t from documents)"""


@query("FN-8", V.with_sql(TOKENS, select="""select row_idx, len(y) as n, md5(array_to_string(y, ' ')) as tokens from (
  select row_idx, list_filter(list_transform(t, lambda x, i: case when x = 'x' and t[i + 1] = 'ray' then 'xray' when x = 'ray' and i > 1 and t[i - 1] = 'x' then null else x end), lambda x: x is not null) as y from found)"""))  # fmt: skip
def fn8(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), T.tokenize_spoken(F.col("text")).alias("t"))
    return d.select("row_idx", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query("FN-9", V.with_sql(V.ATC, select=f"""select row_idx, {V.spelled_sql("ident")} as spelled,
  (['zero','one','two','three','four','five','six','seven','eight','nine'])[(ident[1])::int + 1] || ' ' || case when ident[2] = '1' then (['ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'])[(ident[3])::int + 1]
   when ident[2] = '0' then 'zero ' || (['zero','one','two','three','four','five','six','seven','eight','nine'])[(ident[3])::int + 1]
   else (['','','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'])[(ident[2])::int + 1] || case when ident[3] = '0' then '' else ' ' || (['zero','one','two','three','four','five','six','seven','eight','nine'])[(ident[3])::int + 1] end end as grouped,
  {V.spelled_sql("(level::int // 10)::varchar")} || ' thousand' || case when level::int % 10 > 0 then ' ' || {V.spelled_sql("(level::int % 10)::varchar")} || ' hundred' else '' end as feet
  from atc"""))  # fmt: skip
def fn9(spark, sf_dir):
    a = V.radio(spark, sf_dir)
    return a.select("row_idx", T.digits_to_words(F.col("ident")).alias("spelled"), T.group_number_words(F.col("ident")).alias("grouped"), T.feet_to_words(F.col("level").cast("int") * 100).alias("feet"))


@query("FN-11", V.with_sql(V.ATC, select="""select row_idx, kind, value, case
    when kind = 'heading' and not value::int between 1 and 360 then 'out_of_range'
    when kind = 'flight_level' and not substr(value, 3)::int between 10 and 450 then 'out_of_range'
    when kind = 'altitude' and not replace(value, 'ft', '')::int between 100 and 45000 then 'out_of_range'
    when kind = 'altitude' and replace(value, 'ft', '')::int % 100 <> 0 then 'bad_step'
    when kind = 'speed' and not value::int between 60 and 350 then 'out_of_range'
    when kind = 'gate' then 'unknown_type' end as problem from (
  select row_idx, unnest(['heading', 'flight_level', 'altitude', 'speed', 'gate']) as kind,
    unnest([heading, 'FL' || level, (level::int * 125)::varchar || 'ft', ident, ident]) as value from atc)"""))  # fmt: skip
def fn11(spark, sf_dir):
    a = V.radio(spark, sf_dir)
    pair = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    level = F.col("level").cast("int") * 125
    slots = F.array(pair("heading", F.col("heading")), pair("flight_level", F.concat(F.lit("FL"), "level")), pair("altitude", F.concat(level.cast("string"), F.lit("ft"))), pair("speed", F.col("ident")), pair("gate", F.col("ident")))
    a = a.select("row_idx", F.explode(slots).alias("s")).select("row_idx", "s.*")
    return a.withColumn("problem", T.check_value(F.col("kind"), F.col("value")))


SPOKEN = "spoken as (select row_idx, category, source, duration, " + ", ".join(f"list_filter(string_split({normalize_sql(c)}, ' '), lambda x: x <> '') as {n}" for c, n in (("reference", "r"), ("hyp_a", "a"), ("hyp_b", "b"))) + " from utt)"
REP = (
    SPOKEN
    + r""",
wn as (select row_idx, b as w, r, a as ha from spoken),
grams as (select *, case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) end as g from wn)"""
)


@query("FN-17", V.with_sql(V.UTT, REP, select="""select row_idx, case when len(w) = 0 then 0.0 else greatest(0.0, (list_max(map_values(list_histogram(w))) / len(w) - 0.5) / 0.5,
  coalesce(1.0 - len(list_distinct(g)) / len(g), 0.0)) end as repetition from grams"""))  # fmt: skip
def fn17(spark, sf_dir):
    return V.utterances(spark, sf_dir).select("row_idx", T.repetition_ratio(F.col("hyp_b")).alias("repetition"))


@query("FN-18", V.with_sql(V.UTT, REP, select="select row_idx, least(greatest(0.0, abs(len(ha) - len(r)) / greatest(len(r), 1) - 0.3), 2.0) as deviation from wn"))
def fn18(spark, sf_dir):
    return V.utterances(spark, sf_dir).select("row_idx", T.length_deviation(F.col("reference"), F.col("hyp_a")).alias("deviation"))


def edits_sql(a: str, b: str) -> str:
    """Word edits of the views' hypotheses: a word of hyp_b is replaced by one that no text has, hyp_a only leaves words out."""
    return f"(case when len({a}) = len({b}) then len(list_filter(list_zip({a}, {b}), lambda p: p[1] <> p[2])) else abs(len({a}) - len({b})) end)"


EDITS = rf"""{SPOKEN},
edits as (select row_idx, category, source, duration, len(r) as ref_words, {edits_sql("r", "a")} as errors_a, {edits_sql("r", "b")} as errors_b from spoken)"""


def counted(spark, sf_dir, side="hyp_b"):
    return wer.wer_counts(V.utterances(spark, sf_dir).withColumn("hypothesis", F.col(side)))


@query("FN-19", V.with_sql(V.UTT, REP, f"edited as (select row_idx, {edits_sql('r', 'w')} as e from grams)", select="""select g.row_idx, case when len(r) = 0 then case when len(w) > 0 then -1.0 else 0.0 end else
  -(least(e / len(r), 2.0) + 0.5 * case when len(w) = 0 then 0.0 else greatest(0.0, (list_max(map_values(list_histogram(w))) / len(w) - 0.5) / 0.5, coalesce(1.0 - len(list_distinct(g.g)) / len(g.g), 0.0)) end
  + 0.25 * least(greatest(0.0, abs(len(w) - len(r)) / greatest(len(r), 1) - 0.3), 2.0)) end as score from grams g join edited using (row_idx)"""))  # fmt: skip
def fn19(spark, sf_dir):
    d = counted(spark, sf_dir)
    ref, hyp = F.col("reference"), F.col("hyp_b")
    loud = F.when(F.size(T.words(hyp)) > 0, -1.0).otherwise(0.0)
    total = -(F.least(F.col("errors") / F.col("ref_words"), F.lit(2.0)) + 0.5 * T.repetition_ratio(hyp) + 0.25 * T.length_deviation(ref, hyp))
    return d.select("row_idx", F.when(F.col("ref_words") == 0, loud).otherwise(total).alias("score"))


@query("FN-20", f"""select event_id as row_idx, case when t >= 0.5 then 'dropped' when s <= 0.2 then 'spillover' when s >= 1.0 then 'spillover' else 'selected' end as route,
  case when t >= 0.5 then 'teacher_untrusted' when s <= 0.2 then 'too_easy' when s >= 1.0 then 'too_hard' else 'in_window' end as reason
  from (select event_id, {V.draw_sql("'t'", "event_id")} * 1.5 as t, {V.draw_sql("'s'", "event_id")} * 1.5 as s from events)""")  # fmt: skip
def fn20(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_idx"), (V.draw("t", F.col("event_id")) * 1.5).alias("t"), (V.draw("s", F.col("event_id")) * 1.5).alias("s"))
    return e.select("row_idx", T.hardness_route(F.col("t"), F.col("s"), 0.5, 0.2, 1.0).alias("r")).select("row_idx", "r.route", "r.reason")


#: Paths under the new prefix, and whether the listing, which has every second clip, lacks them.
@query("FN-21", V.with_sql(V.CLIPS, "moved as (select row_idx, case when row_idx % 3 = 0 then '/data/new/' || clip_id || '.wav' else 'E:/other/' || clip_id || '.wav' end as path from clips)",
  select="select path, count(*) as n, not bool_or(row_idx % 3 = 0 and row_idx % 2 = 0) as missing from moved group by 1"))
def fn21(spark, sf_dir):
    from cliploom.operators import joins as J

    c, i = V.clips(spark, sf_dir), F.col("row_idx")
    old = F.when(i % 3 == 0, F.concat(F.lit("C:\\corpus\\\\old/"), "clip_id", F.lit(".wav"))).otherwise(F.concat(F.lit("E:\\other\\"), "clip_id", F.lit(".wav")))
    moved = J.relocate_paths(c.select("row_idx", old.alias("audio")), "C:/corpus/old", "/data/new", ["audio"])
    listing = c.where((i % 2 == 0) & (i % 3 == 0)).select(F.concat(F.lit("/data/new/"), "clip_id", F.lit(".wav")).alias("path"))
    gone = J.missing_targets(moved, listing, ["audio"]).select("path", F.lit(True).alias("missing"))
    return moved.groupBy(F.col("audio").alias("path")).agg(F.count(F.lit(1)).alias("n")).join(gone, "path", "left").select("path", "n", F.coalesce("missing", F.lit(False)).alias("missing"))


@query("FN-22", """select row_idx, substr(sha256('{"category":"' || category || '","ident":"' || ident || '","row_idx":' || row_idx || '}'), 1, 16) as fingerprint from (""" + V.with_sql(V.ATC, select="select * from atc") + ")")
def fn22(spark, sf_dir):
    return V.radio(spark, sf_dir).select("row_idx", T.row_fingerprint("row_idx", "ident", "category", size=16).alias("fingerprint"))


@query("WER-1", V.with_sql(V.UTT, EDITS, select="select row_idx, ref_words, errors_b as errors from edits"))
def wer1(spark, sf_dir):
    return counted(spark, sf_dir).select("row_idx", "ref_words", "errors")


SLICED = "count(*) as n_rows, sum(errors_b)::bigint as errors, sum(ref_words)::bigint as ref_words, sum(errors_b) / sum(ref_words) as wer from edits where ref_words > 0"


@query("WER-2", V.with_sql(V.UTT, EDITS, select=f"select {SLICED}"))
def wer2(spark, sf_dir):
    return wer.corpus_wer(counted(spark, sf_dir))


BAND = "case when duration < 3 then '<3s' when duration < 6 then '3-6s' else '>6s' end"


BLOCK = "case when row_idx % 24 < 4 then '00-03' when row_idx % 24 < 12 then '04-11' when row_idx % 24 < 16 then '12-15' when row_idx % 24 < 20 then '16-19' else '20-23' end"
CALLED = "called as (select *, row_idx % 7 = 0 as has_call from (select row_idx, category, source, duration, errors_b, ref_words + case when row_idx % 7 = 0 then 3 else 0 end as ref_words from edits))"


#: Every seventh text ends with a callsign, as its hypothesis does; names of clips give the hour.
@query("WER-3", V.with_sql(V.UTT, EDITS, CALLED, select=" union all ".join(f"select {s} as slice, {v} as value, {SLICED.replace('from edits', 'from called')} {g}" for s, v, g in [
  ("'all'", "'all'", ""), *((f"'{n}'", v, f"group by {v}") for n, v in (("category", "category"), ("source", "source"), ("band", BAND), ("hour", BLOCK), ("callsign", "case when has_call then 'with' else 'without' end")))])))
def wer3(spark, sf_dir):
    i = F.col("row_idx")
    tail = F.when(i % 7 == 0, " csa one two").otherwise("")
    u = V.utterances(spark, sf_dir).withColumns({"reference": F.concat("reference", tail), "hypothesis": F.concat("hyp_b", tail)})
    u = u.withColumn("clip_id", F.concat(F.lit("KX_20240101_"), F.lpad((i % 24).cast("string"), 2, "0"), F.lit("0000.wav")))
    has_call = F.exists(extract_entities({"csa": "CSA"})(F.col("reference")), lambda e: e["type"] == "callsign")
    d = wer.wer_counts(u.withColumns({"band": T.duration_band(F.col("duration")), "hour": T.hour_block(F.col("clip_id")), "callsign": F.when(has_call, "with").otherwise("without")}))
    return wer.wer_slices(d, ["category", "source", "band", "hour", "callsign"])


@query("WER-4", V.with_sql(V.UTT, EDITS, select="""select sum(least(e, ref_words)) / sum(ref_words) as wer, count(*) filter (e > ref_words) as capped_rows, sum(e - least(e, ref_words))::bigint as discarded_errors
  from (select ref_words, errors_b * 8 as e from edits where ref_words > 0)"""))  # fmt: skip
def wer4(spark, sf_dir):
    return wer.bounded_wer(counted(spark, sf_dir).withColumn("errors", F.col("errors") * 8))


@query("WER-5", V.with_sql(V.UTT, select="""select count(*) as n_empty, count(*) filter (row_idx % 2 = 0) as n_loud, count(*) filter (row_idx % 2 = 0) / count(*) as rate from utt where reference = ''"""))
def wer5(spark, sf_dir):
    u = V.utterances(spark, sf_dir)
    return wer.hallucination_rate(u.withColumn("hypothesis", F.when(F.col("row_idx") % 2 == 0, "roger").otherwise("")))


@query("WER-6", V.with_sql(V.UTT, EDITS, "g as (select source, sum(errors_b) / sum(ref_words) as wer from edits where ref_words > 0 group by source)", select="""select avg(wer) as macro_wer, count(*) as n_groups,
  (select source from g order by wer desc, source limit 1) as worst, max(wer) as worst_wer from g"""))  # fmt: skip
def wer6(spark, sf_dir):
    return wer.macro_wer(counted(spark, sf_dir), "source")


@query("STA-3", None)
def sta3(spark, sf_dir):
    return wer.paired_bootstrap(wer.pair_counts(V.utterances(spark, sf_dir), "hyp_a", "hyp_b"))


@query("STA-11", V.with_sql(V.UTT, EDITS, select="""select row_idx, case when sd > 1e-6 then (reward - m) / sd else 0.0 end as advantage, sd > 1e-6 as used from (
  select row_idx, -errors_b / ref_words as reward, avg(-errors_b / ref_words) over w as m, stddev_pop(-errors_b / ref_words) over w as sd from edits where ref_words > 0 window w as (partition by source))"""))  # fmt: skip
def sta11(spark, sf_dir):
    from cliploom.operators.stats import group_advantages

    d = counted(spark, sf_dir).where("ref_words > 0").select("row_idx", "source", (-F.col("errors") / F.col("ref_words")).alias("reward"))
    return group_advantages(d, "source").select("row_idx", "advantage", "used")
