"""Queries that write driver rows and read them back by the readers, and queries of waveforms and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.functions import text as T
from cliploom.functions import waveform as W
from cliploom.functions.register import register_functions
from cliploom.operators.ingest import ingest_clips
from cliploom.plans import views as V
from cliploom.plans.registry import query
from cliploom.sources import readers as R
from cliploom.sources import writers as O
from cliploom.sources.shared import scratch


#: Relative audio is resolved against the folder of the manifest; keys that rows lack are null.
@query("SRC-1", V.with_sql(V.ATC, select="""select row_idx, text, case when row_idx % 4 > 0 then kind end as kind, category, null::varchar as text_display,
  case when row_idx % 3 = 0 then '/abs/a' || row_idx || '.wav' else 'DIR/sub/a' || row_idx || '.wav' end as audio from atc"""))  # fmt: skip
def src1(spark, sf_dir):
    path, name = scratch(spark, "manifest"), F.concat(F.lit("a"), F.col("row_idx").cast("string"), F.lit(".wav"))
    audio = F.when(F.col("row_idx") % 3 == 0, F.concat(F.lit("/abs/"), name)).otherwise(F.concat(F.lit("sub/"), name))
    kind = F.when(F.col("row_idx") % 4 > 0, F.col("kind"))
    V.radio(spark, sf_dir).select("row_idx", "text", kind.alias("kind"), "category", audio.alias("audio"), F.lit("{}").alias("gen")).write.json(path)
    m = R.read_manifest(spark, path, training=True)
    if {"gen", "lineage", "gate"} & set(m.columns):
        raise ValueError("training rows have free-form columns")
    return m.select("row_idx", "text", "kind", "category", "text_display", F.regexp_replace("audio", "^.*/manifest-[0-9a-f]+/", "DIR/").alias("audio"))


@query("SRC-2", "select doc_id::varchar as audio, case when doc_id % 33 = 0 then '' else md5(text) end as text from documents")
def src2(spark, sf_dir):
    path = scratch(spark, "corpus")
    d = V.table(spark, sf_dir, "documents")
    d.select(F.col("doc_id").cast("string").alias("file"), F.when(F.col("doc_id") % 33 == 0, "").otherwise(F.md5("text")).alias("transcript")).write.json(path)
    return R.read_labeled_corpus(spark, path, "json")


@query("SRC-3", "select doc_id || '.wav' as audio, md5(text) as text, coalesce(toxic, 0) = 1 as suspect, case when doc_id % 2 = 0 then 'train' else 'test' end as half from documents left join labels using (doc_id)")
def src3(spark, sf_dir):
    path = scratch(spark, "snapshot")
    d = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    d = d.select("doc_id", F.concat(F.lit("clips/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("audio"), F.md5("text").alias("text"), F.when(F.col("toxic") == 1, "True").otherwise("False").alias("suspect"))
    for half, rest in (("train", 0), ("test", 1)):
        d.where(f"doc_id % 2 = {rest}").drop("doc_id").write.option("header", True).csv(f"{path}/{half}")
    return R.read_versioned_snapshot(spark, {h: f"{path}/{h}" for h in ("train", "test")}).select("audio", "text", "suspect", "half")


#: Scenes over many lines each, some of them side by side in a line; the second message is blank.
@query("SRC-4", """select coalesce(lang, 'unknown') as kind, 'unknown' as role, 'routine' as category, md5(text) || ' "}{" \\' as text, 1.0::double as weight from documents
  union all select coalesce(lang, 'unknown'), 'atc', 'taxi', doc_id::varchar, 1.0 from documents where doc_id % 5 = 0""")  # fmt: skip
def src4(spark, sf_dir):
    path = scratch(spark, "scenes")
    message = lambda text, speaker=None, category=None: F.struct(text.alias("text"), F.lit(speaker).cast("string").alias("speaker"), F.lit(category).cast("string").alias("category"))
    first = message(F.concat(F.md5("text"), F.lit(' "}{" \\ ')))
    id_text = message(F.when(F.col("doc_id") % 5 == 0, F.col("doc_id").cast("string")).otherwise(" "), "atc", "taxi")
    json = F.to_json(F.struct(F.col("lang").alias("airport_ident"), F.array(first, id_text).alias("messages")), {"pretty": "true"})
    json = F.when(F.col("doc_id") % 3 == 0, F.concat(json, F.lit(" "), F.lit('{"messages": []}'), F.lit("{}"))).otherwise(json)
    V.table(spark, sf_dir, "documents").select(json).write.text(path)
    return R.read_scenes(spark, path)


@query("SRC-5", "select distinct 'old' || doc_id % 400 as old, 'clip' || doc_id % 400 as new from documents")
def src5(spark, sf_dir):
    path = scratch(spark, "renames")
    n = (F.col("doc_id") % 400).cast("string")
    V.table(spark, sf_dir, "documents").select(F.concat(F.lit("RENAME [0000] old"), n, F.lit(" -> clip"), n)).write.text(path)
    return R.read_rename_log(spark, path)


def clip_files(spark, sf_dir, plain=False):
    """A folder of a WAV file for each vector: some unreadable, empty, all alike or silent; pairs share a base name."""
    path, i = scratch(spark, "clips"), F.col("vec_id")
    v = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scale = F.when(i % 29 == 0, 0.01).otherwise(1.0)
    pcm = F.transform("embedding", lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(x.cast("double") * scale * 32768 + 0.5))).cast("int"))
    pcm = F.when(i % 50 == 0, F.array().cast("array<int>")).when(i % 25 == 0, F.transform("embedding", lambda x: F.lit(3000))).otherwise(pcm)
    half = F.floor(i / 2).cast("string")
    name = F.concat(F.lit("d"), (i % 2).cast("string"), F.lit("/ST"), (F.floor(i / 2) % 4).cast("string"), F.lit("_20240101_"), F.lpad(half, 6, "0"), F.lit(".wav"))
    rate, channels = (F.lit(16000), F.lit(1)) if plain else (F.when(i % 3 == 0, 8000).otherwise(16000), 1 + i % 2)
    content = F.when(i % 37 == 0, F.lit("no clip").cast("binary")).otherwise(O.wav_bytes(pcm, rate, channels))
    O.write_files(v.select(name.alias("name"), content.alias("content")), path)
    return path


WAVS = """
scaled as (select vec_id, embedding, case when vec_id % 29 = 0 then 0.01 else 1.0 end::double as scale from embeddings),
wavs as (select vec_id, 1 + vec_id % 2 as channels, case when vec_id % 3 = 0 then 8000 else 16000 end as sr, 'ST' || ((vec_id // 2) % 4) as station,
  'ST' || ((vec_id // 2) % 4) || '_20240101_' || lpad((vec_id // 2)::varchar, 6, '0') as stem, 'd' || (vec_id % 2) as folder,
  case when vec_id % 50 = 0 then []::int[] when vec_id % 25 = 0 then list_transform(embedding, lambda x: 3000::int)
    else list_transform(embedding, lambda x: greatest(-32768, least(32767, floor(x::double * scale * 32768 + 0.5)))::int) end as pcm,
  case when vec_id % 37 = 0 then 'unreadable' when vec_id % 50 = 0 then 'zero_length' end as problem from scaled)"""


def clip_name(c):
    return F.regexp_extract(c, r"([^/]*/[^/]*)$", 1).alias("clip")


#: Sums of samples in units of 1 / 65536, which are whole also where two channels are mixed.
@query("SRC-6", V.with_sql(WAVS, select="""select folder || '/' || stem || '.wav' as clip, problem, case when problem is null or problem <> 'unreadable' then sr end as sr,
  case when problem is null or problem <> 'unreadable' then channels end as channels, case when problem is null then len(pcm) // channels end as n,
  case when problem is null then list_sum(pcm)::bigint * 2 // channels end as total from wavs"""))  # fmt: skip
def src6(spark, sf_dir):
    c = R.read_clips(spark, clip_files(spark, sf_dir))
    x = F.when(F.col("problem").isNull(), F.col("samples"))
    total = F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")) * 65536).cast("long")
    return c.select(clip_name("path"), "problem", "sr", "channels", F.size(x).alias("n"), total.alias("total"))


#: Of clips at 8 kHz every other sample at 16 kHz is one of theirs.
@query("WAV-1", V.with_sql(WAVS, select="""select folder || '/' || stem || '.wav' as clip, sr = 8000 as resampled, channels = 2 as mixed, (len(pcm) // channels) * (16000 // sr) as n,
  list_sum(pcm)::bigint * 2 // channels as total from wavs where problem is null"""))  # fmt: skip
def wav1(spark, sf_dir):
    c = W.to_mono_16k(R.read_clips(spark, clip_files(spark, sf_dir)).where("problem is null"))
    own = F.filter("samples", lambda v, i: ~F.col("resampled") | (i % 2 == 0))
    total = F.round(F.aggregate(own, F.lit(0.0), lambda a, v: a + v.cast("double")) * 65536).cast("long")
    return c.select(clip_name("path"), "resampled", "mixed", F.size("samples").alias("n"), total.alias("total"))


@query("WAV-5", V.with_sql(WAVS, f"""
firsts as (select *, row_number() over (partition by problem, pcm order by folder, stem) as copy, list_max(list_transform(pcm, lambda x: abs(x))) as top from wavs),
judged as (select *, coalesce(problem, case when copy > 1 then 'duplicate' when top / 32768.0 < 0.015 then 'silence_only' end) as reason from firsts),
named as (select folder, stem, stem || case when row_number() over w > 1 then '_' || row_number() over w else '' end as clip_id, station from judged where reason is null window w as (partition by stem order by folder)),
split as (select *, row_number() over (partition by station order by {V.order('ingest', 'clip_id')}, clip_id) as r, count(*) over (partition by station) as many from named)""",
  select="""select folder || '/' || stem || '.wav' as clip, station, reason, clip_id,
  case when reason is null then top end as top, case when reason is null then 0.004::double end as duration,
  case when clip_id is null then null when r <= case when many > 1 then least(greatest(round_even(many * 0.15, 0), 1), many - 1) else 0 end then 'holdout' else 'train' end as split
  from judged left join (select folder, stem, clip_id, r, many from split) using (folder, stem)"""))  # fmt: skip
def wav5(spark, sf_dir):
    c = ingest_clips(R.read_clips(spark, clip_files(spark, sf_dir, plain=True)), scratch(spark, "ingested"))
    top = F.round(F.col("peak") * 32768).cast("long")
    return c.select(clip_name("path"), "station", "reason", "clip_id", top.alias("top"), "duration", "split")


def clips64(spark, sf_dir):
    return V.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"), F.lit(64).alias("sr"))


@query("WAV-6", None)
def wav6(spark, sf_dir):
    return W.noise_segments(clips64(spark, sf_dir), "vec_id", "samples", "sr", 8, 4, 0.1)


#: Every 8 samples a frame; frames over 35 dB below the loudest go from both ends.
@query("WAV-9", """with s as (select vec_id, i - 1 as t, embedding[i]::double * case when (i - 1) // 8 in (0, vec_id % 4, 7 - vec_id % 3) then 0.001 else 1 end as x from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)),
f as (select vec_id, t // 8 as f, sqrt(avg(x * x)) as rms from s group by 1, 2), m as (select vec_id, max(rms) * pow(10, -35 / 20.0) as least from f group by 1),
k as (select vec_id, min(f) as a, max(f) as b from f join m using (vec_id) where rms >= least group by 1), y as (select s.vec_id, t, x from s join k on s.vec_id = k.vec_id and t // 8 between a and b),
g as (select vec_id, least(pow(10, -26 / 20.0) / sqrt(avg(x * x)), 0.99 / max(abs(x))) as gain from y group by 1)
select vec_id, count(*)::int as n, sum(x * gain) as total, max(abs(x * gain)) as peak from y join g using (vec_id) group by 1""")
def wav9(spark, sf_dir):
    frame = F.floor(F.col("i") / 8)
    quiet = (frame == 0) | (frame == F.col("vec_id") % 4) | (frame == 7 - F.col("vec_id") % 3)
    c = clips64(spark, sf_dir).select("vec_id", F.posexplode("samples").alias("i", "x")).select("vec_id", "i", (F.col("x").cast("double") * F.when(quiet, 0.001).otherwise(1.0)).alias("x"))
    c = c.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("vec_id", F.col("s.x").alias("samples"))
    c = W.trim_and_level(c, 8)
    return c.select("vec_id", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total"), W.peak(F.col("samples")).alias("peak"))


@query("WAV-10", None)
def wav10(spark, sf_dir):
    start = W.per_clip(lambda x: (W.quiet_window(x, 8) or (-1, 0.0))[0], "long")
    return clips64(spark, sf_dir).select("vec_id", start("samples").alias("start"))


#: Lengthened from 64 to 96 samples by its end, and brought to an RMS of -20 dB.
@query("WAV-11", """with p as (select vec_id, list_concat(list_transform(embedding, lambda x: x::double), list_reverse(list_transform(embedding[32:63], lambda x: x::double))) as x from embeddings),
g as (select vec_id, x, least(pow(10, -20 / 20.0) / sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 0.99 / list_max(list_transform(x, lambda v: abs(v)))) as gain from p)
select vec_id, len(x)::int as n, x[65] * gain as next, x[96] * gain as last, list_sum(list_transform(x, lambda v: v * gain)) as total from g""")
def wav11(spark, sf_dir):
    c = W.level_and_quantize(clips64(spark, sf_dir), 96, rms_db=-20.0)
    return c.select("vec_id", F.size("samples").alias("n"), F.element_at("samples", 65).alias("next"), F.element_at("samples", 96).alias("last"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("WAV-13", None)
def wav13(spark, sf_dir):
    snr, span = W.per_clip(lambda x: W.measure_snr(x, 8, 4), "double"), W.per_clip(lambda x: W.active_span(x, 64, 4 / 64, 2 / 64, 6.0), "array<long>")
    c = clips64(spark, sf_dir).select("vec_id", snr("samples").alias("snr_db"), span("samples").alias("span"))
    return c.select("vec_id", "snr_db", F.col("span")[0].alias("start"), F.col("span")[1].alias("stop"))


@query("UDF-3", V.with_sql(V.ATC, select="""select row_idx, unnest(['callsign', 'heading', 'flight_level']) as type, unnest(['CSA' || ident, heading, 'FL' || level]) as value, unnest([ident, heading, level]) as digits,
  'csa ' || text as said, case when row_idx % 2 = 0 then 'out_of_range' end as problem from atc"""))  # fmt: skip
def udf3(spark, sf_dir):
    register_functions(spark, {"csa": "CSA"})
    V.radio(spark, sf_dir).withColumn("tokens", T.tokenize_spoken(F.col("text"))).createOrReplaceTempView("cliploom_radio")
    return spark.sql("""
        select row_idx, e.type, e.value, runs[array_position(array('callsign', 'heading', 'flight_level'), e.type) - 1].digits as digits,
            normalize_atc(concat('CSA, ', text)) as said, check_value('heading', if(row_idx % 2 = 0, '361', '360')) as problem
        from (select row_idx, text, scan_numbers(tokens) as runs from cliploom_radio) r, lateral explode_entities(text) e""")
