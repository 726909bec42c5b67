"""Ingestion of recorded clips: normalized, checked, named and split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions import waveform as W
from cliploom.functions.text import parse_station, stem
from cliploom.operators.splits import group_holdout, unique_ids

#: A clip of a lower peak or a smaller share of speech frames is silent; frame and hop at 16 kHz.
SILENT_PEAK, LEAST_ACTIVE = 0.015, 0.03
FRAME, HOP = 400, 160


def ingest_clips(clips: DataFrame, out: str, fraction: float = 0.15, seed: str = "ingest") -> DataFrame:
    """path, station and reason of all clips of read_clips(); clip_id, duration, rms_db, peak and split of those kept.

    The clips at 16 kHz are written to the folder out as Parquet with their measures;
    what follows reads the measures only. reason is null for a clip that is kept, else
    unreadable, zero_length, duplicate (equal samples, all but the first path) or
    silence_only. Of each station the fraction is the holdout.
    """
    measures = {
        "hash": W.audio_hash("samples"),
        "active": W.per_clip(lambda x: W.active_share(x, FRAME, HOP), "double")("samples"),
        "duration": F.round(F.size("samples") / 16_000, 6),
        "peak": F.round(W.peak(F.col("samples")), 6),
        "rms_db": 20 * F.log10(F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.size("samples")) + 1e-10),
    }
    whole = W.to_mono_16k(clips.where("problem is null"))
    whole.withColumns(measures).unionByName(clips.where("problem is not null"), allowMissingColumns=True).write.parquet(out)
    rows = clips.sparkSession.read.parquet(out).select("path", "problem", "hash", "active", "duration", "peak", "rms_db")
    first = rows.where("problem is null").groupBy("hash").agg(F.min("path").alias("path")).select("path", F.lit(True).alias("first"))
    silent = (F.col("peak") < SILENT_PEAK) | (F.col("active") < LEAST_ACTIVE)
    reason = F.coalesce("problem", F.when(F.col("first").isNull(), "duplicate").when(silent, "silence_only"))
    rows = rows.join(first, "path", "left").withColumns({"reason": reason, "station": parse_station(F.col("path"))}).drop("problem", "first", "hash", "active")
    kept = unique_ids(rows.where("reason is null").withColumn("name", stem(F.col("path"))), "name", "path").drop("name")
    kept = group_holdout(kept, "station", fraction, seed, "clip_id")
    split = F.when(F.col("held_out"), "holdout").otherwise("train")
    return kept.withColumn("split", split).drop("held_out").unionByName(rows.where("reason is not null").select("path", "station", "reason"), allowMissingColumns=True)
