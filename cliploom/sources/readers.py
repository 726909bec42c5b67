"""Readers of manifests, corpora, snapshots, scenes, rename logs, clips and named splits."""

from __future__ import annotations

import io
import json
import re
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITY = "struct<type:string,value:string,spoken:string,critical:boolean>"
MANIFEST = f"audio string, text string, text_display string, role string, kind string, category string, duration double, entities array<{ENTITY}>, gen string, lineage string, gate string, row_idx long"
AUDIO, TEXT = ("audio", "path", "file", "filename"), ("text", "transcript", "transcription")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def read_manifest(spark: SparkSession, path: str, training: bool = False, schema: str = MANIFEST) -> DataFrame:
    """Manifest rows from JSON lines; audio is resolved against the folder of its file, and training drops the free-form columns."""
    df = spark.read.schema(schema).json(path).withColumn("__folder", F.regexp_replace(F.input_file_name(), r"/[^/]*$", ""))
    audio = F.when(F.col("audio").rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), F.col("audio")).otherwise(F.concat_ws("/", "__folder", "audio"))
    df = df.withColumn("audio", F.when(F.col("audio").isNotNull(), audio)).drop("__folder")
    return df.drop("gen", "lineage", "gate") if training else df


def _first(df: DataFrame, names: tuple[str, ...], what: str) -> Column:
    own = [F.col(n) for n in names if n in df.columns]
    if not own:
        raise ValueError(f"no {what} column among {names}")
    return F.coalesce(*own)


def read_labeled_corpus(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """audio, text and (if any row has one) source; aliases count, empty text stays, a missing value fails."""
    df = spark.read.option("header", True).option("escape", '"').csv(path) if kind == "csv" else spark.read.json(path)
    need = lambda c, what: F.coalesce(c, F.raise_error(F.lit(f"a row has no {what}")).cast("string"))
    audio, text = _first(df, AUDIO, "audio"), _first(df, TEXT, "text")
    text = F.coalesce(text, F.lit("")) if kind == "csv" else text  # an empty cell is empty text
    has_source = "source" in df.columns and not df.where("source is not null and source <> ''").isEmpty()
    return df.select(need(audio, "audio").alias("audio"), need(text, "text").alias("text"), *(["source"] if has_source else []))


def read_versioned_snapshot(spark: SparkSession, halves: dict[str, str]) -> DataFrame:
    """Rows of both halves (name to path) of audio, text, suspect: the key is the base name."""
    out = None
    for name, path in halves.items():
        df = spark.read.schema("audio string, text string, suspect string").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
        df = df.select(basename(F.col("audio")).alias("audio"), F.coalesce("text", F.lit("")).alias("text"), (F.col("suspect") == "True").alias("suspect"), F.lit(name).alias("half"))
        out = df if out is None else out.unionByName(df)
    return out


def concatenated_json(spark: SparkSession, path: str) -> DataFrame:
    """value: the text of each group of JSON objects that ends where a line ends; objects stand one after another, over as many lines as they like.

    Files are read in line-aligned splits by as many tasks. A line never begins inside a
    JSON string, so all that a line must know of those before it is the depth of open
    brackets: running sums within a split, and sums of the splits before it. Only the lines
    of one object meet in a task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\.", ""), '"[^"]*"', "")  # noqa: E731  without strings
    # objects side by side in a line are put on lines of their own; breaks behind strings do no harm
    parts = F.split(F.regexp_replace("value", r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[}\]](?=\s*[{\[]))', "$1\n"), "\n")
    lines = lines.select("f", "b", "i", F.posexplode(F.when(bare(F.col("value")).rlike(r"[}\]]\s*[{\[]"), parts).otherwise(F.array("value"))).alias("k", "value"))
    count = lambda c, kept: F.length(F.regexp_replace(c, f"[^{kept}]", ""))
    lines = lines.withColumn("d", (count(bare(F.col("value")), r"{\[") - count(bare(F.col("value")), r"}\]")).cast("long"))

    split = Window.partitionBy("f", "b").orderBy("i", "k")
    upto = split.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("f", "b").agg(F.sum("d").alias("d"))
    blocks = blocks.select("f", "b", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("open"))
    deep = lines.withColumn("d", F.sum("d").over(upto)).join(F.broadcast(blocks), ["f", "b"]).withColumn("end", (F.col("d") + F.col("open") == 0).cast("long"))
    ends = deep.groupBy("f", "b").agg(F.sum("end").alias("n"))
    ends = ends.select("f", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ended"))
    numbered = deep.withColumn("g", F.sum("end").over(upto) - F.col("end")).join(F.broadcast(ends), ["f", "b"])
    groups = numbered.groupBy("f", (F.col("g") + F.col("ended")).alias("g")).agg(F.sort_array(F.collect_list(F.struct("b", "i", "k", "value"))).alias("x"))
    return groups.select(F.array_join(F.col("x.value"), "\n").alias("value"))


def _objects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    decode, blank = json.JSONDecoder(), re.compile(r"\s*")
    for pdf in batches:
        found = []
        for text in pdf["value"]:
            at = blank.match(text).end()
            while at < len(text):
                value, at = decode.raw_decode(text, at)
                found.append(json.dumps(value))
                at = blank.match(text, at).end()
        yield pd.DataFrame({"scene": found})


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """A row per message with text: kind (airport), role, category, text, weight. Scenes are JSON values one after another."""
    scene = "struct<airport_ident:string,messages:array<struct<text:string,speaker:string,category:string>>>"
    rows = concatenated_json(spark, path).mapInPandas(_objects, "scene string").select(F.from_json("scene", scene).alias("s"))
    m = rows.select(F.coalesce("s.airport_ident", F.lit("unknown")).alias("kind"), F.explode("s.messages").alias("m"))
    return m.select("kind", F.coalesce("m.speaker", F.lit("unknown")).alias("role"), F.coalesce("m.category", F.lit("routine")).alias("category"), F.trim("m.text").alias("text"), F.lit(1.0).alias("weight")).where("text <> ''")


def read_rename_log(spark: SparkSession, path) -> DataFrame:
    """old and new of RENAME lines; fails where one old name has two targets."""
    form = r"^RENAME \[[0-9]+\] (.+) -> (.+)$"
    rows = spark.read.text(path).where(F.col("value").rlike(form)).select(F.regexp_extract("value", form, 1).alias("old"), F.regexp_extract("value", form, 2).alias("new"))
    one = rows.groupBy("old").agg(F.min("new").alias("new"), F.max("new").alias("__last"))
    return one.withColumn("new", F.when(F.col("new") == F.col("__last"), F.col("new")).otherwise(F.raise_error(F.concat(F.lit("two targets for "), "old")))).drop("__last")


def read_split(df: DataFrame, name: str, registry: dict[str, tuple[int, int | None]], index: str = "row_idx") -> DataFrame:
    """Rows of a named half-open range; an unknown name fails."""
    if name not in registry:
        raise ValueError(f"no split named {name}")
    start, stop = registry[name]
    own = F.col(index) >= start
    return df.where(own if stop is None else own & (F.col(index) < stop))


CLIP = "path string, channels int, sr int, samples array<float>, problem string"
#: Clips whose samples a task holds at once.
TOGETHER = 64


def _pcm(raw: bytes, width: int) -> np.ndarray:
    """Little-endian samples of 1 to 4 bytes as shares of the full range."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    parts = np.frombuffer(raw, np.uint8).reshape(-1, width)
    wide = np.zeros((len(parts), 4), np.uint8)
    wide[:, 4 - width :] = parts
    return (wide.view("<i4")[:, 0] / 2147483648).astype(np.float32)


def _clip(path: str, content: bytes) -> tuple:
    try:
        with wave.open(io.BytesIO(content)) as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
        x = _pcm(raw, width).reshape(-1, channels).mean(axis=1, dtype=np.float32)
        return path, channels, rate, x, None if len(x) else "zero_length"
    except (wave.Error, EOFError, ValueError):
        return path, None, None, None, "unreadable"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), TOGETHER):
            part = pdf.iloc[i : i + TOGETHER]
            out = pd.DataFrame([_clip(*x) for x in zip(part["path"], part["content"], strict=True)], columns=["path", "channels", "sr", "samples", "problem"])
            yield out.astype({"channels": "Int32", "sr": "Int32"})


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """path, channels, sr, samples (mono) and problem (unreadable, zero_length or null) of WAV files; Spark passes over files without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(_decode, CLIP)
