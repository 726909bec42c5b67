"""Writers of manifests, corpus CSV files, shards and clip files."""

from __future__ import annotations

import io
import re
import wave

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def write_manifest(df: DataFrame, path: str, kind: str = "json") -> None:
    """One row per utterance as JSON lines or Parquet, in order of row_idx."""
    out = df.repartitionByRange("row_idx").sortWithinPartitions("row_idx") if "row_idx" in df.columns else df
    (out.write.json if kind == "json" else out.write.parquet)(path)


def write_corpus_csv(df: DataFrame, path: str) -> None:
    """audio, text, suspect (False) and gate_tier, with CRLF and minimal quoting."""
    out = df.select("audio", "text", F.lit("False").alias("suspect"), F.col("tier").alias("gate_tier"))
    out.write.option("header", True).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path)


def corpus_manifest(df: DataFrame, version: str) -> DataFrame:
    """version, tier, rows, digest: counts by tier, and for all with a digest that doesn't depend on order."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "audio", "text", "tier"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n = df.withColumn("__h", h).rollup("tier").agg(F.count(F.lit(1)).alias("rows"), F.sum("__h").alias("digest"))
    return n.select(F.lit(version).alias("version"), F.coalesce("tier", F.lit("all")).alias("tier"), "rows", F.col("digest").cast("string").alias("digest"))


def with_shard(df: DataFrame, n: int, index: str = "row_idx") -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col(index), F.lit(n)).cast("int"))


def write_shards(df: DataFrame, n: int, path: str, index: str = "row_idx") -> None:
    """Row i goes to shard i mod n."""
    with_shard(df, n, index).write.partitionBy("shard").json(path)


@F.pandas_udf(BinaryType())
def wav_bytes(pcm: pd.Series, rate: pd.Series, channels: pd.Series) -> pd.Series:
    """A WAV file of 16-bit samples, those of a frame side by side."""

    def one(x, r, c) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(int(c))
            w.setsampwidth(2)
            w.setframerate(int(r))
            w.writeframes(np.asarray(x, "<i2").tobytes())
        return out.getvalue()

    return pd.Series([one(*x) for x in zip(pcm, rate, channels, strict=True)])


def write_files(df: DataFrame, path: str) -> None:
    """A file below path for each row of name and content; a task that runs again writes the same files."""
    root = re.sub(r"^(file:)?/+", "file:///", path)

    def run(batches):
        fs, at = pyarrow.fs.FileSystem.from_uri(root)
        for pdf in batches:
            for folder in {n.rpartition("/")[0] for n in pdf["name"]}:
                fs.create_dir(f"{at}/{folder}", recursive=True)
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                with fs.open_output_stream(f"{at}/{name}") as f:
                    f.write(content)
            yield pdf[["name"]]

    df.select("name", "content").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()
