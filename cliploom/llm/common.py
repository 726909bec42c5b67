"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker takes in hand at once.
CHUNK_CHARS = 1_000_000
#: Limits of an Arrow batch that goes to a Python worker.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that setting is absent, a temporary folder is set if all of Spark runs in
    this process; on a cluster it is an error, as machines don't see each other's folders.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext.getCheckpointDir()
        master = spark.sparkContext.master
        if not known and not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        where = known or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def forget(df: DataFrame) -> None:
    """Deletes the tables of written() that df reads, once nothing needs them."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":")[-1].lstrip("/").startswith(root.split(":")[-1].lstrip("/")):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches in slices of about CHUNK_CHARS characters, each with its texts (null: empty)."""
    for batch in batches:
        own = [x or "" for x in batch.column(text).to_pylist()]
        begin, size = 0, 0
        for i, x in enumerate(own, 1):
            size += len(x)
            if size >= CHUNK_CHARS or i == len(own):
                yield batch.slice(begin, i - begin), own[begin:i]
                begin, size = i, 0


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch without the columns of these names, then these columns."""
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + list(columns.values()), names=kept + list(columns))


def map_arrow(df: DataFrame, columns: list[str], f: Callable, added: str, without: Iterable[str] = ()) -> DataFrame:
    """mapInArrow over these columns; the result has them, but for `without`, and those of the DDL string added.

    Arrow batches are held to BATCH_BYTES, so that workers hold little text at once.
    """
    from pyspark.sql.types import StructType

    more = StructType.fromDDL(added)
    kept = [x for x in df.select(*columns).schema.fields if x.name not in (*more.names, *without)]
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches):
        yield from f(batches)
        give_back()

    return df.select(*columns).mapInArrow(run, StructType(kept + more.fields))


def give_back() -> None:
    """Returns freed memory to the system, as a worker lives on idle after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ragged(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + count[i]] for each i, joined."""
    total = int(count.sum())
    shift = np.repeat(start - (np.cumsum(count) - count), count)
    return flat[shift + np.arange(total)]


def joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists in one array, and the number of each."""
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


class PieceCache:
    """Ids of pieces of text: each distinct piece is encoded once, texts are joined from the cache.

    encode_new takes a list of unseen pieces and returns all their ids, joined, and
    how many each has. At max_pieces the cache starts anew, which bounds memory and
    changes no result.
    """

    def __init__(self, encode_new: Callable[[list], tuple[np.ndarray, np.ndarray]], max_pieces: int = 200_000):
        self.encode_new, self.max_pieces = encode_new, max_pieces
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = defaultdict(itertools.count().__next__)  # looking a new piece up numbers it
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _add(self, pieces: list) -> None:
        try:
            made, count = self.encode_new(pieces)
        except BaseException:
            self._clear()  # the pieces have numbers, but no ids
            raise
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, made])

    def _numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def ids(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the lists of pieces, and the number of ids of each list."""
        words = list(itertools.chain.from_iterable(lists))
        known = len(self.index)
        at = self._numbers(words)
        if known and len(self.index) > max(known, self.max_pieces):
            self._clear()
            known, at = 0, self._numbers(words)
        if len(self.index) > known:
            self._add(list(itertools.islice(self.index, known, None)))
        sizes = np.array([len(x) for x in lists], np.int64)
        count = self.count[at]
        ends = np.concatenate([[0], np.cumsum(count)])
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return ragged(self.flat, self.start[at], count), ends[edge[1:]] - ends[edge[:-1]]


def list_array(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
