"""Packing of token ids into windows: best-fit decreasing with a segment tree.

windows() tokenizes texts and cuts overlong documents into full windows; place()
gives each piece a window; sequences() puts the ids together.

Best fit needs one view of the open windows, so pieces are dealt by a hash of
their number into shards of about SHARD_PIECES, each packed on its own. The
number of shards grows with the input, and a shard leaves about one window
partly empty, a fraction of 1 / SHARD_PIECES of the work at every size. Piece
numbers are taken from a written table, so a lost executor changes nothing.

Defined results: a null or empty text is its end id alone; repeated rows are
packed once each; an empty table packs to no rows; ties in length go to the
smaller piece number.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import PieceCache, joined, list_array, map_arrow, ragged, slices, written

SHARD_PIECES = 16_384
#: Distinct words, and parts of words, that a worker holds.
MOST_WORDS = 600_000


class WindowTree:
    """Open windows by remaining capacity; a segment tree tells which capacities occur."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, window: int, left: int) -> None:
        self.open[left].append(window)
        node = self.leaves + left
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out a window of the smallest remaining capacity of at least need."""
        node = self.leaves + need
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        left = node - self.leaves
        window = self.open[left].pop()
        if not self.open[left]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return window, left


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; lengths must not grow along the list."""
    tree = WindowTree(capacity)
    windows, offsets, n = [], [], 0
    for length in lengths:
        found = tree.tightest(length)
        if found is None:
            found = n, capacity
            n += 1
        window, left = found
        windows.append(window)
        offsets.append(capacity - left)
        if left > length:
            tree.put(window, left - length)
    return windows, offsets


#: Letters with punctuation behind them, perhaps; each of the two parts is one piece of the tokenizer.
#: Not U+0130: its lower form ends with a mark that joins the punctuation.
SIMPLE = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f]+)([.,!?;:%&#*$|]*)")
#: Strings that the tokenizer reads as one id wherever they stand, in this case of letters alone.
SPECIAL = re.compile(rb"(<\|(?:start|end)oftext\|>)")


class WordEncoder:
    """Ids of words, for a tokenizer that ends each piece with </w>.

    Parts of simple words are encoded many in one text, which is cut at the ends
    of pieces; where that gives more pieces than parts, each is encoded alone.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known = PieceCache(self.parts, most)

    def alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined([x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])

    def parts(self, words: list[str], each: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for i in range(0, len(words), each):
            own = words[i : i + each]
            ids, _ = self.alone([" ".join(own)])
            cuts = np.nonzero(self.ends[ids])[0] + 1
            if len(cuts) == len(own) and cuts[-1] == len(ids):
                count = np.diff(cuts, prepend=0)
            else:
                ids, count = self.alone(own)
            flat.append(ids)
            sizes.append(count)
        return np.concatenate(flat), np.concatenate(sizes)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        split = [m and m.groups() for m in map(SIMPLE.fullmatch, texts)]
        ids, sizes = self.known.ids([x if x[1] else x[:1] for x in split if x])
        simple = np.array([x is not None for x in split])
        if simple.all():
            return ids, sizes
        more, more_sizes = self.alone([t for t, x in zip(texts, split, strict=True) if not x])
        count, start = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        count[simple], count[~simple] = sizes, more_sizes
        start[simple], start[~simple] = np.cumsum(sizes) - sizes, len(ids) + np.cumsum(more_sizes) - more_sizes
        return ragged(np.concatenate([ids, more]), start, count), count


@functools.lru_cache(maxsize=2)
def _cache(path: str) -> PieceCache:
    return PieceCache(WordEncoder(path), MOST_WORDS)


def words_of(text: str) -> list[bytes]:
    """The words between ASCII white space, ASCII letters lowered; special strings are words of their own.

    A word that would only be special after lowering stays as it is.
    """
    raw = text.encode("utf-8", "replace")
    if b"<|" not in raw:
        return raw.lower().split()
    out: list[bytes] = []
    for i, part in enumerate(SPECIAL.split(raw)):
        out += [part] if i % 2 else [w if SPECIAL.search(low := w.lower()) else low for w in part.split()]
    return out


def token_ids(texts: list[str], path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, each followed by end_id, and their numbers.

    For a tokenizer that drops white space, never joins across it, and lowers
    letters: words between ASCII white space are encoded once each.
    """
    flat, sizes = _cache(path).ids([words_of(t) for t in texts])
    return np.insert(flat, np.cumsum(sizes), end_id), sizes + 1


def windows(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: key, start, length, doc_tokens, ids (little-endian unsigned 32-bit, binary)."""

    def run(batches):
        for batch, texts in slices(batches, text):
            ids, sizes = token_ids(texts, path, end_id)
            data = ids.astype("<u4").tobytes()
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, sizes[row] - start)
            at = (np.cumsum(sizes) - sizes)[row] + start
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(row)),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(sizes[row], pa.int64()),
                    pa.array([data[4 * a : 4 * (a + n)] for a, n in zip(at, length, strict=True)], pa.binary()),
                ],
                names=[key, "start", "length", "doc_tokens", "ids"],
            )

    return map_arrow(df, [key, text], run, "start long, length long, doc_tokens long, ids binary", without=[text])


def place(pieces: DataFrame, capacity: int = 4096, fit: Callable = best_fit) -> DataFrame:
    """pieces (with length from 1 to capacity) and each one's sequence_id and offset.

    fit places the lengths of a shard, longest first: windows and offsets of a capacity.
    """
    numbered = written(pieces.withColumn("__piece", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-numbered.count() // SHARD_PIECES))
    dealt = numbered.withColumn("__shard", F.pmod(F.xxhash64("__piece"), F.lit(shards)))
    schema = dealt.drop("sequence_id", "offset").schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "__piece"], ascending=[False, True])
        window, offset = fit(pdf["length"].tolist(), capacity)
        pdf["sequence_id"] = (int(pdf["__shard"].iloc[0]) << 32) + np.array(window, np.int64)
        pdf["offset"] = np.array(offset, np.int64)
        return pdf[names]

    return dealt.groupBy("__shard").applyInPandas(pack, schema).drop("__piece", "__shard")


def sequences(placed: DataFrame, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids (array<int> of capacity ids, padded) from placed pieces with ids.

    A window whose tokens number a power of two is left as long as it is.
    """

    def join(batches):
        for batch in batches:
            lists = [b"".join(x) for x in batch.column("parts").to_pylist()]
            size = [len(x) // 4 for x in lists]
            full = [x if n & (n - 1) == 0 else x + np.full(capacity - n, pad_id, "<u4").tobytes() for x, n in zip(lists, size, strict=True)]
            flat = np.frombuffer(b"".join(full), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array(size, pa.int64()), list_array(flat, np.array([len(x) // 4 for x in full], np.int64))],
                names=["sequence_id", "n_tokens", "ids"],
            )

    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    parts = parts.select("sequence_id", F.col("p.ids").alias("parts"))
    return parts.mapInArrow(join, "sequence_id long, n_tokens long, ids array<int>")
