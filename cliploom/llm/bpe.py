"""Byte-level BPE encoding and decoding.

Text is cut by a pattern; each distinct piece is a row of a padded matrix of
byte tokens, in buckets by length. In each round every row merges its leftmost
pair of lowest rank; pairs are looked up in a hash table held in arrays, and
finished rows leave the matrix. Pieces beyond LONG_BYTES, for which a matrix
would cost the square of their length, merge the same pairs in the same order
with a heap. Rows are independent, so Spark runs this in any partitioning.

Defined results: a null or empty text has no ids and decodes to no bytes; null
ids decode to null; ids outside the vocabulary raise ValueError; other columns
are kept, but for one named like the result, which is replaced.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cliploom.llm.common import PieceCache, list_array, map_arrow, ragged, slices, with_columns

NONE = np.int32(2**31 - 1)
LONG_BYTES = 1024


class PairTable:
    """Open-addressing hash table from a pair of token ids to the merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(left) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]  # the last writer of a slot owns it
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids; NONE where the pair doesn't merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


class Vocabulary:
    """Ranks of a tiktoken file: token bytes by rank, byte tokens, and the pairs that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        size = tokens[-1][1] + 1
        self.count = np.full(size, -1, np.int64)
        rank = np.array([r for _, r in tokens])
        self.count[rank] = [len(t) for t, _ in tokens]
        self.start = np.zeros(size, np.int64)
        self.start[rank] = np.cumsum(self.count[rank]) - self.count[rank]
        self.flat = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)

    @functools.cached_property
    def pairs(self) -> PairTable:
        left, right, merged = array("i"), array("i"), array("i")
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        return PairTable(*(np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (left, right, merged)))

    def encode_pieces(self, pieces: list[str]) -> list:
        """Ids of each piece. A piece that is itself a token is that token."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(raw):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = [rank]
            elif len(piece) > LONG_BYTES:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, 2_000_000 // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._merge_rows([raw[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, raw: list[bytes], width: int) -> list[np.ndarray]:
        sizes = np.array([len(p) for p in raw], np.int64)
        matrix = np.full((len(raw), width), -1, np.int32)
        matrix[np.arange(width) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        ranks = np.full((len(raw), width), NONE, np.int32)  # of the pair that begins at this column
        row, col = np.nonzero(matrix[:, 1:] >= 0)
        ranks[row, col] = self.pairs.get(matrix[row, col], matrix[row, col + 1])
        out: list = [None] * len(raw)
        number = np.arange(len(raw))
        columns = np.arange(width)
        while len(number):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(number)), at]
            done = best == NONE
            for i in np.nonzero(done)[0]:
                out[number[i]] = matrix[i, : sizes[i]].copy()
            live = ~done
            number, matrix, ranks, sizes, at, best = number[live], matrix[live], ranks[live], sizes[live], at[live], best[live]
            if not len(number):
                break
            rows = np.arange(len(number))
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            last = (columns == width - 1) & (columns > at[:, None])
            matrix = np.where(last, -1, np.take_along_axis(matrix, source, 1))
            ranks = np.where(last, NONE, np.take_along_axis(ranks, source, 1))
            matrix[rows, at] = best
            sizes = sizes - 1
            ranks[rows, at] = NONE
            ranks[rows, sizes - 1] = NONE
            for begin, ok in ((at, at + 1 < sizes), (at - 1, at > 0)):
                r, c = rows[ok], begin[ok]
                ranks[r, c] = self.pairs.get(matrix[r, c], matrix[r, c + 1])
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        first = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        gone = bytearray(len(ids) + 1)

        def push(i: int) -> None:
            j = after[i]
            if j < len(ids) and (r := int(self.pairs.get(np.array([ids[i]]), np.array([ids[j]]))[0])) != NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(ids) or (ids[i], ids[j]) != (a, b):
                continue
            ids[i], gone[j], after[i] = rank, 1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [t for i, t in enumerate(ids) if not gone[i]]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, joined, and the number of bytes of each id."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.count) or (self.count[ids] < 0).any()):
            raise ValueError("an id is outside the vocabulary")
        return ragged(self.flat, self.start[ids], self.count[ids]), self.count[ids]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def _cache(path: str) -> PieceCache:
    words = vocabulary(path)
    return PieceCache(lambda pieces: arrays_joined(words.encode_pieces(pieces)))


def arrays_joined(arrays: list) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.asarray(x, np.int32) for x in arrays]), np.array([len(x) for x in arrays], np.int64)


def encode_texts(texts: list[str], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, joined, and the number of ids of each text."""
    cut = regex.compile(pattern)
    return _cache(path).ids([cut.findall(t) for t in texts])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """df with the array<int> column `to` of token ids."""

    def run(batches):
        for batch, texts in slices(batches, text):
            yield with_columns(batch, {to: list_array(*encode_texts(texts, path, pattern))})

    return map_arrow(df, df.columns, run, f"`{to}` array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the binary column `to`: the bytes of the ids, which need not be valid UTF-8."""

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            lists = batch.column(ids)
            raw, width = words.decode(lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(width)])
            size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            edge = ends[np.concatenate([[0], np.cumsum(size)])]
            data = raw.tobytes()
            valid = lists.is_valid().to_pylist()
            out = [data[a:b] if v else None for a, b, v in zip(edge[:-1], edge[1:], valid, strict=True)]
            yield with_columns(batch, {to: pa.array(out, pa.binary())})

    return map_arrow(df, df.columns, run, f"`{to}` binary")
