"""Alignment of two tokenizers over the same texts, and corpus-wide counts of linked ids.

A is a byte-level BPE of the tokenizers library, read over a space and the text;
B is a sentencepiece model, read over the text, to which it adds the space. Spans
of both libraries, in characters, are coarse cuts in bytes. (The installed release of
sentencepiece has no immutable proto any more; its offset mapping has the same spans.)
Where they are too coarse (tokens that share a character, byte fallback) the lengths
of the decoded tokens refine them, from the last sure cut on.
A link is a pair of tokens whose byte ranges overlap; between two neighbouring
cuts of either tokenizer lies exactly one link.

Texts are read in chunks that begin at a space behind a character which isn't
white space: neither tokenizer joins across it, so each distinct chunk is aligned
once and texts are put together from chunks. For the same reason new chunks are
tokenized many in one text.

Defined results: null and empty texts, and texts whose joined token bytes differ
from space and text (those with U+2581, for instance), have no tokens: counts of
zero, empty groups and no pairs. Repeated rows count each as a document. An empty
table gives no rows. Other columns are dropped, so clashing names don't matter.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import list_array, map_arrow, ragged, slices, unused, written

#: Pairs with at least this share of all (document, pair) rows are looked up by a
#: broadcast: there can be no more than 2^18 of them, and no other pair is hot.
HOT_PAIRS = 1 << 18
#: Chunks and bytes of chunks that a worker remembers.
MOST_CHUNKS, MOST_BYTES = 300_000, 16_000_000
#: New chunks that are tokenized in one text.
TOGETHER = 500

CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
COMMA, BAR, SEMICOLON = b",|;"
#: What stands for a space in B's pieces.
SPACE = "\u2581"




def flattened(made: list[tuple[list, list]], parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and a row of two places for each: spans within the parts turned into those within the joined parts."""
    count = np.array([len(ids) for ids, _ in made], np.int64)
    total = int(count.sum())
    ids = np.fromiter(itertools.chain.from_iterable(ids for ids, _ in made), np.int64, total)
    places = itertools.chain.from_iterable(itertools.chain.from_iterable(spans for _, spans in made))
    span = np.fromiter(places, np.int64, 2 * total).reshape(-1, 2)
    chars = np.array([len(x) for x in parts], np.int64)
    return ids, span + np.repeat(np.cumsum(chars) - chars, count)[:, None]


def byte_places(data: np.ndarray) -> np.ndarray:
    """The byte where each character begins, and the end."""
    return np.append(np.nonzero((data & 0xC0) != 0x80)[0], len(data))


class Tokens:
    """Ids of texts by one tokenizer, with the byte ends of all tokens in the joined texts."""

    def __init__(self, names: list[bytes]):
        self.size = np.array([len(x) for x in names], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(names), np.uint8)

    def refined(self, ids: np.ndarray, coarse: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """Ends of tokens: coarse where sure, else the last sure end and the decoded bytes since."""
        run = np.cumsum(self.size[ids])
        last = np.maximum.accumulate(np.where(sure, np.arange(len(ids)), -1))
        from_start = last < 0
        last[from_start] = 0
        return np.where(from_start, run, coarse[last] + run - run[last])

    def spell(self, ids: np.ndarray, count: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each chunk (count of them) spell its bytes (sizes of them) exactly."""
        edge = np.concatenate([[0], np.cumsum(self.size[ids])])
        cut = np.concatenate([[0], np.cumsum(count)])
        own = edge[cut[1:]] - edge[cut[:-1]]
        same = own == sizes
        if same.any():
            made = ragged(self.bytes, self.start[ids], self.size[ids])
            n = sizes[same]
            equal = ragged(made, edge[cut[:-1]][same], n) == ragged(data, (np.cumsum(sizes) - sizes)[same], n)
            same[same] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return same


class ByteLevel(Tokens):
    """The byte-level tokenizer (A): offsets count characters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the byte that each letter of a vocabulary entry stands for: printable ones are themselves, the rest follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        names = [b""] * (max(words.values()) + 1)
        for w, i in words.items():
            names[i] = bytes(letter[c] for c in w) if all(c in letter for c in w) else w.encode()
        super().__init__(names)

    def __call__(self, parts: list[str], data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = self.tokenizer.encode_batch(parts, add_special_tokens=False)
        ids, span = flattened([(x.ids, x.offsets) for x in made], parts)
        sure = np.append(span[1:, 0] >= span[:-1, 1], True)
        return ids, self.refined(ids, byte_places(data)[span[:, 1]], sure)


class Pieces(Tokens):
    """The sentencepiece model (B), which adds a space: spans count bytes behind that space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        every = range(self.model.get_piece_size())
        self.byte = np.array([self.model.is_byte(i) for i in every])
        names = [self.model.id_to_piece(i) for i in every]
        super().__init__([bytes([int(w[1:-1], 16)]) if b else w.replace(SPACE, " ").encode() for w, b in zip(names, self.byte, strict=True)])
        self.space = self.model.piece_to_id(SPACE)

    def __call__(self, parts: list[str], data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = self.model.encode([x[1:] for x in parts], return_type="offset_mapping", num_threads=1)
        # of an empty text the library makes no token, but a last single space is one
        ids, span = flattened([(x["ids"], x["offsets"]) if x["ids"] else ([self.space], [(0, 0)]) for x in made], parts)
        return ids, self.refined(ids, byte_places(data)[span[:, 1] + 1], (span[:, 1] > span[:, 0]) | ~self.byte[ids])


class Digits:
    """Decimal text of numbers below a bound, each followed by a byte."""

    def __init__(self, bound: int):
        n = np.arange(bound)
        self.width = len(str(bound))
        self.table = np.stack([48 + n // 10**k % 10 for k in range(self.width - 1, -1, -1)] + [n * 0], axis=1).astype(np.uint8)
        self.size = np.maximum(1, np.ceil(np.log10(n + 1)).astype(np.int64))

    def __call__(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined text, and the length of each part of it."""
        rows = self.table[ids]
        rows[:, -1] = after
        return rows[np.arange(self.width + 1) >= (self.width - self.size[ids])[:, None]], self.size[ids] + 1


class Aligner:
    """Aligned chunks of text: each distinct one is tokenized once, texts are joined from them.

    At MOST_CHUNKS or MOST_BYTES the memory starts anew, which changes no result.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.width = len(self.b.size)
        self.digits = Digits(max(len(self.a.size), self.width))
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, whether the bytes differ
        self.text, self.text_size = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.pair = np.zeros(0, np.int64)

    def _add(self, chunks: list[str]) -> None:
        # behind white space, which only ends a text, and behind U+2581, which B reads as a space, another chunk would be joined
        alone = [x for x in chunks if x[-1].isspace() or x[-1] == SPACE]
        chunks = [x for x in chunks if not (x[-1].isspace() or x[-1] == SPACE)]
        parts = ["".join(chunks[i : i + TOGETHER]) for i in range(0, len(chunks), TOGETHER)] + alone
        chunks += alone
        raw = [x.encode("utf-8", "replace") for x in chunks]
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(x) for x in raw], np.int64)
        ends = np.cumsum(sizes)
        (a, end_a), (b, end_b) = self.a(parts, data), self.b(parts, data)
        n_a, n_b = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (end_a, end_b))
        good = self.a.spell(a, n_a, data, sizes) & self.b.spell(b, n_b, data, sizes)
        of_a, of_b = np.repeat(good, n_a), np.repeat(good, n_b)
        a, end_a, b, end_b = a[of_a], end_a[of_a], b[of_b], end_b[of_b]
        cuts, common = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        pair = a[np.searchsorted(end_a, cuts)] * self.width + b[np.searchsorted(end_b, cuts)]

        group = np.concatenate([2 * np.searchsorted(common, end_a), 2 * np.searchsorted(common, end_b) + 1])
        order = np.argsort(group, kind="stable")
        after = np.concatenate([np.where(np.isin(end_a, common, assume_unique=True), BAR, COMMA), np.where(np.isin(end_b, common, assume_unique=True), SEMICOLON, COMMA)])
        text, size = self.digits(np.concatenate([a, b])[order], after[order])
        edge = np.concatenate([[0], np.cumsum(size)])
        in_chunk = np.searchsorted(np.concatenate([end_a, end_b])[order], ends, "right")  # tokens up to the end of each chunk
        text_size = np.diff(edge[in_chunk], prepend=0)

        def per_chunk(at: np.ndarray) -> np.ndarray:
            return np.diff(np.searchsorted(at, ends, "right"), prepend=0)

        numbers = np.stack([per_chunk(end_a), per_chunk(end_b), per_chunk(common), per_chunk(cuts), ~good], axis=1)
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks)), strict=True))
        self.numbers = np.concatenate([self.numbers, numbers])
        self.text, self.text_size = np.concatenate([self.text, text]), np.concatenate([self.text_size, text_size])
        self.pair = np.concatenate([self.pair, pair])

    def find(self, chunks: list[str]) -> np.ndarray:
        """Numbers of the chunks, after the unseen ones are aligned."""
        at = np.fromiter(map(self.index.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        missing = np.nonzero(at < 0)[0]
        if len(missing):
            if len(self.index) + len(missing) > MOST_CHUNKS or len(self.text) > MOST_BYTES:
                self._clear()
                missing = np.arange(len(chunks))
            self._add(list(dict.fromkeys(chunks[i] for i in missing)))
            at[missing] = np.fromiter((self.index[chunks[i]] for i in missing), np.int64, len(missing))
        return at

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """A row of four numbers and a groups text for each text; distinct pairs, their times, and how many each text has."""
        lists = [CHUNK.findall(" " + t) if t else [] for t in texts]
        at = self.find(list(itertools.chain.from_iterable(lists)))
        row = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
        bad = np.bincount(row, self.numbers[at, 4], minlength=len(texts)) > 0
        at, row = at[~bad[row]], row[~bad[row]]
        numbers = np.stack([np.bincount(row, self.numbers[at, k], minlength=len(texts)) for k in range(4)], axis=1).astype(np.int64)

        size, links = self.text_size[at], self.numbers[at, 3]
        data = ragged(self.text, (np.cumsum(self.text_size) - self.text_size)[at], size).tobytes()
        edge = np.concatenate([[0], np.cumsum(np.bincount(row, size, minlength=len(texts)).astype(np.int64))])
        groups = [data[i : j - 1] if j > i else b"" for i, j in itertools.pairwise(edge.tolist())]

        all_links = self.numbers[:, 3]
        pair = ragged(self.pair, (np.cumsum(all_links) - all_links)[at], links)
        space = len(self.a.size) * self.width
        held, times = np.unique(np.repeat(row, links) * space + pair, return_counts=True)
        return numbers, groups, held % space, times, np.bincount(held // space, minlength=len(texts))


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def groups(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups, pairs and times of each row.

    groups is a1,a2|b1;a3|b2,b3: ids of A and B between neighbouring common cuts. pairs
    are the distinct linked pairs as A's id times the size of B's vocabulary plus B's id,
    times how often the row links them.
    """

    def run(batches):
        for batch, texts in slices(batches, text):
            numbers, made, pair, times, sizes = aligner(a_path, b_path)(texts)
            columns = [pa.array(numbers[:, k]) for k in range(4)] + [pa.array(made, pa.binary()), list_array(pair, sizes), list_array(times.astype(np.int32), sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    made = map_arrow(df, [key, text], run, "n_a long, n_b long, n_groups long, n_links long, groups binary, pairs array<long>, times array<int>", without=[text])
    return made.withColumn("groups", F.col("groups").cast("string"))


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, n (rows that hold it) and best (whether no pair of its A id has more)."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    counts = counts.withColumn("a", F.expr(f"pair div {width}"))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # at most one row per entry of A's vocabulary
    return counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def counted(rows: DataFrame, width: int) -> DataFrame:
    """rows (with pairs and times), without these two, and n_best and count_sum.

    Pairs that many rows hold are looked up in a broadcast table of at most HOT_PAIRS
    rows, the others meet their counts by a shuffle; both ways are exact.
    """
    row = unused(rows, "row")
    kept = written(rows.withColumn(row, F.monotonically_increasing_id()), "links")
    counts = pair_counts(kept, width)
    total = counts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * F.lit(HOT_PAIRS) >= F.lit(total)
    hot = F.broadcast(counts.where(is_hot))
    links = kept.select(row, F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))

    def sums(of: DataFrame) -> DataFrame:
        return of.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    cold = links.join(hot.select("pair"), "pair", "left_anti").join(counts.where(~is_hot), "pair")
    both = sums(links.join(hot, "pair")).unionByName(sums(cold)).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return kept.drop("pairs", "times").join(both, row, "left").drop(row).fillna(0, ["n_best", "count_sum"])
