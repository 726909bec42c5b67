"""Fill-in-middle: texts cut into prefix, middle and suffix at ends of units.

A unit is white space and the word behind it; white space at the end of a text is
a unit of its own. Texts are laid out as UTF-8, each from a multiple of eight
bytes on, and read as 64-bit words: arithmetic on all eight bytes at once marks
the bytes that end a unit, a count of set bits per word and its running sum tell
the word of the k-th mark by binary search, and a sum of prefixes inside the word
tells its byte.

Defined results: a null or empty text is plain and empty, with no units; a text
that holds a sentinel is plain; a null id draws as the empty text does; repeated
rows draw alike; an empty table gives no rows. Other columns stay, but for the
names that are added.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import CHUNK_CHARS, map_arrow, unused, with_columns

SENTINELS = ("<P>", "<S>", "<M>")


def every(byte: int) -> np.uint64:
    """A word of eight equal bytes."""
    return np.uint64(byte * 0x0101010101010101)


ONE, HIGH, LOW = every(1), every(0x80), every(0x7F)
BIT = [np.uint64(n) for n in range(64)]


def white(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is a space or one of 9 to 13."""
    low = words & LOW
    blank = low ^ every(0x20)
    found = ~(blank + LOW) & HIGH  # only a byte of zero stays below 0x80
    found |= (low + every(0x80 - 9)) & ~(low + every(0x80 - 14)) & HIGH
    return found & ~words


def first_bytes(n: np.ndarray) -> np.ndarray:
    """Words with the first n bytes set, n from 0 to 8."""
    kept = np.uint64(8) * n.astype(np.uint64)
    return np.where(n >= 8, ~np.uint64(0), (np.uint64(1) << (kept & np.uint64(63))) - np.uint64(1))


class Units:
    """Ends of units of many texts, given as bytes."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        n_words = (self.size + 7) // 8
        self.first = np.cumsum(n_words) - n_words  # word where each text begins
        words = np.frombuffer(b"".join(t.ljust(8 * n, b"\0") for t, n in zip(texts, n_words.tolist(), strict=True)), "<u8")
        some = self.size > 0
        last = (self.first + n_words - 1)[some]
        tail = (self.size[some] - 1) % 8

        space = white(words)
        after = space >> BIT[8]  # the mark of the byte behind
        after[:-1] |= space[1:] << BIT[56]
        marks = ~space & after & HIGH
        leads = (~words | (words << BIT[1])) & HIGH  # all but continuation bytes
        own = first_bytes(tail + 1)
        marks[last] = (marks[last] & own) | (np.uint64(0x80) << (np.uint64(8) * tail.astype(np.uint64)))
        leads[last] &= own
        self.marks, self.leads = marks, leads
        self.units = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])
        self.chars = np.concatenate([[0], np.cumsum(np.bitwise_count(leads), dtype=np.int64)])
        self.count = self.units[self.first + n_words] - self.units[self.first]

    def end(self, k: np.ndarray) -> np.ndarray:
        """Bytes up to the end of the k-th unit of each text, k from 0 to its count."""
        some = np.nonzero(k > 0)[0]
        rank = self.units[self.first[some]] + k[some]
        word = np.searchsorted(self.units[1:], rank)
        inside = (rank - self.units[word]).astype(np.uint64)
        so_far = (self.marks[word] >> BIT[7]) * ONE  # in each byte: marks up to it
        reached = np.bitwise_count(((so_far | HIGH) - inside * ONE) & HIGH)
        out = np.zeros(len(k), np.int64)
        out[some] = 8 * (word - self.first[some]) + 8 - reached.astype(np.int64) + 1
        return out

    def code_points(self, end: np.ndarray) -> np.ndarray:
        """Code points in the first bytes of each text."""
        word = self.first + end // 8
        part = self.leads[np.minimum(word, len(self.leads) - 1)] & first_bytes(end % 8) if len(self.leads) else np.zeros(len(end), np.uint64)
        return self.chars[word] - self.chars[self.first] + np.bitwise_count(part)


def draws(key: Column, seed: int) -> list[Column]:
    """The first four 32-bit numbers of the SHA-256 of "seed:key"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 50, spm_rate: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """df with n, form (plain, psm or spm), output, prefix_chars and middle_chars.

    rate is the percentage of texts that are cut, spm_rate that of the cut ones whose
    suffix comes first.
    """
    p, s, m = (x.encode() for x in sentinels)
    names = [unused(df, x) for x in ("h1", "h2", "h3", "h4", "bytes")]
    ready = df.withColumns(dict(zip(names, [*draws(F.col(key), seed), F.coalesce(F.col(text).cast("binary"), F.lit(b""))], strict=True)))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        *h, data = (batch.column(batch.schema.get_field_index(x)) for x in names)
        h, texts = [x.to_numpy() for x in h], data.to_pylist()
        units = Units(texts)
        ends = [units.end(k) for k in np.sort(np.stack([h[0] % (units.count + 1), h[1] % (units.count + 1)]), axis=0)]
        chars = [units.code_points(e) for e in ends]
        forms, made = [], []
        for t, i, j, rolled, order in zip(texts, *(e.tolist() for e in ends), h[2] % 100, h[3] % 100, strict=True):
            if not t or rolled >= rate or p in t or s in t or m in t:
                forms.append("plain")
                made.append(t)
            elif order < spm_rate:
                forms.append("spm")
                made.append(b"".join((s, t[j:], p, t[:i], m, t[i:j])))
            else:
                forms.append("psm")
                made.append(b"".join((p, t[:i], s, t[j:], m, t[i:j])))
        is_plain = np.array([f == "plain" for f in forms], bool)
        return with_columns(
            batch.drop_columns(names),
            {
                "n": pa.array(units.count),
                "form": pa.array(forms, pa.string()),
                "output": pa.array(made, pa.binary()),
                "prefix_chars": pa.array(chars[0], pa.int64(), mask=is_plain),
                "middle_chars": pa.array(chars[1] - chars[0], pa.int64(), mask=is_plain),
            },
        )

    def run(batches):
        for batch in batches:
            size, begin = 0, 0
            for i, n in enumerate(batch.column(batch.schema.get_field_index(names[4])).to_pylist(), 1):
                size += len(n)
                if size >= CHUNK_CHARS or i == batch.num_rows:
                    yield cut(batch.slice(begin, i - begin))
                    begin, size = i, 0

    added = "n long, form string, output binary, prefix_chars long, middle_chars long"
    made = map_arrow(ready, ready.columns, run, added, without=names)
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that transform() has turned into output; no part of it holds a sentinel unless it is plain."""
    part = F.split(output, "|".join(re.escape(x) for x in sentinels))  # an empty part before the first sentinel
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
