"""Language-model scores by prediction by partial matching over bytes.

A byte-context trie holds, for contexts of up to ORDER bytes, how often each
symbol followed. A symbol is coded in its longest known context; if it is not a
child there, an escape is coded and the next shorter context is tried without the
symbols already excluded, down to equal shares of what is left of the 256 bytes.
Escapes take the number of children, and the occurrences of children that the trie
doesn't hold. A text's score is the sum of the log10 probabilities of its bytes.

Counts cover all training texts: each position gives one string of ORDER + 1 bytes,
counted in its task and summed in Spark; shorter strings are sums of longer ones. Every
counted string is a node, whatever the size of the corpus. A parent occurs at least as
often as its child, so the children of a context are children of all its suffixes too,
and what to exclude in a context follows from the one longer context.

The probability of a byte depends only on the string that it ends. That of each string
of the training texts is worked out by joins on its context. Those of the strings with
at least 1 / MAX_CODES of the training bytes are broadcast; the others that a text holds
meet theirs by a shuffle on the string. Strings that no training text holds are worked
out by depth, each distinct suffix once, so that no join gathers more than 256 strings.

Word counts, for a unigram base score, are handled likewise: words with at least
1 / MAX_WORDS of the tokens are broadcast, the rest meet by a shuffle on the word.

Defined results: a null or empty text scores 0 and is one end token; without training
texts every byte has probability 1/256; rows may repeat; an empty table gives no rows.
Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import forget, give_back, map_arrow, slices, unused, with_columns, written

ORDER = 5
MAX_WORDS = 1 << 20
MAX_CODES = 1 << 21
FLUSH = 1_000_000
#: Bytes up to which words are hashed together.
LONG_WORD = 64
GRAM, WORD = 0, 1


def byte_strings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts the number made of it and the ORDER bytes before it (zero before the start), and the sizes."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    pad = b"\0" * ORDER
    data = np.frombuffer(pad + pad.join(raw), np.uint8)
    at = np.arange(int(sizes.sum())) + np.repeat(ORDER * np.arange(1, len(raw) + 1), sizes)
    wide = data.astype(np.int64)
    codes = wide[ORDER:].copy()
    for back in range(1, ORDER + 1):
        codes |= wide[ORDER - back : len(wide) - back] << 8 * back
    return codes[at - ORDER], sizes


def word_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers of the bytes (of A-Z those of a-z), powers of an odd number, and which bytes are white space."""
    of_byte = np.random.default_rng(0).integers(0, 1 << 64, 256, np.uint64)
    of_byte[65:91] = of_byte[97:123]
    powers = np.multiply.accumulate(np.full(LONG_WORD + 1, 0x9E3779B97F4A7C15, np.uint64))
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return of_byte, powers, blank


OF_BYTE, POWERS, BLANKS = word_tables()


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (each text ends with that of the empty word, 0), and their numbers.

    A word's hash sums a random number of each byte times a power for its place; that of a word of over LONG_WORD bytes is xxh3.
    """
    raw = [t.encode("utf-8", "replace") + b" " for t in texts]
    whole = b"".join(raw)
    data = np.frombuffer(whole, np.uint8)
    inside = np.concatenate([[False], ~BLANKS[data]])
    edges = np.nonzero(inside[1:] != inside[:-1])[0]  # the last byte is a blank, so every word ends
    start, end = edges[::2], edges[1::2]
    size = end - start
    spread = np.diff(start, append=len(data))  # a word and the blanks behind it, which count for nothing
    first = int(start[0]) if len(start) else len(data)
    place = np.concatenate([np.zeros(first, np.int64), np.arange(first, len(data)) - np.repeat(start, spread)])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(OF_BYTE[data] * POWERS[np.minimum(place, LONG_WORD)], out=sums[1:])
    key = sums[end] - sums[start]
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    for i in np.nonzero(size > LONG_WORD)[0]:
        key[i] = xxhash.xxh3_64_intdigest(whole[start[i] : end[i]].lower())
    before = np.searchsorted(start, np.cumsum([len(x) for x in raw])) if raw else np.zeros(0, np.int64)
    return np.insert(key, before, 0).view(np.int64), np.diff(before, prepend=0) + 1


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def count_strings(df: DataFrame, text: str = "text") -> DataFrame:
    """kind, key, n: byte strings and words of the texts, counted; a written table."""

    def flush(kind: int, parts: list):
        key, n = summed([x for x, _ in parts], [x for _, x in parts])
        parts[:] = []
        for i in range(0, len(key), 100_000):
            part = key[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[i : i + 100_000])], names=["kind", "key", "n"])

    def run(batches):
        held = {GRAM: [], WORD: []}
        for _, texts in slices(batches, text):
            for kind, keys in ((GRAM, byte_strings(texts)[0]), (WORD, words_of(texts)[0])):
                at, unique = pd.factorize(keys)
                held[kind].append((unique, np.bincount(at, minlength=len(unique))))
                if sum(len(x) for x, _ in held[kind]) > 2 * FLUSH:
                    held[kind][:] = [summed([x for x, _ in held[kind]], [x for _, x in held[kind]])]
                    if len(held[kind][0][0]) > FLUSH:
                        yield from flush(kind, held[kind])
        for kind, parts in held.items():
            if parts:
                yield from flush(kind, parts)

    made = map_arrow(df, [text], run, "kind int, key long, n long", without=[text])
    return written(made.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in sorted keys; -1 where absent."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


@dataclass
class Words:
    """Sorted hashes and counts of the frequent words; tokens and distinct words of the training texts."""

    keys: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    add: float = 0.1

    @property
    def all(self) -> float:
        return self.tokens + self.add * (self.distinct + 1)


def build_words(counts: DataFrame) -> tuple[Words, DataFrame]:
    """The frequent words, and a table (key, n) of the others."""
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    tokens, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    often = F.col("n") * MAX_WORDS >= F.lit(tokens or 0)
    rows = words.where(often).toArrow()
    key, n = (rows.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(key, kind="stable")
    return Words(key[order], n[order], tokens or 0, distinct), words.where(~often)


def mask(column: str, length: int) -> Column:
    """The last bytes of a string, so many."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * length) - 1))


@dataclass
class Strings:
    """The whole model: nodes (code, n) of depths 1 to ORDER + 1 and contexts of lengths 0 to ORDER, written tables.

    codes are the strings of ORDER + 1 bytes (code, n, log) with their log10 probabilities; often and logs are the frequent ones, sorted.
    """

    nodes: list[DataFrame]
    contexts: list[DataFrame]
    codes: DataFrame
    often: np.ndarray
    logs: np.ndarray
    flat: float


def build_strings(counts: DataFrame) -> Strings:
    """The model of all counted strings."""
    nodes = [counts.where(F.col("kind") == GRAM).select(F.col("key").alias("code"), "n")]
    for d in range(ORDER, 0, -1):
        nodes.insert(0, written(nodes[0].groupBy(mask("code", d).alias("code")).agg(F.sum("n").alias("n")), "nodes"))
    contexts = []
    for o in range(ORDER + 1):
        children = nodes[o].select("code", "n", F.shiftright("code", 8).alias("ctx"))
        if not o:
            made = children.groupBy("ctx").agg(F.sum("n").alias("kept"), F.count(F.lit(1)).alias("q"))
            made = made.select("ctx", F.col("kept").alias("total"), "kept", "q", F.lit(None).cast("double").alias("low_all"), F.lit(None).cast("double").alias("low_escape"))
        else:
            short = nodes[o - 1].select(F.col("code").alias("short"), F.col("n").alias("seen"))
            made = children.withColumn("short", mask("code", o)).join(short, "short").groupBy("ctx")
            made = made.agg(F.sum("n").alias("kept"), F.count(F.lit(1)).alias("q"), F.sum("seen").alias("excluded"))
            made = made.join(nodes[o - 1].select(F.col("code").alias("ctx"), F.col("n").alias("own")), "ctx", "left")
            made = made.withColumn("total", F.greatest(F.coalesce("own", F.lit(0)), "kept")).withColumn("short", mask("ctx", o - 1))
            low = contexts[-1].select(F.col("ctx").alias("short"), *(F.col(c).alias(f"low_{c}") for c in ("total", "kept", "q")))
            made = made.join(low, "short")
            all_, q = F.col("low_total") - F.col("excluded"), F.col("low_q") - F.col("q")
            low_all = F.log10(F.greatest(all_ + q, F.lit(1)))
            escape = F.log10(F.greatest(F.col("low_total") - F.col("low_kept") + q, F.lit(1))) - low_all
            made = made.select("ctx", "total", "kept", "q", low_all.alias("low_all"), F.when(q > 0, escape).otherwise(0.0).alias("low_escape"))
        log_all = F.log10(F.col("total") + F.col("q"))
        made = made.withColumn("log_all", log_all).withColumn("log_escape", F.log10(F.col("total") - F.col("kept") + F.col("q")) - log_all)
        contexts.append(written(made, "contexts"))
    codes = nodes[ORDER].withColumn("ctx", F.shiftright("code", 8)).join(contexts[ORDER].select("ctx", "log_all"), "ctx")
    codes = written(codes.select("code", "n", (F.log10("n") - F.col("log_all")).alias("log")), "codes")
    root = contexts[0].first()
    total, known = (root["total"], root["q"]) if root else (0, 0)
    rows = codes.where(F.col("n") * MAX_CODES >= F.lit(total)).select("code", "log").toArrow()
    often, logs = (rows.column(c).to_numpy() for c in ("code", "log"))
    order = np.argsort(often, kind="stable")
    often, logs = often[order], logs[order]
    del rows, order
    give_back()
    return Strings(nodes, contexts, codes, often, logs, -float(np.log10(256 - known)) if known < 256 else 0.0)


def unseen_logs(strings: Strings, wanted: DataFrame) -> DataFrame:
    """code, log: log10 probabilities of the distinct codes wanted, none of which is a node.

    begun is the cost of a string's last byte in its longest known context and shorter ones, below that in contexts shorter than its own after an escape there.
    """
    levels = [wanted]
    for d in range(ORDER, 0, -1):
        levels.insert(0, written(levels[0].select(mask("code", d).alias("code")).distinct(), "suffixes"))
    flat = F.lit(strings.flat)
    last = None
    for o, level in enumerate(levels):
        made = level.withColumn("ctx", F.shiftright("code", 8)).withColumn("short", mask("code", o)).join(strings.nodes[o], "code", "left")
        made = made.join(strings.contexts[o].select("ctx", "log_all", "log_escape", "low_all", "low_escape"), "ctx", "left")
        if last is None:
            made = made.withColumn("below", flat).withColumn("shorter", flat)
        else:
            names = {"code": "short", "n": "short_n", "begun": "shorter", "below": "short_below"}
            made = made.join(last.select(*(F.col(k).alias(v) for k, v in names.items())), "short")
            below = F.when(F.col("short_n").isNotNull(), F.log10("short_n") - F.col("low_all")).otherwise(F.col("low_escape") + F.col("short_below"))
            made = made.withColumn("below", below)
        begun = F.when(F.col("n").isNotNull(), F.log10("n") - F.col("log_all")).when(F.col("log_all").isNotNull(), F.col("log_escape") + F.col("below")).otherwise(F.col("shorter"))
        before, last = last, written(made.select("code", "n", begun.alias("begun"), "below"), "suffixes")
        for used in (before, level) if before is not None else ():
            forget(used)
    return last.select("code", F.col("begun").alias("log"))


def counted(at: np.ndarray, unique: np.ndarray, doc: np.ndarray, docs: int) -> tuple[pa.Array, pa.Array]:
    """The distinct keys of each document, and how often each occurs in it; keys are places in unique."""
    both, many = np.unique(doc * len(unique) + at, return_counts=True)
    offsets = pa.array(np.searchsorted(both, np.arange(docs + 1) * len(unique)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(unique[both % len(unique)] if len(both) else unique[:0])), pa.ListArray.from_arrays(offsets, pa.array(many))


def pairs_of(table: DataFrame, row: str, keys: str, many: str) -> DataFrame:
    """row, key, many: a row for each key of the lists."""
    return table.select(row, F.inline(F.arrays_zip(keys, many)).alias("key", "many"))


def score(df: DataFrame, words: Words, rare: DataFrame, strings: Strings, text: str = "text") -> DataFrame:
    """df without its text, with n_tokens, n_known, base_score and score."""
    both = df.sparkSession.sparkContext.broadcast((strings.often, strings.logs, words))
    lists = {unused(df, x): "array<long>" for x in ("keys", "many", "codes", "times")}
    keys, many, codes, times = lists

    def run(batches):
        often, logs, words = both.value
        for batch, texts in slices(batches, text):
            key, sizes = words_of(texts)
            doc = np.repeat(np.arange(len(texts)), sizes)
            word, unique = pd.factorize(key)
            at = find(words.keys, unique)[word]
            known = at >= 0
            c = np.where(known, words.counts[at] if len(words.counts) else 0, 0)
            base = np.log10((c + words.add) / words.all) if words.all else np.zeros(len(key))
            names = counted(word[~known], unique, doc[~known], len(texts))
            strings_of, sizes_b = byte_strings(texts)
            place = np.repeat(np.arange(len(texts)), sizes_b)
            string, unique = pd.factorize(strings_of)
            at = find(often, unique)
            own = np.where(at >= 0, logs[at] if len(logs) else 0.0, 0.0)[string]
            new = (at < 0)[string]
            rest = counted(string[new], unique, place[new], len(texts))
            made = {
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.bincount(doc[known], minlength=len(texts)).astype(np.int64)),
                "base_score": pa.array(np.bincount(doc, base, minlength=len(texts)).astype(np.float64)),
                "score": pa.array(np.bincount(place, own, minlength=len(texts)).astype(np.float64)),  # of nothing bincount makes integers
                keys: names[0],
                many: names[1],
                codes: rest[0],
                times: rest[1],
            }
            yield with_columns(batch, made).drop_columns([text])

    added = "n_tokens long, n_known long, base_score double, score double, " + ", ".join(f"{n} {t}" for n, t in lists.items())
    row = unused(df, "row")
    table = written(map_arrow(df, df.columns, run, added, without=[text]).withColumn(row, F.monotonically_increasing_id()), "scores")
    more = F.log10(F.col("n") + words.add) - float(np.log10(words.add))
    found = pairs_of(table, row, keys, many).join(rare, "key").groupBy(row).agg(F.sum("many").alias("known"), F.sum(F.col("many") * more).alias("more"))
    pairs = pairs_of(table, row, codes, times).withColumnRenamed("key", "code")
    wanted = written(pairs.select("code").distinct().join(strings.codes.select("code"), "code", "left_anti"), "unseen")
    logs = strings.codes.select("code", "log").unionByName(unseen_logs(strings, wanted))
    rest = pairs.join(logs, "code").groupBy(row).agg(F.sum(F.col("many") * F.col("log")).alias("rest"))
    sums = found.join(rest, row, "full").select(row, F.struct("known", "more", "rest").alias(keys))  # one name that no column has
    out = table.drop(*lists).join(sums, row, "left")
    return out.select(
        *[c for c in df.columns if c not in (text, "n_tokens", "n_known", "base_score", "score")],
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.col(keys)["known"], F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce(F.col(keys)["more"], F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce(F.col(keys)["rest"], F.lit(0.0))).alias("score"),
    )
