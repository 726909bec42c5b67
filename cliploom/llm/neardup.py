"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct word shingles, each a 64-bit hash. Equal sets
form one class, whose smallest id stands for it. The sketch is the SKETCH
smallest hashes. Inverted lists of retained values give candidate pairs, the
union sketch estimates their similarity, and the exact Jaccard value of the full
sets decides.

No list is cut. Two sets of the wanted similarity share at least least_share() of
their sketches: always when the sketch is the whole set; else the bound lies DEVIATIONS
standard deviations below the mean, so that about two links in ten thousand millions
(at 80 %), of documents of over 64 shingles, may be missed. So each document enters only
the lists of its rarest values, as many as that bound requires. Pairs of lists of up to
SMALL members are compared directly. Documents of longer lists are looked at again
with their full sets: lists of their rarest shingles by the exact bound, members held
against one hub of each list (one with few rarer shingles), which joins large groups
of copies in rows in proportion to their size, and then every pair of a list that
still lies in two components, but for those whose rarer shingles, which they don't
share, already make them too different; its lists and bounds are exact.

Defined results: a text without words, or null, has an empty set and is linked
with nothing; rows with one id are one document (of its smallest set digest);
rows with a null id are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import forget, list_array, map_arrow, slices, written

SKETCH = 64
DEVIATIONS = 7
SMALL = 32
HUB_ROUNDS = 2
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def least_share(percent: int) -> float:
    """The share of a sketch that two sets of this similarity have in common, but for chances of DEVIATIONS."""
    p = percent / 100
    return max(1 / SKETCH, p - DEVIATIONS * math.sqrt(p * (1 - p) / SKETCH))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, computed once; begins anew at a size that bounds memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[str], words_per_shingle: int, hashes: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    lists = [t.encode("utf-8", "replace").lower().split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.uint64)] * len(texts)
    word = np.fromiter((hashes[w] for x in lists for w in x), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = np.minimum(sizes, words_per_shingle)  # shorter texts are one shingle
    first = place <= np.repeat(sizes - width, sizes)
    begin, doc = np.nonzero(first)[0], doc[first]
    value = width[doc].astype(np.uint64)
    for i in range(words_per_shingle):
        part = i < width[doc]
        value[part] = mix(value[part] * MULTIPLIER + word[begin[part] + i])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return np.split(value, np.cumsum(np.bincount(doc, minlength=len(lists)))[:-1])


def long_lists(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
    return list_array(flat, np.array([len(x) for x in sets], np.int64))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def sketches(df: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """key, n_shingles, digest of the set, and its sketch."""

    def run(batches):
        hashes = WordHashes()
        for batch, texts in slices(batches, text):
            sets = shingle_sets(texts, words, hashes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s.tobytes()) for s in sets], pa.binary()),
                    long_lists([s[:SKETCH] for s in sets]),
                ],
                names=[key, "n_shingles", "digest", "sketch"],
            )

    return map_arrow(df, [key, text], run, "n_shingles long, digest binary, sketch array<long>", without=[text])


def full_sets(df: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """id, digest and set: the sorted hashes."""

    def run(batches):
        hashes = WordHashes()
        for batch, texts in slices(batches, text):
            sets = shingle_sets(texts, words, hashes)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([digest(s.tobytes()) for s in sets], pa.binary()), long_lists(sets)], names=[key, "digest", "set"])

    return map_arrow(df, [key, text], run, "digest binary, set array<long>", without=[text]).withColumnRenamed(key, "id")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union: the union sketch first, then the full sets."""
    low = np.concatenate([a[:SKETCH], b[:SKETCH]])
    low.sort()
    twice = low[1:] == low[:-1]
    union = np.concatenate([low[:1], low[1:][~twice]])
    k = min(SKETCH, len(union))
    if (low[1:][twice] <= union[k - 1]).sum() < least_share(percent) * k:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            array = lambda v: v.values.to_numpy(zero_copy_only=False).view(np.uint64)
            ok = [similar(array(x[i]), array(y[i]), percent) for i in range(len(x))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return map_arrow(both, ["a", "b", "x", "y"], run, "", without=["x", "y"])


def rarest(values: DataFrame, need) -> DataFrame:
    """value, many, id, n, rank: each document (id, n, values) in the lists of its rarest values.

    If at least need of its values are shared with a similar document, the two
    share one among all but need - 1 of the values of either, in any fixed order.
    Values that one document alone has come first and need no list. rank is the
    number of the document's values before this one.
    """
    each = values.select("id", F.explode("values").alias("value"))
    common = each.groupBy("value").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    rest = each.join(common, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("many", "value"))).alias("x"))
    rest = rest.join(values.select("id", "n", F.size("values").alias("s")), "id")
    take = F.size("x") - F.ceil(need).cast("int") + 1
    rest = rest.where(take > 0).select("id", "n", (F.col("s") - F.size("x")).alias("own"), F.posexplode(F.slice("x", 1, take)).alias("at", "x"))
    return rest.select("x.value", "x.many", "id", "n", (F.col("own") + F.col("at")).cast("long").alias("rank"))


def components(edges: DataFrame) -> DataFrame:
    """id and root (smallest id reachable) of all ids in edges (a, b).

    Alternates large-star and small-star steps, each a grouped minimum and a
    join, until the edges are stars.
    """
    star = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")
    before = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "star")
        forget(star)
        star = after
        state = star.agg(F.count(F.lit(1)), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    return star.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def renamed(lists: DataFrame) -> DataFrame:
    return lists.select("value", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "rank", "comp") if c in lists.columns))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def links(small: DataFrame, full: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all similar documents of the lists into components; not all links of a component."""
    close = F.expr(f"100 * least(n, n2) >= {percent} * greatest(n, n2)")
    # In the first list that two documents share, the values before it are not shared: they and the
    # difference in size of the rest lie outside the intersection.
    near = close & F.expr(f"{100 + percent} * (rank + rank2 + abs((n - rank) - (n2 - rank2))) <= {100 - percent} * (n + n2)")
    found = labels = checked = None
    for turn in range(HUB_ROUNDS + 1):
        member = full.withColumn("comp", F.col("id"))
        if labels is not None:
            member = full.join(labels, "id", "left").select("value", "id", "n", "rank", F.coalesce("root", "id").alias("comp"))
        key = F.struct(F.col("rank") if turn == 0 else F.xxhash64("id", F.lit(turn)), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"))
        mixed = member.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(key).alias("x")).where("lo <> hi")
        if turn < HUB_ROUNDS:
            pairs = member.join(mixed.select("value", "x.id2", "x.n2", "x.comp2"), "value").where(close & F.expr("comp <> comp2"))
        else:
            apart = member.join(mixed.select("value"), "value", "left_semi")
            pairs = apart.join(renamed(apart), "value").where(near & F.expr("comp < comp2"))
        pairs = ordered(pairs)
        if turn == 0:
            pairs = pairs.unionByName(ordered(small.join(renamed(small), "value").where(close & F.expr("id < id2")))).distinct()
        else:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if turn == HUB_ROUNDS and pairs.isEmpty():
            break
        new = written(verified(pairs, sets, percent), "links")
        found = new if found is None else found.unionByName(new)
        if turn < HUB_ROUNDS:
            checked = pairs if checked is None else checked.unionByName(pairs)
            labels = written(components(found), "labels")
    return found


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest id reachable over links) and kept, one row per id."""
    docs = df.select(key, text).where(F.col(key).isNotNull())
    slim = written(sketches(docs, words, key, text).withColumnRenamed(key, "id"), "sketches")
    one = slim.groupBy("id").agg(F.min(F.struct("digest", "n_shingles")).alias("x")).select("id", "x.*")
    one = written(one, "classes")
    rep = one.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("rep"))
    reps = slim.join(rep, (slim.id == rep.rep) & (slim.digest == rep.digest)).select("id", "n_shingles", "sketch").dropDuplicates(["id"])
    lists = written(rarest(reps.select("id", F.col("n_shingles").alias("n"), F.col("sketch").alias("values")), least_share(percent) * F.col("s")), "lists")
    label = one.join(rep, "digest", "left").select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep"))
    if not lists.isEmpty():
        ids = lists.select("id").distinct()
        texts = docs.join(ids.withColumnRenamed("id", key), key, "left_semi")
        sets = full_sets(texts, words, key, text)
        if slim.count() != one.count():  # repeated ids
            sets = sets.join(one, ["id", "digest"], "left_semi").dropDuplicates(["id"])
        sets = written(sets.select("id", "set"), "sets")
        hot = sets.join(lists.where(F.col("many") > SMALL).select("id").distinct(), "id", "left_semi")
        full = rarest(hot.select("id", F.size("set").cast("long").alias("n"), F.col("set").alias("values")), F.expr(f"({percent} * s + 99) div 100"))
        found = links(lists.where(F.col("many") <= SMALL), written(full, "full"), sets, percent)
        forget(sets)
        if found is not None and not found.isEmpty():
            roots = written(components(found), "roots").withColumnRenamed("id", "rep")
            label = label.join(roots, "rep", "left").select("id", "n_shingles", F.coalesce("root", "rep").alias("rep"))
    return label.select(F.col("id").alias(key), "n_shingles", F.col("rep").alias("component_id"), (F.col("id") == F.col("rep")).alias("kept"))

