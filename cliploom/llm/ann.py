"""Approximate nearest neighbours by largest inner product: cross-polytope hashing.

Vectors get one more coordinate that brings all to the largest norm, so that the
largest inner product is the smallest angle. TABLES fast pseudo-rotations (three
rounds of random signs and a Hadamard transform) turn each unit vector; its bucket
is the nearest signed axis. A query looks into the PROBES buckets of nearest axes in
each table, and all candidates are ranked by their exact inner product.

Equal vectors are one class, searched once; a class holds its smallest ids only, as
many as one answer can use (ties go to smaller ids). Buckets and probes meet in a
cogroup by table and bucket, cut into cells of about CELL vectors and CELL queries by
counts taken before, so a hot bucket or query is split and no candidate is left out.
In each cell a matrix product leaves the best of each query, then windows with a
limit, which Spark also applies before the shuffle, leave the best of all.

Defined results: vectors that are null, empty, zero, of another length than most (the
longer at a tie), or hold null or non-finite components take no part; rows with a null
id neither; repeated ids with equal vectors count once; a query that its buckets give
fewer than k neighbours is held against all vectors, in blocks, so if few vectors exist
all others are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import map_arrow, written

TABLES, PROBES, CELL = 8, 28, 2048


def hadamard(y: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; its length is a power of two."""
    n, h = y.shape[1], 1
    while h < n:
        y = y.reshape(len(y), -1, 2, h)
        y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(y), n)
        h *= 2
    return y / np.sqrt(n)


class Rotations:
    """The pseudo-rotations of all tables, from a seed."""

    def __init__(self, dimension: int, tables: int, seed: int):
        self.size = 1 << dimension.bit_length()  # room for the added coordinate
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def axes(self, x: np.ndarray, table: int) -> np.ndarray:
        """The inner product of each row with each signed axis, after rotation."""
        for s in self.signs[table]:
            x = hadamard(x * s)
        return np.concatenate([x, -x], 1)

    def lifted(self, x: np.ndarray, largest: float, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.size))
        out[:, : x.shape[1]] = x / largest
        norm = np.linalg.norm(out, axis=1)
        if query:
            return out / np.maximum(norm, 1e-300)[:, None]
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - norm**2))
        return out


def unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vec (doubles) of the vectors that take part, and their class c1, c2."""
    vec = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") > 0))
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    top = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("vec") == (top["d"] if top else 0))
    return rows.withColumns({"c1": F.xxhash64("vec"), "c2": F.xxhash64(F.lit(1), F.col("vec"))})


def packed(df: DataFrame, columns: list[str]) -> DataFrame:
    """vec as binary of doubles."""

    def run(batches):
        for batch in batches:
            data = [np.asarray(v, np.float64).tobytes() for v in batch.column("vec").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("vec"), pa.field("vec", pa.binary()), pa.array(data, pa.binary())).select([*columns, "vec"])

    return map_arrow(df, [*columns, "vec"], run, "vec binary")


def hashed(df: DataFrame, key: str, turns: Rotations, largest: float, probes: int = 0) -> DataFrame:
    """A row per vector and table (or per probe): key, vec, t, b."""
    each = max(1, probes)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = turns.lifted(unpack(batch.column("vec").to_pylist()), largest, probes > 0)
            rows, found = np.repeat(np.arange(len(x)), each), []
            for t in range(len(turns.signs)):
                axes = turns.axes(x, t)
                found.append((np.argsort(-axes, axis=1, kind="stable")[:, :each] if probes else axes.argmax(1)[:, None]).ravel())
            for t, b in enumerate(found):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(rows)), batch.column("vec").take(pa.array(rows)), pa.array(np.full(len(rows), t, np.int32)), pa.array(b.astype(np.int32))],
                    names=[key, "vec", "t", "b"],
                )

    return map_arrow(df, [key, "vec"], run, "t int, b int")


def nearest(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row for which the condition on its key holds."""
    rows = valid(df, key, vector)
    limit = Window.partitionBy("c1", "c2").orderBy("id")
    some = rows.select("c1", "c2", "id").distinct().withColumn("n", F.row_number().over(limit)).where(F.col("n") <= k + 1)
    members = written(some.groupBy("c1", "c2").agg(F.collect_list("id").alias("ids")).withColumn("class", F.array_min("ids")), "members")
    asked = written(rows.where(is_query(F.col("id"))).join(members.select("c1", "c2", "class"), ["c1", "c2"]).select(F.col("id").alias("query_id"), "class").distinct(), "asked")
    named = members.select(F.col("class").alias("id"), "class")
    vectors = rows.select("id", "vec").join(named, "id").dropDuplicates(["class"])
    vectors = written(packed(vectors.select("class", "vec"), ["class"]), "vectors")
    if vectors.isEmpty():
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest, dimension = measured(vectors)
    turns = Rotations(dimension, tables, seed)
    index = written(hashed(vectors, "class", turns, largest), "index")
    wanted = vectors.join(asked.select("class").distinct(), "class", "left_semi")
    probe = written(hashed(wanted, "class", turns, largest, min(probes, 2 * turns.size)).withColumnRenamed("class", "query"), "probes")

    cells = index.groupBy("t", "b").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("across"))
    cells = cells.join(probe.groupBy("t", "b").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("down")), ["t", "b"])
    cells = F.broadcast(written(cells, "cells"))  # at most tables * 2 * size rows
    own = lambda name, many: F.pmod(F.xxhash64(name), F.col(many)).cast("int")
    all_of = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    left = probe.join(cells, ["t", "b"]).withColumn("y", own("query", "down")).withColumn("x", all_of("across")).select("t", "b", "x", "y", "query", "vec")
    right = index.join(cells, ["t", "b"]).withColumn("x", own("class", "across")).withColumn("y", all_of("down")).select("t", "b", "x", "y", "class", "vec")

    def cell(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query": [], "t": [], "class": [], "score": []}).astype({"query": "int64", "t": "int32", "class": "int64", "score": "float64"})
        v = v.sort_values("class")
        a, b, ids = unpack(q["vec"].tolist()), unpack(v["vec"].tolist()), v["class"].to_numpy()
        product = a @ b.T
        n = min(k + 1, len(ids))
        best = np.argsort(-product, axis=1, kind="stable")[:, :n] if len(ids) <= 4 * n else np.argpartition(-product, n - 1, axis=1)[:, :n]
        row, column = np.repeat(np.arange(len(a)), n), best.ravel()
        return pd.DataFrame({"query": q["query"].to_numpy()[row], "t": q["t"].to_numpy()[row], "class": ids[column], "score": (a[row] * b[column]).sum(1)})

    keys = ["t", "b", "x", "y"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "query long, t int, class long, score double")
    found = written(found, "found")

    def answers(found: DataFrame, asked: DataFrame) -> DataFrame:
        order = (F.desc("score"), F.asc("class"))
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("query", "t").orderBy(*order))).where(F.col("n") <= k + 1)
        found = found.groupBy("query", "class").agg(F.max("score").alias("score"))
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("n") <= k + 1)
        spread = found.join(members.select("class", F.explode("ids").alias("vec_id")), "class").select("query", "vec_id", "score")
        order = (F.desc("score"), F.asc("vec_id"))
        spread = spread.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("n") <= k + 1)
        out = asked.join(spread.drop("n"), asked["class"] == spread["query"]).where(F.col("query_id") != F.col("vec_id"))
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
        return out.select("query_id", "rank", "vec_id", "score")

    out = answers(found, asked)
    got = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
    few = written(asked.join(got, "query_id", "left").where(F.coalesce("got", F.lit(0)) < k).select("query_id", "class"), "few")
    if few.isEmpty():
        return out
    blocks = max(1, -(-vectors.count() // CELL))
    wanted = vectors.join(few.select("class").distinct(), "class", "left_semi").withColumnRenamed("class", "query")
    sides = {"query": (written(wanted, "wanted"), -(-few.count() // CELL), blocks), "class": (vectors, blocks, -(-few.count() // CELL))}
    zero = [F.lit(0).alias("t"), F.lit(0).alias("b")]
    dealt = {}
    for name, (side, mine, others) in sides.items():
        at = {"x" if name == "class" else "y": F.pmod(F.xxhash64(name), F.lit(mine)).cast("int"), "y" if name == "class" else "x": F.explode(F.sequence(F.lit(0), F.lit(others - 1)))}
        dealt[name] = side.select(*zero, *(c.alias(n) for n, c in at.items()), name, "vec")
    more = dealt["query"].groupBy(*keys).cogroup(dealt["class"].groupBy(*keys)).applyInPandas(cell, "query long, t int, class long, score double")
    return out.join(few.select("query_id"), "query_id", "left_anti").unionByName(answers(written(more, "more"), few))


def measured(vectors: DataFrame) -> tuple[float, int]:
    """Largest norm, and the dimension, of packed vectors."""

    def run(batches):
        for batch in batches:
            if len(batch):
                x = unpack(batch.column("vec").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([float(np.linalg.norm(x, axis=1).max())]), pa.array([x.shape[1]], pa.int32())], names=["norm", "d"])

    top = map_arrow(vectors, ["vec"], run, "norm double, d int", without=["vec"]).agg(F.max("norm"), F.max("d")).first()
    return float(top[0]), int(top[1])
