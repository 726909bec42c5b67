"""Ranks, running sums and exact percentiles of groups of any size.

A window over a group puts the group into one task. Here a group with more than a
share of 1 / SHARE of all rows is cut at PIECES approximate quantiles of its order, so
a window sees one piece, and a small table of pieces gives what lies before each. The
cuts only say which task orders a row; ranks and sums are exact. Groups that are cut
number at most SHARE, so their cuts are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES, SHARE = 100, 5_000
#: Accuracy of the approximate quantiles.
ACCURACY = 2_000


def ranked(df: DataFrame, by: list[str], key: Column, ties: list[str], sums: list[str] = (), previous: bool = False) -> DataFrame:
    """df with rank (from 1) and group_rows, in the order of key, then ties, within each group; nulls come first.

    key is a number, or a time. Each column of sums gets its running sum as upto_<name>
    and its sum over the group as all_<name>; with previous, previous is the key of the
    row before. Rows of equal keys stay together: a key that many rows share needs its
    rows counted beforehand.
    """
    names = df.columns
    df = df.withColumns({"__key": key, "__of": F.struct(F.lit(0).alias("__0"), *by)})
    # structs of keys are equal where their nulls are, too
    sizes = df.groupBy("__of").agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__key", [(i + 1) / PIECES for i in range(PIECES - 1)], ACCURACY).alias("__cuts"))
    hot = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("__n").alias("__rows")))).where(F.col("__n") * SHARE > F.col("__rows")).select("__of", "__cuts")
    df = df.join(F.broadcast(hot), "__of", "left")
    piece = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__key"))), F.lit(0))
    df = df.withColumn("__piece", F.struct("__of", F.when(F.col("__cuts").isNull(), 0).otherwise(piece).alias("piece"))).drop("__cuts", "__of")

    pieces = df.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"), F.max("__key").alias("__last"), *(F.sum(c).alias(f"__sum_{c}") for c in sums))
    whole = Window.partitionBy("__piece.__of")
    before = whole.orderBy("__piece.piece").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    pieces = pieces.select(
        "__piece",
        zero(F.sum("__n").over(before)).alias("__before"),
        F.sum("__n").over(whole).alias("group_rows"),
        F.max("__last").over(before).alias("__last"),
        *(x for c in sums for x in (zero(F.sum(f"__sum_{c}").over(before)).alias(f"__sum_{c}"), F.sum(f"__sum_{c}").over(whole).alias(f"all_{c}"))),
    )
    order = Window.partitionBy("__piece").orderBy("__key", *ties)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    made = {"__r": F.row_number().over(order)} | {f"__upto_{c}": F.sum(c).over(running) for c in sums}
    if previous:
        made["__lag"] = F.lag("__key").over(order)
    df = df.withColumns(made).join(pieces, "__piece")
    out = [F.col(c) for c in names] + [(F.col("__r") + F.col("__before")).alias("rank"), F.col("group_rows")]
    for c in sums:
        out += [(zero(F.col(f"__upto_{c}")) + F.col(f"__sum_{c}")).alias(f"upto_{c}"), F.col(f"all_{c}")]
    if previous:
        out.append(F.when(F.col("__r") > 1, F.col("__lag")).otherwise(F.col("__last")).alias("previous"))
    return df.select(*out)


def percentiles(df: DataFrame, value: str | Column, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Per group (a row for all without by): n and mean of the values that aren't null, the linear-interpolated percentiles, max.

    shares maps names to shares from 0 to 1. Equal values are counted first, so no
    buffer holds a group's values; a group without values has n = 0 and nulls.
    """
    by = list(by)
    counts = df.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("__v")).groupBy(*by, "__v").agg(F.count("__v").alias("n"))
    r = ranked(counts, by, F.col("__v"), [], ["n"])
    low, high = F.col("upto_n") - F.col("n"), F.col("upto_n")
    out = [F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum(F.col("__v") * F.col("n")), F.sum("n")).alias("mean"), F.max("__v").alias("max")]
    for name, q in shares.items():
        place = F.lit(q) * (F.col("all_n") - 1)
        at = lambda k: F.max(F.when((low <= k) & (k < high), F.col("__v")))
        part = F.max(place - F.floor(place))
        a, b = at(F.floor(place)), at(F.ceil(place))
        out.append(F.when(a == b, a).otherwise((1 - part) * a + part * b).alias(name))
    return (r.groupBy(*by) if by else r).agg(*out).select(*by, "n", "mean", *shares, "max")
