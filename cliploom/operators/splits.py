"""Capture blocks, holdouts and ranks inside groups, by windows over slim rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.draws import draw, order_key
from cliploom.operators.ranks import ranked

#: Hexadecimal digits of a hash that are counted at once, and rows about a boundary that may be ordered.
STEP, EDGE = 3, 100_000


def capture_blocks(df: DataFrame, gap_minutes: float, group: str = "station", ts: str = "ts", order: str = "row_idx") -> DataFrame:
    """df with block_id: a new block where the gap to the last clip is longer; rows without a time are blocks of their own, after the others.

    Gaps are found within the days of a group, so that no task holds a whole group; a small
    table of days tells whether a day's first clip begins a block, and the blocks before it.
    """
    limit = int(gap_minutes * 60_000_000)
    w = Window.partitionBy(group, "__day").orderBy(ts, order)
    rows = df.withColumn("__day", F.to_date(ts))
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
    rows = rows.withColumn("__new", F.when(F.col(ts).isNull() | (gap > limit), 1).otherwise(0))
    days = rows.groupBy(group, "__day").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.sum("__new").alias("inside"))
    by_day = Window.partitionBy(group).orderBy(F.col("__day").asc_nulls_last())
    apart = F.unix_micros("first") - F.unix_micros(F.lag("last").over(by_day))
    days = days.withColumn("edge", F.when(F.col("__day").isNull(), 0).when(F.lag("last").over(by_day).isNull() | (apart > limit), 1).otherwise(0))
    start = F.sum(F.col("inside") + F.col("edge")).over(by_day.rowsBetween(Window.unboundedPreceding, 0)) - F.col("inside") - 1
    days = days.select(F.col(group).alias("__group"), F.col("__day").alias("__of"), start.alias("__start"))
    rows = rows.withColumn("__b", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(days, F.col(group).eqNullSafe(F.col("__group")) & F.col("__day").eqNullSafe(F.col("__of")))
    number = (F.col("__b") + F.col("__start")).cast("string")
    return rows.withColumn("block_id", F.concat(group, F.lit("/b"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), "0"))).select(*df.columns, "block_id")


def pseudo_split(df: DataFrame, group: str = "station", ts: str = "ts", order: str = "row_idx") -> DataFrame:
    """df with part (0 or 1) and pseudo: a group of one block and at least two timed rows is cut at its largest gap, the first at a tie."""
    timed = ranked(df.where(F.col(ts).isNotNull()).select(group, ts, order), [group], F.unix_micros(ts), [order], previous=True)
    gap = F.unix_micros(ts) - F.col("previous")
    cuts = timed.groupBy(group).agg(F.max(F.when(gap.isNotNull(), F.struct(gap.alias("gap"), (-F.col("rank")).alias("r"), F.col(ts).alias("ts"), F.col(order).alias("order")))).alias("__cut"))
    blocks = df.groupBy(group).agg((F.min("block_id") == F.max("block_id")).alias("__one"))
    cuts = blocks.where("__one").join(cuts, group).where("__cut is not null").select(F.col(group).alias("__group"), "__cut")
    df = df.join(cuts, F.col(group).eqNullSafe(F.col("__group")), "left").withColumn("pseudo", F.col("__cut").isNotNull())
    late = F.col(ts).isNull() | (F.struct(F.col(ts).alias("ts"), F.col(order).alias("order")) >= F.struct("__cut.ts", "__cut.order"))
    return df.withColumn("part", F.when(F.col("pseudo") & late, 1).otherwise(0)).drop("__group", "__cut")


def first_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with duplicate: every row of a key but the first by the order."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def unique_ids(df: DataFrame, name: str, order: str) -> DataFrame:
    """df with clip_id: the name, then name_2, name_3 and so on; a suffix that is a name in the table is passed over."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(name).orderBy(order)))
    base = F.regexp_extract(F.col(name), r"^(.*)_([1-9][0-9]*)$", 1)
    taken = df.select(base.alias(name), F.regexp_extract(F.col(name), r"_([1-9][0-9]*)$", 1).try_cast("int").alias("n")).where("n >= 2").groupBy(name).agg(F.sort_array(F.collect_set("n")).alias("__taken"))
    ranked = ranked.join(taken, name, "left")
    # the rank-th number from 2 on that is not taken
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__r"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    return ranked.withColumn("clip_id", F.when(F.col("__r") == 1, F.col(name)).otherwise(F.concat_ws("_", name, free.cast("string")))).drop("__r", "__taken")


def cap_per_group(df: DataFrame, group: str, n: int, seed: str, key: str, wanted: list[str] | None = None) -> DataFrame:
    """At most n rows of each group, in hash order; a limit that Spark also applies before the shuffle.

    With wanted only these groups, and an error if one of them has no rows.
    """
    if wanted is not None:
        df = df.where(F.col(group).isin(*wanted))
        there = {r[0] for r in df.select(group).distinct().collect()}  # at most the wanted ones
        if missing := sorted(set(wanted) - there):
            raise ValueError(f"no rows of {', '.join(missing)}")
    w = Window.partitionBy(group).orderBy(order_key(seed, F.col(key)), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def interleave(df: DataFrame, group: str, order: str, each: int, limit: int) -> DataFrame:
    """The first rows of round-robin order over groups; position counts from 0."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__r") <= each)
    top = ranked.orderBy("__r", group, order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy("__r", group, order)) - 1).drop("__r")


def holdout_size(n: Column, fraction: float) -> Column:
    return F.when(n > 1, F.least(F.greatest(F.bround(n * F.lit(fraction)), F.lit(1)), n - 1)).otherwise(F.lit(1 if fraction >= 0.5 else 0)).cast("long")


def group_holdout(df: DataFrame, group: str, fraction: float, seed: str, key: str) -> DataFrame:
    """df with held_out: of each group the rounded fraction, between 1 and all but one."""
    slim = ranked(df.select(group, key).withColumn("__h", order_key(seed, F.col(key))), [group], draw(seed, F.col(key)), ["__h", key])
    out = slim.where(F.col("rank") <= holdout_size(F.col("group_rows"), fraction)).select(key, F.lit(True).alias("held_out"))
    return df.join(out, key, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def transcript_split(df: DataFrame, fraction: float, seed: str, stratum: str = "kind", text: str = "text") -> DataFrame:
    """df with held_out: whole groups of equal text, by stratum, up to the first that would overshoot by more than half its size."""
    groups = df.groupBy(stratum, text).agg(F.count(F.lit(1)).alias("__n"))
    parts = (seed, F.col(stratum), F.col(text))
    r = ranked(groups.withColumn("__h", order_key(*parts)), [stratum], draw(*parts), ["__h", text], ["__n"])
    over = F.col("upto___n") - F.col("__n") / 2 > fraction * F.col("all___n")
    first = r.where(over).groupBy(stratum).agg(F.min("rank").alias("__first"))  # one row a stratum
    r = r.join(first, stratum, "left").withColumn("held_out", F.col("rank") < F.coalesce("__first", F.col("rank") + 1))
    return df.join(r.select(stratum, text, "held_out"), [stratum, text])


def day_split(df: DataFrame, day: str, dev_day: str, locked_day: str, n_dev: int, seed: str, key: str) -> DataFrame:
    """df with split: locked and held-out days, n_dev rows of the dev day as dev; fails where a day is empty or short."""
    sizes = df.agg(F.count_if(F.col(day) == dev_day).alias("d"), F.count_if(F.col(day) == locked_day).alias("l")).first()
    if not sizes["l"] or sizes["d"] < n_dev:
        raise ValueError("a day is empty or short")
    dev = df.where(F.col(day) == dev_day).orderBy(order_key(seed, F.col(key)), key).limit(n_dev).select(key, F.lit(True).alias("__dev"))
    out = df.join(dev, key, "left")
    return out.withColumn("split", F.when(F.col(day) == locked_day, "locked").when(F.col("__dev"), "dev").when(F.col(day) == dev_day, "heldout").otherwise("train")).drop("__dev")


def exact_sample(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """The n rows that come first in hash order, or all.

    The hash below which they lie is found by counts of its digits, STEP at a time, so
    that only rows about the boundary are ordered.
    """
    hashed = order_key(seed, F.col(key))
    bound, left = "", n
    for _ in range(32 // STEP):
        counts = df.where(hashed.startswith(bound)).groupBy(F.substring(hashed, len(bound) + 1, STEP).alias("d")).count().orderBy("d").collect()
        if sum(r["count"] for r in counts) <= left:
            break
        for r in counts:  # at most 16 ** STEP
            if r["count"] > left:
                break
            left -= r["count"]
        bound += r["d"]
        if r["count"] <= EDGE:
            break
    if not bound:
        return df
    return df.where(hashed < bound).unionByName(df.where(hashed.startswith(bound)).orderBy(hashed, key).limit(left))
