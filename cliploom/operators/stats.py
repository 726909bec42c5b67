"""Statistics of arms, seeds and groups."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators.ranks import percentiles


def group_advantages(df: DataFrame, group: str, reward: str = "reward", least: float = 1e-6) -> DataFrame:
    """df with advantage (z-score in its group, population deviation) and used (false in groups without spread)."""
    w = Window.partitionBy(group)
    mean, sd = F.avg(reward).over(w), F.stddev_pop(reward).over(w)
    return df.withColumns({"advantage": F.when(sd > least, (F.col(reward) - mean) / sd).otherwise(0.0), "used": sd > least})


def arm_summary(df: DataFrame, base: str) -> DataFrame:
    """arm, n, mean, sd, pooled (mean of the arms' deviations), gap to the base arm and gap in pooled units."""
    arms = df.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean"), F.stddev_samp("reward").alias("sd"))
    whole = arms.agg(F.avg("sd").alias("pooled"), F.max(F.when(F.col("arm") == base, F.col("mean"))).alias("base_mean"))
    out = arms.crossJoin(F.broadcast(whole)).withColumn("gap", F.col("mean") - F.col("base_mean")).drop("base_mean")
    return out.withColumn("separation", F.when(F.col("pooled") > 0, F.col("gap") / F.col("pooled")))


def paired_by_seed(df: DataFrame, base: str) -> DataFrame:
    """Per arm but the base: base minus arm on shared seeds, with mean, sd, se, t, degrees of freedom and lower count."""
    own = df.where(F.col("arm") == base).select("seed", F.col("reward").alias("base_reward"))
    d = df.where(F.col("arm") != base).join(own, "seed").withColumn("d", F.col("base_reward") - F.col("reward"))
    out = d.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") > 0).alias("positive"))
    out = out.withColumn("se", F.col("sd") / F.sqrt("n"))
    return out.withColumns({"t": F.when(F.col("se") > 0, F.col("mean") / F.col("se")), "df": F.col("n") - 1})


def additivity(df: DataFrame, base: str, parts: list[str], whole: str) -> DataFrame:
    """arm, effect (mean base minus arm on shared seeds), share of the parts' sum; the rows sum and residual (sum less the whole arm's effect) come last."""
    own = paired_by_seed(df.where(F.col("arm").isin(base, whole, *parts)), base).select("arm", F.col("mean").alias("effect"))
    of = lambda names: F.sum(F.when(F.col("arm").isin(*names), F.col("effect")))
    known = F.count_if(F.col("arm").isin(*parts)) == len(set(parts))
    total = own.agg(F.when(known, of(parts)).alias("total"), of([whole]).alias("whole"))  # arms are few
    rows = own.crossJoin(F.broadcast(total)).select("arm", "effect", F.when(F.col("arm").isin(*parts), F.try_divide("effect", "total")).alias("share"))
    none = F.lit(None).cast("double")
    sums = total.select(F.lit("sum").alias("arm"), F.col("total").alias("effect"), none.alias("share"))
    return rows.unionByName(sums).unionByName(total.select(F.lit("residual").alias("arm"), (F.col("total") - F.col("whole")).alias("effect"), none.alias("share")))


def pooled_gap(df: DataFrame, base: str) -> DataFrame:
    """Gap of each arm's mean to the base in units of the deviation pooled by degrees of freedom."""
    arms = df.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean"), F.var_samp("reward").alias("v"))
    whole = arms.agg(F.sqrt(F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("pooled"), F.max(F.when(F.col("arm") == base, F.col("mean"))).alias("b"))
    return arms.crossJoin(F.broadcast(whole)).select("arm", "n", "mean", "pooled", ((F.col("mean") - F.col("b")) / F.col("pooled")).alias("gap"))


def block_deltas(df: DataFrame, base: str) -> DataFrame:
    """Per block and arm: seeds, mean difference to the base at the same seed, and how many are lower."""
    own = df.where(F.col("arm") == base).select("block", "seed", F.col("wer").alias("b"))
    d = df.where(F.col("arm") != base).join(own, ["block", "seed"]).withColumn("d", F.col("wer") - F.col("b"))
    return d.groupBy("block", "arm").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("delta"), F.count_if(F.col("d") < 0).alias("lower"))


def mad_filter(df: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """Rows with a finite value of at most median + k * max(MAD, 1e-6)."""
    own = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    middle = percentiles(own, value, {"__m": 0.5}).select("__m")
    apart = own.crossJoin(F.broadcast(middle)).select(F.abs(F.col(value) - F.col("__m")).alias("d"))
    spread = middle.crossJoin(percentiles(apart, "d", {"__d": 0.5}).select("__d"))  # one row
    return own.crossJoin(F.broadcast(spread)).where(F.col(value) <= F.col("__m") + k * F.greatest("__d", F.lit(1e-6))).drop("__m", "__d")


def distribution(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n, mean, p10, p50, p90 and max of a column, for each group."""
    return percentiles(df, value, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, by)


def preset_summary(presets: DataFrame, fields: list[str], bands: str = "band_gains_db", by: str = "station") -> DataFrame:
    """by, field, n, mean, p10, p50, p90, max of the fit fields for all presets ("all") and by station, and the mean of each band (band_00 and so on)."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields))
    band = F.transform(F.coalesce(bands, F.array().cast("array<double>")), lambda x, i: F.struct(F.concat(F.lit("band_"), F.lpad(i.cast("string"), 2, "0")).alias("field"), x.cast("double").alias("x")))
    entries = "array<struct<field:string,x:double>>"
    groups = F.array_distinct(F.array(F.lit("all"), F.coalesce(F.col(by).cast("string"), F.lit("unknown"))))
    long = presets.select(F.explode(groups).alias(by), F.concat(each.cast(entries), band.cast(entries)).alias("__x")).select(by, F.inline("__x"))
    is_band = F.col("field").startswith("band_")
    means = long.where(is_band).groupBy(by, "field").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    return distribution(long.where(~is_band), "x", [by, "field"]).unionByName(means, allowMissingColumns=True)


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin, low, high, n: half-open bins, the last one closed; values outside are dropped, empty bins stay."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    v, at = F.col(value), F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (v >= a) & ((v <= b) if i == len(edges) - 2 else (v < b))
        at = F.when(inside, i).otherwise(at)
    counts = df.select(at.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(bins).join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def beta_posteriors(pulls: DataFrame, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Per arm alpha, beta, mean, sd and observations, from successes and failures."""
    s = pulls.groupBy("arm").agg(F.sum("successes").alias("s"), F.sum("failures").alias("f"))
    a, b = F.col("s") + prior[0], F.col("f") + prior[1]
    return s.select("arm", a.alias("alpha"), b.alias("beta"), (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"), (F.col("s") + F.col("f")).alias("observations"))


def sample_arm(posteriors: DataFrame, seed: int) -> DataFrame:
    """posteriors (arm, alpha, beta) with theta, a draw from each arm's distribution, and chosen: the largest, the first arm at a tie.

    The draw hangs on the seed and the arm's name alone, so it is the same in any
    partitioning, and on a redo. The table has a row an arm.
    """

    @F.pandas_udf("double")
    def theta(arm: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
        rng = (np.random.default_rng([seed, zlib.crc32(str(a).encode())]) for a in arm)
        return pd.Series([r.beta(a, b) for r, a, b in zip(rng, alpha, beta, strict=True)], dtype=float)

    drawn = posteriors.withColumn("theta", theta(F.col("arm").cast("string"), "alpha", "beta"))
    best = drawn.agg(F.min(F.struct((-F.col("theta")).alias("t"), F.col("arm").alias("arm"))).alias("__best"))
    return drawn.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("arm") == F.col("__best.arm")).drop("__best")


def route_counts() -> list[Column]:
    return [F.count_if(F.col("route") == r).alias(r) for r in ("selected", "spillover", "dropped")]


def pull_summary(samples: DataFrame) -> DataFrame:
    """Per pull: rows by route and by reason (a map, without null reasons), and n, mean, p50 and p90 of the teacher's rate."""
    reasons = samples.where("reason is not null").groupBy("pull", "reason").agg(F.count(F.lit(1)).alias("k"))
    reasons = reasons.groupBy("pull").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "k")))).alias("reasons"))  # one entry a kind of reason
    counts = samples.groupBy("pull").agg(F.count(F.lit(1)).alias("n"), *route_counts())
    rates = percentiles(samples, "teacher", {"p50": 0.5, "p90": 0.9}, ["pull"]).select("pull", F.col("n").alias("n_rated"), "mean", "p50", "p90")
    none = F.create_map().cast("map<string,bigint>")
    return counts.join(rates, "pull").join(reasons, "pull", "left").withColumn("reasons", F.coalesce("reasons", none))


def running_totals(pulls: DataFrame) -> DataFrame:
    """Totals of routes up to each pull, and the posterior mean of selection then; pulls are few."""
    w = Window.orderBy("pull").rowsBetween(Window.unboundedPreceding, 0)
    out = pulls.select("pull", *(F.sum(c).over(w).alias(c) for c in ("selected", "spillover", "dropped")))
    return out.withColumn("posterior_mean", (F.col("selected") + 1) / (F.col("selected") + F.col("spillover") + F.col("dropped") + 2))
