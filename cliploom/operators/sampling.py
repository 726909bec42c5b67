"""Views, quotas, mixes, draws and set operations on manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions.draws import draw, order_key
from cliploom.operators.ranks import ranked
from cliploom.operators.splits import exact_sample

#: The fewest bins that the weights of a group are cut into.
BINS = 64
TIERS = ("gold", "silver", "adversarial", "rejected", "noise")


def expand_views(df: DataFrame, n: int, seed: str, key: str = "row_idx") -> DataFrame:
    """n copies of each row, with base_id, view_index and shuffle (a text to sort by)."""
    out = df.withColumn("view_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumns({"base_id": F.concat(F.lit("u"), F.lpad(F.col(key).cast("string"), 8, "0")), "shuffle": order_key(seed, F.col(key), F.col("view_index"))})


def category_distribution(pool: DataFrame, quotas: dict[str, float]) -> DataFrame:
    """category and share: quotas of present categories (scaled if over 1), the rest by weight."""
    spark = pool.sparkSession
    asked = spark.createDataFrame(list(quotas.items()), "category string, quota double")
    own = pool.groupBy("category").agg(F.sum("weight").alias("w")).join(F.broadcast(asked), "category", "left")
    whole = own.agg(F.coalesce(F.sum("quota"), F.lit(0.0)).alias("q"), F.sum(F.when(F.col("quota").isNull(), F.col("w"))).alias("rest"))
    left = F.greatest(F.lit(0.0), 1 - F.col("q"))
    share = F.when(F.col("quota").isNotNull(), F.col("quota") / F.greatest(F.lit(1.0), F.col("q"))).otherwise(F.col("w") / F.col("rest") * left)
    return own.crossJoin(F.broadcast(whole)).select("category", share.alias("share"))


def weighted_draw(requests: DataFrame, pool: DataFrame, seed: str, key: str, group: str, item: str) -> DataFrame:
    """For each request an item of its group, by weight; requests of groups without weight get none.

    Items are laid side by side by their running weights, and the whole stretch is cut
    into as many equal bins as the group has items, at least BINS. An item stands in each
    bin that it touches, so a request, which looks in one bin, meets two on average at
    most. Bins also spread the requests of a group with few items.
    """
    return drawn(requests.withColumn("__u", draw(seed, F.col(key))), weight_bins(pool, group, item), group).drop("__u")


def order_number(df: DataFrame, column: str) -> Column:
    """A number in the order of the column: itself, or the first six bytes of a text."""
    if dict(df.dtypes)[column] != "string":
        return F.col(column)
    return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")


def weight_bins(pool: DataFrame, group: str, item: str, weight: str = "weight") -> DataFrame:
    """pool with a row for each bin that an item touches, and the item's stretch (__low to __high of __total)."""
    own = ranked(pool.where(F.col(weight) > 0), [group], order_number(pool, item), [item], [weight])
    own = own.withColumns({"__high": F.col(f"upto_{weight}"), "__low": F.col(f"upto_{weight}") - F.col(weight), "__total": F.col(f"all_{weight}"), "__bins": F.greatest("group_rows", F.lit(BINS))})
    own = own.drop("rank", "group_rows", f"upto_{weight}", f"all_{weight}")
    # a little wider than the stretch, as divisions are rounded
    bin_of = lambda x, wider: F.least(F.floor(F.col(x) / F.col("__total") * F.col("__bins") * wider), F.col("__bins") - 1)
    return own.withColumn("__bin", F.explode(F.sequence(bin_of("__low", 1 - 1e-12), bin_of("__high", 1 + 1e-12))))


def drawn(asked: DataFrame, bins: DataFrame, group: str) -> DataFrame:
    """asked (with __u from 0 to 1) joined to the item of its group whose stretch holds __u."""
    sizes = bins.groupBy(group).agg(F.max("__bins").alias("__n"))
    asked = asked.join(sizes, group).withColumn("__bin", F.floor(F.col("__u") * F.col("__n")))
    inside = F.expr("__u * __total >= __low and __u * __total < __high")
    return asked.join(bins, [group, "__bin"]).where(inside).drop("__n", "__bin", "__bins", "__low", "__high", "__total")


def mix_ratio(real: DataFrame, other: DataFrame, share: float, seed: str, key: str) -> DataFrame:
    """The largest mix with this share of real rows, with is_real; the scarcer side fixes the total."""
    n_real, n_other = real.count(), other.count()
    k_real = min(n_real, int(n_other * share / (1 - share)))
    k_other = int(k_real * (1 - share) / share)
    return exact_sample(real, k_real, seed, key).withColumn("is_real", F.lit(True)).unionByName(exact_sample(other, k_other, seed, key).withColumn("is_real", F.lit(False)))


def mix_upsample(synthetic: DataFrame, real: DataFrame) -> DataFrame:
    """All synthetic rows once, and real rows repeated until they are about as many; copy counts from 0."""
    n, m = synthetic.count(), real.count()
    times = max(1, round(n / m)) if m else 1
    return synthetic.withColumn("copy", F.lit(0)).unionByName(real.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))))


def balanced_regions(parts: dict[str, DataFrame], n: int, seed: str, key: str) -> DataFrame:
    """Exactly n rows of each part with its name as region; fails where one is short."""
    out = None
    for name, df in parts.items():
        own = exact_sample(df, n, seed, key).withColumn("region", F.lit(name))
        if own.count() < n:
            raise ValueError(f"{name} has fewer than {n} rows")
        out = own if out is None else out.unionByName(own)
    return out


def random_holdout(df: DataFrame, fraction: float, seed: str, key: str) -> DataFrame:
    n = df.count()
    return exact_sample(df, -int(-n * max(fraction, 1 / n) // 1) if n else 0, seed, key)


def synthetic_for_real(real: DataFrame, synthetic: DataFrame, share: float, seed: str, key: str) -> DataFrame:
    """All real rows and as many gold and silver ones as give real rows this share, with origin."""
    k = round(real.count() * (1 / share - 1))
    good = exact_sample(synthetic.where(F.col("tier").isin("gold", "silver")), k, seed, key)
    return real.withColumn("origin", F.lit("real")).unionByName(good.withColumn("origin", F.lit("synthetic")))


def select_tiers(gated: DataFrame, wanted: list[str], cap: float, order: str) -> DataFrame:
    """Rows of the wanted tiers; adversarial rows, first by the order, up to the share cap of the result."""
    if unknown := set(wanted) - set(TIERS):
        raise ValueError(f"unknown tiers: {sorted(unknown)}")
    plain = gated.where(F.col("tier").isin([t for t in wanted if t != "adversarial"]))
    if "adversarial" not in wanted:
        return plain
    k = int(plain.count() * cap / (1 - cap))
    return plain.unionByName(first_rows(gated.where("tier = 'adversarial'"), k, order))


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The n rows that come first by a column which tells rows apart; only that column is ranked, in pieces."""
    bound = ranked(df.select(order), [], order_number(df, order), [order]).where(F.col("rank") <= n).agg(F.max(order).alias("__bound"))
    return df.crossJoin(F.broadcast(bound)).where(F.col(order) <= F.col("__bound")).drop("__bound")


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def best_trial(log: DataFrame) -> DataFrame:
    """The trial of highest reward without an error, the first at a tie."""
    return log.where(F.col("error").isNull()).orderBy(F.desc("reward"), "trial").limit(1)


def set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """part (missing: in a alone, extra: in b alone, common) and n, of distinct keys."""
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    parts = {"missing": F.col("b") == 0, "extra": F.col("a") == 0, "common": (F.col("a") == 1) & (F.col("b") == 1)}
    n = sides.agg(*(F.count_if(c).alias(k) for k, c in parts.items()))
    return n.select(F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col(k).alias("n")) for k in ("missing", "extra", "common")))).alias("x")).select("x.*")


def merge_runs(runs: dict[str, DataFrame], key: str) -> DataFrame:
    """All rows of the runs with the run's name; fails where two rows share a key. Missing columns are null."""
    out = None
    for name, df in runs.items():
        own = df.withColumn("run", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    twice = out.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][0]} is in two rows")
    return out
