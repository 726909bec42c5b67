"""Joins of manifests, transcripts, views, metrics and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.draws import order_key
from cliploom.functions.text import relocated
from cliploom.operators.ranks import ranked
from cliploom.operators.sampling import order_number


def clean_label_reason(text: Column, suspect: Column) -> Column:
    """Why a label can't be used, the first reason; null for a clean one."""
    return F.when(suspect, "suspect").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(F.trim(text).rlike(r"^\[.*\]$"), "bracket")


def join_transcripts(clips: DataFrame, snapshot: DataFrame, renames: DataFrame) -> DataFrame:
    """Snapshot rows (audio, text, suspect) with clip (direct, or by a rename from old to new) and outcome; the first clean row of a clip is kept."""
    names = clips.select(F.col("clip").alias("audio"), F.col("clip").alias("direct")).distinct()
    moved = renames.join(clips.select(F.col("clip").alias("new")).distinct(), "new").select(F.col("old").alias("audio"), F.col("new").alias("renamed"))
    out = snapshot.join(names, "audio", "left").join(moved, "audio", "left").withColumn("clip", F.coalesce("direct", "renamed"))
    reason = F.coalesce(clean_label_reason(F.col("text"), F.col("suspect")), F.when(F.col("clip").isNull(), "no_local_audio"))
    out = out.withColumn("__reason", reason).withColumn("__r", F.row_number().over(Window.partitionBy("clip", F.col("__reason").isNull()).orderBy("row_idx")))
    outcome = F.coalesce("__reason", F.when(F.col("__r") > 1, "duplicate"), F.when(F.col("direct").isNotNull(), "direct"), F.lit("renamed"))
    return out.withColumn("outcome", outcome).drop("direct", "renamed", "__reason", "__r")


def tally(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def join_tiers_exact(rows: DataFrame, gated: DataFrame) -> DataFrame:
    """Problems of attaching tiers by audio: key and problem; no row means that the join is exact."""
    twice = lambda df, side: df.groupBy("audio").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("audio", F.lit(f"duplicate_{side}").alias("problem"))
    speech = rows.where("text <> ''")
    return (
        twice(rows, "row")
        .unionByName(twice(gated, "gated"))
        .unionByName(gated.where(~F.col("tier").isin("gold", "silver", "adversarial", "rejected")).select("audio", F.lit("invalid_tier").alias("problem")))
        .unionByName(speech.join(gated, "audio", "left_anti").select("audio", F.lit("missing").alias("problem")))
        .unionByName(gated.join(speech, "audio", "left_anti").select("audio", F.lit("extra").alias("problem")))
    )


def with_tiers(rows: DataFrame, gated: DataFrame) -> DataFrame:
    return rows.join(gated.select("audio", "tier"), "audio", "left").withColumn("tier", F.when(F.col("text") == "", "noise").otherwise(F.col("tier")))


def audit_leakage(corpus: DataFrame, artifacts: DataFrame, allowed: str = "channel_train") -> DataFrame:
    """All failures: artifacts (name, clip_id, split, digest) whose clip is unknown or in another split, whose own label differs, or whose digest isn't the clip's."""
    both = artifacts.join(corpus.select("clip_id", F.col("split").alias("clip_split"), F.col("digest").alias("clip_digest")), "clip_id", "left")
    checks = [
        F.when(F.col("clip_split").isNull(), "unknown_clip").when(F.col("clip_split") != allowed, "clip_outside_split"),
        F.when(F.coalesce(F.col("split") != allowed, F.lit(True)), "own_label"),
        F.when(F.col("digest") != F.col("clip_digest"), "digest"),
    ]
    return both.select("name", "clip_id", F.explode(F.array_compact(F.array(*checks))).alias("failure"))


def common_support(views: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys in every view; fails where a key occurs twice in one."""
    parts = [df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("view", F.lit(v)) for v, df in views.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    kept = whole.groupBy(key).agg(F.count(F.lit(1)).alias("views"), F.max("n").alias("most"))
    return kept.where((F.col("views") == len(views)) & F.when(F.col("most") > 1, F.raise_error(F.lit("a key occurs twice in a view")).cast("boolean")).otherwise(True)).select(key)


def align_views(base: DataFrame, derived: DataFrame, key: str, digest: str) -> DataFrame:
    """Mismatches by full outer join: missing, extra, repeated or other digest."""
    d = derived.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first(digest).alias("__d"))
    both = base.select(key, F.col(digest).alias("__b")).join(d, key, "full")
    why = F.when(F.col("n").isNull(), "missing").when(F.col("__b").isNull(), "extra").when(F.col("n") > 1, "repeated").when(F.col("__b") != F.col("__d"), "digest")
    return both.select(key, why.alias("mismatch")).where("mismatch is not null")


def multiset_match(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, in_a, in_b: the k-th occurrence of a key on one side matches the k-th on the other.

    Both sides are counted, and numbers made from the counts, so a frequent key is no large group.
    """
    marked = a.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    n = marked.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = n.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest("a", "b").cast("int"))))
    return n.select(*keys, "k", (F.col("k") <= F.col("a")).alias("in_a"), (F.col("k") <= F.col("b")).alias("in_b"))


def overlapping(ranges: DataFrame) -> DataFrame:
    """Pairs of named half-open ranges (name, start, stop; null stop is open) that overlap; empty ranges overlap nothing.

    Ranges are cut at multiples of their mean length and joined by part; a pair counts in
    the part where its overlap begins. Parts are at most about twice as many as ranges.
    """
    top = ranges.agg(F.max(F.greatest(F.col("start") + 1, "stop")).alias("top"))
    closed = ranges.crossJoin(F.broadcast(top)).select("name", "start", F.coalesce("stop", "top").alias("stop")).where("stop > start")
    width = closed.agg(F.ceil(F.avg(F.col("stop") - F.col("start"))).alias("width"))  # one row
    closed = closed.crossJoin(F.broadcast(width))
    cut = closed.withColumn("part", F.explode(F.expr("sequence(start div width, (stop - 1) div width)")))
    other = cut.select("part", *(F.col(c).alias(f"{c}2") for c in ("name", "start", "stop")))
    both = cut.join(other, "part").where("name < name2 and start < stop2 and start2 < stop and part = greatest(start, start2) div width")
    return both.select("name", F.col("name2").alias("other"))


#: Ranges that are broadcast at most.
FEW_RANGES = 10_000


def window_cover(rows: DataFrame, ranges: DataFrame, index: str) -> DataFrame:
    """rows with the name of the range that covers their index (null if none); ranges don't overlap.

    Up to FEW_RANGES ranges are broadcast. More are sorted in among the rows: a row takes
    the last start before it, which is exact as ranges don't overlap.
    """
    if len(ranges.take(FEW_RANGES + 1)) <= FEW_RANGES:
        cover = (F.col(index) >= F.col("start")) & (F.col("stop").isNull() | (F.col(index) < F.col("stop")))
        return rows.join(F.broadcast(ranges), cover, "left").drop("start", "stop")
    extra = [c for c in ranges.columns if c not in ("start", "stop")]
    width = ranges.agg(F.max("start") - F.min("start")).first()[0] // FEW_RANGES + 1
    at = lambda c: F.floor(c / width)  # noqa: E731  stretches of the index; a range stands in the stretch of its start
    starts = ranges.select(F.col("start").alias("__at"), F.struct("start", "stop", *extra).alias("__range"))
    both = rows.select(F.col(index).alias("__at"), F.struct("*").alias("__row")).unionByName(starts, allowMissingColumns=True).withColumn("__part", at(F.col("__at")))
    last = starts.groupBy((at(F.col("__at"))).alias("__part")).agg(F.max_by("__range", "__at").alias("__last"))
    parts = both.select("__part").distinct().join(last, "__part", "left")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch, about FEW_RANGES
    parts = parts.select("__part", F.last("__last", ignorenulls=True).over(before).alias("__before"))
    order = Window.partitionBy("__part").orderBy("__at", F.col("__range").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__own", F.last("__range", ignorenulls=True).over(order)).join(parts, "__part").where("__row is not null")
    own = F.coalesce("__own", "__before")
    inside = own["stop"].isNull() | (F.col("__at") < own["stop"])
    return both.select("__row.*", *(F.when(inside, own[c]).alias(c) for c in extra))


def diff_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric, old, new, delta (null if either is missing)."""
    both = old.select("metric", F.col("value").alias("old")).join(new.select("metric", F.col("value").alias("new")), "metric", "full")
    return both.withColumn("delta", F.col("new") - F.col("old"))


def pair_hypotheses(a: DataFrame, b: DataFrame, index: str = "index", reference: str = "reference") -> DataFrame:
    """Rows of a with the other columns of b of the same index, where both have the same reference with text.

    Rows meet by their index; of b's reference only a hash is shuffled.
    """
    other = b.withColumn("__same", F.sha2(reference, 256)).drop(reference)
    return a.where(F.trim(reference) != "").join(other, index).where(F.sha2(reference, 256) == F.col("__same")).drop("__same")


def missing_audio(manifest: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    return manifest.join(listing.select(key).distinct(), key, "left_anti")


def relocate_paths(df: DataFrame, source: str, target: str, columns: list[str]) -> DataFrame:
    """df with the paths of these columns under another prefix, in plain slashes."""
    return df.withColumns({c: relocated(F.col(c), source, target) for c in columns})


def missing_targets(df: DataFrame, listing: DataFrame, columns: list[str], path: str = "path") -> DataFrame:
    """column, path and n of the paths in these columns that the listing lacks; nulls aren't paths."""
    each = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("__p")) for c in columns)))).where("__p is not null")
    counts = each.groupBy("column", "__p").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(listing.select(F.col(path).alias("__p")).distinct(), "__p", "left_anti").select("column", F.col("__p").alias("path"), "n")


def pair_noise(presets: DataFrame, noise: DataFrame, share_other: float, draw: Column) -> DataFrame:
    """For each preset (name, station) a noise segment by slot: of its station, with this probability of the next one; of any where there is none."""
    slots = ranked(noise, ["station"], order_number(noise, "segment"), ["segment"]).withColumns({"slot": F.col("rank") - 1, "many": F.col("group_rows")})
    sizes = slots.groupBy("station").agg(F.first("many").alias("many"))
    order = sizes.withColumns({"next": F.coalesce(F.lead("station").over(Window.orderBy("station")), F.min("station").over(Window.partitionBy(F.lit(1))))})
    fallback = sizes.agg(F.min("station").alias("any"))
    p = presets.join(order.select("station", "next"), "station", "left").crossJoin(F.broadcast(fallback)).withColumn("u", draw)
    p = p.withColumn("from_station", F.when(F.col("next").isNull(), F.col("any")).when(F.col("u") < share_other, F.col("next")).otherwise(F.col("station")))
    p = p.join(sizes.select(F.col("station").alias("from_station"), "many"), "from_station").withColumn("slot", F.conv(F.substring(order_key("slot", F.col("name")), 1, 8), 16, 10).cast("long") % F.col("many"))
    return p.join(slots.select(F.col("station").alias("from_station"), "slot", "segment"), ["from_station", "slot"]).select("name", "station", "from_station", "segment")
