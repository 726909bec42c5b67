"""Statistics of corpora and set-to-set fidelity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.draws import order_key
from cliploom.functions.waveform import CLIP_STATS
from cliploom.operators.ranks import percentiles, ranked
from cliploom.sources.shared import written


def wasserstein(df: DataFrame, value: str, in_a: str, by: list[str] = ()) -> DataFrame:
    """distance: of two sets in one table, along one axis, for each group of by.

    Values are counted first; the shares of both sets up to a value come from running
    sums over distinct values, which are exact for groups of any size.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__x")).agg(F.count_if(in_a).alias("a"), F.count_if(~F.col(in_a)).alias("b"))
    r = ranked(counts, by, F.col("__x"), [], ["a", "b"], previous=True)
    gap = F.abs(F.expr("try_divide(upto_a - a, all_a) - try_divide(upto_b - b, all_b)"))  # null where a set is empty
    step = F.when(F.col("previous").isNull(), gap * 0).otherwise(gap * (F.col("__x") - F.col("previous")))
    own = r.select(*by, step.alias("step"))
    return (own.groupBy(*by) if by else own).agg(F.sum("step").alias("distance"))


def stats_long(clips: DataFrame, stats: str = "stats", keep: list[str] = ()) -> DataFrame:
    """keep, stat, x: the seven clip statistics and the bands of the long-term spectrum of each clip that has any."""
    own = [F.struct(F.lit(n).alias("stat"), F.col(f"{stats}.{n}").alias("x")) for n in CLIP_STATS]
    bands = F.transform(f"{stats}.ltas_db", lambda x, i: F.struct(F.concat(F.lit("ltas_"), F.lpad(i.cast("string"), 2, "0")).alias("stat"), x.alias("x")))
    return clips.where(F.col(f"{stats}.duration").isNotNull()).select(*keep, F.inline(F.concat(F.array(*own), bands)))


def channel_set_stats(clips: DataFrame, by: list[str], stats: str = "stats") -> DataFrame:
    """by, stat, n, mean, p10, p50, p90 of the seven clip statistics, and n and mean of each band of the spectrum (ltas_00 and so on)."""
    long = stats_long(clips, stats, by)
    is_band = F.col("stat").startswith("ltas_")
    seven = percentiles(long.where(~is_band), "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, [*by, "stat"]).drop("max")
    bands = long.where(is_band).groupBy(*by, "stat").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    return seven.unionByName(bands, allowMissingColumns=True)


def compare_sets(clips: DataFrame, is_real: str, stats: str = "stats") -> DataFrame:
    """A row for each clip statistic: distance of the two sets, normalized by the real p90 - p10, the other set's median, the real p10 and p90, and whether it lies within.

    The row ltas has the mean absolute gap of the mean spectra as distance; the row all
    tells whether all medians lie within. The long form is written, as it is read twice.
    """
    long = written(stats_long(clips, stats, [is_real]), "stats")
    seven = long.where(~F.col("stat").startswith("ltas_"))
    distances = wasserstein(seven, "x", is_real, ["stat"])
    shares = percentiles(seven, "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, [is_real, "stat"])
    of = lambda real, name: F.max(F.when(F.col(is_real) == real, F.col(name)))
    shares = shares.groupBy("stat").agg(of(False, "p50").alias("p50"), of(True, "p10").alias("real_p10"), of(True, "p90").alias("real_p90"))
    spread = F.col("real_p90") - F.col("real_p10")
    rows = distances.join(shares, "stat").select(
        "stat", "distance", F.when(spread > 0, F.col("distance") / spread).alias("normalized"), "p50", "real_p10", "real_p90", F.col("p50").between(F.col("real_p10"), F.col("real_p90")).alias("in_range")
    )
    bands = long.where(F.col("stat").startswith("ltas_")).groupBy("stat").agg(*(F.avg(F.when(F.col(is_real) == r, F.col("x"))).alias(f"m{int(r)}") for r in (True, False)))
    gap = bands.agg(F.lit("ltas").alias("stat"), F.avg(F.abs(F.col("m1") - F.col("m0"))).alias("distance"))
    every = rows.agg(F.lit("all").alias("stat"), F.bool_and("in_range").alias("in_range"))
    return rows.unionByName(gap, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)


def measure_envelope(df: DataFrame, metric: str, report: str, value: str) -> DataFrame:
    """metric, p10, p90: the widest 10th and 90th percentiles over the reports."""
    each = percentiles(df, value, {"p10": 0.1, "p90": 0.9}, [metric, report])
    return each.groupBy(F.col(metric).alias("metric")).agg(F.min("p10").alias("p10"), F.max("p90").alias("p90"))


def mean_arrays(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Element-wise mean of arrays by group, one row per place."""
    return df.select(*by, F.posexplode(column).alias("place", "x")).groupBy(*by, "place").agg(F.avg("x").alias("mean"))


def envelope_check(ranges: DataFrame, envelope: DataFrame, slack: float) -> DataFrame:
    """A finding for each side of a declared range (metric, low, high) beyond the envelope (metric, p10, p90) with slack."""
    x = ranges.join(F.broadcast(envelope), "metric")
    sides = F.array_compact(F.array(F.when(F.col("low") < F.col("p10") - slack, "low"), F.when(F.col("high") > F.col("p90") + slack, "high")))
    return x.select("metric", F.explode(sides).alias("side"))


def fidelity_verdict(discard: DataFrame, compared: DataFrame, probe: DataFrame) -> DataFrame:
    """verdict: pass, fail, or incomplete where a part is missing."""
    d = discard.agg(F.max("rate").alias("rate"))
    c = compared.agg(F.bool_and("in_range").alias("in_range"))
    p = probe.agg(F.max("accuracy").alias("accuracy"))
    x = d.crossJoin(c).crossJoin(p)
    known = F.col("rate").isNotNull() & F.col("in_range").isNotNull() & F.col("accuracy").isNotNull()
    good = (F.col("rate") < 0.15) & F.col("in_range") & (F.col("accuracy") <= 0.65)
    return x.withColumn("verdict", F.when(~known, "incomplete").when(good, "pass").otherwise("fail"))


def frechet(df: DataFrame, vector: str, in_a: str) -> DataFrame:
    """Distance of two Gaussians fitted to the sets; tasks hand on sums of x and of its outer product."""

    def sums(batches):
        for pdf in batches:
            for side, own in pdf.groupby(in_a):
                x = np.stack(own[vector].to_numpy()).astype(float)
                yield pd.DataFrame({"side": [bool(side)], "n": [len(x)], "s": [x.sum(0)], "q": [(x.T @ x).ravel()]})

    parts = df.select(vector, in_a).mapInPandas(sums, "side boolean, n long, s array<double>, q array<double>")
    long = parts.select("side", "n", F.posexplode(F.concat("s", "q")).alias("place", "x")).groupBy("side", "place").agg(F.sum("x").alias("x"))
    rows = long.groupBy("side").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("v")).join(parts.groupBy("side").agg(F.sum("n").alias("n")), "side")

    def distance(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = {}
        for _, r in pdf.iterrows():
            v = np.array([x["x"] for x in r["v"]])
            d = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
            mean = v[:d] / r["n"]
            fit[r["side"]] = mean, (v[d:].reshape(d, d) / r["n"] - np.outer(mean, mean)) * r["n"] / (r["n"] - 1), r["n"]
        if len(fit) < 2:
            return pd.DataFrame({"distance": [None], "reliable": [False]})
        (m, s, n), (m2, s2, n2) = fit[True], fit[False]
        w, v = np.linalg.eigh(s)
        root = v @ np.diag(np.sqrt(np.maximum(w, 0))) @ v.T
        cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ s2 @ root), 0)).sum()
        return pd.DataFrame({"distance": [float(((m - m2) ** 2).sum() + np.trace(s) + np.trace(s2) - 2 * cross)], "reliable": [min(n, n2) > 2 * len(m)]})

    return rows.groupBy().applyInPandas(distance, "distance double, reliable boolean")


def kid(df: DataFrame, vector: str, in_a: str, key: str, subsets: int = 20, size: int = 50, seed: str = "kid") -> DataFrame:
    """Mean and deviation over subsets of the unbiased cubic-polynomial discrepancy; subsets are drawn by hash."""
    n = F.explode(F.sequence(F.lit(0), F.lit(subsets - 1))).alias("subset")
    each = df.select(key, in_a).select(key, in_a, n)
    w = Window.partitionBy("subset", in_a).orderBy(order_key(seed, F.col("subset"), F.col(key)), key)
    drawn = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size).join(df.select(key, vector), key)

    def mmd(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x, y = (np.stack(pdf.loc[pdf[in_a] == s, vector].to_numpy()).astype(float) for s in (True, False))
        k = lambda p, q: (p @ q.T / p.shape[1] + 1) ** 3
        xx, yy, xy = k(x, x), k(y, y), k(x, y)
        off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
        return pd.DataFrame({"mmd": [off(xx) + off(yy) - 2 * xy.mean()]})

    return drawn.groupBy("subset").applyInPandas(mmd, "mmd double").agg(F.avg("mmd").alias("mean"), F.stddev_pop("mmd").alias("std"))


def validation_folds(blocks: DataFrame, least: int) -> DataFrame:
    """blocks (block_id, n) with fold: a block of enough clips is a fold, the others are pooled.

    A pool of one clip, which can't be compared, joins the fold of the first name;
    without any fold all blocks are one pool.
    """
    big = F.col("n") >= least
    whole = blocks.agg(F.sum(F.when(~big, F.col("n"))).alias("__pool"), F.min(F.when(big, F.col("block_id"))).alias("__first"))
    df = blocks.crossJoin(F.broadcast(whole))
    pool = F.when((F.col("__pool") == 1) & F.col("__first").isNotNull(), F.col("__first")).otherwise(F.lit("pool"))
    return df.withColumn("fold", F.when(big, F.col("block_id")).otherwise(pool)).drop("__pool", "__first")


def select_candidate(evals: DataFrame) -> DataFrame:
    """Of gate-passing steps the one of lowest mean over folds, then the earliest whose paired difference to it is within its standard error."""
    ok = evals.where("gates_ok")
    best = ok.groupBy("step").agg(F.avg("value").alias("mean")).orderBy("mean", "step").limit(1).select(F.col("step").alias("best"))
    own = ok.join(F.broadcast(best), F.col("step") == F.col("best")).select("fold", "best", F.col("value").alias("best_value"))
    d = ok.join(own, "fold").withColumn("d", F.col("value") - F.col("best_value")).groupBy("step").agg(F.avg("d").alias("diff"), (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return d.where("diff <= coalesce(se, 0) or diff = 0").orderBy("step").limit(1).select("step", "diff")


class Probes:
    """Logistic probes for all layers, both tasks (the sets; halves of one set) and all folds, fitted together.

    Every pass over the rows gives sums of the size of the models, which tasks add up by
    layer; only they reach the driver. A model is fitted on all folds but its own, on
    standardized features, with mean loss and an L2 penalty, by gradient steps of
    Barzilai and Borwein.
    """

    def __init__(self, rows: DataFrame, layers: int, folds: int, l2: float):
        self.rows, self.layers, self.folds, self.l2 = rows, layers, folds, l2

    def summed(self, of) -> list[np.ndarray]:
        """For each layer the sum over all rows of of(layer, x, known, y, fold): an array for x, and labels of both tasks."""
        n = self.layers

        def part(batches):
            total: list = [None] * n
            for pdf in batches:
                x = np.stack([np.stack(v) for v in pdf["layers"]]).astype(float) if len(pdf) else None
                if x is None:
                    continue
                y = np.stack([pdf["in_a"].to_numpy(), pdf["half"].to_numpy()])
                known, fold = np.stack([np.ones(len(pdf), bool), pdf["in_a"].to_numpy() == 1]), pdf["fold"].to_numpy()
                for k in range(n):
                    own = of(k, x[:, k], known, y, fold)
                    total[k] = own if total[k] is None else total[k] + own
            if any(t is not None for t in total):  # a task without rows has nothing to add
                yield pd.DataFrame({"layer": [k for k in range(n) if total[k] is not None], "total": [t.ravel() for t in total if t is not None]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:  # a row for each task that has rows
            return pd.DataFrame({"layer": [int(pdf["layer"].iloc[0])], "total": [np.sum(np.stack(pdf["total"].to_numpy()), axis=0)]})

        kind = "layer int, total array<double>"
        rows = self.rows.mapInPandas(part, kind).groupBy("layer").applyInPandas(add, kind).collect()  # a row a layer
        return [np.array(r["total"]) for r in sorted(rows, key=lambda r: r["layer"])]

    def moments(self) -> None:
        folds = self.folds

        def of(k, x, known, y, fold):
            both = np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)
            return np.stack([[both[m & (fold == f)].sum(0) for f in range(folds)] for m in known])

        own = np.stack([t.reshape(2, folds, -1) for t in self.summed(of)])
        train = own.sum(2, keepdims=True) - own  # layer, task, fold, 1 + 2 * d
        d = (train.shape[-1] - 1) // 2
        self.n = np.maximum(train[..., :1], 1)
        self.mean = train[..., 1 : d + 1] / self.n
        spread = (train[..., d + 1 :] - self.n * self.mean**2) / np.maximum(self.n - 1, 1)
        self.sd = np.where(spread > 1e-12, np.sqrt(np.maximum(spread, 0)), 1.0)

    def in_rows(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and offsets for features as they are."""
        a = w[..., :-1] / self.sd
        return a, w[..., -1] - (self.mean * a).sum(-1)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        folds, (a, c) = self.folds, self.in_rows(w)

        def of(k, x, known, y, fold):
            out = []
            for t in range(2):
                off = 1 / (1 + np.exp(-np.clip(x @ a[k, t].T + c[k, t], -30, 30))) - y[t][:, None]
                off *= known[t][:, None] & (fold[:, None] != np.arange(folds))
                out.append(np.concatenate([off.T @ x, off.sum(0)[:, None]], axis=1))
            return np.stack(out)

        g = np.stack([t.reshape(2, folds, -1) for t in self.summed(of)]) / self.n
        inner = (g[..., :-1] - self.mean * g[..., -1:]) / self.sd + self.l2 * w[..., :-1]
        return np.concatenate([inner, g[..., -1:]], axis=-1)

    def fit(self, steps: int, tolerance: float = 1e-3) -> np.ndarray:
        self.moments()
        w = np.zeros((*self.mean.shape[:-1], self.mean.shape[-1] + 1))
        g, rate = self.gradient(w), 0.5
        for _ in range(steps):
            if np.abs(g).max(initial=0) < tolerance:
                break
            new = w - rate * g
            after = self.gradient(new)
            s, y = new - w, after - g
            rate = np.clip((s * s).sum(-1, keepdims=True) / np.maximum((s * y).sum(-1, keepdims=True), 1e-12), 1e-2, 50.0)
            w, g = new, after
        return w

    def hits(self, w: np.ndarray) -> np.ndarray:
        """By layer, task and class: rows, and rows that the model without their fold gets right."""
        a, c = self.in_rows(w)

        def of(k, x, known, y, fold):
            said = np.stack([(x * a[k, t][fold]).sum(1) + c[k, t][fold] > 0 for t in range(2)])
            return np.array([[[(m := known[t] & (y[t] == v)).sum(), (m & (said[t] == v)).sum()] for v in (0, 1)] for t in range(2)], float)

        return np.stack([t.reshape(2, 2, 2) for t in self.summed(of)])


def separability_probe(df: DataFrame, vector: str, in_a: str, key: str, folds: int = 5, seed: str = "probe", steps: int = 60) -> DataFrame:
    """layer, accuracy (balanced, over held-out folds), verdict, and null (of a split of one set in half, which nothing should tell apart).

    vector is an array for one layer, or an array of arrays for a stack of layers, which
    are fitted together. Accuracies are null where a class has no rows.
    """
    spark = df.sparkSession
    stack = F.col(vector) if dict(df.dtypes)[vector].startswith("array<array") else F.array(vector)
    number = lambda *parts: F.conv(F.substring(order_key(seed, *parts, F.col(key)), 1, 8), 16, 10).cast("long")
    own = df.where(F.col(vector).isNotNull()).select(stack.alias("layers"), F.col(in_a).cast("int").alias("in_a"), (number() % folds).cast("int").alias("fold"), (number(F.lit("half")) % 2).cast("int").alias("half"))
    rows = written(own, "probe")
    kind = "layer int, accuracy double, `null` double, verdict string"
    first = rows.select(F.size("layers")).first()
    if not first:
        return spark.createDataFrame([], kind)
    probes = Probes(rows, first[0], folds, 0.01)
    hits = probes.hits(probes.fit(steps))
    out = []
    for k, tasks in enumerate(hits):
        accuracy, null = (float((t[:, 1] / t[:, 0]).mean()) if t[:, 0].all() else None for t in tasks)
        verdict = None if accuracy is None else "separable" if accuracy > 0.65 else "unclear" if accuracy > 0.55 else "alike"
        out.append((k, accuracy, null, verdict))
    return spark.createDataFrame(out, kind)


def cohort_ltas(df: DataFrame, samples: str, cohort: str, frame: int, points: int = 16) -> DataFrame:
    """cohort, place, db: each clip's power spectrum over its power, averaged, in dB of the peak, at evenly spaced points."""
    from cliploom.functions.waveform import spectrum

    @F.pandas_udf("array<double>")
    def shares(x: pd.Series) -> pd.Series:
        def one(v) -> list:
            p = spectrum(v, frame)
            return (p / max(p.sum(), 1e-12)).tolist()

        return x.map(one)

    mean = df.select(cohort, F.posexplode(shares(samples)).alias("place", "p")).groupBy(cohort, "place").agg(F.avg("p").alias("p"))

    def at_points(pdf: pd.DataFrame) -> pd.DataFrame:  # a row for each frequency of one cohort
        pdf = pdf.sort_values("place")
        db = 10 * np.log10(np.maximum(pdf["p"].to_numpy() / pdf["p"].max(), 1e-12))
        at = np.linspace(0, len(db) - 1, points)
        return pd.DataFrame({cohort: pdf[cohort].iloc[0], "place": np.arange(points), "db": np.interp(at, np.arange(len(db)), db)})

    kind = dict(df.dtypes)[cohort]
    return mean.groupBy(cohort).applyInPandas(at_points, f"{cohort} {kind}, place int, db double")
