"""Ranks, running sums, percentiles, draws and distances of groups of any size, against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.operators import fidelity as D
from cliploom.operators import ranks
from cliploom.operators import sampling as P
from cliploom.operators import splits as S


@pytest.fixture(params=[(100, 5_000), (7, 3)])
def cuts(request, monkeypatch):
    """With all groups cut into pieces, and with the large ones alone."""
    monkeypatch.setattr(ranks, "PIECES", request.param[0])
    monkeypatch.setattr(ranks, "SHARE", request.param[1])


def rows(n=3000):
    rnd = random.Random(2)
    groups = ["hot"] * 60 + ["b", "c", None]
    return [(i, rnd.choice(groups), None if i % 97 == 0 else float(rnd.randrange(50) if i % 3 else 7), rnd.randrange(4)) for i in range(n)]


def test_ranked(spark, cuts):
    data = rows()
    df = spark.createDataFrame(data, "id long, g string, x double, w int").repartition(5)
    got = {r.id: r for r in ranks.ranked(df, ["g"], F.col("x"), ["id"], ["w"], previous=True).collect()}
    assert len(got) == len(data)
    by_group = defaultdict(list)
    for r in data:
        by_group[r[1]].append(r)
    for own in by_group.values():
        own.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        total = 0
        for k, (i, _, _, w) in enumerate(own):
            total += w
            r = got[i]
            assert (r["rank"], r.group_rows, r.upto_w, r.all_w) == (k + 1, len(own), total, sum(x[3] for x in own))
            assert r.previous == (own[k - 1][2] if k else None)
    assert ranks.ranked(df.limit(0), ["g"], F.col("x"), ["id"]).count() == 0


def test_percentiles(spark, cuts):
    data = rows()
    df = spark.createDataFrame(data, "id long, g string, x double, w int").repartition(3)
    shares = {"low": 0.0, "p10": 0.1, "p37": 0.37, "p50": 0.5, "high": 1.0}
    for by in (["g"], []):
        for r in ranks.percentiles(df, "x", shares, by).collect():
            own = [x for _, g, x, _ in data if x is not None and (not by or g == r.g)]
            assert r.n == len(own) and r.mean == pytest.approx(np.mean(own)) and r["max"] == max(own)
            for name, q in shares.items():
                assert r[name] == pytest.approx(np.percentile(own, 100 * q))
    none = ranks.percentiles(df.where("x is null").limit(3), "x", shares).first()
    assert (none.n, none.mean, none.p50) == (0, None, None)
    assert ranks.percentiles(df.limit(0), "x", shares).first().n == 0
    assert ranks.percentiles(df.limit(0), "x", shares, ["g"]).count() == 0


def test_wasserstein(spark, cuts):
    data = [r for r in rows(800) if r[1]]
    df = spark.createDataFrame(data, "id long, g string, x double, w int").withColumn("in_a", F.col("w") > 1)
    got = {r.g: r.distance for r in D.wasserstein(df, "x", "in_a", ["g"]).collect()}
    for g, distance in got.items():
        a, b = ([x for _, h, x, w in data if h == g and x is not None and (w > 1) == s] for s in (True, False))
        values = sorted({*a, *b})
        share = lambda xs, v: sum(x <= v for x in xs) / len(xs)
        assert distance == pytest.approx(sum(abs(share(a, v) - share(b, v)) * (after - v) for v, after in zip(values, values[1:], strict=False)))
    assert D.wasserstein(df.where("w > 1"), "x", "in_a").first().distance is None


def test_weighted_draws_meet_few_items_and_the_right_one(spark, cuts):
    items = [("a", i, 1000.0 if i == 0 else 0.01) for i in range(300)] + [("b", 0, 2.0)] + [("c", 1, 0.0)]
    pool = spark.createDataFrame(items, "grp string, item long, weight double")
    asked = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(4000)] + [(9999, "c"), (9998, None)], "id long, grp string")
    got = P.weighted_draw(asked, pool, "s", "id", "grp", "item").collect()
    assert sorted(r.id for r in got) == list(range(4000))
    chosen = Counter((r.grp, r.item) for r in got)
    assert chosen["b", 0] == 2000 and abs(chosen["a", 0] / 2000 - 1000 / 1002.99) < 0.01
    bins = P.weight_bins(pool, "grp", "item")
    assert bins.where("grp = 'a'").count() <= 2 * 300 + 2
    top = bins.groupBy("grp", "__bin").count().agg(F.max("count")).first()[0]
    assert top <= 301


def test_first_rows_and_holdouts(spark, cuts):
    df = spark.createDataFrame([(7 * i % 1000, "hot" if i % 50 else "cold") for i in range(1000)], "row_idx long, station string")
    assert sorted(r.row_idx for r in P.first_rows(df, 25, "row_idx").collect()) == list(range(25))
    assert P.first_rows(df, 0, "row_idx").count() == 0
    held = S.group_holdout(df, "station", 0.1, "s", "row_idx")
    assert held.columns == ["row_idx", "station", "held_out"]
    assert {r.station: r.n for r in held.where("held_out").groupBy("station").agg(F.count("*").alias("n")).collect()} == {"hot": 98, "cold": 2}
