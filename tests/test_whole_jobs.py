"""Queries that once left a part of their table out."""

from cliploom.plans import views as V
from cliploom.plans.catalog import QUERIES


def test_cap_per_station_has_every_station(spark, sf_dir):
    want = {r.station: min(r["count"], 100) for r in V.clips(spark, sf_dir).groupBy("station").count().collect()}
    got = {r.station: r["count"] for r in QUERIES["WIN-6"](spark, sf_dir).groupBy("station").count().collect()}
    assert len(want) == 6 and got == want


def test_balanced_regions_hold_200_rows_of_every_category(spark, sf_dir):
    categories = {r.category for r in V.radio(spark, sf_dir).select("category").distinct().collect()}
    got = {r.region: r["count"] for r in QUERIES["SMP-8"](spark, sf_dir).groupBy("region").count().collect()}
    assert got == dict.fromkeys(categories, 200) and len(categories) == 3
