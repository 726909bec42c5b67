"""Slots of teachers against labels by row: multisets, asserted slots, scores and label checks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cliploom.functions import entities as E
from cliploom.operators import corpus as C
from cliploom.operators import gate as G

AIR = {"bluewing": "BLW"}
SLOT = "array<struct<type:string,value:string,spoken:string,critical:boolean>>"


def judged(spark, label, teachers):
    """Verdicts of one row; teachers map names to entities and asserted slots, given as (type, value)."""
    slot = lambda x: (*x, "", x[0] in E.CRITICAL)
    t = [(n, [slot(x) for x in e], [slot(x) for x in a]) for n, (e, a) in teachers.items()]
    df = spark.createDataFrame([([slot(x) for x in label], t)], f"entities {SLOT}, teachers array<struct<teacher:string,entities:{SLOT},asserted:{SLOT}>>")
    return G.verify_entities(df).first()


def both(*slots):
    return list(slots), list(slots)


H, F1, F2 = ("heading", "090"), ("flight_level", "FL340"), ("flight_level", "FL030")
CASES = [
    ([("callsign", "BLW123")], {"a": both(("callsign", "BLW1")), "b": both(("callsign", "BLW1"))}, ["substituted"], 0.0),
    ([H], {"a": both(H), "b": both(("heading", "080"))}, ["verified"], 1.0),
    ([H], {"a": both(), "b": both()}, ["missed"], 0.0),
    # a slot that only the normalized text gives doesn't count against the label
    ([F1], {"a": ([F2], []), "b": ([F2], [])}, ["missed"], 0.0),
    ([F1], {"a": ([F2], [F2]), "b": ([F2], [])}, ["substituted"], 0.0),
    ([F1], {"a": ([F1], []), "b": both(F2)}, ["verified"], 1.0),
    # one teacher asserts a value of the label, so not all stray
    ([("runway", "24L"), ("runway", "07R")], {"a": both(("runway", "24L"))}, ["verified", "missed"], 0.5),
    ([H, H], {"a": both(H)}, ["verified", "missed"], 0.5),
    ([H, H], {"a": both(H, H)}, ["verified", "verified"], 1.0),
    ([H, H], {"a": both(H), "b": both(H)}, ["verified", "missed"], 0.5),
    ([("callsign", "BLW1"), ("waypoint", "LOMKI")], {"a": both(("callsign", "BLW1"), ("waypoint", "PADKA"))}, ["verified", "substituted"], 1.0),
    ([], {"a": both(H)}, [], 1.0),
]


@pytest.mark.parametrize("label,teachers,want,recall", CASES)
def test_verdicts(spark, label, teachers, want, recall):
    r = judged(spark, label, teachers)
    assert [v.verdict for v in r.verdicts] == want and r.recall == recall
    assert all(bool(v.heard) == (v.verdict == "substituted") for v in r.verdicts)


def test_heard_and_verified_by(spark):
    r = judged(spark, [H, F1], {"a": both(("heading", "100"), ("heading", "080"), F1), "b": both(F1)})
    assert [(h.teacher, h["values"]) for h in r.verdicts[0].heard] == [("a", ["080", "100"])]
    assert r.verdicts[1].verified_by == ["a", "b"]


def test_both_renderings_of_a_hypothesis(spark):
    texts = ["Contact Praha 127.825, squawk 471.1", "descend to flight level 3.0", None, "bluewing one two, heading 090 heading 090"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    got = {r.i: r.teachers[0] for r in G.teacher_slots(df, {"t": "raw"}, AIR).collect()}
    keys = lambda slots: [(s.type, s.value) for s in slots]
    assert set(keys(got[0].entities)) == {("frequency", "127.825"), ("squawk", "4711")} and keys(got[0].asserted) == [("frequency", "127.825")]
    assert keys(got[1].entities) == [("flight_level", "FL030")] and got[1].asserted == []
    assert got[2].entities == [] and got[2].hyp == "" and got[2].words == 0
    assert keys(got[3].entities) == [("callsign", "BLW12"), ("heading", "090")] and len(got[3].asserted) == 3


def test_no_exchange_before_tiers(spark):
    df = spark.createDataFrame([(1, "heading zero nine zero", "heading 090")], "row_idx long, text string, t1 string").withColumn("entities", E.extract_entities(AIR)("text"))
    gated = G.tier_rows(G.with_best_teacher(G.verify_entities(G.teacher_slots(df, {"t1": "t1"}, AIR))).withColumn("audio_ok", F.lit(True)))
    plan = gated._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") <= 2
    assert gated.first().best_wer == 1.0  # no rate is given


def plain_scores(ref, hyp):
    out = {}
    for kind in {t for t, _ in ref + hyp}:
        a, b = (Counter(v for t, v in x if t == kind) for x in (ref, hyp))
        tp = sum((a & b).values())
        left, extra = sum(a.values()) - tp, sum(b.values()) - tp
        sub = min(left, extra)
        out[kind] = (tp, extra - sub, left - sub, sub)
    return out


def plain_diff(ref, hyp):
    out = []
    for kind in {t for t, _ in ref + hyp}:
        left, extra = [], [v for t, v in hyp if t == kind]
        for v in (v for t, v in ref if t == kind):
            if v in extra:
                extra.remove(v)
            else:
                left.append(v)
        # of equal values the first ones match, so the later ones are left
        a, b = list((Counter(v for t, v in ref if t == kind) - Counter(v for t, v in hyp if t == kind)).elements()), extra
        assert sorted(a) == sorted(left)
        out += [(kind, len(left), len(b))]
    return sorted(o for o in out if o[1] or o[2])


def test_scores_and_differences_of_random_slots(spark):
    rnd = random.Random(1)
    pick = lambda: [(rnd.choice(["heading", "speed"]), rnd.choice("123")) for _ in range(rnd.randrange(6))]
    pairs = [(pick(), pick()) for _ in range(300)]
    slots = lambda x: [(t, v, "", True) for t, v in x]
    df = spark.createDataFrame([(i, slots(a), slots(b)) for i, (a, b) in enumerate(pairs)], f"row_idx long, ref {SLOT}, hyp {SLOT}")
    for r in G.score_entities(df).collect():
        assert {s.type: (s.tp, s.fp, s.fn, s["sub"]) for s in r.scores} == plain_scores(*pairs[r.row_idx])
    for r in G.entity_diff(df).collect():
        for kind, left, extra in plain_diff(*pairs[r.row_idx]):
            own = [d for d in r["diff"] if d.type == kind]
            assert sum(d.ref_value is not None for d in own) == left and sum(d.hyp_value is not None for d in own) == extra
            assert sum(d.outcome == "substituted" for d in own) == min(left, extra)
    one = spark.createDataFrame([(1, slots([("speed", "1"), ("speed", "2"), ("speed", "1")]), slots([("speed", "3"), ("speed", "1")]))], f"row_idx long, ref {SLOT}, hyp {SLOT}")
    assert [(d.outcome, d.ref_value, d.hyp_value) for d in G.entity_diff(one).first()["diff"]] == [("substituted", "2", "3"), ("missed", "1", None)]


def test_labels(spark):
    slot = lambda t, v, s="": (t, v, s, True)
    rows = [
        (0, "bluewing one two heading zero nine zero", [slot("callsign", "BLW12"), slot("heading", "090", "zero nine zero")]),
        (1, "bluewing one two", [slot("heading", "090", "zero nine zero")]),
        (2, "direct to ralud", []),
        (3, "heading zero nine zero", [slot("heading", "999", ""), slot("nonsense", "1", "x")]),
        (4, None, None),
        (5, "heading zero nine zero heading zero nine zero", [slot("heading", "090")]),
    ]
    df = spark.createDataFrame(rows, f"i int, text string, entities {SLOT}")
    got = {r.i: sorted((p.type, p.value, p.problem) for p in r.problems) for r in C.validate_labels(df, AIR).collect()}
    assert got[0] == got[2] == got[4] == []
    assert got[1] == [("callsign", "BLW12", "unlabelled"), ("heading", "090", "lost"), ("heading", "090", "not_spoken")]
    assert got[3] == [("heading", "090", "unlabelled"), ("heading", "999", "lost"), ("heading", "999", "out_of_range"), ("nonsense", "1", "lost"), ("nonsense", "1", "unknown_type")]
    assert got[5] == [("heading", "090", "unlabelled")]


def test_text_records(spark):
    slot = "array<struct<type:string,value:string>>"
    rows = [(0, "x", 1.0, None, [("heading", "090")]), (1, " ", -1.0, "departure", [("heading", "9"), ("speed", None)]), (2, "y", None, None, None)]
    df = spark.createDataFrame(rows, f"i int, text string, weight double, category string, entities {slot}")
    got = {r.i: r for r in C.validate_text_records(df).collect()}
    assert got[0].problems == got[2].problems == [] and got[2].weight == 1.0
    assert (got[0].category, got[1].category, got[0].role, got[0].kind) == ("routine", "departure", "unknown", "external")
    assert got[1].problems == ["no_text", "weight", "entity_heading_malformed", "entity_speed_incomplete"]
    assert C.validate_text_records(df.where("i <> 1"), fail=True).count() == 2
    with pytest.raises(Exception, match="no_text, weight"):
        C.validate_text_records(df, fail=True).collect()
