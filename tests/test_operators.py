"""Small cases with known results."""

import io
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.functions import entities as E
from cliploom.functions import text as T
from cliploom.functions import waveform as W
from cliploom.operators.ingest import ingest_clips
from cliploom.operators import gate as G
from cliploom.operators import sampling as P
from cliploom.operators import splits as S
from cliploom.operators import wer
from cliploom.sources import readers as R
from cliploom.streaming import jobs as M


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    got = column(spark, ["X-Ray", "xray", "x-ray", "runway 35R!", "niner fife", "don't", None, ""], T.normalize_atc)
    assert got == ["x ray", "x ray", "x ray", "runway three five r", "nine five", "don't", "", ""]


def test_spoken_numbers(spark):
    assert column(spark, ["618", "2740", "902", "13", "8"], T.group_number_words) == ["six eighteen", "twenty seven forty", "nine zero two", "thirteen", "eight"]
    assert column(spark, ["9435"], lambda c: T.digits_to_words(c, radio=True)) == ["niner fower tree fife"]
    assert column(spark, [7600, 12000, 800, 0], T.feet_to_words, "int") == ["seven thousand six hundred", "one two thousand", "eight hundred", "zero"]


def test_tokens(spark):
    assert column(spark, ["Gate 31st x ray 119.35, ray"], T.tokenize_spoken) == [["gate", "31", "xray", "119.35", "ray"]]


def test_slots():
    air = {"bluewing": "BLW", "north coast": "NCO"}
    cases = {
        "north coast eight oh five reduce speed to two hundred ten": ["callsign NCO805", "altitude 210ft"][:1],
        "northcoast eight oh five, speed two one zero": ["callsign NCO805", "speed 210"],
        "bluewing four mike tango fly heading two niner five": ["callsign BLW4MT", "heading 295"],
        "bluewing seventy one heading four one zero": ["callsign BLW71"],
        "cirrus six two golf kilo maintain two thousand": ["callsign N62GK", "altitude 2000ft"],
        "north coast piper four four one": ["callsign N441"],
        "tower on one one eight decimal one": ["frequency 118.100"],
        "try 133.65 or one four one point five": ["frequency 133.650"],
        "passing level one four zero for level eight five zero": ["flight_level FL140"],
        "cleared to land rwy zero nine centre, runway three nine is closed": ["runway 09C"],
        "squawk seven five oh oh": ["squawk 7500"],
        "sqawk one eight one one": [],
        "qnh niner niner eight, altimeter two niner fife fower": ["altimeter Q998", "altimeter A2954"],
        "we have information whisky": ["atis W"],
        "proceed direct to velmi then overhead tower": ["waypoint VELMI", "waypoint TOWER"],
        "direct when able": [],
        "maintain one eight zero kts": ["speed 180"],
        "descending to one zero thousand": ["altitude 10000ft"],
        "four thousand six hundred and wind five knots": ["altitude 4600ft"],
        "at 2600 ft": ["altitude 2600ft"],
        "nought nought": [],
    }
    for text, want in cases.items():
        assert [f"{s['type']} {s['value']}" for s in E.slots_of(text, air)] == want, text
    (slot, *_) = E.slots_of("turn heading zero eight five now", air)
    assert slot["spoken"] == "zero eight five" and slot["critical"]
    assert E.slots_of("", air) == [] and E.slots_of(None, air) == []


def test_number_runs():
    assert [r[:] for r in E.scan("x one two three four five six seven eight nine zero one two y".split())] == [(1, 13, "123456789012", 123456789012)]
    assert [r[2:] for r in E.scan("six thousand four hundred and twenty two".split())] == [("", 6400), ("22", 22)]
    assert E.scan(["hundred", "and"]) == []


def test_alignment():
    assert wer.align([], ["roger"]) == (0, 0, 0, 1)
    assert wer.align("a b c".split(), "a x c".split()) == (2, 1, 0, 0)
    assert wer.align("a b c".split(), "a c".split()) == (2, 0, 1, 0)
    rnd = random.Random(0)
    for _ in range(200):
        a, b = (rnd.choices("abc", k=rnd.randrange(8)) for _ in range(2))
        h, s, d, i = wer.align(a, b)
        assert (h + s + d, h + s + i) == (len(a), len(b))
        row = list(range(len(b) + 1))
        for x in a:
            last, row = row, [row[0] + 1]
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        assert s + d + i == row[-1]


def test_identical_systems(spark):
    df = spark.createDataFrame([(i, 2, 2, 10) for i in range(30)], "row_idx long, errors_a long, errors_b long, ref_words long")
    r = wer.paired_bootstrap(df, 50).first()
    assert (r.delta, r.low, r.high, r.p) == (0, 0, 0, 1.0)
    one, many = (wer.paired_bootstrap(df.withColumn("errors_a", F.col("row_idx") % 4).repartition(n), 50).first() for n in (1, 7))
    assert [round(x, 12) for x in one] == [round(x, 12) for x in many]


def test_tiers(spark):
    rows = [(k, k / 14, 1.0, 0, True) for k in (3, 4, 7, 8, 12, 13)]
    df = spark.createDataFrame(rows, "k int, best_wer double, recall double, critical_substituted long, audio_ok boolean")
    got = {r.k: r.tier for r in G.tier_rows(df).collect()}
    assert got == {3: "gold", 4: "silver", 7: "silver", 8: "adversarial", 12: "adversarial", 13: "rejected"}


def test_noise(spark):
    w = spark.createDataFrame([(1, "a", 5), (1, "b", 0), (2, "a", 5), (2, "b", 4)], "row_idx long, teacher string, words int")
    assert {r.row_idx: r.rejected for r in G.noise_verdict(w).collect()} == {1: False, 2: True}
    assert all(r.rejected for r in G.noise_verdict(w, strict=True).collect())


def test_adversarial_cap(spark):
    df = spark.createDataFrame([(i, "gold" if i < 95 else "adversarial") for i in range(200)], "row_idx long, tier string")
    n = lambda cap: P.select_tiers(df, ["gold", "adversarial"], cap, "row_idx").where("tier = 'adversarial'").count()
    assert n(0.05) == 5 and n(0) == 0
    with pytest.raises(ValueError):
        P.select_tiers(df, ["bronze"], 0.05, "row_idx")


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_holdouts_do_not_depend_on_partitions(spark, parts):
    df = spark.createDataFrame([(i, "hot" if i % 100 else "cold") for i in range(1000)], "row_idx long, station string").repartition(parts)
    got = S.group_holdout(df, "station", 0.1, "s", "row_idx").where("held_out").groupBy("station").count().collect()
    assert {r.station: r["count"] for r in got} == {"hot": 99, "cold": 1}


def test_unique_ids_pass_over_names_in_use(spark):
    df = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x_2"), (3, "x")], "row_idx long, name string")
    assert {r.row_idx: r.clip_id for r in S.unique_ids(df, "name", "row_idx").collect()} == {0: "x", 1: "x_3", 2: "x_2", 3: "x_4"}


def test_blocks_with_null_times_and_empty_tables(spark):
    df = spark.createDataFrame([(0, "s", "2024-01-01 00:00:00"), (1, "s", "2024-01-01 00:15:00"), (2, "s", "2024-01-01 00:30:01"), (3, "s", None), (4, "s", None)], "row_idx long, station string, t string").withColumn("ts", F.to_timestamp("t"))
    got = {r.row_idx: r.block_id for r in S.capture_blocks(df, 15).collect()}
    assert got == {0: "s/b00", 1: "s/b00", 2: "s/b01", 3: "s/b02", 4: "s/b03"}
    assert S.capture_blocks(df.limit(0), 15).count() == 0
    cut = {r.row_idx: (r.part, r.pseudo) for r in S.pseudo_split(df.where("row_idx < 2").withColumn("block_id", F.lit("s/b00"))).collect()}
    assert cut == {0: (0, True), 1: (1, True)}


def test_readers(spark, tmp_path):
    (tmp_path / "scenes.json").write_text('{"airport_ident": "A", "messages": [{"text": " hi ", "speaker": "atc"}]}\n\n{\n "messages": [{"text": "x"}, {"text": " "}]\n}')
    assert sorted((r.kind, r.role, r.category, r.text) for r in R.read_scenes(spark, str(tmp_path / "scenes.json")).collect()) == [("A", "atc", "routine", "hi"), ("unknown", "unknown", "routine", "x")]
    (tmp_path / "log.txt").write_text("RENAME [0000] a.wav -> b.wav\nRENAME [0001] a.wav -> b.wav\nnoise\n")
    assert [tuple(r) for r in R.read_rename_log(spark, str(tmp_path / "log.txt")).collect()] == [("a.wav", "b.wav")]
    (tmp_path / "bad.txt").write_text("RENAME [0000] a.wav -> b.wav\nRENAME [0001] a.wav -> c.wav\n")
    with pytest.raises(Exception, match="two targets"):
        R.read_rename_log(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "c.csv").write_text('file,transcript\na.wav,"say ""hi"", now"\nb.wav,\n')
    assert [tuple(r) for r in R.read_labeled_corpus(spark, str(tmp_path / "c.csv")).collect()] == [("a.wav", 'say "hi", now'), ("b.wav", "")]
    with pytest.raises(ValueError):
        R.read_split(spark.range(3).toDF("row_idx"), "none", {})


def test_clips(spark, tmp_path):
    data = io.BytesIO()
    with wave.open(data, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[0, 16384], [16384, 0]], "<i2").tobytes())
    (tmp_path / "a.wav").write_bytes(data.getvalue())
    (tmp_path / "b.wav").write_bytes(b"no clip")
    rows = {r.path[-5:]: r for r in R.read_clips(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].samples == [0.25, 0.25] and rows["a.wav"].sr == 8000 and rows["b.wav"].problem == "unreadable"
    t = np.arange(8000) / 8000
    up = W.to_mono_rate(np.sin(2 * np.pi * 440 * t), 8000)
    assert len(up) == 16000 and np.abs(up[200:-200] - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)[200:-200]).max() < 0.01


def test_append_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "pull int, x string")
    assert M.append_once(df, f"{tmp_path}/log", "pull") == 2
    assert M.append_once(df.union(spark.createDataFrame([(3, "c")], df.schema)), f"{tmp_path}/log", "pull") == 1
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3


def test_exact_sample_at_every_size(spark, monkeypatch):
    from cliploom.operators import splits

    df = spark.range(3000).withColumnRenamed("id", "row_idx").union(spark.createDataFrame([(5,)] * 40, "row_idx long"))
    hashed = splits.order_key("s", F.col("row_idx"))
    ordered = [r.row_idx for r in df.orderBy(hashed, "row_idx").collect()]
    for edge in (0, 2, 100_000):
        monkeypatch.setattr(splits, "EDGE", edge)
        for n in (0, 1, 37, 1500, 3039, 3040, 5000):
            assert sorted(r.row_idx for r in splits.exact_sample(df, n, "s", "row_idx").collect()) == sorted(ordered[:n]), (edge, n)
    assert splits.exact_sample(df.limit(0), 5, "s", "row_idx").count() == 0


def test_long_texts_align_like_a_whole_table():
    rnd = random.Random(4)
    for _ in range(20):
        a = rnd.choices("abcdefgh", k=rnd.randrange(150, 250))
        b = [x for x in a if rnd.random() > 0.2]
        for _ in range(30):
            b.insert(rnd.randrange(len(b)), rnd.choice("abz"))
        h, s, d, i = wer.align(a, b)
        row = list(range(len(b) + 1))
        for x in a:
            last, row = row, [row[0] + 1]
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        assert (s + d + i, h + s + d, h + s + i) == (row[-1], len(a), len(b))
    n = 20_000
    assert wer.align(["a"] * n, ["a"] * (n - 5)) == (n - 5, 0, 5, 0)


def test_ingested_clips(spark, tmp_path):
    def wav(name: str, x, rate: int, width: int) -> None:
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        with wave.open(str(tmp_path / "in" / name), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(rate)
            wide = np.round(np.asarray(x) * 2147483647).astype("<i4").view(np.uint8).reshape(-1, 4)
            w.writeframes(wide[:, 4 - width :].tobytes())

    tone = 0.5 * np.sin(2 * np.pi * 440 * np.arange(4000) / 8000)
    wav("a/ST1_20240101_000000.wav", tone, 8000, 3)
    wav("b/ST1_20240101_000000.wav", tone, 16000, 4)
    wav("b/again.wav", tone, 16000, 4)
    wav("b/quiet.wav", tone / 100, 16000, 2)
    wav("c/empty.wav", [], 16000, 2)
    (tmp_path / "in" / "c" / "broken.wav").write_bytes(b"no clip")
    clips = R.read_clips(spark, str(tmp_path / "in"))
    assert np.abs(np.array(next(r.samples for r in clips.collect() if "/a/" in r.path)) - tone).max() < 1e-6
    rows = {r.path.split("/in/")[1]: r for r in ingest_clips(clips, str(tmp_path / "out")).collect()}
    assert {k: r.reason for k, r in rows.items() if r.reason} == {"b/again.wav": "duplicate", "b/quiet.wav": "silence_only", "c/empty.wav": "zero_length", "c/broken.wav": "unreadable"}
    a, b = rows["a/ST1_20240101_000000.wav"], rows["b/ST1_20240101_000000.wav"]
    assert (a.clip_id, b.clip_id) == ("ST1_20240101_000000", "ST1_20240101_000000_2") and {a.split, b.split} == {"train", "holdout"}
    assert (a.duration, b.duration, a.station) == (0.5, 0.25, "ST1") and abs(b.rms_db + 9.031) < 0.01
    assert ingest_clips(clips.where("path is null"), str(tmp_path / "none")).count() == 0
