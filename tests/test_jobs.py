"""Readers over ranges of files, replays of streams, user models, draws of arms, clips, and joins of ranges."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.functions import waveform as W
from cliploom.operators import corpus as C
from cliploom.operators import joins as J
from cliploom.operators import splits as S
from cliploom.operators import stats
from cliploom.sources import readers as R
from cliploom.streaming import jobs as M


@pytest.fixture
def split_size(spark):
    def to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_concatenated_json_at_every_split_size(spark, tmp_path, split_size):
    rnd = random.Random(4)
    odd = ['}{ "', "\\", 'a\\"]', "[[{", "é日🙂", "", "\n\n", "}\n{"]
    scenes = [{"airport_ident": f"K{i}", "messages": [{"text": f"{i}:{j} {rnd.choice(odd)}", "speaker": rnd.choice(["atc", "pilot"])} for j in range(rnd.randrange(4))]} for i in range(60)]
    folder = tmp_path / "scenes"
    folder.mkdir()
    want = sorted((s["airport_ident"], m["speaker"], m["text"].strip(" ")) for s in scenes for m in s["messages"])
    for name, part in (("a", scenes[:40]), ("b", scenes[40:])):
        text = "".join(json.dumps(s, indent=rnd.choice([None, 1, 2])) + rnd.choice(["", " ", "\n", "\n\n\n"]) for s in part)
        (folder / name).write_text(text)
    size = sum(f.stat().st_size for f in folder.iterdir())
    (folder / "empty").write_text("")
    parts = set()
    for n in [*range(40, 200, 7), 500, size, 10**6]:
        split_size(n)
        got = R.read_scenes(spark, str(folder))
        assert sorted((r.kind, r.role, r.text) for r in got.collect()) == want, n
        parts.add(spark.read.text(str(folder)).rdd.getNumPartitions())
    assert max(parts) > size // 60


def test_replayed_pulls_count_once(spark, tmp_path):
    log, source = str(tmp_path / "log"), str(tmp_path / "in")
    pulls = spark.createDataFrame([(i, "ab"[i % 2], i % 3, 2 - i % 3) for i in range(90)], "pull long, arm string, successes long, failures long")
    want = {r.arm: (r.s, r.f) for r in pulls.groupBy("arm").agg(F.sum("successes").alias("s"), F.sum("failures").alias("f")).collect()}
    totals = lambda: {r.arm: (r.successes, r.failures) for r in M.log_posteriors(spark, log).collect()}
    for k in range(3):
        pulls.where(f"pull % 3 = {k}").coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(pulls.schema).option("maxFilesPerTrigger", 1).parquet(source)
    M.stream_posteriors(arriving, log, str(tmp_path / "state"))
    assert totals() == want
    assert spark.read.parquet(log).select("batch").distinct().count() == 3
    M.stream_posteriors(arriving, log, str(tmp_path / "state"))  # nothing new
    M.stream_posteriors(arriving, log, str(tmp_path / "lost-state"))  # all three batches again
    M.merge_pulls(log)(pulls.where("pull % 3 = 1"), 7)  # and one under another id
    M.merge_pulls(log)(pulls.where("pull < 5").unionByName(pulls.where("pull < 5")), 8)
    assert totals() == want


def test_arms_are_drawn_alike_and_by_their_distribution(spark):
    arms = spark.createDataFrame([("a", 3.0, 5.0), ("b", 30.0, 50.0), ("c", 1.0, 1.0)], "arm string, alpha double, beta double")
    one, many = ({r.arm: (r.theta, r.chosen) for r in stats.sample_arm(arms.repartition(n), 5).collect()} for n in (1, 7))
    assert one == many and sum(c for _, c in one.values()) == 1
    assert max(one, key=lambda a: one[a][0]) == next(a for a, (_, c) in one.items() if c)
    assert one != {r.arm: (r.theta, r.chosen) for r in stats.sample_arm(arms, 6).collect()}
    wide = spark.range(4000).select(F.concat(F.lit("x"), "id").alias("arm"), F.lit(3.0).alias("alpha"), F.lit(5.0).alias("beta"))
    m = stats.sample_arm(wide, 1).agg(F.avg("theta").alias("m"), F.stddev("theta").alias("s")).first()
    assert m.m == pytest.approx(3 / 8, abs=0.01) and m.s == pytest.approx(np.sqrt(15 / (64 * 9)), abs=0.01)


def test_models_with_throughput(spark, tmp_path):
    mark = tmp_path / "failed"

    def model(clips):
        if not mark.exists():  # the first task fails once, if Spark tries again
            mark.write_text("")
        return [str(len(x)) for x in clips]

    df = spark.createDataFrame([(i, [0.0] * (i % 5)) for i in range(40)], "id long, x array<float>").repartition(4)
    made, seen = C.with_throughput(C.transcribe_with(df, {"a": model, "b": model}, "id", "x"), ["a", "b"])
    rows = made.collect()
    assert len(rows) == 80 and seen.get["clips_a"] == seen.get["clips_b"] == 40 and seen.get["seconds_a"] >= 0
    table = {r.teacher: r for r in C.teacher_throughput(spark.createDataFrame(rows)).collect()}
    assert table["a"].clips == 40 and table["b"].seconds == pytest.approx(sum(r.seconds for r in rows if r.teacher == "b"))
    with pytest.raises(Exception, match="gave 0 texts"):
        C.transcribe_with(df, {"a": lambda clips: []}, "id", "x").collect()


def test_names_in_transmissions(spark):
    texts = [
        "sky travel one two three contact praha radar one two one decimal five", "blue one two one point five", "contact north two three", "csa one climb", "praha radar sky travel four five six direct to ralud via lomki",
        "abeam to", "direct", "", "travel hundred two", "tower 12 34",
    ]
    df = spark.createDataFrame([(t.split(),) for t in texts] + [(None,)], "tokens array<string>")
    got = {(r.kind, r.phrase): r.n for r in C.harvest_vocab(df, 1).collect()}
    assert got == {("airline", "travel"): 2, ("airline", "sky travel"): 2, ("station", "praha radar"): 2, ("waypoint", "ralud"): 1, ("waypoint", "lomki"): 1}
    counts = spark.createDataFrame([("travel", 3), ("sky travel", 2), ("bird", 9), ("praha", 4), ("old praha", 4), ("landing", 4), ("abc", 4), ("loner", 1)], "phrase string, n long")
    assert {r.phrase for r in C.prune_airlines(counts, ["praha"], ["speedbird"]).collect()} == {"sky travel", "loner"}


def test_codes_are_unique_within_and_across_families(spark):
    names = [("alpha", 9), ("alps", 8), ("alpine", 7), ("al", 6), ("beta", 5), ("known name", 4), ("knife", 3)] + [(f"zz{chr(97 + i)}x", 1) for i in range(26)] + [("zzz", 1), ("zzaa", 1)]
    df = spark.createDataFrame(names, "phrase string, n long")
    got = {r.phrase: r.code for r in C.assign_codes(df, {"known name": "KNI"}).collect()}
    assert (got["alpha"], got["alps"], got["alpine"], got["al"], got["beta"], got["known name"], got["knife"]) == ("ALP", "ALA", "ALB", "ALX", "BET", "KNI", "KNA")
    codes = [c for c in got.values() if c]
    assert len(codes) == len(set(codes)) and sum(c is None for c in got.values()) == 2


def test_clips_without_samples_and_levels(spark):
    df = spark.createDataFrame([(0, []), (1, None), (2, [0.0] * 64), (3, [0.5, -0.5] * 32)], "id int, samples array<float>").withColumn("sr", F.lit(64))
    got = {r.id: r for r in df.select("id", W.clip_stats(32, 0.125, 0.0625, 1.5, 31, 8)("samples", "sr").alias("s")).collect()}
    assert got[0].s.duration is None and got[1].s.ltas_db is None and got[2].s.rms_db == -90 and got[2].s.edge_hz == 0
    assert got[3].s.peak_db == pytest.approx(20 * np.log10(0.5)) and got[3].s.edge_hz == 32
    trimmed = {r.id: r.samples for r in W.trim_and_level(df, 8).select("id", "samples").collect()}
    assert trimmed[0] is trimmed[1] is trimmed[2] is None and len(trimmed[3]) == 64
    assert np.sqrt(np.mean(np.square(trimmed[3]))) == pytest.approx(10 ** (-26 / 20))
    level = lambda **to: {r.id: r.samples for r in W.level_and_quantize(df, 48, **to).select("id", "samples").collect()}
    assert [len(level(rms_db=-20.0)[k]) for k in (2, 3)] == [96, 96] and max(level(peak=0.8)[3]) == pytest.approx(0.8)
    assert max(level(rms_db=3.0)[3]) == pytest.approx(0.99) and set(level(peak=0.8)[2]) == {0.0} and level()[0] is None
    (r,) = W.level_report(df.withColumn("set", F.lit("a")), ["set"]).collect()
    assert (r.n, r.duration, r.zero_share) == (2, 1.0, 0.5)
    assert W.active_span(np.array([0.0] * 20 + [1.0] * 4 + [0.0] * 40), 64, 4 / 64, 2 / 64) == (18, 26) and W.active_span(np.zeros(64), 64) == (0, 64)


def test_many_ranges(spark, monkeypatch):
    rnd = random.Random(0)
    cuts = sorted(rnd.sample(range(3000), 400))
    ranges = [(a, b if rnd.random() < 0.7 else (a + b) // 2, f"r{a}") for a, b in zip(cuts, cuts[1:], strict=False)] + [(3000, None, "open")]
    df = spark.createDataFrame([(i, "x") for i in range(0, 3300)], "row_idx long, y string")
    table = spark.createDataFrame(ranges, "start long, stop long, name string")
    want = {i: next((n for a, b, n in ranges if a <= i and (b is None or i < b)), None) for i in range(3300)}
    for few in (10_000, 20):
        monkeypatch.setattr(J, "FEW_RANGES", few)
        got = J.window_cover(df, table, "row_idx")
        assert got.columns == ["row_idx", "y", "name"] and {r.row_idx: r.name for r in got.collect()} == want


def test_wanted_stations_and_missing_targets(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "row_idx long, station string")
    assert S.cap_per_group(df, "station", 3, "s", "row_idx", ["a"]).count() == 3
    with pytest.raises(ValueError, match="no rows of z"):
        S.cap_per_group(df, "station", 3, "s", "row_idx", ["a", "z"])
    paths = spark.createDataFrame([("C:\\old\\x.wav", None), ("c/y.wav", "C:/old/z.wav")], "audio string, ref string")
    moved = J.relocate_paths(paths, "C:/old", "/new", ["audio", "ref"])
    listing = spark.createDataFrame([("/new/x.wav",)], "path string")
    assert sorted(tuple(r) for r in J.missing_targets(moved, listing, ["audio", "ref"]).collect()) == [("audio", "c/y.wav", 1), ("ref", "/new/z.wav", 1)]


def test_folds_of_small_blocks(spark):
    from cliploom.operators.fidelity import validation_folds

    folds = lambda rows: {r.block_id: r.fold for r in validation_folds(spark.createDataFrame(rows, "block_id string, n long"), 3).collect()}
    assert folds([("a", 5), ("b", 1), ("c", 2)]) == {"a": "a", "b": "pool", "c": "pool"}
    assert folds([("b", 5), ("c", 9), ("a", 1)]) == {"b": "b", "c": "c", "a": "b"}
    assert folds([("a", 1)]) == {"a": "pool"}


def test_corpus_manifest_does_not_hang_on_order(spark):
    from cliploom.sources.writers import corpus_manifest

    df = spark.createDataFrame([(f"a{i}", f"t{i % 7}", "gold" if i % 3 else "silver") for i in range(50)], "audio string, text string, tier string")
    one, many = ({r.tier: tuple(r) for r in corpus_manifest(x, "v1").collect()} for x in (df, df.repartition(5).orderBy(F.desc("audio"))))
    assert one == many and one["all"][2] == 50 and one["gold"][2] + one["silver"][2] == 50
    other = {r.tier: r.digest for r in corpus_manifest(df.withColumn("text", F.when(F.col("audio") == "a4", "x").otherwise(F.col("text"))), "v1").collect()}
    assert other["all"] != one["all"][3] and other["silver"] == one["silver"][3]


def test_errors_of_mixed_edits_in_whole_texts(spark, sf_dir):
    """Words left out, replaced and put in, in one hypothesis: distances by a plain table."""
    from cliploom.operators import wer

    rnd = random.Random(8)
    texts = [r.text.split()[:1500] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 = 1").collect() if r.text]
    rows = []
    for i, ref in enumerate(texts):
        hyp = []
        for w in ref:
            u = rnd.random()
            hyp += [] if u < 0.07 else ["zz"] if u < 0.14 else [w, rnd.choice(ref)] if u < 0.2 else [w]
        rows.append((i, " ".join(ref), " ".join(hyp), " ".join(hyp[::2])))

    def distance(a, b):
        codes = {}
        a, b = (np.array([codes.setdefault(w, len(codes)) for w in x]) for x in (a.split(), b.split()))
        last = np.arange(len(b) + 1)
        for x in a:
            row = np.minimum(last[1:] + 1, last[:-1] + (b != x))
            row = np.concatenate([[last[0] + 1], row])
            last = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
        return int(last[-1])

    df = spark.createDataFrame(rows, "row_idx long, reference string, hypothesis string, other string").repartition(8)
    got = {r.row_idx: r for r in wer.wer_counts(df, raw=True).collect()}
    assert len(got) == len(rows) > 20
    for i, ref, hyp, _ in rows:
        r = got[i]
        assert r.errors == distance(ref, hyp) and r.hits + r.substitutions + r.insertions == len(hyp.split()) and r.ref_words == len(ref.split())
    assert sum(bool(r.substitutions and r.deletions and r.insertions) for r in got.values()) > 15
    both = {r.row_idx: r for r in wer.pair_counts(df.withColumn("n", F.lit(1)), "hypothesis", "other").limit(10).collect()}
    plain = {r.row_idx: (r.errors, r.ref_words) for r in wer.wer_counts(df.drop("other")).collect()}
    assert all((r.errors_a, r.ref_words) == plain[i] and r.n == 1 for i, r in both.items())


def test_normal_forms_agree(spark, sf_dir):
    from cliploom.functions.register import normal_form
    from cliploom.functions.text import normalize_atc

    odd = [(None,), ("",), ("  X-Ray 35R! niner,fife  street don't_stop  ",), ("tree\\tfower\\n7",), ("\\u00e9t\\u00e9 12\\u00b2 \\u65e5\\u672c",)]
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").unionByName(spark.createDataFrame(odd, "text string"))
    for r in df.select("text", normalize_atc(F.col("text")).alias("made")).collect():
        assert r.made == normal_form(r.text)
