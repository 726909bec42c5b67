"""Queries without SQL against versions written out step by step, on the smallest tables."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from cliploom.plans import q_text
from cliploom.plans import views as V
from cliploom.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def vectors(sf_dir):
    """id: samples as doubles, and label."""
    rows = duckdb.sql(f"select vec_id, embedding, label from '{sf_dir}/embeddings.parquet'").fetchall()
    return {i: (np.array(x, np.float64), y) for i, x, y in rows}


def by_id(df):
    rows = df.collect()
    out = {r["vec_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def levels(x, frame, hop):
    out = []
    at = 0
    while at + frame <= len(x):
        out.append(10 * math.log10(max(sum(v * v for v in x[at : at + frame]) / frame, 1e-12)))
        at += hop
    return out


def speech(db):
    """Frames of speech, from the rule as stated: strong frames, and weak ones that a run of weak frames joins to one."""
    low, high = np.percentile(db, 20), np.percentile(db, 90)
    if high - low < 6:
        return [True] * len(db)
    strong = [d >= low + 6 and d >= high - 15 for d in db]
    weak = [d >= low + 3 and d >= high - 20 for d in db]
    out = [s and w for s, w in zip(strong, weak, strict=True)]
    grown = True
    while grown:
        grown = False
        for i in range(len(db)):
            beside = (i > 0 and out[i - 1]) or (i + 1 < len(db) and out[i + 1])
            if weak[i] and not out[i] and beside:
                out[i] = grown = True
    return out


def power(x, size):
    """Mean power of Hann-weighted half-overlapping frames, by a written-out transform."""
    hop, total, n = max(1, size // 2), 0, 0
    weigh = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / (size - 1)) for i in range(size)]) if size > 1 else np.ones(1)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(size // 2 + 1), np.arange(size)) / size)
    for at in range(0, len(x) - size + 1, hop):
        total, n = total + np.abs(turn @ (x[at : at + size] * weigh)) ** 2, n + 1
    return total / n


def test_all_without_sql_are_here():
    without = {n for n in QUERIES if n not in ORACLE_SQL}
    assert without == {"WAV-2", "WAV-6", "WAV-7", "WAV-10", "WAV-13", "FID-4", "FID-5", "FID-6", "FID-7", "STA-3"}


def test_audio_hash(spark, sf_dir, vectors):
    got = by_id(QUERIES["WAV-2"](spark, sf_dir))
    assert {i: r.audio_hash for i, r in got.items()} == {i: hashlib.sha256(x.astype("<f4").tobytes()).hexdigest() for i, (x, _) in vectors.items()}


def test_noise_segments(spark, sf_dir, vectors):
    got = {(r.vec_id, r.start, r.stop): r for r in QUERIES["WAV-6"](spark, sf_dir).collect()}
    want = {}
    for i, (x, _) in vectors.items():
        mask = speech(levels(x, 8, 4))
        busy = [False] * len(x)
        for f, m in enumerate(mask):
            for k in range(max(0, 4 * f - 1), min(len(x), 4 * f + 8 + 1)) if m else ():  # 0.02 s of 64 Hz is one sample
                busy[k] = True
        start = None
        for k in range(len(x) + 1):
            if k < len(x) and not busy[k]:
                start = k if start is None else start
            elif start is not None:
                if k - start >= 6.4 and not all(mask):
                    part = x[start:k]
                    p = power(part, min(8, k - start))
                    hz = np.linspace(0, 32, len(p))
                    level = 10 * math.log10(max((part**2).mean(), 1e-12))
                    want[i, start, k] = level, (hz * p).sum() / p.sum(), level < -60
                start = None
    assert len(want) > 20 and set(got) == set(want)
    for k, (level, centroid, gated) in want.items():
        assert got[k].rms_db == pytest.approx(level) and got[k].centroid_hz == pytest.approx(centroid) and got[k].squelch_gated == gated


def test_repeat_score(spark, sf_dir, vectors):
    got = by_id(QUERIES["WAV-7"](spark, sf_dir))
    assert set(got) == set(vectors)
    for i, (x, _) in vectors.items():
        e = np.array(levels(x, 8, 4)) / 10
        e -= e.mean()
        lags = range(2, len(e) // 2 + 1)
        best = max([0.0] + [sum(e[k] * e[k + lag] for k in range(len(e) - lag)) / (np.linalg.norm(e[:-lag]) * np.linalg.norm(e[lag:])) for lag in lags])
        assert got[i].score == pytest.approx(best, abs=1e-9) and got[i].looped == (best > 0.8)


def test_quiet_window(spark, sf_dir, vectors):
    got = by_id(QUERIES["WAV-10"](spark, sf_dir))
    assert set(got) == set(vectors) and any(r.start >= 0 for r in got.values())
    for i, (x, _) in vectors.items():
        rms = [math.sqrt((x[k : k + 8] ** 2).mean()) for k in range(len(x) - 7)]
        k = min(range(len(rms)), key=rms.__getitem__)
        share = rms[k] / math.sqrt((x**2).mean())
        assert got[i].start == (k if 0.02 <= share <= 0.35 else -1)


def test_measured_snr(spark, sf_dir, vectors):
    got = by_id(QUERIES["WAV-13"](spark, sf_dir))
    assert set(got) == set(vectors) and len({r.snr_db for r in got.values()}) > 20
    for i, (x, _) in vectors.items():
        db = levels(x, 8, 4)
        mask = speech(db)
        loud = [10 ** (d / 10) for d, m in zip(db, mask, strict=True) if m]
        rest = sorted(d for d, m in zip(db, mask, strict=True) if not m)
        middle = (rest[(len(rest) - 1) // 2] + rest[len(rest) // 2]) / 2 if rest else None
        want = min(60.0, max(0.0, 10 * math.log10(sum(loud) / len(loud)) - middle)) if rest and loud else 60.0
        assert got[i].snr_db == pytest.approx(want)
        power = [sum(v * v for v in x[k : k + 4]) for k in range(0, 64, 4)]
        loud = [k for k, p in enumerate(power) if 10 * math.log10(p / max(power)) >= -6]
        assert (got[i].start, got[i].stop) == (max(0, 4 * loud[0] - 2), min(64, 4 * loud[-1] + 6))
    assert len({(r.start, r.stop) for r in got.values()}) > 20


def test_cohort_spectra(spark, sf_dir, vectors):
    got = {(r.cohort, r.place): r.db for r in QUERIES["FID-4"](spark, sf_dir).collect()}
    assert len(got) == 2 * 16
    for cohort in (0, 1):
        shares = [p / p.sum() for p in (power(x, 32) for x, y in vectors.values() if y % 2 == cohort)]
        mean = sum(shares) / len(shares)
        db = [10 * math.log10(v / max(mean)) for v in mean]
        for place in range(16):
            at = place * (len(db) - 1) / 15
            k = min(int(at), len(db) - 2)
            assert got[cohort, place] == pytest.approx(db[k] + (at - k) * (db[k + 1] - db[k]), abs=1e-6)


def test_kernel_discrepancy(spark, sf_dir, vectors):
    (got,) = QUERIES["FID-5"](spark, sf_dir).collect()
    found = []
    for subset in range(20):
        sides = []
        for side in (True, False):
            own = [i for i, (_, y) in vectors.items() if (y < 5) == side]
            own.sort(key=lambda i: (hashlib.md5(f"kid:{subset}:{i}".encode()).hexdigest(), i))
            sides.append([vectors[i][0] for i in own[:50]])
        k = lambda a, b: (float(a @ b) / len(a) + 1) ** 3
        within = [sum(k(a, b) for i, a in enumerate(s) for j, b in enumerate(s) if i != j) / (len(s) * (len(s) - 1)) for s in sides]
        across = sum(k(a, b) for a in sides[0] for b in sides[1]) / (len(sides[0]) * len(sides[1]))
        found.append(sum(within) - 2 * across)
    assert got["mean"] == pytest.approx(np.mean(found), rel=1e-9, abs=1e-12) and got["std"] == pytest.approx(np.std(found), rel=1e-9)


def test_frechet_distance(spark, sf_dir, vectors):
    (got,) = QUERIES["FID-6"](spark, sf_dir).collect()
    a, b = (np.array([x for x, y in vectors.values() if (y < 5) == side]) for side in (True, False))
    s, t = np.cov(a.T), np.cov(b.T)
    root = np.sqrt(np.maximum(np.linalg.eigvals(s @ t).real, 0)).sum()  # the trace of the root of the product
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(s) + np.trace(t) - 2 * root
    assert got.distance == pytest.approx(want, rel=1e-6) and got.reliable == (min(len(a), len(b)) > 2 * a.shape[1])


def logistic(x, y, penalty):
    """Coefficients of a penalised logistic model, the constant last and free, by Newton's steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    free = np.append(np.full(x.shape[1] - 1, penalty), 0.0)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(free + 1e-12), x.T @ (p - y) / len(x) + free * w)
    return w


def test_probe(spark, sf_dir, vectors):
    got = {r.layer: r for r in QUERIES["FID-7"](spark, sf_dir).collect()}
    assert set(got) == {0, 1, 2}
    head = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:8], 16)

    draw = lambda i, k: int(hashlib.md5(f"layer:{i}:{k}".encode()).hexdigest()[:13], 16) / 2**52
    layers = {i: (x, np.array([draw(i, k) for k in range(len(x))]), x + 0.5 * (y < 5) * (np.arange(len(x)) == 0)) for i, (x, y) in vectors.items()}

    def balanced(labels, layer):
        ids = sorted(labels)
        x, y = np.array([layers[i][layer] for i in ids]), np.array([labels[i] for i in ids])
        fold, said = np.array([head("probe", i) % 3 for i in ids]), np.zeros(len(ids))
        for k in range(3):
            train = fold != k
            mean, sd = x[train].mean(0), x[train].std(0, ddof=1)
            w = logistic((x[train] - mean) / sd, y[train], 0.01)
            said[~train] = ((x[~train] - mean) / sd) @ w[:-1] + w[-1] > 0
        return np.mean([(said[y == v] == v).mean() for v in (0, 1)])

    for k, r in got.items():
        real = balanced({i: int(y < 5) for i, (_, y) in vectors.items()}, k)
        null = balanced({i: head("probe", "half", i) % 2 for i, (_, y) in vectors.items() if y < 5}, k)
        assert r.accuracy == pytest.approx(real, abs=0.01) and r["null"] == pytest.approx(null, abs=0.01)
        assert r.verdict == ("separable" if r.accuracy > 0.65 else "unclear" if r.accuracy > 0.55 else "alike")
    assert got[2].verdict == "separable"


def test_paired_bootstrap(spark, sf_dir):
    (got,) = QUERIES["STA-3"](spark, sf_dir).collect()
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    rows = c.sql(V.with_sql(V.UTT, q_text.EDITS, select="select errors_a, errors_b, ref_words from edits where ref_words > 0")).fetchall()
    x = np.array(rows, np.float64)
    assert got.n_rows == len(x) and got.delta == pytest.approx((x[:, 0].sum() - x[:, 1].sum()) / x[:, 2].sum())
    total = np.random.default_rng(3).poisson(1, (20_000, len(x))) @ x
    d = (total[:, 0] - total[:, 1]) / total[:, 2]
    low, high = np.percentile(d, [2.5, 97.5])
    assert abs(got.low - low) < 0.2 * (high - low) and abs(got.high - high) < 0.2 * (high - low)  # of 200 replicates
    assert abs(got.p - min(1.0, 2 * min((d <= 0).mean(), (d >= 0).mean()))) < 0.1
