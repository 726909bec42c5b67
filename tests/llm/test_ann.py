from collections import defaultdict

import numpy as np

from cliploom.llm import ann
from cliploom.llm.op04_ann import op4_ann


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out[ids[q]] = [(int(ids[i]), s[i]) for i in order]
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_query_recall(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    want = brute(ids, x, np.nonzero(ids % 20 == 0)[0])
    got = answers(op4_ann(spark, sf_dir))
    assert set(got) == set(want)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]
    print("recall", np.mean(hits))
    assert np.mean(hits) >= 0.9
    for q, list_ in got.items():
        assert list_ == sorted(list_, key=lambda p: (-p[1], p[0])) and q not in dict(list_)
        for v, s in list_:
            assert abs(s - (x[ids == v][0] * x[ids == q][0]).sum()) < 1e-12


def test_exact_with_all_probes_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 16)
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 6)) * rnd.uniform(0.1, 5, (200, 1))
    x[50:120] = x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, []), (1040, [0.0] * 6), (1060, [float("nan")] + [1.0] * 5), (1080, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, [1.0] * 3), (None, [1.0] * 6), (1120, [float("inf")] * 6)]
    df = spark.createDataFrame(rows + [(*o, 1) for o in odd] + [rows[3], rows[60]], "vec_id long, embedding array<double>, score int")
    got = answers(ann.nearest(df, lambda i: i % 20 == 0, k=20, tables=1, probes=64))
    want = brute(np.arange(200), x, range(0, 200, 20))
    assert {q: [v for v, _ in a] for q, a in got.items()} == {q: [v for v, _ in a] for q, a in want.items()}
    few = answers(ann.nearest(df.where("vec_id < 5"), lambda i: i == 0, k=20, tables=1, probes=64))
    assert len(few[0]) == 4
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_few_vectors_get_all_others(spark):
    x = np.random.default_rng(2).normal(size=(15, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = answers(ann.nearest(df, lambda i: i % 5 == 0)), brute(np.arange(15), x, range(0, 15, 5))
    assert {q: [v for v, _ in a] for q, a in got.items()} == {q: [v for v, _ in a] for q, a in want.items()}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
