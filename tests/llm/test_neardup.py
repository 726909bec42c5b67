import random
import re

import numpy as np

from cliploom.llm import neardup
from cliploom.llm.op02_neardup import op2_neardup


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if len(words) >= n else frozenset([tuple(words)])


def brute(texts, n, percent=80):
    ids = sorted(texts)
    sets = {i: shingles(texts[i], n) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    rows = df.collect()
    out = {r[0]: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got(op2_neardup(spark, sf_dir)) == brute(texts, 4)


def test_groups_of_near_copies(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefg", k=4))
    passage = [word() for _ in range(40)]
    texts = {}
    for g in range(4):
        base = [word() for _ in range(rnd.choice([12, 60, 150]))]
        for _ in range(30):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                t[rnd.randrange(len(t))] = word()
            texts[len(texts)] = " ".join(t)
    for _ in range(60):
        texts[len(texts)] = " ".join(passage + [word() for _ in range(rnd.choice([3, 8, 30]))])
    texts |= {1000: None, 1001: "", 1002: " \n", 1003: "One two", 1004: "one TWO", 1005: "É é", 1006: "é é"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, value string")
    for n in (4, 5):
        assert got(neardup.near_duplicates(df, words=n)) == brute(texts, n)


def test_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, "x"), (3, "y")], "doc_id long, text string")
    rows = got(neardup.near_duplicates(df))
    assert rows[1] == (1, 1, True) and rows[2] == (1, 1, False) and rows[3] == (1, 3, True) and len(rows) == 3
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.id: r.root for r in neardup.components(edges).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_sketch_filter_keeps_similar_sets():
    rnd = np.random.default_rng(2)
    for n in (5, 40, 100, 1000):
        for _ in range(200):
            base = neardup.mix(rnd.integers(0, 2**63, n).astype(np.uint64))
            k = n // 9
            other = np.sort(np.concatenate([base[k:], neardup.mix(rnd.integers(0, 2**63, k).astype(np.uint64))]))
            base = np.sort(base)
            both = len(np.intersect1d(base, other))
            assert neardup.similar(base, other, 80) == (100 * both >= 80 * (2 * n - both))
