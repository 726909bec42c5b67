import re

import numpy as np

from cliploom.llm import quality
from cliploom.llm.op05_quality import op5_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (r.kept and r.base_failed)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    texts = {i: t for i, t in texts.items() if len(t) < 6000}
    rows = op5_quality(spark, sf_dir).collect()
    check([r for r in rows if r.doc_id in texts], texts)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r.kept or r.base_failed for r in rows if label.get(r.doc_id) == 1]
    assert np.mean(good) > 0.95


def test_measures_of_odd_texts(spark, tmp_path):
    texts = {0: None, 1: "", 2: " \n\t", 3: "a b c d e f g h " * 3, 4: "x\nx\n\ny\nx", 5: "é 日本 # $\x0b|", 6: "a" * 10_000, 7: "a b c d e f g h i a b c d e f g h"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(op5_quality(spark, str(tmp_path)).collect(), texts)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op5_quality(spark, f"{tmp_path}/none").count() == 0


def test_em_finds_accuracies():
    rnd = np.random.default_rng(0)
    true, accuracy = rnd.random(20_000) < 0.7, np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    right = rnd.random((20_000, 5)) < accuracy
    votes = np.where(right, true[:, None], ~true[:, None]).astype(int)
    votes[rnd.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, found = quality.fit_em(patterns, counts)
    assert abs(share - 0.7) < 0.03 and np.abs(found - accuracy).max() < 0.03


def test_sql_posterior_equals_numpy(spark):
    df = spark.createDataFrame([(None,) * 9, (1,) * 9, (0, 1, None) * 3], ", ".join(f"vote_{n} int" for n, _, _ in quality.RULES))
    accuracy = {n: 0.6 + i / 30 for i, (n, _, _) in enumerate(quality.RULES)}
    got = [r.quality for r in quality.judge(df, 0.6, accuracy).collect()]
    want = quality.posterior(np.array([[-1] * 9, [1] * 9, [0, 1, -1] * 3]), 0.6, np.array(list(accuracy.values())))
    assert np.allclose(got, want)
