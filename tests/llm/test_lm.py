import math
import re
import zlib
from collections import Counter

import numpy as np

from cliploom.llm import ppm
from cliploom.llm.common import written
from cliploom.llm.op06_lm import op6_lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def plain_model(texts, nodes):
    """Nested dictionaries: counts of byte strings; and the probability of a byte by the rules, step by step."""
    counts, total = Counter(), 0
    for t in texts:
        data = b"\0" * ppm.ORDER + t.encode()
        for i in range(ppm.ORDER, len(data)):
            total += 1
            for d in range(1, ppm.ORDER + 2):
                counts[data[i + 1 - d : i + 1]] += 1
    kept = {k: n for k, n in counts.items() if n * nodes >= total}
    children = {}
    for k, n in kept.items():
        children.setdefault(k[:-1], {})[k[-1]] = n

    def log_probability(history, symbol):
        p, excluded = 1.0, {}
        for o in range(ppm.ORDER, -1, -1):
            ctx = history[len(history) - o :]
            if ctx not in children:
                continue
            own = {s: n for s, n in children[ctx].items() if s not in excluded}
            all_kept = sum(children[ctx].values())
            whole = max(kept.get(ctx, 0) if o else total, all_kept) - sum(children[ctx][s] for s in excluded)
            if symbol in own:
                return math.log10(p * own[symbol] / (whole + len(own)))
            if own:
                p *= (whole - sum(own.values()) + len(own)) / (whole + len(own))
            excluded = children[ctx]
        return math.log10(p / (256 - len(children.get(b"", {}))))

    def score(text):
        data = b"\0" * ppm.ORDER + text.encode()
        return sum(log_probability(data[i - ppm.ORDER : i], data[i]) for i in range(ppm.ORDER, len(data)))

    return score, log_probability


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    model, _ = plain_model([t for i, t in texts.items() if not held[i]], 1 << 40)
    rows = op6_lm(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
    for r in rows[:25]:
        assert math.isclose(r.score, model(texts[r.doc_id]), rel_tol=1e-9, abs_tol=1e-9)
    # the model beats equal shares by far on texts that it hasn't seen
    new = [(r.score, len(texts[r.doc_id].encode())) for r in rows if r.held_out]
    assert sum(s for s, _ in new) > -0.75 * sum(b for _, b in new)


def test_probabilities_sum_to_one_and_rare_words_meet(spark, monkeypatch):
    monkeypatch.setattr(ppm, "MAX_CODES", 40)
    monkeypatch.setattr(ppm, "MAX_WORDS", 4)
    texts = ["abracadabra abra", "the theatre there", "", "é zz"] * 5 + ["once only"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    counts = ppm.count_strings(df)
    strings = ppm.build_strings(counts)
    _, log_probability = plain_model(texts, 1 << 40)
    for history in (b"\0\0\0\0\0", b"abrac", b"e the", b"zzzzz", b"\0\0the"):
        code = int.from_bytes(history, "big")
        wanted = spark.createDataFrame([(code << 8 | s,) for s in range(256)], "code long")
        known = wanted.join(strings.codes.select("code", "log"), "code")
        unseen = ppm.unseen_logs(strings, written(wanted.join(known, "code", "left_anti"), "unseen"))
        got = {r.code & 255: r.log for r in known.unionByName(unseen).collect()}
        assert len(got) == 256 and math.isclose(sum(10**x for x in got.values()), 1, rel_tol=1e-9)
        assert np.allclose([got[s] for s in range(256)], [log_probability(history, s) for s in range(256)])
    words, rare = ppm.build_words(counts)
    assert len(words.keys) < words.distinct
    own = Counter(w for t in [*texts, ""] for w in tokens(t))
    clashing = df.withColumn("score", df.text).withColumn("__row", df.text).withColumn("__keys", df.text)
    rows = ppm.score(clashing, words, rare, strings).collect()
    assert sorted(str(r["__row"]) for r in rows) == sorted(map(str, [*texts, None])) and rows[0]["__keys"] == rows[0]["__row"]
    want = sorted(sum(math.log10((own[w] + 0.1) / words.all) for w in tokens(t)) for t in [*texts, ""])
    assert np.allclose(sorted(r.base_score for r in rows), want)
    assert sorted(r.n_known for r in rows) == sorted(len(tokens(t)) for t in [*texts, ""])


def test_without_training_texts_and_without_any_text(spark):
    df = spark.createDataFrame([("ab",)], "text string")
    counts = ppm.count_strings(df.limit(0))
    words, rare = ppm.build_words(counts)
    strings = ppm.build_strings(counts)
    (row,) = ppm.score(df, words, rare, strings).collect()
    assert math.isclose(row.score, -2 * math.log10(256)) and row.n_known == 0
    assert ppm.score(df.limit(0), words, rare, strings).count() == 0
    none = spark.createDataFrame([(None,), ("",), (None,)], "text string").coalesce(1)
    assert [r.score for r in ppm.score(none, words, rare, strings).collect()] == [0.0] * 3
    counts = ppm.count_strings(none)
    rows = ppm.score(none, *ppm.build_words(counts), ppm.build_strings(counts)).collect()
    assert [(r.score, r.n_tokens, r.n_known) for r in rows] == [(0.0, 1, 1)] * 3


def test_contexts_below_the_broadcast_share_count(spark, monkeypatch):
    monkeypatch.setattr(ppm, "MAX_CODES", 40)
    train = ["abracadabra abra", "the theatre there", "", "é zz"] * 5 + ["once only"]
    new = ["once only", "once more", "abrupt theatre", "é é zebra", "", "QQ"]
    counts = ppm.count_strings(spark.createDataFrame([(t,) for t in train], "text string"))
    strings = ppm.build_strings(counts)
    assert 0 < len(strings.often) < strings.codes.count()
    model, _ = plain_model(train, 1 << 40)
    df = spark.createDataFrame(list(enumerate([*train, *new])), "id int, text string")
    rows = {r.id: r.score for r in ppm.score(df, *ppm.build_words(counts), strings).collect()}
    assert len(rows) == len(train) + len(new)
    for i, t in enumerate([*train, *new]):
        assert math.isclose(rows[i], model(t), rel_tol=1e-9, abs_tol=1e-9)


def test_query_keeps_every_context(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ppm, "MAX_CODES", 1000)  # stands for a corpus many times as large
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    model, _ = plain_model([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10], 1 << 40)
    for r in op6_lm(spark, sf_dir).collect()[:25]:
        assert math.isclose(r.score, model(texts[r.doc_id]), rel_tol=1e-9, abs_tol=1e-9)


def test_words_hashed_together_are_told_apart_as_split_words():
    rng = np.random.default_rng(1)
    letters = np.array(list("abABzé\u0085\x1c .\t\n\x0b\x0c\r"))
    texts = ["", " \n", "a", "Q" * 64 + " " + "q" * 65 + " " + "Q" * 65, *("".join(rng.choice(letters, n)) for n in range(1, 400))]
    want = [[*t.encode().lower().split(), b""] for t in texts]
    keys, sizes = ppm.words_of(texts)
    assert sizes.tolist() == list(map(len, want))
    pairs = set(zip((w for x in want for w in x), keys.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({k for _, k in pairs})
    assert [len(x) for x in ppm.words_of([])] == [0, 0]
