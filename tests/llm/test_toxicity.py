import numpy as np
import pytest

from cliploom.llm import toxicity
from cliploom.llm.op03_toxicity import op3_toxicity


def test_gradients(monkeypatch):
    net = toxicity.Network.new(["idiot", "the", "a"], seed=1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    words = ["the", "idiot", "unseen", "a"]
    rnd = np.random.default_rng(0)
    at = rnd.integers(0, 4, (3, toxicity.WINDOW))
    at[1, 5:] = -1
    pull = np.array([0.5, -1.0, 2.0])

    def value():
        source = net.source(words)
        x = net.inputs(source)
        kept: list = []
        out = net.forward(net.project(x), at, kept)
        return (out[0] * pull).sum(), (kept, out, x, source)

    _, (kept, out, x, source) = value()
    gradients = net.backward(pull, kept, out, x, source)
    for name, g in gradients.items():
        w = net.weights[name]
        for _ in range(4):
            i = tuple(rnd.integers(0, n) for n in w.shape)
            if name == "C":
                i = (source[1][0], i[1])
            before, step = w[i], 1e-5
            w[i] = before + step
            up = value()[0]
            w[i] = before - step
            down = value()[0]
            w[i] = before
            assert abs((up - down) / (2 * step) - g[i]) < 2e-3 * max(1, abs(g[i])), name


def test_windows_cover_all_words():
    for n in (1, 15, 16, 17, 31, 32, 33, 48, 49, 500):
        covered = set()
        for s in toxicity.window_starts(n):
            assert s < n
            covered.update(range(s, min(n, s + toxicity.WINDOW)))
        assert covered == set(range(n))
        for begin in range(n - toxicity.STRIDE + 1):  # each run of so many words lies whole in a window
            assert any(s <= begin and begin + toxicity.STRIDE <= s + toxicity.WINDOW for s in toxicity.window_starts(n))


def test_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op3_toxicity(spark, sf_dir).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [i for i in labels if rows[i].held_out]
    y, p = np.array([labels[i] for i in held]), np.array([rows[i].predicted for i in held])
    hit = (y & p).sum()
    print("precision", hit / p.sum(), "recall", hit / y.sum())
    assert hit / p.sum() > 0.85 and hit / y.sum() > 0.75
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())


def test_scores_equal_a_plain_forward_pass(spark):
    """Every window of every whole text alone, word by word, without batches, word table or Spark."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.train(docs, labels)
    w = net.weights
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        form = toxicity.plain(word)
        row = net.vocabulary.get(form, 0)
        flat, _ = toxicity.grams([form])
        return np.concatenate([w["E"][row], w["C"][flat].mean(0), net.odds[row : row + 1]])

    def logit(words):
        states = np.zeros((len(words), 2 * toxicity.HIDDEN))
        for k, d in enumerate("fb"):
            h = np.zeros(toxicity.HIDDEN)
            for t in range(len(words)) if d == "f" else reversed(range(len(words))):
                g, u = vector(words[t]) @ w[f"X{d}"] + w[f"B{d}"], h @ w[f"H{d}"]
                z, r, c = np.split(g, 3)[0] + np.split(u, 3)[0], np.split(g, 3)[1] + np.split(u, 3)[1], np.split(g, 3)[2]
                c = np.tanh(c + sigmoid(r) * np.split(u, 3)[2])
                h = sigmoid(z) * h + (1 - sigmoid(z)) * c
                states[t, k * toxicity.HIDDEN : (k + 1) * toxicity.HIDDEN] = h
        e = np.exp(np.tanh(states @ w["A"] + w["a"]) @ w["v"])
        return (e / e.sum()) @ states @ w["o"] + w["c"][0]

    rows = sorted(docs.collect(), key=lambda r: len(r.text or ""))[::12]
    got = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    for r in rows:
        words = toxicity.split(r.text or "")
        best = max((logit(words[s : s + toxicity.WINDOW]) for s in range(0, max(1, len(words) - toxicity.STRIDE), toxicity.STRIDE)), default=-np.inf) if words else -np.inf
        want = sigmoid((best - net.cut) * net.scale + np.log(0.7 / 0.3)) if words else 0.0
        assert abs(got[r.doc_id] - want) < 1e-4, (r.doc_id, got[r.doc_id], want)


def test_few_labels_leave_clean_texts(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op3_toxicity(spark, sf_dir).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [i for i in labels if rows[i].held_out]
    y, p = np.array([labels[i] for i in held]), np.array([rows[i].predicted for i in held])
    hit = (y & p).sum()
    print("few labels: precision", hit / p.sum(), "recall", hit / y.sum())
    assert hit / p.sum() > 0.75 and hit / y.sum() > 0.5


def test_odd_texts(spark):
    bad, good = "you utter moron go away " * 3, "the meeting of the council was held in may " * 3
    docs = spark.createDataFrame([(i, bad if i % 3 == 0 else good) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, " \n"), (3, "moron " * 50_000), (4, good), (4, good), (5, bad)], "doc_id long, text string")
    rows = toxicity.score(odd.selectExpr("*", "1 as score"), net).collect()
    assert [r.score for r in rows if not (r.text or "").strip()] == [0, 0, 0]
    assert [r.score >= 0.7 for r in rows if (r.text or "").strip()] == [True, False, False, True]
    assert toxicity.score(odd.limit(0), net).count() == 0
    with pytest.raises(ValueError):
        toxicity.train(docs, labels.where("toxic = 1"))


def test_long_words_count_whole():
    for word in ("x", "a" * 64, "a" * 65, "ab." * 1000, "\u8a9e\U0001f600\u00e9z" * 500):
        own = toxicity.parts(word.encode())
        assert all(len(x) <= toxicity.PART and x.decode() for x in own)
        at = 0
        for i, x in enumerate(own):  # each part begins in the one before and goes on
            begin = word.encode().index(x, max(0, at - toxicity.PART)) if i else 0
            assert begin <= at
            at = begin + len(x)
        assert own[-1] == word.encode()[-len(own[-1]) :]
    assert toxicity.split(" ab  c" + "d" * 100) == [b"ab", *toxicity.parts(b"c" + b"d" * 100)]


def test_texts_without_blanks(spark):
    edge = "the_meeting_of_the_council_was_held_in_may_"
    text = lambda i, middle: edge * (2 + i // 3 % 3) + f"{i}_" + middle * 4 + edge * 2
    docs = [(i, text(i, "you_utter_moron_go_away_" if i % 3 == 0 else "see_annual_report_of_work_")) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert [r.score >= 0.7 for r in sorted(rows)] == [i % 3 == 0 for i in range(90)]
