"""Toxicity scores from a bidirectional gated recurrent network, trained in numpy.

Words are what lies between white space; a longer one than PART bytes, as in texts
without blanks, is read as overlapping parts of at most so many, each in its own place.
Each word enters by a word vector, by the mean of its character n-gram vectors,
and by its odds: how much oftener than by chance toxic texts hold it, less a
margin for few texts. A forward and a backward gated recurrent layer read a window
of words, attention pools the states, and a logistic unit scores the window. A
text's score is that of its highest window, over all overlapping windows of the
whole text. Windows begin every half window, so WINDOW / 2 words in a row always lie
in one. Because the label is the text's, training repeats: score all windows of
the sample, then learn from the highest windows of toxic texts and the highest
and some random windows of the others. The first scores are the log odds of
n-grams to lie in toxic texts. A text of the sample is left out of its own odds, so
that words of one text teach nothing.

The cut between the classes comes from scores of texts by networks that have not
learned from them: FOLDS networks, each fitted without its share of the sample.

The classifier is fitted on at most max_toxic and max_clean labelled texts,
taken in the order of a hash of their ids; these bounds hold the driver's memory
and time. The vocabulary is all words of three texts of the sample or more. The
fitted arrays are bounded by the sample and broadcast.

Defined results: a null, empty or blank text scores 0; rows may repeat; an
unlabelled corpus, or one without both labels, raises ValueError; labels of a
text that disagree count as toxic; of repeated ids one text is learned from; an
empty table scores no rows.
"""

from __future__ import annotations

import itertools
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import give_back, map_arrow, ragged, slices, with_columns

WINDOW, STRIDE = 32, 16
PART = 64
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 12, 8, 8
INPUTS = WORD_DIM + CHAR_DIM + 1
BUCKETS, FOLDS = 8192, 3
SMOOTH, PRIOR, RECALL = 0.05, 20, 0.25
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(np.clip(-2 * x, -40, 40))) - 1


def plain(word: bytes) -> str:
    """Lower case without punctuation at the ends; a word of punctuation alone stays."""
    low = word.decode("utf-8", "replace").lower()
    return low.strip(PUNCTUATION) or low


def parts(word: bytes) -> list[bytes]:
    """The word, or parts of whole characters that overlap by about half of PART bytes and cover it."""
    out, begin, end = [], 0, 0
    while end < len(word):
        end = min(begin + PART, len(word))
        while end < len(word) and word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[begin:end])
        begin = end - PART // 2
        while begin > 0 and word[begin] & 0xC0 == 0x80:
            begin -= 1
    return out


def split(text: str) -> list[bytes]:
    """The words of a text in order, long ones in parts."""
    words = text.encode("utf-8", "replace").split()
    return words if max(map(len, words), default=0) <= PART else [p for w in words for p in parts(w)]


def grams(words: list[str], buckets: int = BUCKETS, each: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of 2 to 6 of each word, with marks at both ends, and how many each word has."""
    made = [grams_at_once(words[i : i + each], buckets) for i in range(0, len(words), each)]  # a part at a time holds less
    if not made:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in made]), np.concatenate([n for _, n in made])


def grams_at_once(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    size = np.array([len(w) for w in raw])
    data = np.frombuffer(b"".join(raw) + bytes(6), np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(word))  # bytes of the word from here on
    code, places, owners = np.zeros(len(word), np.uint32), [], []
    for n in range(1, 7):
        code = code * np.uint32(0x01000193) + data[n - 1 : n - 1 + len(word)] + np.uint32(n)
        if n > 1:
            ok = left >= n
            places.append((code[ok] * np.uint32(0x9E3779B1)) >> np.uint32(33 - buckets.bit_length()))
            owners.append(word[ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(places)[order].astype(np.int32), np.bincount(owner, minlength=len(raw))


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.zeros(0, np.int64)


def added(n: int, places: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """n rows of sums of the rows by place."""
    order = np.argsort(places, kind="stable")
    first = np.nonzero(np.diff(places[order], prepend=-1))[0]
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[places[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


@dataclass
class Network:
    """Weights by name; vocabulary maps a word to its row of E and of odds, row 0 is any other word."""

    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    odds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    cut: float = 0.0
    scale: float = 1.0

    @classmethod
    def new(cls, words: list[str], seed: int = 0) -> Network:
        rnd = np.random.default_rng(seed)
        n = INPUTS
        f = lambda *s, k=0.3: rnd.normal(0, k, s)
        w = {"E": f(len(words) + 1, WORD_DIM), "C": f(BUCKETS, CHAR_DIM)}
        for d in "fb":
            w |= {f"X{d}": f(n, 3 * HIDDEN), f"H{d}": f(HIDDEN, 3 * HIDDEN), f"B{d}": f(3 * HIDDEN, k=0.0)}
        w |= {"A": f(2 * HIDDEN, ATTENTION), "a": f(ATTENTION, k=0.0), "v": f(ATTENTION), "o": f(2 * HIDDEN), "c": f(1, k=0.0)}
        return cls({x: i + 1 for i, x in enumerate(words)}, w, np.zeros(len(words) + 1))

    def source(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of E of each word, the buckets of all n-grams, how many each word has, and its odds."""
        row = np.array([self.vocabulary.get(w, 0) for w in words])
        return row, *grams(words), self.odds[row]

    def inputs(self, source: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Input vectors of the words."""
        row, flat, size, odds = source
        out = np.empty((len(row), INPUTS), self.weights["C"].dtype)
        out[:, :WORD_DIM] = self.weights["E"][row]
        out[:, -1] = odds
        ends = np.cumsum(size)
        for i in range(0, len(row), 10_000):  # the vectors of all n-grams at once would be large
            own = slice(i, i + 10_000)
            first = ends[i] - size[i]
            chars = self.weights["C"][flat[first : ends[own][-1]]]
            out[own, WORD_DIM:-1] = np.add.reduceat(chars, ends[own] - size[own] - first, axis=0) / size[own, None]
        return out

    def odds_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        row = np.array([self.vocabulary.get(w, 0) for w in words])
        return row, self.odds[row]

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.weights[f"X{d}"] + self.weights[f"B{d}"] for d in "fb"}

    def forward(self, gates: dict[str, np.ndarray], at: np.ndarray, keep: list | None = None):
        """Logits of windows of word numbers (-1: none); keep gathers what backward() needs."""
        n, w, mask = len(at), self.weights, at >= 0
        dtype = gates["f"].dtype
        mask = mask.astype(dtype)
        safe = np.maximum(at, 0)
        states = np.zeros((WINDOW, n, 2 * HIDDEN), dtype)
        for k, d in enumerate("fb"):
            h = np.zeros((n, HIDDEN), dtype)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                g, m = gates[d].take(safe[:, t], axis=0), mask[:, t : t + 1]
                u = h @ w[f"H{d}"]
                zr = sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                if keep is not None:
                    keep.append((d, t, h, z, r, c, u[:, 2 * HIDDEN :]))
                h = h + m * (1 - z) * (c - h)
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        hidden = tanh(states @ w["A"] + w["a"])
        score = np.where(at.T >= 0, hidden @ w["v"], -1e9)
        score = np.exp(score - score.max(0))
        weight = score * mask.T
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (states * weight[:, :, None]).sum(0)
        logit = pooled @ w["o"] + w["c"][0]
        return (logit, states, hidden, weight, pooled, safe, mask) if keep is not None else logit

    def backward(self, d_logit: np.ndarray, kept: list, out: tuple, x: np.ndarray, source: tuple) -> dict[str, np.ndarray]:
        """Gradients of sum(d_logit * logit) by name."""
        _, states, hidden, weight, pooled, safe, mask = out
        w, g = self.weights, {}
        g["o"], g["c"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * w["o"]
        d_weight = (states * d_pooled).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["v"] = (hidden * d_score[:, :, None]).sum((0, 1))
        d_hidden = d_score[:, :, None] * w["v"] * (1 - hidden**2)
        g["A"] = np.tensordot(states, d_hidden, ((0, 1), (0, 1)))
        g["a"] = d_hidden.sum((0, 1))
        d_states = weight[:, :, None] * d_pooled + d_hidden @ w["A"].T
        d_x = np.zeros_like(x)
        for k, name in enumerate("fb"):
            d_h = np.zeros((len(safe), HIDDEN), x.dtype)
            g[f"H{name}"] = np.zeros_like(w[f"H{name}"])
            places, parts = [], []
            for d, t, h, z, r, c, u in reversed(kept):
                if d != name:
                    continue
                m = mask[:, t : t + 1]
                d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                d_new = d_h * m
                d_c = d_new * (1 - z) * (1 - c**2)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * u * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_c * r], 1)
                g[f"H{name}"] += h.T @ d_u
                places.append(safe[:, t])
                parts.append(np.concatenate([d_z, d_r, d_c], 1))
                d_h = d_h * (1 - m) + d_new * z + d_u @ w[f"H{name}"].T
            d_gate = added(len(x), np.concatenate(places), np.concatenate(parts))
            g[f"X{name}"], g[f"B{name}"] = x.T @ d_gate, d_gate.sum(0)
            d_x += d_gate @ w[f"X{name}"].T
        row, flat, size, _ = source
        g["E"] = added(len(w["E"]), row, d_x[:, :WORD_DIM])
        g["C"] = added(len(w["C"]), flat, np.repeat((d_x[:, WORD_DIM:-1] / size[:, None]).astype(x.dtype), size, axis=0))
        return g


class WordTable:
    """Gate inputs of each distinct word for a fixed network, made once; begins anew at a size that bounds memory."""

    def __init__(self, network: Network, most: int = 200_000):
        self.network, self.most = network, most
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.gates = {d: np.zeros((0, 3 * HIDDEN), np.float32) for d in "fb"}

    def rows(self, lists: list[list[bytes]]) -> np.ndarray:
        words = list(itertools.chain.from_iterable(lists))
        rows = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.nonzero(rows < 0)[0]
        if len(missing):
            new = {words[i] for i in missing}
            if len(self.index) + len(new) > self.most:
                self._clear()
                new, missing = set(words), np.arange(len(words))
            self._add(sorted(new))
            rows[missing] = np.fromiter((self.index[words[i]] for i in missing), np.int64, len(missing))
        return rows

    def _add(self, words: list[bytes]) -> None:
        forms = [plain(w) for w in words]
        number = {w: i for i, w in enumerate(dict.fromkeys(forms))}
        made = self.network.project(self.network.inputs(self.network.source(list(number))))
        known = len(self.gates["f"])
        self.gates = {d: np.concatenate([self.gates[d], made[d]]) for d in "fb"}
        self.index.update((w, known + number[f]) for w, f in zip(words, forms, strict=True))

    def windows(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Windows of word rows, -1 where there is no word, and the text of each."""
        rows, sizes = self.rows(lists), [len(x) for x in lists]
        starts = [window_starts(n) for n in sizes]
        text = np.repeat(np.arange(len(lists)), [len(s) for s in starts])
        if not len(text):
            return np.zeros((0, WINDOW), np.int64), text
        sizes = np.array(sizes)
        place = np.concatenate(starts)[:, None] + np.arange(WINDOW)
        inside = place < sizes[text][:, None]
        at = np.where(inside, (np.cumsum(sizes) - sizes)[text][:, None] + place, 0)
        return np.where(inside, rows[at], -1), text

    def logits(self, texts: list[str], each: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows, and the text of each."""
        at, text = self.windows([split(t) for t in texts])
        parts = [self.network.forward(self.gates, at[i : i + each]) for i in range(0, len(at), each)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32), text


def highest(logit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The highest logit of each text; minus infinity for texts without windows."""
    out = np.full(n, -np.inf)
    np.maximum.at(out, text, logit)
    return out


@dataclass
class Sample:
    """Distinct words of the sample, the word numbers of each text, and its windows with the text of each."""

    names: list[str]
    rows: list[np.ndarray]
    toxic: np.ndarray
    at: np.ndarray
    text: np.ndarray
    grams: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, texts: list[str], toxic: np.ndarray) -> Sample:
        number: dict[str, int] = {}
        forms: dict[bytes, int] = {}
        rows = []
        for t in texts:
            own = split(t)
            for w in dict.fromkeys(own):
                if w not in forms:
                    forms[w] = number.setdefault(plain(w), len(number))
            rows.append(np.array([forms[w] for w in own], np.int32))
        starts = [window_starts(len(x)) for x in rows]
        text = np.repeat(np.arange(len(rows)), [len(x) for x in starts])
        at = np.full((len(text), WINDOW), -1, np.int32)
        i = 0
        for x, own in zip(rows, starts, strict=True):
            for k in own:
                at[i, : min(WINDOW, len(x) - k)] = x[k : k + WINDOW]
                i += 1
        return cls(list(number), rows, np.asarray(toxic, bool), at, text, grams(list(number)))


def fit(texts: list[str], toxic: np.ndarray, seed: int = 0) -> Network:
    """A network fitted to whole labelled texts, with the cut between the classes and the scale of its logits."""
    sample = Sample.of(texts, toxic)
    fold = np.zeros(len(texts), np.int64)
    rnd = np.random.default_rng(seed)
    for label in (False, True):
        own = np.nonzero(sample.toxic == label)[0]
        fold[rnd.permutation(own)] = np.arange(len(own)) % FOLDS
    best = np.zeros(len(texts))
    if min(sample.toxic.sum(), (~sample.toxic).sum()) >= FOLDS:
        for k in range(FOLDS):
            best[fold == k] = unseen(learned(sample, fold != k, seed), sample, fold == k)[fold == k]
        net = learned(sample, np.ones(len(texts), bool), seed)
    else:  # too few texts of a kind to leave some out
        net = learned(sample, np.ones(len(texts), bool), seed)
        best = unseen(net, sample, np.ones(len(texts), bool))
    net.cut, net.scale = cut_of(best, sample.toxic)
    # fitted in double precision, so that the machine's order of sums decides nothing; scored in single precision
    net.weights = {k: v.astype(np.float32) for k, v in net.weights.items()}
    net.odds = net.odds.astype(np.float32)
    return net


def unseen(net: Network, sample: Sample, mine: np.ndarray) -> np.ndarray:
    """The highest logit of each text of a mask; the lowest of all for texts without words."""
    own = np.nonzero(mine[sample.text])[0]
    best = highest(scores(net, sample, sample.at[own], net.odds_of(sample.names)), sample.text[own], len(mine))
    return np.where(np.isfinite(best), best, best[np.isfinite(best)].min(initial=0.0))


def learned(sample: Sample, known: np.ndarray, seed: int, rounds: int = 3, passes: int = 2, rate: float = 0.01, batch: int = 256, least: int = 30, decay: float = 0.02) -> Network:
    """A network that learned from the known texts of the sample."""
    rnd = np.random.default_rng(seed)
    names, toxic, at, text = sample.names, sample.toxic, sample.at, sample.text
    seen = np.zeros((2, len(names)), np.int64)
    for x, y, k in zip(sample.rows, toxic, known, strict=True):
        if k:
            seen[int(y), np.unique(x)] += 1
    texts = np.bincount(toxic[known].astype(int), minlength=2)
    often = np.nonzero(seen.sum(0) >= 3)[0]
    net = Network.new([names[i] for i in often], seed)
    net.odds[1:] = margin_odds(seen[:, often], texts)
    row = np.zeros(len(names), np.int64)
    row[often] = 1 + np.arange(len(often))
    # a text's own share is taken off the counts that its windows see
    own_odds = np.zeros((2, len(names)))
    for y in (0, 1):
        off = np.array([[1 - y], [y]])
        own_odds[y, often] = margin_odds(np.maximum(seen[:, often] - off, 0), texts - off[:, 0])
    flat, size = sample.grams
    begin = np.cumsum(size) - size
    hot = toxic[text]
    learn = np.nonzero(known[text])[0]
    odds = np.append(word_odds(names, [x for x, k in zip(sample.rows, known, strict=True) if k], toxic[known]), np.float32(0))
    first = odds[at].max(axis=1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step = 0
    for turn in range(rounds):
        logit = first
        if turn:
            logit = np.zeros(len(at), np.float32)
            for y in (0, 1):
                own = learn[hot[learn] == y]
                logit[own] = scores(net, sample, at[own], (row, own_odds[y]))
        order = learn[np.argsort(-logit[learn], kind="stable")]
        rank = np.zeros(len(at), np.int64)
        counts: dict[int, int] = {}
        for i in order:
            rank[i] = counts[text[i]] = counts.get(text[i], -1) + 1
        chosen = learn[np.where(hot[learn], rank[learn] < (3 if turn else 2), rank[learn] < 1)]
        others = learn[~hot[learn]]
        chosen = np.unique(np.concatenate([chosen, rnd.choice(others, min(len(others), len(chosen)), replace=False)]))
        share = hot[chosen].mean()
        parts = max(1, len(chosen) // batch)
        for _ in range(max(passes, least // parts)):
            for part in np.array_split(rnd.permutation(chosen), parts):
                both = np.where(at[part] < 0, -1, at[part] + len(names) * hot[part][:, None])
                used, inverse = np.unique(both, return_inverse=True)
                inverse = inverse.reshape(both.shape) - (used[0] < 0)
                used = used[used >= 0]
                word = used % len(names)
                hide = rnd.random(len(used))
                place = np.where(hide < 0.2, 0, row[word])  # some words count by their characters alone
                lean = np.where(hide < 0.2, 0, own_odds[used // len(names), word])
                own = place, ragged(flat, begin[word], size[word]), size[word], lean
                x = net.inputs(own)
                kept: list = []
                out = net.forward(net.project(x), inverse, kept)
                y = np.where(hot[part], 1 - SMOOTH, SMOOTH)
                weigh = np.where(hot[part], 0.5 / share, 0.5 / (1 - share)) / len(part)
                gradients = net.backward((sigmoid(out[0]) - y) * weigh, kept, out, x, own)
                step += 1
                for k, g in gradients.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.weights[k] -= rate * (decay * net.weights[k] + m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    return net


def margin_odds(seen: np.ndarray, texts: np.ndarray, add: float = 0.5, margin: float = 1.5) -> np.ndarray:
    """Log odds of words to lie in toxic texts, by numbers of clean and toxic texts, drawn towards 0 by a margin of standard errors."""
    prior = 2 * add * texts / texts.sum()
    c, t = seen + prior[:, None]
    odds = np.log(t / (texts[1] + 1)) - np.log(c / (texts[0] + 1)) - np.log((prior[1] / (texts[1] + 1)) / (prior[0] / (texts[0] + 1)))
    return np.sign(odds) * np.maximum(0, np.abs(odds) - margin * np.sqrt(1 / (t + add) + 1 / (c + add)))


def word_odds(names: list[str], rows: list[np.ndarray], toxic: np.ndarray, buckets: int = 1 << 20) -> np.ndarray:
    """For each word the highest log odds of its n-grams to lie in toxic texts, by numbers of texts."""
    flat, size = grams(names, buckets)
    begin = np.cumsum(size) - size
    seen = np.zeros((2, buckets), np.float32)
    for x, y in zip(rows, toxic, strict=True):
        own = np.unique(x)
        seen[int(y), np.unique(ragged(flat, begin[own], size[own]))] += 1
    share = (seen + 0.5) / (np.array([(~toxic).sum(), toxic.sum()])[:, None] + 1)
    odds = np.where(seen[1] >= 3, np.log(share[1] / share[0]), 0.0).astype(np.float32)
    return np.maximum.reduceat(odds[flat], begin)


def scores(net: Network, sample: Sample, at: np.ndarray, rows_odds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Logits of windows of the sample's words, with the row of E and the odds of each word."""
    gates = net.project(net.inputs((rows_odds[0], *sample.grams, rows_odds[1])))
    return np.concatenate([np.zeros(0, np.float32), *(net.forward(gates, at[i : i + 4096]) for i in range(0, len(at), 4096))])


def cut_of(best: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The middle of the logits between which the F value is highest, and the scale that fits the labels best there.

    Recall weighs RECALL of precision, as clean texts are many more. Both kinds weigh alike in training, so that a logit of 0 is the cut without any
    scores; it counts as PRIOR toxic texts, which softens a cut from few labels.
    """
    order = np.argsort(-best, kind="stable")
    falling = best[order]
    f = (1 + RECALL) * np.cumsum(toxic[order]) / (np.arange(len(best)) + 1 + RECALL * toxic.sum())
    top = np.nonzero(f >= f.max() - 1e-12)[0]
    k = int(top[len(top) // 2])
    low = falling[k + 1] if k + 1 < len(best) else falling[k] - 1
    cut = float((falling[k] + low) / 2 * toxic.sum() / (toxic.sum() + PRIOR))
    fit = lambda s: np.logaddexp(0, np.where(toxic, cut - best, best - cut) * s).mean()
    return cut, min((0.25, 0.5, 1.0, 2.0), key=fit)


def training_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """key, text, __y (1 for toxic) and __h, by which the sample is ordered: at most max_toxic and max_clean rows."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max((F.col(label) != 0).cast("int")).alias("__y"))
    known = known.withColumn("__h", F.xxhash64(F.col(key).cast("string"), F.lit(7)))
    chosen = known.where("__y = 1").orderBy("__h", key).limit(max_toxic).unionByName(known.where("__y = 0").orderBy("__h", key).limit(max_clean))
    return docs.select(key, text).join(F.broadcast(chosen), key).groupBy(key, "__y", "__h").agg(F.max(text).alias(text))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 800, max_clean: int = 1600, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    """A network fitted to the sample, which one task holds; the driver gets the network alone."""

    def learn(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["__h", key])
        toxic = sample["__y"].to_numpy() == 1
        made = pickle.dumps(fit(sample[text].fillna("").tolist(), toxic)) if toxic.any() and not toxic.all() else None
        give_back()
        return pd.DataFrame({"network": [made]})

    sample = training_sample(docs, labels, max_toxic, max_clean, key, text, label)
    row = sample.groupBy().applyInPandas(learn, "network binary").first()
    if not row or row[0] is None:
        raise ValueError("labelled texts of both kinds are needed")
    return pickle.loads(row[0])


def score(df: DataFrame, network: Network, text: str = "text", to: str = "score", threshold: float = 0.7) -> DataFrame:
    """df with the double column `to`; the network's cut lies at threshold."""
    known = df.sparkSession.sparkContext.broadcast(network)
    base = float(np.log(threshold / (1 - threshold)))

    def run(batches):
        table = WordTable(known.value)
        for batch, texts in slices(batches, text):
            best = highest(*table.logits(texts), len(texts))
            value = np.clip(1 / (1 + np.exp(-np.clip((best - known.value.cut) * known.value.scale + base, -700, 700))), 0, 1)
            yield with_columns(batch, {to: pa.array(np.where(np.isfinite(best), value, 0.0), pa.float64())})

    return map_arrow(df, df.columns, run, f"`{to}` double")
