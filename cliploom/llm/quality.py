"""Quality by weak supervision: rules vote or abstain, and EM estimates how far to trust each.

features() measures whole texts, votes() turns the measures into votes of RULES
(1 good, 0 bad, null abstains). Votes are counted by pattern in Spark; there are at
most 3 ** len(RULES) patterns, whatever the corpus. On those counts, expectation-
maximisation fits the share of good texts and the accuracy of each rule, which is
held above one half so that the classes can't change places. A text's posterior
probability of being good replaces a filter that all rules must pass.

Defined results: a null or empty text has zero measures, and rules that need words
abstain; with no vote at all the posterior is the share of good texts; an empty
table fits the starting values and gives no rows; repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import map_arrow, slices, with_columns
from cliploom.llm.neardup import MULTIPLIER, WordHashes, mix

WINDOW = 8
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = frozenset(
    "the of and to in is that for it as with on by at from this be are was an or "
    "de la le les des et en un une que qui dans pour par sur est du au "
    "el los las y del se por con una su para al como "
    "der die das und zu den von mit ist auf für im ein eine dem nicht".split()
)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_alpha_words", "n_upper_words", "n_distinct_words"]

STOP, ALPHA, UPPER = 1, 2, 4


def kind_of(word: bytes) -> int:
    w = word.decode("utf-8", "replace").strip(".,;:!?\"'()")
    return STOP * (w.lower() in STOP_WORDS) | ALPHA * w.isalpha() | UPPER * (w.isupper() and len(w) > 1)


class WordKinds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = kind_of(word)
        return value


def repeats(word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of WINDOW words found twice or more in it."""
    total, out = len(word), np.zeros(len(sizes), np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begin = np.nonzero(place <= np.repeat(sizes - WINDOW, sizes))[0]
    if not len(begin):
        return out
    value = np.zeros(len(begin), np.uint64)
    for i in range(WINDOW):
        value = mix(value * MULTIPLIER + word[begin + i])
    order = np.lexsort((value, doc[begin]))
    v, d = value[order], doc[begin][order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = begin[order[twice]]
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=len(sizes))


def measure(texts: list[str], hashes: WordHashes, kinds: WordKinds) -> dict[str, np.ndarray]:
    lists = [t.encode("utf-8", "replace").split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    doc = np.repeat(np.arange(len(lists)), sizes)
    word = np.fromiter((hashes[w] for x in lists for w in x), np.uint64, len(doc))
    kind = np.fromiter((kinds[w] for x in lists for w in x), np.int64, len(doc))
    dup, lines = [], []
    for t in texts:
        own = [x for x in t.split("\n") if x.strip(SPACES)]
        lines.append(len(own))
        dup.append(len(own) - len(set(own)))
    count = lambda keep: np.bincount(doc[keep], minlength=len(lists))
    return {
        "n_words": sizes,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": repeats(word, sizes),
        "n_lines": np.array(lines, np.int64),
        "n_stop_words": count(kind & STOP > 0),
        "n_alpha_words": count(kind & ALPHA > 0),
        "n_upper_words": count(kind & UPPER > 0),
        "n_distinct_words": np.array([len(set(x)) for x in lists], np.int64),
    }


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with the MEASURES."""

    def run(batches):
        hashes, kinds = WordHashes(), WordKinds()
        for batch, texts in slices(batches, text):
            made = measure(texts, hashes, kinds)
            yield with_columns(batch, {k: pa.array(made[k], pa.int64()) for k in MEASURES}).drop_columns([text])

    return map_arrow(df, df.columns, run, ", ".join(f"{k} long" for k in MEASURES), without=[text])


#: Name, condition of a good vote, condition of a bad vote; else the rule abstains.
RULES = [
    ("length", "n_words >= 50", "n_words < 20"),
    ("word_length", "word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("symbols", "n_words >= 10 and 100 * n_symbols <= n_words", "n_symbols > 0 and 10 * n_symbols >= n_words"),
    ("lines", "n_lines >= 3 and n_dup_lines = 0", "n_lines > 1 and 10 * n_dup_lines >= 3 * n_lines"),
    ("windows", "n_words >= 50 and 100 * n_repeat_words <= 5 * n_words", "n_words > 0 and 100 * n_repeat_words > 20 * n_words"),
    ("stop_words", "n_words >= 10 and 100 * n_stop_words >= 10 * n_words", "n_words >= 30 and 100 * n_stop_words < 2 * n_words"),
    ("letters", "n_words >= 10 and 100 * n_alpha_words >= 85 * n_words", "n_words >= 10 and 100 * n_alpha_words < 60 * n_words"),
    ("capitals", "n_words >= 10 and 100 * n_upper_words <= 10 * n_words", "n_words >= 10 and 100 * n_upper_words > 40 * n_words"),
    ("variety", "n_words >= 50 and 100 * n_distinct_words >= 30 * n_words", "n_words >= 50 and 100 * n_distinct_words < 10 * n_words"),
]


def votes(measured: DataFrame) -> DataFrame:
    """measured with an int column vote_<rule> for each rule."""
    return measured.withColumns({f"vote_{n}": F.expr(f"case when {bad} then 0 when {good} then 1 end") for n, good, bad in RULES})


def fit_em(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[float, np.ndarray]:
    """Share of good texts and accuracy of each rule, from vote patterns (-1 abstains) and their counts."""
    share, accuracy = 0.8, np.full(patterns.shape[1], 0.8)
    voted, good = patterns >= 0, patterns == 1
    weight = counts.astype(float)
    for _ in range(steps):
        p = posterior(patterns, share, accuracy)
        right = np.where(good, p[:, None], 1 - p[:, None]) * voted
        new = (weight @ right + 8) / (weight @ voted + 10)  # as if ten more votes, eight of them right
        new_share = (weight @ p + 8) / (weight.sum() + 10)
        moved = max(abs(new - accuracy).max(initial=0), abs(new_share - share))
        accuracy, share = np.clip(new, 0.55, 0.99), float(np.clip(new_share, 0.05, 0.95))
        if moved < 1e-9:
            break
    return share, accuracy


def posterior(patterns: np.ndarray, share: float, accuracy: np.ndarray) -> np.ndarray:
    odds = np.log(accuracy / (1 - accuracy))
    total = np.log(share / (1 - share)) + ((patterns == 1) * odds - (patterns == 0) * odds).sum(1)
    return 1 / (1 + np.exp(-total))


def estimate(voted: DataFrame) -> tuple[float, dict[str, float]]:
    """Share of good texts and accuracy by rule; counts the votes in Spark."""
    names = [f"vote_{n}" for n, _, _ in RULES]
    rows = sorted(voted.groupBy(*(F.coalesce(c, F.lit(-1)).alias(c) for c in names)).count().collect())
    table = np.array([tuple(r) for r in rows], np.int64).reshape(-1, len(names) + 1)
    share, accuracy = fit_em(table[:, :-1], table[:, -1])
    return share, dict(zip((n for n, _, _ in RULES), accuracy.tolist(), strict=True))


def judge(voted: DataFrame, share: float, accuracy: dict[str, float], to: str = "quality") -> DataFrame:
    """voted with the posterior probability of a good text."""
    total = F.lit(float(np.log(share / (1 - share))))
    for name, a in accuracy.items():
        odds = float(np.log(a / (1 - a)))
        total = total + F.when(F.col(f"vote_{name}") == 1, odds).when(F.col(f"vote_{name}") == 0, -odds).otherwise(0.0)
    return voted.withColumn(to, 1 / (1 + F.exp(-total)))
