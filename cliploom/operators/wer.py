"""Word error rates: counts per row, then sums by slice."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cliploom.functions.text import normalize_atc, words

COUNTS = StructType([StructField(n, LongType()) for n in ("hits", "substitutions", "deletions", "insertions")])
PAIR = StructType([StructField(n, LongType()) for n in ("errors_a", "errors_b", "ref_words")])

FAR = 1 << 40


def banded(r: np.ndarray, h: np.ndarray, band: int) -> np.ndarray:
    """Errors, substitutions, deletions and insertions of a shortest edit that keeps within band places of the diagonal.

    Two rows are held. A cell comes from its diagonal neighbour, else by a deletion,
    else by an insertion, whichever comes first among the cheapest.
    """
    m, width = len(h), 2 * band + 1
    places = np.arange(width)
    # column k of row i stands for place i - band + k of the hypothesis
    first = places - band
    row = np.full((4, width + 1), FAR)  # one more column: nothing lies beyond the band
    inside = (first >= 0) & (first <= m)
    row[:, :width][:, inside] = 0
    row[0, :width][inside] = row[3, :width][inside] = first[inside]
    padded = np.concatenate([np.full(band + 1, -1), h, np.full(band + len(r) + 1, -1)])
    for i in range(1, len(r) + 1):
        other = padded[i : i + width] != r[i - 1]
        diagonal, above = row[0, :width] + other, row[0, 1:] + 1
        best = np.minimum(diagonal, above)
        deleted = above < diagonal
        moved = np.where(deleted, row[:, 1:], row[:, :width])
        moved[0] = best
        moved[1] += ~deleted & other
        moved[2] += deleted
        j = i - band + places
        if j[0] <= 0:
            moved[0, j < 0] = FAR
        if j[-1] > m:
            moved[0, j > m] = FAR
        level = moved[0] - places
        low = np.minimum.accumulate(level)
        origin = np.maximum.accumulate(np.where(level == low, places, 0))  # where the insertions that lead here begin
        row[:, :width] = moved[:, origin]
        row[0, :width] = low + places
        row[3, :width] += places - origin
    return row[:, m - len(r) + band]


def align(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """Hits, substitutions, deletions, insertions of a shortest edit; of equal ones the diagonal, then the deletion goes first.

    Equal ends are matched at once. Words that the other side lacks are a least number of
    errors; word-for-word replacement, or deletions or insertions alone, that reach it are
    shortest. Else a shortest edit of d errors lies within d places of the diagonal, so a
    band is doubled until it holds one: time grows with words times errors.
    """
    codes = numbers()
    return align_numbers(numbered(ref, codes), numbered(hyp, codes), len(codes))


def numbers() -> defaultdict[str, int]:
    """Gives each new word the next number."""
    return defaultdict(count().__next__)


def numbered(said: list[str], codes: dict[str, int]) -> np.ndarray:
    return np.array([*map(codes.__getitem__, said)], np.int64)


def align_numbers(r: np.ndarray, h: np.ndarray, known: int) -> tuple[int, int, int, int]:
    """align of words that have numbers below known."""
    n = min(len(r), len(h))
    unlike = np.nonzero(r[len(r) - n :][::-1] != h[len(h) - n :][::-1])[0]
    end = int(unlike[0]) if len(unlike) else n
    r, h = r[: len(r) - end], h[: len(h) - end]
    if not len(r) or not len(h):
        return end, 0, len(r), len(h)
    least = max(len(r), len(h)) - int(np.minimum(np.bincount(r, minlength=known), np.bincount(h, minlength=known)).sum())
    if len(r) == len(h):
        if (sub := int((r != h).sum())) == least:
            return end + len(r) - sub, sub, 0, 0
    elif abs(len(r) - len(h)) == least:
        short, long = (r, h) if len(r) < len(h) else (h, r)
        rest = iter(long.tolist())
        if all(w in rest for w in short.tolist()):
            return (end + len(r), 0, 0, least) if short is r else (end + len(h), 0, least, 0)
    band = max(least, 8)
    while True:
        band = min(band, max(len(r), len(h)))
        errors, sub, dele, ins = map(int, banded(r, h, band))
        if errors <= band or band == max(len(r), len(h)):
            return end + len(r) - sub - dele, sub, dele, ins
        band *= 2


def aligned(ref: pd.Series, *hypotheses: pd.Series) -> list[tuple[int, ...]]:
    """Counts of each hypothesis against the same reference, side by side; equal rows are aligned once."""
    known: dict = {}
    rows = []
    for texts in zip(ref.fillna(""), *(h.fillna("") for h in hypotheses), strict=True):
        if texts not in known:
            codes = numbers()
            r, *others = (numbered(t.split(), codes) for t in texts)
            known[texts] = sum((align_numbers(r, h, len(codes)) for h in others), ())
        rows.append(known[texts])
    return rows


@F.pandas_udf(COUNTS)
def _counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(aligned(ref, hyp), columns=COUNTS.names)


@F.pandas_udf(PAIR)
def _pairs(ref: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    x = np.array(aligned(ref, a, b), np.int64).reshape(-1, 2, 4)
    errors = x[:, :, 1:].sum(2)
    return pd.DataFrame({"errors_a": errors[:, 0], "errors_b": errors[:, 1], "ref_words": x[:, 0, :3].sum(1)})


# as nondeterministic functions they are called once a row: a filter on their counts isn't moved below the call with another one
_counts, _pairs = _counts.asNondeterministic(), _pairs.asNondeterministic()


def wer_counts(df: DataFrame, ref: str = "reference", hyp: str = "hypothesis", raw: bool = False) -> DataFrame:
    """df with hits, substitutions, deletions, insertions, errors and ref_words."""
    text = (lambda c: F.col(c)) if raw else (lambda c: normalize_atc(F.col(c)))
    df = df.withColumn("__c", _counts(text(ref), text(hyp)))
    df = df.withColumns({n: F.col(f"__c.{n}") for n in COUNTS.names}).drop("__c")
    # each word of the reference is a hit, replaced or left out
    return df.withColumns({"errors": F.expr("substitutions + deletions + insertions"), "ref_words": F.expr("hits + substitutions + deletions")})


def pair_counts(df: DataFrame, a: str, b: str, ref: str = "reference") -> DataFrame:
    """df with errors_a, errors_b and ref_words of two systems: each text is normalized once, each row aligned in one call."""
    made = _pairs(normalize_atc(F.col(ref)), normalize_atc(F.col(a)), normalize_atc(F.col(b)))
    return df.withColumn("__c", made).select(*df.columns, "__c.*")


def rate(errors: Column, total: Column) -> Column:
    return F.when(total > 0, errors / total)


def corpus_wer(counted: DataFrame) -> DataFrame:
    """Sum of errors over sum of words, over rows whose reference has words."""
    own = counted.where("ref_words > 0")
    return own.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("errors").alias("errors"), F.sum("ref_words").alias("ref_words"), rate(F.sum("errors"), F.sum("ref_words")).alias("wer"))


def wer_slices(counted: DataFrame, by: list[str]) -> DataFrame:
    """slice, value and the rate: all rows, then each value of each column of by, in one pass."""
    own = counted.where("ref_words > 0").select("errors", "ref_words", F.explode(F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *(F.struct(F.lit(b).alias("slice"), F.col(b).cast("string").alias("value")) for b in by))).alias("s"))
    return own.groupBy("s.slice", "s.value").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("errors").alias("errors"), F.sum("ref_words").alias("ref_words"), rate(F.sum("errors"), F.sum("ref_words")).alias("wer"))


def bounded_wer(counted: DataFrame) -> DataFrame:
    """Errors of a row count up to its words."""
    own = counted.where("ref_words > 0").withColumn("capped", F.least("errors", "ref_words"))
    return own.agg(
        rate(F.sum("capped"), F.sum("ref_words")).alias("wer"),
        F.count_if(F.col("errors") > F.col("ref_words")).alias("capped_rows"),
        F.sum(F.col("errors") - F.col("capped")).alias("discarded_errors"),
    )


def hallucination_rate(df: DataFrame, ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    none = df.where(F.size(words(F.col(ref))) == 0)
    loud = F.count_if(F.size(words(F.col(hyp))) > 0)
    return none.agg(F.count(F.lit(1)).alias("n_empty"), loud.alias("n_loud"), rate(loud, F.count(F.lit(1))).alias("rate"))


def macro_wer(counted: DataFrame, by: str = "station") -> DataFrame:
    """Mean of the rates of the groups, and the worst group (first name at a tie)."""
    groups = counted.where("ref_words > 0").groupBy(by).agg((F.sum("errors") / F.sum("ref_words")).alias("wer"))
    worst = F.min(F.struct((-F.col("wer")).alias("w"), F.col(by).alias("g")))
    return groups.agg(F.avg("wer").alias("macro_wer"), F.count(F.lit(1)).alias("n_groups"), worst["g"].alias("worst"), (-worst["w"]).alias("worst_wer"))


def paired_bootstrap(counted: DataFrame, replicates: int = 200, seed: int = 0, key: str = "row_idx") -> DataFrame:
    """delta of two systems (errors_a, errors_b over ref_words), its 95 % interval, and a two-sided sign p.

    Each row gets a Poisson(1) weight in each replicate, drawn from a hash of seed,
    replicate and key; tasks hand on sums per replicate, never rows times replicates.
    """
    base = pd.util.hash_array

    def sums(batches):
        total, rows = np.zeros((replicates + 1, 3)), 0
        cut = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1, 12)])))
        for pdf in batches:
            keys = base(pdf[key].to_numpy(np.int64).astype(np.uint64))
            values = pdf[["errors_a", "errors_b", "ref_words"]].to_numpy(float)
            total[-1] += values.sum(0)
            rows += len(pdf)
            for r in range(replicates):
                mixed = base(keys ^ np.uint64((seed * 1_000_003 + r + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                total[r] += np.searchsorted(cut, (mixed >> np.uint64(11)) / 2.0**53, side="right") @ values
        yield pd.DataFrame(total, columns=["a", "b", "n"]).assign(rows=rows, r=[*range(replicates), -1])

    own = counted.where("ref_words > 0").select(key, "errors_a", "errors_b", "ref_words")
    # replicate -1 has a weight of 1 for each row: the point estimate comes from the same pass
    parts = own.mapInPandas(sums, "a double, b double, n double, rows long, r int").groupBy("r").agg(*(F.sum(c).alias(c) for c in ("a", "b", "n", "rows")))
    d = parts.select("r", "rows", F.try_divide(F.col("a") - F.col("b"), F.col("n")).alias("d"))
    drawn = lambda c: F.when(F.col("r") >= 0, c)
    tail = F.least(F.avg(drawn((F.col("d") <= 0).cast("double"))), F.avg(drawn((F.col("d") >= 0).cast("double"))))
    quantile = lambda q: F.percentile(drawn(F.col("d")), q)  # noqa: E731  of as many values as there are replicates
    return d.agg(
        F.max(F.when(F.col("r") < 0, F.col("d"))).alias("delta"), F.max(F.when(F.col("r") < 0, F.col("rows"))).alias("n_rows"),
        quantile(0.025).alias("low"), quantile(0.975).alias("high"), F.least(F.lit(1.0), 2 * tail).alias("p"),
    )
