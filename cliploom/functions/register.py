"""Functions by name for SQL."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cliploom.functions import entities as E
from cliploom.functions.text import DIGITS, FOLD
from cliploom.operators.wer import align


def normal_form(text: str | None) -> str:
    """What normalize_atc gives, for one text."""
    plain = re.sub(r"[^\w\s']", " ", (text or "").lower().replace("-", " "))
    out: list[str] = []
    for word in plain.split():
        out += [DIGITS.get(c, c) for c in word] if re.search("[0-9]", word) else [word]
    return " ".join(FOLD.get(w, w) for w in out)


def register_functions(spark: SparkSession, airlines: dict[str, str]) -> None:
    """extract_entities(text), scan_numbers(tokens), word_errors(reference, hypothesis), fold_word(word), normalize_atc(text), check_value(type, value), and the table function explode_entities(text).

    From DataFrames the column functions of the same names need no Python worker.
    """

    @F.pandas_udf("string")
    def normalized(text: pd.Series) -> pd.Series:
        return text.map(normal_form)

    @F.pandas_udf("string")
    def value_problem(kind: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or v is None else E.problem_of(k, v) for k, v in zip(kind, value, strict=True)], dtype=object)

    @F.pandas_udf("long")
    def word_errors(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        return pd.Series([sum(align((a or "").split(), (b or "").split())[1:]) for a, b in zip(ref, hyp, strict=True)])

    @F.pandas_udf("string")
    def fold_word(word: pd.Series) -> pd.Series:
        return word.map(lambda w: FOLD.get(w, w))

    @F.udtf(returnType="type string, value string, spoken string, critical boolean")
    class ExplodeEntities:
        def eval(self, text: str):
            for s in E.slots_of(text, airlines):
                yield s["type"], s["value"], s["spoken"], s["critical"]

    spark.udf.register("extract_entities", E.extract_entities(airlines))
    spark.udf.register("scan_numbers", E.scan_numbers())
    spark.udf.register("normalize_atc", normalized)
    spark.udf.register("check_value", value_problem)
    spark.udf.register("word_errors", word_errors)
    spark.udf.register("fold_word", fold_word)
    spark.udtf.register("explode_entities", ExplodeEntities)
