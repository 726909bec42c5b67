"""Jobs that failed or took too long on larger tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cliploom.functions import entities as E
from cliploom.functions.draws import draw, drawn_below
from cliploom.functions.text import normalize_atc
from cliploom.operators import fidelity as D
from cliploom.operators.gate import tier_rows
from cliploom.plans.catalog import QUERIES
from cliploom.plans.q_gate import gate_rows


def test_probe_with_tasks_that_have_no_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2 == 0, (rng.normal(size=4) + (i % 2)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, in_a boolean, v array<double>").coalesce(1)
    want = D.separability_probe(df, "v", "in_a", "id", folds=2, steps=5).collect()
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:  # a file is read in many parts, of which one has all rows
        for k in held:
            spark.conf.set(k, "512")
        got = D.separability_probe(df, "v", "in_a", "id", folds=2, steps=5).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == want and got[0].accuracy > 0.65


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["AGG-7", "GATE-3"])
def test_slots_and_verdicts_are_worked_out_once(spark, sf_dir, name):
    plan = optimized(QUERIES[name](spark, sf_dir))
    assert plan.count("ArrowEvalPython") == 1 and plan.count("run(") == 1 and "Filter" not in plan


def test_texts_of_the_same_words_are_read_once(monkeypatch):
    read = []
    init = E.Transmission.__init__
    monkeypatch.setattr(E.Transmission, "__init__", lambda self, words, airlines: (read.append(words), init(self, words, airlines))[1])
    texts = ["turn heading zero nine zero", None, "Turn heading zero, nine zero", "roger", "roger", "turn heading zero nine zero"]
    got = E.read_all(pa.array(texts), E.Airlines({})).to_pylist()
    assert len(read) == 2 and got[1] == got[3] == got[4] == [] and got[0] == got[2] == got[5] and got[0][0]["value"] == "090"


@pytest.mark.parametrize("name, call", [("STA-3", "_pairs("), ("WER-3", "_counts(")])
def test_texts_are_aligned_once(spark, sf_dir, name, call):
    assert optimized(QUERIES[name](spark, sf_dir)).count(call) == 1


@pytest.mark.parametrize("share", [0.0, 0.1, 0.15, 0.5, 1 / 3])
def test_draws_below_a_share(spark, share):
    i = F.col("id")
    df = spark.range(20_000).select(draw("b", i, i + 1).alias("u"), drawn_below(share, "b", i, i + 1).alias("below"))
    assert df.where(F.col("below") != (F.col("u") < share)).count() == 0


def test_only_whole_words_are_variants(spark):
    df = spark.createDataFrame([("Street trees,  fifer",), ("tree -Okay",), ("x\ttree2 fife",)], "text string")
    assert [r[0] for r in df.select(normalize_atc(F.col("text"))).collect()] == ["street trees fifer", "three ok", "x t r e e two five"]


def test_tiers_parse_the_texts_of_a_row_in_one_call(spark, sf_dir):
    plan = optimized(tier_rows(gate_rows(spark, sf_dir)))
    assert plan.count("ArrowEvalPython") == 1 and plan.count("run(") == 1
