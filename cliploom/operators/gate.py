"""The verification gate: slots of several teachers against labels, tiers, and panels of slot scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions.entities import extract_each
from cliploom.functions.text import normalize_atc, words
from cliploom.operators.stats import distribution
from cliploom.sources.shared import written

GOLD, SILVER, CEILING, RECALL = 0.25, 0.50, 0.90, 0.5


#: Verdicts on a slot of the label.
VERDICTS = ("verified", "substituted", "missed")


def same_slot(a: Column, b: Column) -> Column:
    return (a["type"] == b["type"]) & (a["value"] == b["value"])


def times(slots: Column, slot: Column) -> Column:
    return F.size(F.filter(slots, lambda x: same_slot(x, slot)))


def first_of_each(slots: Column) -> Column:
    """slots without those that repeat the type and value of an earlier one."""
    return F.filter(slots, lambda x, i: times(F.slice(slots, F.lit(1), i), x) == 0)


def unmatched(slots: Column, others: Column) -> Column:
    """What is left of slots when the k-th of a type and value goes with the k-th among the others."""
    return F.filter(slots, lambda x, i: times(F.slice(slots, F.lit(1), i), x) >= times(others, x))


def teacher_slots(df: DataFrame, hypotheses: dict[str, str], airlines: dict[str, str], wers: dict[str, str] | None = None, also: dict[str, str] | None = None) -> DataFrame:
    """df with teachers: an array of teacher, hyp, hyp_normalized, words, wer, entities and asserted.

    hypotheses and wers name the columns of each teacher, in their order. entities are the
    slots of the text as written and as normalized; asserted those as written alone. All
    texts of a row go through the parser together, also those of the columns of also, which
    names the column that gets their slots; nothing is shuffled.
    """
    also = also or {}
    made = {f"__n{i}": normalize_atc(F.coalesce(F.col(column), F.lit(""))) for i, column in enumerate(hypotheses.values())}
    df = df.withColumns(made)
    df = df.withColumn("__slots", extract_each(airlines, [*dict.fromkeys([*also, *hypotheses.values(), *made])]))
    slots = lambda c: F.col("__slots")[c]
    each = [
        F.struct(
            F.lit(name).alias("teacher"),
            F.trim(F.coalesce(F.col(column), F.lit(""))).alias("hyp"),
            F.col(f"__n{i}").alias("hyp_normalized"),
            F.size(words(F.col(f"__n{i}"))).cast("long").alias("words"),
            (F.col(wers[name]) if wers else F.lit(None)).cast("double").alias("wer"),
            F.concat(slots(column), slots(f"__n{i}")).alias("entities"),
            slots(column).alias("asserted"),
        )
        for i, (name, column) in enumerate(hypotheses.items())
    ]
    df = df.withColumns({"teachers": F.array(*each), **{name: slots(c) for c, name in also.items()}}).drop(*made, "__slots")
    return df.withColumn("teachers", F.transform("teachers", lambda t: t.withField("entities", first_of_each(t["entities"]))))


def verdicts_of(label: Column, teachers: Column) -> Column:
    """type, value, critical, verdict, verified_by and heard of each slot of the label.

    Verified: a teacher has the value, the k-th time for the k-th in the label.
    Substituted: every teacher that asserts the type asserts a value there that the label
    lacks (heard tells which). Else missed.
    """

    def evidence(slot: Column, i: Column) -> Column:
        before = times(F.slice(label, F.lit(1), i), slot)
        stray = lambda t: F.filter(t["asserted"], lambda x: (x["type"] == slot["type"]) & (times(label, x) == 0))
        by = F.filter(teachers, lambda t: times(t["entities"], slot) > before)
        heard = F.filter(teachers, lambda t: F.exists(t["asserted"], lambda x: x["type"] == slot["type"]))
        values = F.transform(heard, lambda t: F.struct(t["teacher"], F.array_sort(F.array_distinct(F.transform(stray(t), lambda x: x["value"]))).alias("values")))
        return F.struct(slot["type"], slot["value"], slot["critical"], F.transform(by, lambda t: t["teacher"]).alias("verified_by"), values.alias("heard"))

    def judge(e: Column) -> Column:
        strayed = (F.size(e["heard"]) > 0) & F.forall(e["heard"], lambda x: F.size(x["values"]) > 0)
        verdict = F.when(F.size(e["verified_by"]) > 0, VERDICTS[0]).when(strayed, VERDICTS[1]).otherwise(VERDICTS[2])
        return e.withField("verdict", verdict)

    def told(e: Column) -> Column:
        heard = F.filter(e["heard"], lambda x: e["verdict"] == VERDICTS[1])
        return F.struct(e["type"], e["value"], e["critical"], e["verdict"], e["verified_by"], heard.alias("heard"))

    return F.transform(F.transform(F.transform(label, evidence), judge), told)


def verify_entities(df: DataFrame, label: str = "entities") -> DataFrame:
    """df (label and teachers) with verdicts, and of its critical slots the total, the number of each verdict and recall (1 without any)."""
    df = df.withColumn("verdicts", verdicts_of(F.col(label), F.col("teachers")))
    critical = lambda more: F.size(F.filter("verdicts", lambda v: v["critical"] & more(v))).cast("long")
    df = df.withColumn("critical_total", critical(lambda v: F.lit(True)))
    df = df.withColumns({f"critical_{x}": critical(lambda v, x=x: v["verdict"] == x) for x in VERDICTS})
    return df.withColumn("recall", F.when(F.col("critical_total") > 0, F.col("critical_verified") / F.col("critical_total")).otherwise(1.0))


def with_best_teacher(df: DataFrame) -> DataFrame:
    """df (teachers) with best_teacher and best_wer: the lowest rate, the first in order at a tie; without any rate null and 1."""
    rated = F.filter(F.transform("teachers", lambda t, i: F.struct(t["wer"], i.alias("i"), t["teacher"])), lambda t: t["wer"].isNotNull())
    df = df.withColumn("__best", F.array_min(rated))
    return df.withColumns({"best_teacher": F.col("__best.teacher"), "best_wer": F.coalesce("__best.wer", F.lit(1.0))}).drop("__best")


def noise_verdict(words: DataFrame, strict: bool = False, loud: int = 2) -> DataFrame:
    """Per noise row (row_idx, teacher, words): how many teachers hear over two words, and whether it is rejected."""
    n = words.groupBy("row_idx").agg(F.count(F.lit(1)).alias("teachers"), F.count_if(F.col("words") > loud).alias("loud"))
    return n.withColumn("rejected", F.col("loud") > 0 if strict else F.col("loud") == F.col("teachers"))


def tier_rows(df: DataFrame, gold: float = GOLD, silver: float = SILVER, ceiling: float = CEILING, recall: float = RECALL) -> DataFrame:
    """df (best_wer, recall, critical_substituted, audio_ok) with reasons and tier."""
    wer = F.col("best_wer")
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("audio_ok"), "audio"),
            F.when(F.col("critical_substituted") > 0, "critical_substitution"),
            F.when(wer > ceiling, "teacher_wer_above_ceiling"),
            F.when((wer <= ceiling) & (wer > silver) & (F.col("recall") < recall), "low_recall"),
        )
    )
    tier = F.when(F.size("reasons") > 0, "rejected").when((wer <= gold) & (F.col("recall") >= recall), "gold").when(wer <= silver, "silver").otherwise("adversarial")
    return df.withColumn("reasons", reasons).withColumn("tier", tier)


def retier(df: DataFrame, configs: DataFrame) -> DataFrame:
    """Tier counts for every row of a small table of thresholds (config, gold, silver, ceiling, recall), in one pass."""
    x = df.crossJoin(F.broadcast(configs.withColumnRenamed("recall", "need")))
    bad = ~F.col("audio_ok") | (F.col("critical_substituted") > 0) | (F.col("best_wer") > F.col("ceiling"))
    low = (F.col("best_wer") > F.col("silver")) & (F.col("recall") < F.col("need"))
    tier = F.when(bad | low, "rejected").when((F.col("best_wer") <= F.col("gold")) & (F.col("recall") >= F.col("need")), "gold").when(F.col("best_wer") <= F.col("silver"), "silver").otherwise("adversarial")
    return x.groupBy("config", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def best_teacher(scores: DataFrame) -> DataFrame:
    """Per row the teacher of lowest rate, the first by order at a tie."""
    return scores.groupBy("row_idx").agg(F.min(F.struct("wer", "ord", "teacher")).alias("x")).select("row_idx", F.col("x.teacher").alias("best_teacher"), F.col("x.wer").alias("best_wer"))


def gate_stats(tiered: DataFrame) -> DataFrame:
    """part, value, n, share of all rows, and for rates mean, p10, p50 and p90.

    Parts: tier, reason (a row may have several), best_teacher, and teacher_wer (of each
    teacher, and of the best ones as "best"), where n counts rates.
    """
    entry = lambda part, value: F.struct(F.lit(part).alias("part"), value.alias("value"))
    slim = written(
        tiered.select(
            F.concat(
                F.array(entry("tier", F.col("tier"))),
                F.transform("reasons", lambda r: entry("reason", r)),
                F.filter(F.array(entry("best_teacher", F.col("best_teacher"))), lambda x: x["value"].isNotNull()),
            ).alias("parts"),
            F.concat(
                F.transform("teachers", lambda t: F.struct(t["teacher"].alias("value"), t["wer"].alias("wer"))),
                F.array(F.struct(F.lit("best").alias("value"), F.when(F.col("best_teacher").isNotNull(), F.col("best_wer")).alias("wer"))),
            ).alias("rates"),
        ),
        "gate",
    )
    counts = slim.select(F.inline("parts")).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    rates = distribution(slim.select(F.inline("rates")), "wer", ["value"]).drop("max").withColumn("part", F.lit("teacher_wer"))
    # a row has one tier, so the few counts of tiers add up to all rows
    rows = counts.where("part = 'tier'").agg(F.sum("n").alias("__rows"))
    both = counts.unionByName(rates, allowMissingColumns=True).crossJoin(F.broadcast(rows))
    return both.select("part", "value", "n", (F.col("n") / F.col("__rows")).alias("share"), "mean", "p10", "p50", "p90")


def entity_recovery(gated: DataFrame) -> DataFrame:
    """Per slot type, and for all: slots by verdict and the verified share."""
    # of the transformed array Spark infers no filter, which would work the verdicts out once more
    each = gated.select(F.inline(F.transform("verdicts", lambda v: F.struct(v["type"], v["verdict"]))))
    n = each.rollup("type").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))
    return n.select(F.coalesce("type", F.lit("all")).alias("type"), "n", *VERDICTS, (F.col("verified") / F.col("n")).alias("rate"))


def score_entities(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """df with scores: per type of its slots tp, fp, fn and sub; what is left of a type on both sides pairs into substitutions."""
    r, h = F.col(ref), F.col(hyp)
    df = df.withColumns({"__left": unmatched(r, h), "__extra": unmatched(h, r)})
    of = lambda slots, kind: F.size(F.filter(slots, lambda x: x["type"] == kind)).cast("long")

    def scored(kind: Column) -> Column:
        left, extra = of("__left", kind), of("__extra", kind)
        sub = F.least(left, extra)
        return F.struct(kind.alias("type"), (of(ref, kind) - left).alias("tp"), (extra - sub).alias("fp"), (left - sub).alias("fn"), sub.alias("sub"))

    kinds = F.array_distinct(F.transform(F.concat(r, h), lambda x: x["type"]))
    return df.withColumn("scores", F.transform(kinds, scored)).drop("__left", "__extra")


def entity_panel(scored: DataFrame) -> DataFrame:
    """Per type, and for all: precision, recall, F1 and support, over rows (scores) with reference slots."""
    has = F.exists("scores", lambda s: s["tp"] + s["fn"] + s["sub"] > 0)
    n = scored.where(has).select(F.inline("scores")).rollup("type").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "sub")))
    p, r = F.expr("try_divide(tp, tp + fp + sub)"), F.expr("try_divide(tp, tp + fn + sub)")
    return n.select(F.coalesce("type", F.lit("all")).alias("type"), p.alias("precision"), r.alias("recall"), F.expr("try_divide(2 * tp, 2 * tp + fp + fn + 2 * sub)").alias("f1"), F.expr("tp + fn + sub").alias("support"))


def entity_diff(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """df with diff: type, outcome, ref_value and hyp_value; what is left of a type pairs in order."""
    r, h = F.col(ref), F.col(hyp)
    df = df.withColumns({"__left": unmatched(r, h), "__extra": unmatched(h, r)})
    of = lambda slots, kind: F.transform(F.filter(slots, lambda x: x["type"] == kind), lambda x: x["value"])

    def told(kind: Column, pair: Column) -> Column:
        a, b = pair["0"], pair["1"]
        outcome = F.when(a.isNull(), "spurious").when(b.isNull(), "missed").otherwise("substituted")
        return F.struct(kind.alias("type"), outcome.alias("outcome"), a.alias("ref_value"), b.alias("hyp_value"))

    kinds = F.array_distinct(F.transform(F.concat("__left", "__extra"), lambda x: x["type"]))
    pairs = F.transform(kinds, lambda k: F.transform(F.arrays_zip(of("__left", k), of("__extra", k)), lambda p: told(k, p)))
    return df.withColumn("diff", F.flatten(pairs)).drop("__left", "__extra")


def worst_examples(scored: DataFrame, k: int, key: str = "row_idx") -> DataFrame:
    total = lambda *names: F.aggregate("scores", F.lit(0).cast("long"), lambda n, s: n + sum((s[x] for x in names[1:]), s[names[0]]))
    n = scored.select(key, total("sub").alias("sub"), total("fn", "fp").alias("other"))
    return n.orderBy(F.desc("sub"), F.desc("other"), key).limit(k)
