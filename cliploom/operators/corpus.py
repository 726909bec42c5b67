"""Corpus checks, quotas, vocabulary and user models."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cliploom.functions.draws import draw, order_key
from cliploom.functions.entities import LETTERS, NO_WAYPOINT, NUMBERS, SCALES, SIGNS, SLOT, extract_entities
from cliploom.functions.text import check_value
from cliploom.operators.gate import unmatched
from cliploom.operators.sampling import category_distribution, drawn, weight_bins, weighted_draw
from cliploom.operators.splits import exact_sample

#: Columns of a built manifest, which text records must not bring along.
RESERVED = ("audio", "duration", "gen", "lineage", "text_display", "tier", "gate")
DEFAULTS = {"role": "unknown", "kind": "external", "category": "routine"}


def telephony_key(c: Column) -> Column:
    """A key of an airline's spoken name that joins and cuts of words don't change."""
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def telephony_code(c: Column, known: dict[str, str]) -> Column:
    """The known three-letter code of a spoken name, or the first three letters of its key."""
    table = F.create_map(*(F.lit(x) for p in known.items() for x in p))
    return F.coalesce(table[telephony_key(c)], F.upper(F.substring(telephony_key(c), 1, 3)))


def entity_problem(slot: Column) -> Column:
    """Why a slot of a label isn't legal; null for a legal one."""
    return F.when(slot["type"].isNull() | slot["value"].isNull(), "incomplete").otherwise(check_value(slot["type"], slot["value"]))


def validate_text_records(df: DataFrame, fail: bool = False) -> DataFrame:
    """df with defaults filled in and problems: missing text, weight not positive, reserved or nested extra columns, slots that aren't legal.

    With fail, reading a row with problems is an error that names them.
    """
    nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct")) and n != "entities"]
    reserved = [n for n in df.columns if n in RESERVED]
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in df.columns else F.lit(1.0)
    checks = [
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no_text"),
        F.when(~(weight > 0) | F.isnan(weight), "weight"),
        *(F.when(F.col(n).isNotNull(), f"reserved_{n}") for n in reserved),
        *(F.when(F.col(n).isNotNull(), f"nested_{n}") for n in nested),
    ]
    problems = F.array_compact(F.array(*checks))
    if "entities" in df.columns:
        told = F.transform("entities", lambda e: F.concat_ws("_", F.lit("entity"), e["type"], entity_problem(e)))
        wrong = F.filter(F.arrays_zip(told.alias("told"), F.transform("entities", entity_problem).alias("why")), lambda x: x["why"].isNotNull())
        problems = F.concat(problems, F.coalesce(F.transform(wrong, lambda x: x["told"]), F.array().cast("array<string>")))
    own = {n: F.coalesce(F.col(n), F.lit(v)) if n in df.columns else F.lit(v) for n, v in DEFAULTS.items()}
    df = df.withColumns({**own, "weight": weight, "problems": problems})
    if fail:
        df = df.withColumn("problems", F.when(F.size("problems") > 0, F.raise_error(F.concat(F.lit("text record: "), F.array_join("problems", ", ")))).otherwise(F.col("problems")))
    return df


def validate_labels(df: DataFrame, airlines: dict[str, str], text: str = "text", label: str = "entities") -> DataFrame:
    """df with problems (type, value, problem): what keeps the slots of a text from being its labels, by row.

    A label's value isn't legal, or its spoken form isn't in the text; the text doesn't
    give the label (lost), or gives a critical slot that no label has (unlabelled). Equal
    slots are counted.
    """
    df = df.withColumns({"__said": extract_entities(airlines)(F.col(text)), "__label": F.coalesce(label, F.array().cast(SLOT))})
    problem = lambda e, why: F.struct(e["type"], e["value"], why.alias("problem"))
    silent = lambda e: (F.length(e["spoken"]) > 0) & ~F.coalesce(F.col(text).contains(e["spoken"]), F.lit(False))
    own = F.transform("__label", lambda e: problem(e, F.coalesce(entity_problem(e), F.when(silent(e), "not_spoken"))))
    lost = F.transform(unmatched(F.col("__label"), F.col("__said")), lambda e: problem(e, F.lit("lost")))
    more = F.transform(F.filter(unmatched(F.col("__said"), F.col("__label")), lambda e: e["critical"]), lambda e: problem(e, F.lit("unlabelled")))
    return df.withColumn("problems", F.concat(F.filter(own, lambda x: x["problem"].isNotNull()), lost, more)).drop("__said", "__label")


def tallied(df: DataFrame, *entries: Column) -> DataFrame:
    """part, value, n: counts of all entries that aren't null, in one pass."""
    return df.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))


def entry(part: str, value: Column, where: Column) -> Column:
    return F.when(where, F.struct(F.lit(part).alias("part"), value.cast("string").alias("value")))


def corpus_stats(clips: DataFrame) -> DataFrame:
    """part, value, n of ingested clips (reason, resampled, mixed, station, split): kept, dropped by reason, and of kept ones resampled, mixed, per station, per split."""
    kept = F.col("reason").isNull()
    flags = [entry("kept", F.lit(n), kept & F.coalesce(F.col(n), F.lit(False))) for n in ("resampled", "mixed")]
    groups = [entry(n, F.coalesce(F.col(n), F.lit("unknown")), kept) for n in ("station", "split")]
    return tallied(clips, entry("kept", F.lit("all"), kept), entry("dropped", F.col("reason"), ~kept), *flags, *groups)


def qc_tally(clips: DataFrame) -> DataFrame:
    """part, value, n and rate of checked clips (reason, null for good ones): total, kept, discarded, and each reason."""
    good = F.col("reason").isNull()
    n = tallied(clips, entry("all", F.lit("total"), F.lit(True)), entry("all", F.when(good, "kept").otherwise("discarded"), F.lit(True)), entry("reason", F.col("reason"), ~good))
    rows = n.where("value = 'total' and part = 'all'").select(F.col("n").alias("__rows"))
    return n.crossJoin(F.broadcast(rows)).withColumn("rate", F.col("n") / F.col("__rows")).drop("__rows")


def cohort_by_step(df: DataFrame, steps: str, primitive: str) -> DataFrame:
    """df with cohort: whether the step is in the array; fails where a cohort is empty."""
    n = df.agg(F.count_if(F.exists(steps, lambda s: s == primitive)).alias("w"), F.count(F.lit(1)).alias("n")).first()
    if not 0 < n["w"] < n["n"]:
        raise ValueError("a cohort is empty")
    return df.withColumn("cohort", F.when(F.exists(steps, lambda s: s == primitive), "with").otherwise("without"))


def run_stats(df: DataFrame, quotas: dict[str, float]) -> DataFrame:
    """Per category of rows with text: n, share, target and gap; noise rows are the category noise, over all rows."""
    spark = df.sparkSession
    asked = spark.createDataFrame(list(quotas.items()), "category string, target double")
    label = F.when(F.col("text") == "", "noise").otherwise(F.col("category"))
    n = df.groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    whole = n.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("category") != "noise", F.col("n"))).alias("speech"))
    x = n.crossJoin(F.broadcast(whole)).join(F.broadcast(asked), "category", "left")
    share = F.when(F.col("category") == "noise", F.col("n") / F.col("all")).otherwise(F.col("n") / F.col("speech"))
    return x.select("category", "n", share.alias("share"), "target", (share - F.col("target")).alias("gap"))


def matrix_verdicts(reports: DataFrame, base: str, other: str, gap: float = 0.015) -> DataFrame:
    """From arm and wer: the gap of two arms, whether it is small, and whether the other wins."""
    of = lambda a: F.max(F.when(F.col("arm") == a, F.col("wer")))
    x = reports.agg(of(base).alias("a"), of(other).alias("b"))
    return x.select((F.col("b") - F.col("a")).alias("gap"), ((F.col("b") - F.col("a")) <= gap).alias("close"), (F.col("b") < F.col("a")).alias("wins"))


def pick_val_blocks(blocks: DataFrame, fraction: float, seed: str, group: str = "station") -> DataFrame:
    """blocks (group, block_id, n) with val: whole blocks, never all, whose clips come nearest to the rounded fraction.

    Up to 16 blocks every subset is tried (fewer blocks at a tie); beyond that blocks are
    taken in hash order while the sum before is below the target, but for the last.
    """
    schema = blocks.schema.add("val", "boolean")

    def few(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_id").reset_index(drop=True)
        n, total = pdf["n"].to_numpy(), int(pdf["n"].sum())
        target = max(round(total * fraction), 1 if len(pdf) >= 2 and fraction > 0 else 0)
        masks = np.arange(1 << len(pdf))
        bits = (masks[:, None] >> np.arange(len(pdf))) & 1
        off, size = np.abs(bits @ n - target), bits.sum(1)
        allowed = (size < len(pdf)) & ((size > 0) | (target == 0))
        order = np.lexsort((masks, size, np.where(allowed, off, 1 << 60)))
        pdf["val"] = bits[order[0]].astype(bool) if allowed.any() else False
        return pdf[schema.names]

    w = Window.partitionBy(group)
    own = blocks.withColumn("__many", F.count(F.lit(1)).over(w))
    h = w.orderBy(order_key(seed, F.col("block_id")), "block_id")
    before = F.coalesce(F.sum("n").over(h.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    target = F.greatest(F.bround(F.sum("n").over(w) * F.lit(fraction)), F.lit(1 if fraction > 0 else 0))
    many = own.where("__many > 16").withColumns({"__b": before, "__t": target, "__r": F.row_number().over(h)})
    many = many.withColumn("val", (F.col("__b") < F.col("__t")) & (F.col("__r") < F.col("__many"))).select(*schema.names)
    return many.unionByName(own.where("__many <= 16").drop("__many").groupBy(group).applyInPandas(few, schema))


def sample_quota(pool: DataFrame, n: int, quotas: dict[str, float], seed: str, item: str) -> DataFrame:
    """n draws with replacement: a category by its share, then an item by weight; draw counts from 0."""
    shares = category_distribution(pool, quotas).withColumn("__one", F.lit(0))
    asked = pool.sparkSession.range(n).select(F.col("id").alias("draw"), F.lit(0).alias("__one"), draw(seed, F.lit("c"), F.col("id")).alias("__u"))
    chosen = drawn(asked, weight_bins(shares, "__one", "category", "share"), "__one").select("draw", "category")
    return weighted_draw(chosen.withColumn("__i", F.concat(F.lit("i:"), F.col("draw").cast("string"))), pool, seed, "__i", "category", item).select("draw", "category", item)


def synthetic_quotas(real: DataFrame, quotas: dict[str, float], total: int) -> DataFrame:
    """category and quota of what is missing after real rows, over the synthetic rows, within 0 and 1."""
    asked = real.sparkSession.createDataFrame(list(quotas.items()), "category string, q double")
    n = real.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    whole = real.agg(F.count(F.lit(1)).alias("all"))
    x = asked.join(n, "category", "left").crossJoin(F.broadcast(whole))
    missing = (F.col("q") * total - F.coalesce("n", F.lit(0))) / (total - F.col("all"))
    return x.select("category", F.least(F.lit(1.0), F.greatest(F.lit(0.0), missing)).alias("quota"))


def expand_corpus(real: DataFrame, synthetic: DataFrame, total: int, held: str, seed: str, key: str) -> DataFrame:
    """Real rows that are not held out, and synthetic ones up to total, with origin."""
    train = real.where(~F.col(held)).drop(held)
    k = max(0, total - train.count())
    return train.withColumn("origin", F.lit("real")).unionByName(exact_sample(synthetic, k, seed, key).withColumn("origin", F.lit("synthetic")))


def balanced_arms(selected: DataFrame, uniform: DataFrame, seed: str, key: str, least: int) -> DataFrame:
    """Both arms cut to the smaller size in hash order; no rows where that is below least."""
    k = min(selected.count(), uniform.count())
    k = k if k >= least else 0
    a = exact_sample(selected, k, seed, key).withColumn("arm", F.lit("selected"))
    return a.unionByName(exact_sample(uniform, k, seed, key).withColumn("arm", F.lit("uniform")))


def draw_presets(requests: DataFrame, presets: DataFrame, seed: str, key: str) -> DataFrame:
    """For each request a station by its number of presets, then a preset of it; both by hash."""
    n = presets.groupBy("station").agg(F.count(F.lit(1)).alias("many"))
    edges = n.withColumns({"hi": F.sum("many").over(Window.orderBy("station").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("many").over(Window.partitionBy())})
    slots = presets.withColumn("slot", F.row_number().over(Window.partitionBy("station").orderBy("preset")) - 1)
    asked = requests.withColumn("u", draw(seed, F.col(key)))
    x = asked.join(F.broadcast(edges), F.expr("u * all >= hi - many and u * all < hi"))
    x = x.withColumn("slot", F.floor(draw(seed, F.lit("slot"), F.col(key)) * F.col("many")).cast("int"))
    return x.join(slots, ["station", "slot"]).select(key, "station", "preset")


def top_deviations(trials: DataFrame, ranges: DataFrame, k: int, least: float = 0.01) -> DataFrame:
    """Per trial the k knobs (knobs: map) furthest from the default, in units of their range (knob, low, high, default)."""
    x = trials.select("trial", F.explode("knobs").alias("knob", "value")).join(F.broadcast(ranges), "knob")
    x = x.withColumn("move", F.abs(F.col("value") - F.col("default")) / (F.col("high") - F.col("low"))).where(F.col("move") >= least)
    w = Window.partitionBy("trial").orderBy(F.desc("move"), "knob")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("trial", "rank", "knob", "move")


#: Words of facilities, words before a waypoint, and the default words that are no names.
FACILITIES = ("radar", "approach", "tower", "ground", "apron", "control", "director", "delivery", "arrival", "departure", "information")
ANCHORS = ("direct", "overhead", "abeam", "via")
NO_NAME = tuple(sorted({w for w in SIGNS if w not in ANCHORS} | NO_WAYPOINT | set(NUMBERS) | set(LETTERS) | set(ANCHORS) | set(FACILITIES)))


def harvest_vocab(df: DataFrame, least: int = 3, tokens: str = "tokens", no_name: Sequence[str] = NO_NAME) -> DataFrame:
    """kind, phrase, n: names of airlines, stations and waypoints in token arrays, found at least so often.

    Airline: the word, and the two words, before a run of two or more number words that
    isn't a frequency (no decimal word behind it, no "contact" before the name). Station:
    a word and the facility behind it, or a facility behind "contact". Waypoint: the word
    behind an anchor, perhaps with "to" between. no_name are words that are no names.
    """
    t = F.col(tokens)
    at = lambda i: F.get(t, i)  # noqa: E731  null outside of the array
    number = lambda i: F.coalesce(at(i).isin(*NUMBERS) | at(i).rlike("^[0-9]+$"), F.lit(False))
    name = lambda i: (i >= 0) & at(i).isNotNull() & ~at(i).isin(*no_name) & ~number(i)
    entry = lambda kind, phrase, where: F.when(F.coalesce(where, F.lit(False)), F.struct(F.lit(kind).alias("kind"), phrase.alias("phrase")))
    pair = lambda i: F.concat_ws(" ", at(i - 1), at(i))

    def behind_run(i: Column) -> Column:
        """The word behind the run of numbers that begins at i; an empty text at the end."""
        rest = F.slice(t, i + 1, F.size(t))
        first = F.array_position(F.transform(rest, lambda w: ~(w.isin(*NUMBERS) | w.rlike("^[0-9]+$"))), True)
        return F.when(first > 0, F.get(rest, (first - 1).cast("int"))).otherwise("")

    def found(word: Column, i: Column) -> Column:
        starts = number(i) & ~number(i - 1) & ~word.isin(*SCALES) & number(i + 1) & ~behind_run(i).isin("decimal", "point")
        airline = starts & name(i - 1) & ~F.coalesce((i >= 2) & (at(i - 2) == "contact"), F.lit(False))
        long_name = F.length(at(i)) >= 4
        return F.array_compact(
            F.array(
                entry("airline", at(i - 1), airline),
                entry("airline", pair(i - 1), airline & name(i - 2)),
                entry("station", pair(i), word.isin(*FACILITIES) & name(i - 1) & (F.length(at(i - 1)) >= 4)),
                entry("station", word, word.isin(*FACILITIES) & (at(i - 1) == "contact")),
                entry("waypoint", word, long_name & name(i) & ((at(i - 1).isin(*ANCHORS) & (word != "to")) | ((at(i - 1) == "to") & at(i - 2).isin(*ANCHORS)))),
            )
        )

    each = df.select(F.explode(F.flatten(F.transform(t, found))).alias("x")).select("x.*")
    each = each.where(F.col("phrase").rlike("^[a-z ]+$"))
    return each.groupBy("kind", "phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def prune_airlines(counts: DataFrame, places: Sequence[str], known: Sequence[str]) -> DataFrame:
    """counts (phrase, n) without names that hold a place word, and of single words without short ones, those in -ing, those half of whose count is one pair, and ends of known names."""
    one = ~F.col("phrase").contains(" ")
    in_place = F.exists(F.split("phrase", " "), lambda w: w.isin(*places)) if places else F.lit(False)
    ends = F.exists(F.array(*map(F.lit, known)), lambda k: k.endswith(F.col("phrase")) & (k != F.col("phrase"))) if known else F.lit(False)
    x = counts.where(~in_place & ~(one & ((F.length("phrase") < 4) | F.col("phrase").endswith("ing") | ends)))
    pairs = counts.where(~one).select(F.substring_index("phrase", " ", -1).alias("phrase"), F.col("n").alias("pair_n"))
    last = pairs.groupBy("phrase").agg(F.max("pair_n").alias("pair_n"))
    return x.join(last, "phrase", "left").where(~(one & (F.coalesce("pair_n", F.lit(0)) >= F.col("n") / 2))).drop("pair_n")


def assign_codes(vocabulary: DataFrame, known: dict[str, str]) -> DataFrame:
    """phrase, n, code: unique codes in descending count: known, else three letters, else two of them and the first free one (null if none is).

    Only codes that share their first two letters can meet, so each such family, of
    which there are 26 * 26, gets its codes in a task of its own.
    """
    letters = F.rpad(F.substring(F.upper(telephony_key(F.col("phrase"))), 1, 3), 3, "X")
    own = F.create_map(*(F.lit(x) for p in known.items() for x in p))[F.col("phrase")] if known else F.lit(None).cast("string")
    df = vocabulary.select("phrase", "n", own.alias("own"), F.coalesce(own, letters).alias("wish"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, codes = set(known.values()), []
        pdf = pdf.sort_values(["n", "phrase"], ascending=[False, True])
        for mine, wish in zip(pdf["own"], pdf["wish"], strict=True):
            free = (c for c in [wish, *(wish[:2] + chr(65 + i) for i in range(26))] if c not in used)
            code = mine if isinstance(mine, str) else next(free, None)
            used.add(code)
            codes.append(code)
        return pdf.assign(code=codes)[["phrase", "n", "code"]]

    return df.groupBy(F.substring("wish", 1, 2)).applyInPandas(run, "phrase string, n long, code string")


def transcribe_with(df: DataFrame, models: dict[str, Callable[[list], list[str]]], key: str, samples: str, batch: int = 8) -> DataFrame:
    """key, teacher, hypothesis and seconds (the share of the batch's model time): user models from a list of waveforms to as many texts."""

    def run(batches):
        for pdf in batches:
            for name, model in models.items():
                texts, seconds = [], []
                for i in range(0, len(pdf), batch):
                    own = list(pdf[samples].iloc[i : i + batch])
                    begin = time.perf_counter()
                    got = list(model(own))
                    seconds += [(time.perf_counter() - begin) / len(own)] * len(own)
                    if len(got) != len(own):
                        raise ValueError(f"{name} gave {len(got)} texts for {len(own)} clips")
                    texts += got
                yield pd.DataFrame({key: pdf[key], "teacher": name, "hypothesis": texts, "seconds": seconds})

    kind = dict(df.dtypes)[key]
    return df.select(key, samples).mapInPandas(run, f"{key} {kind}, teacher string, hypothesis string, seconds double")


def with_throughput(transcribed: DataFrame, teachers: Sequence[str], name: str = "throughput") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that holds clips_<teacher> and seconds_<teacher> once an action has run.

    Failed tasks don't count. A stage that runs again for lost shuffle files may count
    twice; teacher_throughput() of the written rows doesn't.
    """
    seen = Observation(name)
    of = lambda t: F.col("teacher") == t
    counts = [F.count_if(of(t)).alias(f"clips_{t}") for t in teachers]
    sums = [F.coalesce(F.sum(F.when(of(t), F.col("seconds"))), F.lit(0.0)).alias(f"seconds_{t}") for t in teachers]
    return transcribed.observe(seen, *counts, *sums), seen


def teacher_throughput(transcribed: DataFrame) -> DataFrame:
    """teacher, clips, seconds and clips a second."""
    n = transcribed.groupBy("teacher").agg(F.count(F.lit(1)).alias("clips"), F.sum("seconds").alias("seconds"))
    return n.withColumn("clips_per_second", F.try_divide("clips", "seconds"))


def embed_with(df: DataFrame, model: Callable, key: str, samples: str) -> DataFrame:
    """key and embedding by a user model; empty clips are left out."""

    def run(batches):
        for pdf in batches:
            own = pdf[pdf[samples].map(lambda x: x is not None and len(x) > 0)]
            yield pd.DataFrame({key: own[key], "embedding": [np.asarray(model(x), np.float32) for x in own[samples]]})

    kind = dict(df.dtypes)[key]
    return df.select(key, samples).mapInPandas(run, f"{key} {kind}, embedding array<float>")
