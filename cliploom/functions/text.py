"""Text functions of radio transcripts: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spoken variants and what they fold to.
FOLD = {"niner": "nine", "tree": "three", "fife": "five", "fower": "four", "juliett": "juliet", "xray": "x ray", "okay": "ok"}
DIGITS = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine"}
RADIO_DIGITS = DIGITS | {"3": "tree", "4": "fower", "5": "fife", "9": "niner"}
TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()


def table_of(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for p in d.items() for x in p))


def words(c: Column) -> Column:
    """The parts between white space; none for empty or null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def normalize_atc(c: Column) -> Column:
    """Lower case, no punctuation but the apostrophe, digits inside tokens as words, spoken variants folded.

    Only texts with a digit, or with a variant as a word, are looked at word by word.
    """
    plain = F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("-"), F.lit(" ")), r"[^\p{L}\p{N}_\s']", " ")
    digits, fold = table_of(DIGITS), table_of(FOLD)
    apart = lambda t: F.when(t.rlike("[0-9]"), F.transform(F.filter(F.split(t, ""), lambda x: x != ""), lambda x: F.coalesce(digits[x], x))).otherwise(F.array(t))
    by_word = F.array_join(F.transform(F.flatten(F.transform(words(plain), apart)), lambda w: F.coalesce(fold[w], w)), " ")
    return F.when(plain.rlike(rf"[0-9]|(?<!\S)(?:{'|'.join(FOLD)})(?!\S)"), by_word).otherwise(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def transcript_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, ",.!?;:", ""), r"\s+", " "))


def tokenize_spoken(c: Column) -> Column:
    """Numerals (decimals kept, ordinal suffix cut) and words of a to z; x ray is one token."""
    found = F.regexp_extract_all(F.replace(F.lower(c), F.lit("-"), F.lit(" ")), F.lit(r"([0-9]+(?:\.[0-9]+)?(?:st|nd|rd|th)?|[a-z]+)"), 1)
    cut = F.transform(found, lambda t: F.regexp_replace(t, r"^([0-9.]+)(st|nd|rd|th)$", "$1"))
    joined = F.transform(cut, lambda t, i: F.when((t == "x") & (F.get(cut, i + 1) == "ray"), "xray").otherwise(t))
    return F.filter(joined, lambda t, i: ~((t == "ray") & (i > 0) & F.coalesce(F.get(cut, i - 1) == "x", F.lit(False))))


def digits_to_words(c: Column, radio: bool = False) -> Column:
    each = F.transform(F.filter(F.split(c, ""), lambda x: x.rlike("[0-9]")), lambda x: table_of(RADIO_DIGITS if radio else DIGITS)[x])
    return F.array_join(each, " ")


def pair_names(radio: bool) -> dict[str, str]:
    """Spoken form of each pair of digits, and of each single digit after a blank."""
    one = RADIO_DIGITS if radio else DIGITS
    out = {f" {d}": w for d, w in one.items()}
    for n in range(100):
        tens, ones = divmod(n, 10)
        spoken = TEENS[ones] if tens == 1 else " ".join([TENS[tens] if tens else one["0"]] + [one[str(ones)]] * (ones > 0 or not tens))
        out[f"{n:02d}"] = spoken
    return out


def group_number_words(c: Column, radio: bool = False) -> Column:
    """Up to four digits as pairs from the right, a single digit before them alone; longer ones digit by digit."""
    s, names = c.cast("string"), table_of(pair_names(radio))
    even = F.lpad(s, F.length(s) + F.length(s) % 2, F.lit(" "))
    pairs = F.transform(F.sequence(F.lit(1), F.length(even), F.lit(2)), lambda i: names[F.substring(even, i, F.lit(2))])
    return F.when(F.length(s).between(1, 4), F.array_join(pairs, " ")).otherwise(digits_to_words(s, radio))


def feet_to_words(c: Column, radio: bool = False) -> Column:
    """Thousands digit by digit and hundreds; below a hundred zero."""
    said = lambda n, unit: F.when(n > 0, F.concat(digits_to_words(n.cast("string"), radio), F.lit(f" {unit}")))
    both = F.concat_ws(" ", said(F.floor(c / 1000), "thousand"), said(F.floor(c % 1000 / 100), "hundred"))
    return F.when(both != "", both).otherwise("zero")


#: Pattern of each slot type.
VALUE_FORMS = {
    "callsign": r"^[A-Z]{1,4}[0-9][A-Z0-9]{0,5}$",
    "runway": r"^[0-9]{2}[LRC]?$",
    "heading": r"^[0-9]{3}$",
    "altitude": r"^[1-9][0-9]{2,4}ft$",
    "flight_level": r"^FL[0-9]{3}$",
    "frequency": r"^[0-9]{3}\.[0-9]{3}$",
    "speed": r"^[1-9][0-9]{1,2}$",
    "squawk": r"^[0-7]{4}$",
    "altimeter": r"^[QA][0-9]{3,4}$",
    "waypoint": r"^[A-Z]{2,10}$",
    "atis": r"^[A-Z]$",
}

#: Least, greatest and step of a value's number; frequencies in kHz, altimeters by their first letter.
VALUE_LIMITS = {"runway": (1, 36, 1), "heading": (1, 360, 1), "flight_level": (10, 450, 1), "altitude": (100, 45000, 100), "frequency": (118000, 136975, 5), "speed": (60, 350, 1), "Q": (900, 1100, 1), "A": (2800, 3150, 1)}


def check_value(kind: Column, value: Column) -> Column:
    """unknown_type, malformed, out_of_range or bad_step; null for a legal value."""
    form = F.lit(False)
    for k, p in VALUE_FORMS.items():
        form = form | ((kind == k) & value.rlike(p))
    number = F.regexp_extract(F.replace(value, F.lit("."), F.lit("")), r"([0-9]+)", 1).try_cast("int")
    limit = F.when(kind == "altimeter", F.substring(value, 1, 1)).otherwise(kind)
    outside = step = F.lit(False)
    for k, (low, high, by) in VALUE_LIMITS.items():
        outside = F.when(limit == k, ~number.between(low, high)).otherwise(outside)
        step = F.when(limit == k, number % by != 0).otherwise(step)
    return F.when(~kind.isin(*VALUE_FORMS), "unknown_type").when(~form, "malformed").when(outside, "out_of_range").when(step, "bad_step")


def parse_station(c: Column) -> Column:
    found = F.regexp_extract(stem(c), r"^(.+)_[0-9]{8}_[0-9]{6}$", 1)
    return F.when(found == "", "unknown").otherwise(found)


def stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def parse_capture_ts(c: Column) -> Column:
    """Null for another form of name or an impossible date."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(stem(c), r"_([0-9]{8}_[0-9]{6})$", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def capture_day(c: Column) -> Column:
    return F.nullif(F.regexp_extract(stem(c), r"_([0-9]{8})_[0-9]{6}$", 1), F.lit(""))


def hour_block(c: Column) -> Column:
    h = F.hour(parse_capture_ts(c))
    return F.when(h < 4, "00-03").when(h < 12, "04-11").when(h < 16, "12-15").when(h < 20, "16-19").when(h < 24, "20-23").otherwise("unknown")


def duration_band(c: Column) -> Column:
    return F.when(c < 3, "<3s").when(c < 6, "3-6s").when(c >= 6, ">6s")


def most_alike(sorted_words: Column) -> Column:
    """How often the most frequent entry of a sorted array occurs."""

    def step(seen: Column, word: Column) -> Column:
        run = F.when(seen["word"] == word, seen["run"] + 1).otherwise(1)
        return F.struct(word.alias("word"), run.alias("run"), F.greatest(seen["most"], run).alias("most"))

    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    return F.aggregate(sorted_words, start, step, lambda seen: seen["most"])


def repetition_ratio(c: Column, n: int = 4) -> Column:
    """Share of repeated n-grams, or how far the most frequent token is beyond half of the words."""

    def ratio(w: Column) -> Column:
        size = F.size(w)
        loop = F.greatest(F.lit(0.0), (most_alike(F.array_sort(w)) / size - 0.5) / 0.5)
        grams = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        repeated = 1.0 - F.size(F.array_distinct(grams)) / F.size(grams)
        return F.when(size == 0, 0.0).when(size < n, loop).otherwise(F.greatest(repeated, loop))

    # as the only entry of an array the words are worked out once
    return F.element_at(F.transform(F.array(words(normalize_atc(c))), ratio), 1)


def length_deviation(ref: Column, hyp: Column, tol: float = 0.3, clip: float = 2.0) -> Column:
    r, h = F.size(words(normalize_atc(ref))), F.size(words(normalize_atc(hyp)))
    return F.least(F.greatest(F.lit(0.0), F.abs(h - r) / F.greatest(r, F.lit(1)) - tol), F.lit(clip))


def hardness_route(teacher: Column, student: Column, trust: float, easy: float, hard: float) -> Column:
    """struct<route, reason> of a pair of error rates; bounds are strict, null is dropped."""
    pick = lambda route, reason: F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason"))
    return (
        F.when(teacher.isNull() | student.isNull(), pick("dropped", "no_reference"))
        .when(teacher >= trust, pick("dropped", "teacher_untrusted"))
        .when(student <= easy, pick("spillover", "too_easy"))
        .when(student >= hard, pick("spillover", "too_hard"))
        .otherwise(pick("selected", "in_window"))
    )


def relocated(c: Column, source: str, target: str) -> Column:
    """The path under another prefix, in any spelling of slashes; others only get plain slashes."""
    plain = F.regexp_replace(c, r"[\\/]+", "/")
    old = source.replace("\\", "/").rstrip("/")
    return F.when((plain == old) | plain.startswith(old + "/"), F.concat(F.lit(target.rstrip("/")), F.substring(plain, F.lit(len(old) + 1), F.length(plain)))).otherwise(plain)


def row_fingerprint(*columns: str, size: int = 64) -> Column:
    """SHA-256 of canonical JSON with sorted keys."""
    names = sorted(columns)
    return F.substring(F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256), 1, size)
