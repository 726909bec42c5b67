"""Line dedup over all documents by a deletion-neighbourhood join, in DataFrame functions only.

A line counts by its words. Two lines of at least min_words words are near
copies if one word inserted, deleted or replaced makes them equal; shorter lines
only if they are equal. A line goes if an earlier line (by document id, then
line number) is equal or a near copy of it; lines without a word stay.

Equal lines are joined into classes first, by a 128-bit hash of the line with
single blanks. Near copies share the first or the last words, nearly half of
them, so lines that share neither with a line of another class need no variants.
Each remaining class emits its word sequence and all sequences with one word
deleted, as hashed keys. Equal keys are joined through their earliest member
instead of in pairs, which is enough: classes with one key at the same deleted
position are all within one replacement, and a key that is a whole line is within
one deletion of all others. So a key that very many lines share costs one row a
line. The edit distance of each line and its witness is then verified.

The key of a sequence is made of the exclusive or of one hash for each word and
its place. All words before a deleted one keep their place and all behind it move
up by one, so one pass over a line gives all its keys.

Defined results: null and empty texts have no lines with words and stay as they
are; rows with equal id and text are one document, and each is kept; a null id
comes last; an empty table gives no rows; columns of any other name stay, but
n_lines, n_equal and n_near are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import forget, unused, written

SPACE = r"[\x20\x09-\x0D]+"
#: What a line with single blanks between words holds nowhere; blanks at its ends are looked for apart.
ODD = ["  ", "\t", "\x0b", "\x0c", "\r"]


def single_blanks(line: Column) -> Column:
    """The words of a line with one blank between them; most lines are so already."""
    odd = line.startswith(" ") | line.endswith(" ")
    for x in ODD:
        odd |= line.contains(x)
    return F.when(odd, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)


def end_keys(min_words: int) -> Column:
    """Keys of the first and last words that a line shares with any near copy; of columns line and n.

    Of m words, those of the shorter line, the first or last half is untouched by one edit.
    A multiple of four words is taken of longer halves, so that m and m - 1 mostly give one key.
    """
    half = lambda m: F.when(m < 8, (m / 2).cast("int")).otherwise((m / 8).cast("int") * 4)
    own, less = half(F.col("n")), half(F.col("n") - 1)
    key = lambda name, count: F.xxhash64(F.lit(name), count, F.call_function("substring_index", F.col("line"), F.lit(" "), count if name == "first" else -count))
    both = lambda count: F.array(key("first", count), key("last", count))
    return F.when(F.col("n") < min_words, None).when((own == less) | (F.col("n") == min_words), both(own)).otherwise(F.concat(both(own), both(less)))


def line_table(docs: DataFrame, doc: str, text: str, min_words: int) -> DataFrame:
    """A row per line with a word: place (document and line number), class keys h1 and h2, ends."""
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("number", "line"))
    lines = lines.withColumn("line", single_blanks(F.col("line"))).where("line <> ''")
    lines = lines.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    return lines.select(
        F.struct(F.col(doc).alias("doc"), "number").alias("place"),
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"),
        end_keys(min_words).alias("ends"),
    )


def edit_within_one(a: Column, b: Column) -> Column:
    """Whether the arrays differ by one element inserted, deleted or replaced, or not at all."""

    def common(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(first == 0, F.size(x).cast("long")).otherwise(first - 1)

    return common(a, b) + common(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def variant_keys(words: Column) -> Column:
    """Array of (at, key): the whole sequence at 0, and the sequence without its word at 1, 2, …"""
    start = F.struct(F.lit(0).alias("at"), *(F.lit(0).cast("long").alias(c) for c in ("stay", "move")), F.array().cast("array<bigint>").alias("out"))

    def step(seen: Column, word: Column) -> Column:
        at = seen["at"] + 1
        move = seen["move"].bitwiseXOR(F.xxhash64(at - 1, word))
        return F.struct(
            at.alias("at"),
            seen["stay"].bitwiseXOR(F.xxhash64(at, word)).alias("stay"),
            move.alias("move"),
            F.array_append(seen["out"], seen["stay"].bitwiseXOR(move)).alias("out"),
        )

    def finish(seen: Column) -> Column:
        n = seen["at"]
        cut = F.transform(seen["out"], lambda x, i: F.struct((i + 1).alias("at"), F.xxhash64(n - 1, x.bitwiseXOR(seen["move"])).alias("key")))
        return F.concat(F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(n, seen["stay"]).alias("key"))), cut)

    return F.aggregate(words, start, step, finish)


def near_classes(docs: DataFrame, lines: DataFrame, classes: DataFrame, doc: str, text: str) -> DataFrame:
    """h1, h2 of the classes that are near copies of an earlier one."""
    ends = lines.where("ends is not null").select("h1", "h2", F.explode("ends").alias("end"))
    shared = ends.groupBy("end").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("end")
    wanted = ends.join(shared, "end", "left_semi").select("h1", "h2").distinct()
    candidates = classes.join(wanted, ["h1", "h2"], "left_semi").select("h1", "h2", "place")
    # numbers that grow in the order of place, and are fixed by the table
    candidates = written(candidates.orderBy("place").withColumn("line", F.monotonically_increasing_id()), "candidates")
    numbers = candidates.groupBy(F.col("place.doc").alias(doc)).agg(F.collect_set(F.struct("place.number", "line")).alias("own"))
    found = docs.select(doc, F.split(text, "\n").alias("lines")).join(numbers, doc).select(F.explode("own").alias("x"), "lines")
    found = found.select("x.line", F.element_at("lines", F.col("x.number") + 1).alias("text")).dropDuplicates(["line"])
    texts = written(found.select("line", F.split(single_blanks(F.col("text")), " ").alias("words")), "lines")

    variants = texts.select("line", F.explode(variant_keys(F.col("words"))).alias("v")).select("line", "v.at", "v.key")
    variants = written(variants, "variants")
    shared = variants.groupBy("key").agg(
        F.count(F.lit(1)).alias("many"),
        F.min(F.when(F.col("at") == 0, F.col("line"))).alias("whole"),
        F.min(F.when(F.col("at") > 0, F.col("line"))).alias("cut"),
    )
    met = written(variants.join(shared.where("many > 1"), "key"), "met")
    same = met.where("at > 0").groupBy("key", "at").agg(F.min("line").alias("witness"))
    one = met.join(same, ["key", "at"]).select("line", "witness")
    two = met.select("line", F.when(F.col("at") == 0, F.col("cut")).otherwise(F.col("whole")).alias("witness"))
    pairs = one.unionByName(two).where("witness < line").distinct()
    a = texts.select("line", F.col("words").alias("a"))
    b = texts.select(F.col("line").alias("witness"), F.col("words").alias("b"))
    near = pairs.join(a, "line").join(b, "witness").where(edit_within_one(F.col("a"), F.col("b"))).select("line").distinct()
    near = written(candidates.join(near, "line", "left_semi").select("h1", "h2"), "near")
    for made in (candidates, texts, variants, met):
        forget(made)
    return near


def dedup_lines(df: DataFrame, min_words: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the text of the kept lines, and n_lines, n_equal, n_near: its lines with words, and those dropped."""
    names = [c for c in df.columns if c not in ("n_lines", "n_equal", "n_near")]
    doc, split, gone = (unused(df, x) for x in ("doc", "lines", "gone"))
    same = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    docs = df.select(same.alias(doc), *names)
    lines = written(line_table(docs, doc, text, min_words), "lines")
    classes = written(lines.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("many")), "classes")
    near = near_classes(docs, lines, classes, doc, text).withColumn("near", F.lit(True))
    # a class of one line that is no near copy loses nothing
    known = classes.join(near, ["h1", "h2"], "left").where("near or many > 1")
    known = known.select("h1", "h2", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    marked = lines.select("place", "h1", "h2").join(known, ["h1", "h2"]).where("near or place > first")
    marked = marked.select("place.doc", "place.number", (F.col("place") > F.col("first")).alias("equal")).distinct()
    dropped = marked.groupBy(F.col("doc").alias(doc)).agg(
        F.count_if("equal").alias("n_equal"), F.count_if(~F.col("equal")).alias("n_near"), F.collect_list("number").alias(gone)
    )
    others = [c for c in names if c != text]
    whole = docs.select(doc, *others, F.split(text, "\n").alias(split))
    out = whole.join(dropped, doc, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.col(split)).otherwise(F.transform(left, lambda i: F.element_at(split, i + 1)))
    worded = F.size(F.filter(split, lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != ""))
    out = out.withColumn(text, F.array_join(kept, "\n")).withColumn("n_lines", F.coalesce(worded, F.lit(0)))
    return out.select(*names, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_equal", "n_near")))
