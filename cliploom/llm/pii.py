"""Personal data: base expressions, and contextual extraction bootstrapped from them.

mentions() finds the base spans of whole texts, and candidates: other tokens with
digits or an at sign that could be an identifier, and runs of digit groups with
blanks between them that could be a card or phone number. Each is tied to the lexical
patterns around it: the two words before, the word before and the word after, the
two words after. In the graph of patterns and instances, which Spark scores for
ROUNDS rounds by joins and grouped sums, base instances are sure; a pattern is as
good as the share of its distinct instances that are (with at least SUPPORT of
them), and an instance is as sure as its patterns are together. A candidate of a
high-confidence pattern and instance becomes a span.

A pattern with fewer than SUPPORT distinct instances, of which none is more than sure,
can't ever be trusted, so it leaves the graph at once; the others are judged each round. No step gathers the instances of a pattern.

Defined results: a null or empty text has no spans; rows may repeat and count as one
instance each value; an empty table gives no rows. Positions are code points, ends
exclusive. Columns base and spans are replaced; columns of any other name stay.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import map_arrow, slices, unused, with_columns, written

KINDS = ["email", "ip", "card", "phone"]
#: Fixed patterns of the base. A match may begin only where the last one ended or at the start of a run: starts inside a run would fail alike, in the square of its length.
EMAIL = regex.compile(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = regex.compile(r"(?:\G|(?<![0-9]))[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = regex.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = regex.compile(r"[0-9@]")
GROUP = regex.compile(r"[0-9]++")
RUN = regex.compile(r"(?<![0-9])[0-9]++(?:[\x20\t\u00a0\u202f().-]{1,3}[0-9]++)+")
BLANK = regex.compile(r"[\x20\t\u00a0\u202f]")
#: Most digits of a phone and of a card number.
LIMITS = (15, 19)
SPACE = " \t\n\x0b\x0c\r"
STRIP = ".,;:!?\"'()[]{}<>*#$%&|="
ROUNDS, SUPPORT, SURE = 3, 3, 0.8
REACH = 80


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in order."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in EMAIL.finditer(text)]
    if HINT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def could_be(token: str) -> list[int]:
    """Kinds that a token might belong to though the base expressions don't match it."""
    n = len(digits_of(token))
    groups = regex.findall(r"[0-9]+", token)
    kinds = []
    if "@" in token[1:-1]:
        kinds.append(0)
    if n >= 4 and len(groups) in (4, 6) and not regex.search(r"[A-Za-z]", token):
        kinds.append(1)
    if 12 <= n <= 19 and 2 * n >= len(token):
        kinds.append(2)
    if 7 <= n <= 15 and 2 * n >= len(token):
        kinds.append(3)
    return kinds


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """start, end, kinds of the tokens outside the spans that could be identifiers."""
    spans = sorted((a, b) for _, a, b in taken)
    at = k = 0
    while m := HINT.search(text, at):
        begin = end = m.start()
        while begin > 0 and text[begin - 1] not in SPACE:
            begin -= 1
        while end < len(text) and text[end] not in SPACE:
            end += 1
        at = end
        token = text[begin:end]
        begin += len(token) - len(token.lstrip(STRIP))
        token = token.strip(STRIP)
        end = begin + len(token)
        while k < len(spans) and spans[k][1] <= begin:
            k += 1
        if len(token) >= 5 and (k == len(spans) or spans[k][0] >= end) and (kinds := could_be(token)):
            yield begin, end, kinds


def parts_of(groups: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """First and last group of the candidates in a run: the whole run, or if it has too many digits, from each group on what fits a limit."""
    ends = [0]
    for a, b in groups:
        ends.append(ends[-1] + b - a)
    if ends[-1] <= LIMITS[0]:
        return {(0, len(groups) - 1)}
    out = set()
    for limit in LIMITS:
        j = 0
        for i in range(len(groups)):
            j = max(j, i)
            while j < len(groups) and ends[j + 1] - ends[i] <= limit:
                j += 1
            if j > i + 1:
                out.add((i, j - 1))
    return out


def runs(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """start, end, kinds of the runs of digit groups with a blank among them, outside the spans, that could be card or phone numbers."""
    spans = sorted((a, b) for _, a, b in taken)
    k = 0
    for m in RUN.finditer(text):
        free: list[list[tuple[int, int]]] = [[]]
        for g in GROUP.finditer(text, m.start(), m.end()):
            while k < len(spans) and spans[k][1] <= g.start():
                k += 1
            if k < len(spans) and spans[k][0] < g.end():
                free.append([])
            else:
                free[-1].append(g.span())
        for groups in free:
            for i, j in sorted(parts_of(groups)) if len(groups) > 1 else ():
                begin, end = groups[i][0], groups[j][1]
                own = text[begin:end]
                if not BLANK.search(own):
                    continue
                if own.count(")") > own.count("(") and text[begin - 1 : begin] == "(":
                    begin -= 1
                if text[begin - 1 : begin] == "+":
                    begin -= 1
                if own.count("(") > own.count(")") and text[end : end + 1] == ")":
                    end += 1
                if kinds := [x for x in could_be(text[begin:end]) if x > 1]:
                    yield begin, end, kinds


def words_to(text: str, at: int, step: int) -> list[str]:
    """The two whole words before (step -1) or after (step 1) a place, or more; in lower case."""
    reach = REACH
    while True:
        own = text[max(0, at - reach) : at] if step < 0 else text[at : at + reach]
        words = own.lower().split()
        whole = reach >= (at if step < 0 else len(text) - at)
        if whole or len(words) > 2:  # of three words the outermost may be cut
            return words if whole else words[1:] if step < 0 else words[:-1]
        reach *= 4


def patterns_at(text: str, begin: int, end: int) -> list[str]:
    before = ["^", "^", *words_to(text, begin, -1)][-2:]
    after = [*words_to(text, end, 1), "$", "$"][:2]
    return [f"{before[0]} {before[1]} _", f"{before[1]} _ {after[0]}", f"_ {after[0]} {after[1]}"]


SPANS = "array<struct<kind:int,start:int,end:int>>"
FOUND = "array<struct<start:int,end:int,value:string,seed:int,kinds:array<int>,patterns:array<string>>>"
SPANS_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
FOUND_TYPE = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("seed", pa.int32()), ("kinds", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string()))])
)


def mentions(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with base (spans) and found: seeds and candidates with their patterns."""

    def run(batches):
        for batch, texts in slices(batches, text):
            base = [base_spans(t) for t in texts]
            found = []
            for t, spans in zip(texts, base, strict=True):
                own = [(a, b, k, [k]) for k, a, b in spans]
                if spans or HINT.search(t):
                    own += [(a, b, -1, kinds) for a, b, kinds in itertools.chain(candidates(t, spans), runs(t, spans))]
                found.append([{"start": a, "end": b, "value": t[a:b], "seed": k, "kinds": kinds, "patterns": patterns_at(t, a, b)} for a, b, k, kinds in own])
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in base]
            yield with_columns(batch, {"base": pa.array(spans, SPANS_TYPE), "found": pa.array(found, FOUND_TYPE)}).drop_columns([text])

    return map_arrow(df, df.columns, run, f"base {SPANS}, found {FOUND}", without=[text])


def score_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns (pattern, kind, score) and of instances (value, kind, sure), from rows of mentions."""
    edges = found.select(F.explode("patterns").alias("pattern"), "value", F.when(F.col("seed") >= 0, F.col("seed")).alias("seed"), "kinds")
    edges = edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"))
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    edges = written(edges.join(size.select("pattern", "n"), "pattern"), "edges")
    seeds = edges.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("sure")).distinct()
    other = edges.where("seed is null").select("pattern", "value", "n", F.explode("kinds").alias("kind"))
    links = other.unionByName(edges.where("seed is not null").select("pattern", "value", "n", F.col("seed").alias("kind")))
    links = written(links, "links")
    sure = written(seeds, "sure")
    for _ in range(ROUNDS):
        gained = links.join(sure, ["value", "kind"]).groupBy("pattern", "kind").agg((F.sum("sure") / F.first("n")).alias("score"), F.sum("sure").alias("support"))
        scores = written(gained.where(F.col("support") >= SUPPORT).select("pattern", "kind", F.least("score", F.lit(0.999)).alias("score")), "patterns")
        new = links.join(scores, ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("sure"))
        new = new.join(seeds.select("value").distinct(), "value", "left_anti")
        sure = written(seeds.unionByName(new), "sure")
    return scores, sure


def extract(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with base (spans of the base expressions) and spans (those and the discovered ones)."""
    row, more = unused(df, "row"), unused(df, "more")
    table = written(mentions(df, text).withColumn(row, F.monotonically_increasing_id()), "mentions")
    found = table.select(F.col(row).alias("row"), F.explode("found").alias("x")).select("row", "x.*")
    patterns, sure = score_graph(found)
    good = patterns.where(F.col("score") >= SURE).select("pattern", "kind")
    fresh = found.where("seed < 0").select("row", "start", "end", "value", F.explode("kinds").alias("kind"), "patterns")
    fresh = fresh.join(sure.where(F.col("sure") >= SURE), ["value", "kind"])
    fresh = fresh.select("row", "start", "end", "kind", F.explode("patterns").alias("pattern")).join(good, ["pattern", "kind"])
    fresh = fresh.groupBy("row", "start", "end").agg(F.min("kind").alias("kind"))
    found = fresh.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("kind", "start", "end")).alias(more))
    spans = F.array_sort(F.concat("base", F.coalesce(more, F.array().cast(SPANS))))
    return table.join(found, row, "left").withColumn("spans", spans).drop(row, "found", more)


def redact(df: DataFrame, spans: str = "spans", text: str = "text") -> DataFrame:
    """df without its spans, each span of the text replaced by its kind in angle brackets; overlapping spans count as one."""

    def run(batches):
        for batch in batches:
            out = []
            for t, own in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                parts, at = [], 0
                for x in sorted(own or (), key=lambda x: (x["start"], -x["end"])) if t is not None else ():
                    if x["start"] >= at:
                        parts += [t[at : x["start"]], f"<{KINDS[x['kind']].upper()}>"]
                    at = max(at, x["end"])
                out.append(t if not parts else "".join(parts) + t[at:])
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(out, pa.string())).drop_columns([spans])

    return map_arrow(df, df.columns, run, "", without=[spans])


def redacted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with each span of its texts replaced by its kind."""
    name, own = unused(df, "mark"), unused(df, "spans")
    mark = F.struct(F.xxhash64(F.col(key), F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))
    found = extract(df.select(mark.alias(name), text), text).where(F.size("spans") > 0)
    found = found.dropDuplicates([name]).select(name, F.col("spans").alias(own))
    marked = df.withColumn(name, mark).join(found, name, "left").drop(name)
    return redact(marked, own, text).select(*df.columns)
