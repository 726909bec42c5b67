import hashlib
import random
import re

from cliploom.llm import pii
from cliploom.llm.op07_pii import op7_pii

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == 1:
        return all(int(x) <= 255 for x in m.split("."))
    if kind == 2:
        luhn = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(d[::-1])) % 10 == 0
        return 13 <= len(d) <= 19 and luhn
    return kind == 0 or 9 <= len(d) <= 15


def plain(text):
    return [(k, *m.span()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text or "") if valid(k, m[0])]


def spelled(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_base_equals_plain_expressions():
    rnd = random.Random(6)
    for _ in range(3000):
        t = "".join(rnd.choices("a.@_-1234567890 +()é", k=rnd.randrange(60)))
        assert pii.base_spans(t) == plain(t)
    for t in ("a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (017) 555-7713.", "300.1.1.1 1.1.1.1"):
        assert pii.base_spans(t) == plain(t)
    long = "1" * 200_000 + "." + "a." * 100_000
    assert pii.base_spans(long) == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(spelled(want).encode()).hexdigest()
        assert set(spelled(want).split(",")) <= set(r.spans.split(","))


def test_patterns_find_unseen_identifiers(spark):
    names = [f"user{i}@mail{i}.example.com" for i in range(8)]
    texts = [f"note {i} please write to {n} for more help" for i, n in enumerate(names)]
    texts += ["please write to someone@localhost for more help", "the value 12@34x is odd", "call 555-0199-22 now", None, "", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("*", "1 as base", "2 as value", "3 as more", "4 as __row", "5 as row")
    rows = {r.id: r for r in pii.extract(df).collect()}
    at = texts[8].index("someone")
    assert [tuple(x) for x in rows[8].spans] == [(0, at, at + len("someone@localhost"))]
    assert all(not rows[i].spans for i in (9, 10, 11, 12)) and len(rows) == len(texts)
    whole = df.select("id", "text").join(spark.createDataFrame([(i, r.spans) for i, r in rows.items()], f"id int, spans {pii.SPANS}"), "id")
    clean = {r.id: r.text for r in pii.redact(whole).collect()}
    assert clean[8] == "please write to <EMAIL> for more help" and clean[11] is None and clean[9] == texts[9]
    assert pii.extract(df.limit(0)).count() == 0


def test_discovered_instances_qualify_a_pattern_without_base_spans(spark):
    texts = [f"note {i} please write to user{i}@mail.example.com for more help" for i in range(60)]
    texts += [f"please write to someone{i}@localhost for more help" for i in range(9)]
    texts += [f"our desk is reached via someone{i}@localhost every single day" for i in range(9)]
    texts += ["our desk is reached via fresh@localhost every single day"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    (row,) = pii.extract(df).where(f"id = {len(texts) - 1}").collect()
    at = texts[-1].index("fresh")
    assert [tuple(x) for x in row.spans] == [(0, at, at + len("fresh@localhost"))]


def test_numbers_in_groups_are_found_whole(spark):
    numbers = ["06 12 34 56 78", "(555) 123-4567", "06\u00a012\u00a034\u00a056\u00a079"]
    texts = [f"note {i} please call me at +33 1 23 45 {10 + i // 10} {10 + i} before noon today" for i in range(60)]
    texts += [f"please call me at {n} before noon today" for n in numbers]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    spans = pii.extract(df).select("id", "spans")
    clean = {r.id: r.text for r in pii.redact(df.join(spans, "id")).collect()}
    assert [clean[60 + i] for i in range(3)] == ["please call me at <PHONE> before noon today"] * 3


def test_runs_of_digit_groups():
    found = lambda t: [t[a:b] for a, b, _ in pii.runs(t, pii.base_spans(t))]
    assert found("tel 06 12 34 56 78, or (06 12 34 56 79).") == ["06 12 34 56 78", "06 12 34 56 79"]
    assert found("12 34 or 555-0199-22 or 1 2 3 4") == []
    assert "4111 1111 1111 1112" in found("4111 1111 1111 1112")
    many = " ".join(["123"] * 50_000)
    assert all(7 <= len(pii.digits_of(x)) <= 19 for x in found(many)) and len(found(many)) <= 100_000
    assert found("1" * 200_000) == []


def test_contexts_are_whole_words(spark):
    long = "x" * 1000
    assert pii.patterns_at(f"one {long} 5 {long}y two", 5 + 1000, 6 + 1000) == [f"one {long} _", f"{long} _ {long}y", f"_ {long}y two"]
    ids = [f"{i:03}" + "9" * 80 + "@host" for i in range(9)]
    texts = [f"please write to user{i}@mail.example.com for more help" for i in range(60)] + [f"please write to {x} for more help" for x in ids]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id int, text string, __mark int, __spans int")
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert all(clean[60 + i] == "please write to <EMAIL> for more help" for i in range(9))
