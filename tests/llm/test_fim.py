import hashlib
import random
import re

import duckdb
import numpy as np

from cliploom.llm import fim
from cliploom.llm.op13_fim import SQL, fill_in_middle, op13_fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def brute(key, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return key, len(units), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < spm else ("psm", f"<P>{a}<S>{c}<M>{b}")
    return key, len(units), form, len(a), len(b), sha(out), sha(text)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in op13_fim(spark, sf_dir).collect())
    assert got == sorted(brute(*d) for d in docs)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(c.sql(f"select {', '.join(COLUMNS)} from ({SQL})").fetchall()) == got


def test_units_of_random_texts():
    rnd = random.Random(11)
    letters = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x08", "\x0e", "\x1f", "!", "a", "é", "日", "🙂", "\x00", "\x7f", " ", "\x85", "Ā"]
    texts = ["".join(rnd.choices(letters, weights=[6, 1, 1, 1, 1, 1] + [1] * 13, k=rnd.randint(0, 60))) for _ in range(3000)] + ["x" * 8, " " * 16, "a b c d " * 9]
    units = fim.Units([t.encode() for t in texts])
    found = [UNIT.findall(t) for t in texts]
    assert units.count.tolist() == [len(x) for x in found]
    for _ in range(4):
        k = np.array([rnd.randint(0, len(x)) for x in found])
        ends = units.end(k)
        assert ends.tolist() == [len("".join(x[:i]).encode()) for x, i in zip(found, k, strict=True)]
        assert units.code_points(ends).tolist() == [len("".join(x[:i])) for x, i in zip(found, k, strict=True)]


def test_odd_texts_and_all_forms(spark, monkeypatch):
    texts = [None, "", " ", "a", " \n", "a<P>b", "<M>", "< P>", "<S", "x <P <S <", "日本 🙂\x0b語  ", "w " * 50_000, "z" * 200_000, "a\x00 b\x00"]
    rows = [(i, t, 5, "h") for i in range(0, 140, 14) for i, t in enumerate(texts, i)] + [(None, "a b c", 5, "h"), (3, "a", 5, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, __h1 string")
    want = sorted((brute(*r[:2]) for r in rows), key=str)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in fill_in_middle(df).collect()), key=str) == want
    made = fim.transform(df, rate=100, spm_rate=0)
    assert made.columns == ["doc_id", "text", "__h1", "n", "form", "output", "prefix_chars", "middle_chars"]
    for r in made.collect():
        assert r.form == ("psm" if r.text and not re.search("<[PSM]>", r.text) else "plain")
        if r.form == "psm":
            p, m = r.prefix_chars, r.middle_chars
            assert r.output == f"<P>{r.text[:p]}<S>{r.text[p + m :]}<M>{r.text[p : p + m]}"
    assert made.limit(0).count() == fill_in_middle(df.limit(0)).count() == 0
    monkeypatch.setattr(fim, "CHUNK_CHARS", 1)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in fill_in_middle(df).collect()), key=str) == want
