import random
import re

from cliploom.llm.linededup import dedup_lines
from cliploom.llm.op09_linededup import op9_linededup


def words_of(line):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", line))


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs, least=8):
    """docs: (id, text) in any order."""
    seen, out = [], {}
    for i, text in sorted(docs):
        n = equal = close = 0
        kept = []
        for line in (text or "").split("\n"):
            w = words_of(line)
            gone = False
            if w:
                n += 1
                if w in seen:
                    equal, gone = equal + 1, True
                elif len(w) >= least and any(len(s) >= least and near(w, s) for s in seen):
                    close, gone = close + 1, True
                seen.append(w)
            if not gone:
                kept.append(line)
        out[i] = (n, equal, close, "\n".join(kept))
    return out


def test_query(spark, sf_dir):
    import hashlib

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (*x[:3], hashlib.sha256(x[3].encode()).hexdigest()) for i, x in brute(docs).items()}
    assert {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.kept_sha256) for r in op9_linededup(spark, sf_dir).collect()} == want


def test_edits_in_all_places(spark):
    rnd = random.Random(8)
    docs = []
    for i in range(60):
        base = [rnd.choice("abc") for _ in range(rnd.choice([3, 7, 8, 9, 12]))]
        lines = []
        for _ in range(5):
            line = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                at = rnd.randrange(len(line))
                rnd.choice([lambda: line.insert(at, "x"), lambda: line.pop(at), lambda: line.__setitem__(at, "y")])()
            lines.append(rnd.choice([" ", "\t"]).join(line))
        docs.append((i, "\n".join([*lines, "", " "])))
    docs += [(100, ""), (101, " \n\t"), (102, docs[3][1])]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_lines int, words string").repartition(5)
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.text) for r in dedup_lines(df).collect()}
    assert got == brute(docs)


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b\nc"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_equal) for r in dedup_lines(df).collect()), key=str)
    assert got == sorted([(1, "a b", 0), (1, "a b", 0), (None, "c", 1), (2, None, 0)], key=str)
    assert dedup_lines(df.limit(0)).count() == 0


def test_many_lines_of_one_pattern(spark):
    docs = [(i, f"order number {i} was sent to the given address today") for i in range(300)]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.text) == [0] and sum(r.n_near for r in got) == 299


def test_very_long_lines_and_reserved_names(spark):
    long = [f"w{i}" for i in range(16_000)]
    edited = long[:9_000] + ["x"] + long[9_001:]
    texts = [" ".join(long), "\t".join(edited), " ".join(edited[1:]) + " a", " ".join(long[:-1])]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, __doc int, __gone int, __LINES int")
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_equal", "n_near"]
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.text) for r in out.collect()}
    assert got == brute(list(enumerate(texts)))
