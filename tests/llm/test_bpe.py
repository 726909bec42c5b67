import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from cliploom.llm import bpe
from cliploom.llm.op01_bpe import op1_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " ", "a", "x" * 5000, "ab" * 3000, "\n\n  \t", "naïve 日本語 🙂🙂 <|endoftext|>", "don't  stop", "é" * 700, "0123456789" * 300]


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_library(spark):
    enc = library()
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choices("abcdeir éß日 \n.", k=rnd.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "a", "x")], "n int, text string, decoded string")
    got = {r.n: r for r in bpe.decode(bpe.encode(df, PATH, PATTERN), PATH).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == enc.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()


def test_long_pieces_merge_in_the_same_order():
    words = bpe.vocabulary(PATH)
    for piece in (b"abcabcthethethe" * 60, b"ingerstion" * 90, "éàthe".encode() * 100):
        assert words._merge_long(piece) == words._merge_rows([piece], 1024)[0].tolist()


def test_pair_table_finds_each_pair_and_no_other():
    left, right = np.divmod(np.arange(5000), 70)
    t = bpe.PairTable(left, right, np.arange(5000))
    assert (t.get(left, right) == np.arange(5000)).all()
    assert (t.get(left + 100, right) == bpe.NONE).all()


def test_query(spark, sf_dir):
    enc = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op1_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "text string")
    assert bpe.decode(bpe.encode(empty, PATH, PATTERN), PATH).count() == 0
    nulls = spark.createDataFrame([(None,), ([],), ([64],)], "ids array<int>")
    got = [r.decoded for r in bpe.decode(nulls, PATH).collect()]
    assert got[0] is None and sorted(map(bytes, got[1:])) == [b"", b"a"]
