import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cliploom.llm import packing
from cliploom.llm.op08_packing import op8_packing, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [x.ids + [2] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def brute_best_fit(lengths, capacity):
    left, out = [], []
    for n in lengths:
        fit = [x for x in left if x >= n]
        if fit:
            i = left.index(min(fit))
        else:
            left.append(capacity)
            i = len(left) - 1
        out.append(capacity - left[i])
        left[i] -= n
    return len(left), sorted(out), sorted(left)


def test_tree_equals_a_plain_search():
    rnd = random.Random(3)
    for capacity in (1, 7, 64, 100):
        for _ in range(20):
            lengths = sorted((rnd.randint(1, capacity) for _ in range(60)), reverse=True)
            window, offset = packing.best_fit(lengths, capacity)
            fill = defaultdict(int)
            for w, o, n in zip(window, offset, lengths, strict=True):
                assert fill[w] == o
                fill[w] += n
            n, offsets, left = brute_best_fit(lengths, capacity)
            assert (len(fill), sorted(offset)) == (n, offsets)
            assert sorted(capacity - x for x in fill.values()) == left


def check(rows, texts):
    ids = {k: v for k, v in zip(texts, plain_ids(texts.values()), strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for groups in (by_doc, by_sequence):
        for parts in groups.values():
            at = 0
            for begin, n in sorted(parts):
                assert begin == at
                at += n
    assert {k: sum(n for _, n in v) for k, v in by_doc.items()} == {k: len(v) for k, v in ids.items()}
    assert max(sum(n for _, n in v) for v in by_sequence.values()) <= 4096
    return len(by_sequence)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    used = check(op8_packing(spark, sf_dir).collect(), texts)
    assert used <= 1 + 1.02 * sum(map(len, plain_ids(texts.values()))) / 4096


def test_odd_texts_and_sequences(spark):
    texts = {0: None, 1: "", 2: "a " * 9000, 3: "don't STOP now <|endoftext|> é ́x\x1cy", 4: "日本語 🙂", 5: "x" * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit("clash"))
    check(pack_documents(df).collect(), texts)
    placed = packing.place(packing.windows(df, PATH))
    made = packing.sequences(placed).collect()
    assert sum(r.n_tokens for r in made) == sum(map(len, plain_ids(texts.values())))
    for r in made:
        assert len(r.ids) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 4096)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two")] * 3 + [(None, "x")], "doc_id long, text string")
    got = pack_documents(df).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4
    assert pack_documents(df.limit(0)).count() == 0


def test_words_encoded_together_and_alone():
    words = ["a <|endoftext|> b", "x<|startoftext|>y", "<|EndOfText|> <|", "<|endoftext|>" * 3, "the", "thorion,", "İstanbul", "über!!", "don't", "a1b", "é", "éx", "x.,", "日本語。", "...", "it's,", "가", "ΑΣ", "KK"] * 3
    ids, sizes = packing.token_ids(words, PATH, 2)
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == plain_ids(words)
