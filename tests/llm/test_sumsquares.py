import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cliploom.llm.op12_sumsquares import op12_sumsquares, pack_documents
from cliploom.llm.sumsquares import sum_of_squares


def plain_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [x.ids + [0] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def brute(lengths, capacity):
    """The offset of each piece: every open sequence is tried, and the squares are summed anew."""
    rooms, out = [], []
    for n in lengths:
        tried = []
        for i, room in enumerate(rooms):
            if room >= n:
                after = Counter(rooms[:i] + [room - n] + rooms[i + 1 :])
                tried.append((sum(c * c for r, c in after.items() if r), room - n, i))
        if not tried:
            rooms.append(capacity)
            tried = [(0, 0, len(rooms) - 1)]
        i = min(tried)[2]
        out.append(capacity - rooms[i])
        rooms[i] -= n
    return len(rooms), out, Counter(rooms)


def test_equals_trying_every_sequence():
    rnd = random.Random(7)
    for capacity in (1, 2, 9, 40):
        for _ in range(30):
            lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 50))]
            lengths = sorted(lengths, reverse=True) if rnd.random() < 0.5 else lengths
            sequence, offset = sum_of_squares(lengths, capacity)
            fill = Counter()
            for s, o, n in zip(sequence, offset, lengths, strict=True):
                assert fill[s] == o
                fill[s] += n
            assert (len(fill), offset, Counter(capacity - n for n in fill.values())) == brute(lengths, capacity)


def check(rows, texts):
    ids = dict(zip(texts, plain_ids(texts.values()), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and 0 < r.length == len(piece)
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for k, all_ids in ids.items():
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(all_ids) // 2048)))
        assert [r.length for r in own[:-1]] == [2048] * (len(own) - 1) and sum(r.length for r in own) == len(all_ids)
    for parts in by_sequence.values():
        at = 0
        for begin, n in sorted(parts):
            assert begin == at
            at += n
        assert at <= 2048
    return len(by_sequence), sum(map(len, ids.values()))


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    used, total = check(op12_sumsquares(spark, sf_dir).collect(), texts)
    assert used <= -(-total // 2048) + 1


def test_odd_texts(spark):
    texts = {0: None, 1: "", 2: "a " * 9000, 3: "<|endoftext|> İ. aİ! x İ...", 4: "日本語 🙂", 5: "x" * 3000, 6: "a " * 2047, 7: "a " * 2048}
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, length string, piece int")
    check(pack_documents(df).collect(), texts)
    same = spark.createDataFrame([(1, "one two")] * 3 + [(None, "x")], "doc_id long, text string")
    got = pack_documents(same).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4
    assert pack_documents(df.limit(0)).count() == 0
