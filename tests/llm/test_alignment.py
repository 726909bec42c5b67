import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cliploom.llm import alignment
from cliploom.llm.op11_align import align_documents, op11_align

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = {}


def letters():
    """The byte of each letter of a byte-level vocabulary, found from the tokenizer itself."""
    if not LETTERS:
        t = Tokenizer.from_file(A)
        for c in [*range(0x800), *range(0x800, 0xD800, 64), *range(0xE000, 0x110000, 1024)]:
            for x, y in zip("".join(p[0] for p in t.pre_tokenizer.pre_tokenize_str(chr(c))), chr(c).encode(), strict=True):
                LETTERS[x] = y
    return LETTERS


def brute(texts):
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    names = {i: w for w, i in a.get_vocab().items()}
    out, links, documents = [], [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        spell_a = [bytes(letters()[c] for c in names[i]) for i in ids_a]
        spell_b = [bytes([int(w[3:-1], 16)]) if b.is_byte(i) else w.replace("▁", " ").encode() for i in ids_b for w in [b.id_to_piece(i)]]
        whole = (" " + text).encode() if text else b""
        if b"".join(spell_a) != whole or b"".join(spell_b) != whole:
            ids_a, ids_b, spell_a, spell_b = [], [], [], []
        cuts, held = defaultdict(lambda: [[], []]), []
        ends = [[], []]
        for side, spell in enumerate((spell_a, spell_b)):
            at = 0
            for x in spell:
                at += len(x)
                ends[side].append(at)
        common = sorted(set(ends[0]) & set(ends[1]))
        for side, ids in enumerate((ids_a, ids_b)):
            k = 0
            for i, e in zip(ids, ends[side], strict=True):
                while common[k] < e:
                    k += 1
                cuts[k][side].append(i)
        i = j = 0
        while i < len(ids_a):
            held.append((ids_a[i], ids_b[j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
        groups = ";".join("|".join(",".join(map(str, s)) for s in cuts[k]) for k in sorted(cuts))
        documents.update(set(held))
        links.append(held)
        out.append([len(ids_a), len(ids_b), len(common), len(held), hashlib.sha256(groups.encode()).hexdigest() if groups else ""])
    top = Counter()
    for (x, _), n in documents.items():
        top[x] = max(top[x], n)
    return [(*o[:4], sum(documents[p] == top[p[0]] for p in held), sum(documents[p] for p in held), o[4]) for o, held in zip(out, links, strict=True)]


def check(rows, texts):
    want = dict(zip(texts, brute([t or "" for t in texts.values()]), strict=True))
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}
    assert got == want


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(op11_align(spark, sf_dir).collect(), texts)


ODD = [
    None, "", " ", "  ", "a", "a ", " a  b ", "\n", "a\n b\n\n  c\t d", "x▁y", "é 🙂ﷺ𝕏 日本語。テスト", "　a   b\x1c c\x85 d", "don't we'll 's",
    "<|endoftext|> <s></s><unk> <0x0A>", "\x00\x01 \x7f", "é ​ ﻿ x", "12345 1e-9 --- ... !!??", "\r\n \r x();\r\n", "가나다 가 한국어 텍스트", "ab " * 5000, "q" * 3000,
]


def test_odd_texts_repeats_and_clashing_columns(spark, monkeypatch):
    texts = dict(enumerate(ODD))
    df = spark.createDataFrame([(k, t, 7, "x") for k, t in texts.items()], "doc_id long, text string, n_a int, __row string")
    check(align_documents(df).collect(), texts)
    same = spark.createDataFrame([(1, "one two")] * 3 + [(None, "one")], "doc_id long, text string")
    got = sorted(align_documents(same).collect(), key=str)
    assert [r.doc_id for r in got].count(1) == 3 and len(got) == 4
    assert {r.count_sum for r in got if r.doc_id == 1} == {4 + 3}  # " one" in four rows, " two" in three
    assert align_documents(df.limit(0)).count() == 0
    assert [r.n_links for r in align_documents(df.where("doc_id < 2")).collect()] == [0, 0]
    monkeypatch.setattr(alignment, "HOT_PAIRS", 1)  # nothing is broadcast
    check(align_documents(df).collect(), texts)


def test_random_texts_and_a_small_memory(monkeypatch):
    rnd = random.Random(5)
    parts = [" ", "  ", "\n", "the", "ing", "é", "ß", "日", "🙂", "ﷺ", ".", "'s", "9", "\t", " ", "　", "A", "é", "▁", "<s>", "\x1c", " ", "\r"]
    texts = ["".join(rnd.choices(parts, weights=[9, 2, 2, 9, 9] + [2] * 13 + [0.1] + [1] * 4, k=rnd.randint(1, 40))) for _ in range(600)]
    want = brute(texts)
    for most in (alignment.MOST_CHUNKS, 50):
        monkeypatch.setattr(alignment, "MOST_CHUNKS", most)
        made = alignment.Aligner(A, B)
        at = 0
        for i in range(0, len(texts), 100):
            numbers, groups, *_ = made(texts[i : i + 100])
            for n, g in zip(numbers.tolist(), groups, strict=True):
                assert (*n, hashlib.sha256(g).hexdigest() if g else "") == (*want[at][:4], want[at][6])
                at += 1
