"""The cache of pieces looks each piece up once, and loses nothing where it starts anew or an encoder fails."""

import numpy as np
import pytest

from cliploom.llm.common import PieceCache


class Word(bytes):
    """A word that counts how often it is looked up."""

    hashed = 0

    def __hash__(self):
        Word.hashed += 1
        return super().__hash__()


def encode(pieces):
    return np.array([x for p in pieces for x in p], np.int32), np.array([len(p) for p in pieces], np.int64)


def test_a_new_word_is_looked_up_once():
    Word.hashed = 0
    flat, sizes = PieceCache(encode).ids([[Word(b"ab"), Word(b"c")], [Word(b"ab")]])
    assert flat.tolist() == [97, 98, 99, 97, 98] and sizes.tolist() == [3, 2]
    assert Word.hashed <= 5  # once each, and once more where a new one is put in


def test_starting_anew_and_failures_change_no_result():
    cache, broken = PieceCache(lambda p: encode(p) if b"!" not in p else 1 / 0, 3), [[b"x", b"!"]]
    for texts in ([[b"ab", b"c"]], [[b"d", b"ab"], []], [[b"e", b"c"]], [[b"f", b"g", b"h", b"i"]]):
        flat, sizes = cache.ids(texts)
        assert flat.tolist() == [x for t in texts for w in t for x in w] and sizes.tolist() == [sum(map(len, t)) for t in texts]
        with pytest.raises(ZeroDivisionError):
            cache.ids(broken)
