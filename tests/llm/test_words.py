"""Cutting, remembering and merging of words against the tokenizers library and plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from lorekeep.llm import bpe, neardup, packing, words

#: Letters that only some versions of Unicode know, contractions, numerals, white space of all kinds, marks, specials.
ALPHABET = "\u0558\u088f\U00011de1ab'stredvmlL \u00e9\n\t  \x85\x1c12\u00bd\u00b2\u2167z\u0307\u00c0\u0301\u4e00\U0001f600.,-|<>_\xa0\u200b\u0130\u03a3\u017f\u1e9e\u212a  '"


def texts(seed, n=400, most=30):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, most))) for _ in range(n)]
    return [t + "<|endoftext|>" + t[:4] if rnd.random() < 0.05 else t for t in out]


def test_classes_are_the_librarys():
    points = [k for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    text = "".join(map(chr, points))
    for kind, pattern in ((words.LETTER, r"\p{L}+"), (words.NUMBER, r"\p{N}+"), (words.SPACE, r"\s+")):
        want = np.zeros(len(points), bool)
        for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            want[a:b] = True
        assert ((words.classes()[points] == kind) == want).all()


@pytest.mark.parametrize("module", [bpe, packing])
def test_encoders_equal_the_library(module, monkeypatch):
    monkeypatch.setattr(module, "MEMORY_WORDS", 300)  # so that words are forgotten, too
    path = bpe.tokenizer_path(module.DEFAULT_TOKENIZER)
    library = Tokenizer.from_file(path)
    few = bpe.Lexicon.mapped(bpe.Lexicon.compile({b" a": [1, 2], b"b": [3]})) if module is bpe else None
    encoder = bpe.Codec(bpe.Merges(path), None) if module is bpe else packing.Encoder(path)
    assert few is None or few.lookup([b" a", b"b", b"a"]) == [[1, 2], [3], None]
    for seed in range(15):
        t = texts(seed)
        ids, count = encoder.ids(pa.array([*t, None]))
        assert count[-1] == 0
        for text, got in zip(t, np.split(ids, np.cumsum(count)[:-1]), strict=False):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert all(len(x) == 0 for x in encoder.ids(pa.array([], pa.string())))


def test_merging_side_by_side_equals_one_by_one():
    m = bpe.Merges(bpe.tokenizer_path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    some = ["".join(rnd.choice("theinga r\u00e9") for _ in range(rnd.randint(1, 70))).encode() for _ in range(500)] + [b"x" * 3000]
    size = np.array([len(w) for w in some])
    ids, count = m.merge_all(np.frombuffer(b"".join(some), np.uint8), np.cumsum(size) - size, size)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [m.merge(w) for w in some]


def test_numbers_find_their_places():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**60, 5000))
    table = words.Numbers.build(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(np.setdiff1d(rng.integers(0, 2**60, 5000), keys)) == -1).all()
    assert (words.Numbers.build(np.empty(0, np.int64)).find(keys[:5]) == -1).all()


def test_word_hashes_tell_words_apart():
    t = [x.replace("\n", " ") for x in texts(9, 1000)] + ["x" * 500 + " y", "", "x" * 501, "ab", "ab\x00"]
    h, count = neardup.word_hashes(t)
    split = [w for x in t for w in x.split()]
    assert count.tolist() == [len(x.split()) for x in t]
    seen = dict(zip(split, h.tolist(), strict=True))
    assert [seen[w] for w in split] == h.tolist() and len(set(seen.values())) == len(seen)
