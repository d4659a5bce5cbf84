"""Words of batches against regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from editpulse.llm import words as w

SAMPLES = [None, "", " ", "a", "a b", "Été  déjà\tvu\nx", "éé", "A1-b2_c3 ü", "\x0b\x0c\x0d", "x" * 700_000, "word " * 90_000, "\x1fa\x00b"]


@pytest.mark.parametrize(
    "inside, pattern",
    [(w.NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (w.LETTERS_DIGITS, rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")],
)
def test_words_equal_regular_expression(inside, pattern):
    random.seed(3)
    samples = SAMPLES + ["".join(random.choice("aB é\n.") for _ in range(random.randint(0, 40))) for _ in range(300)]
    random.shuffle(samples)
    texts = w.text_bytes(pa.array(samples).slice(2))
    found = w.words(texts, inside, lower=True)
    expected = [(i, m.group().lower()) for i, s in enumerate(samples[2:]) for m in re.finditer(pattern, (s or "").encode())]
    got = [(int(t), texts.data[a:b].tobytes().lower()) for t, a, b in zip(found.text, found.start, found.end, strict=True)]
    assert got == expected
    by_word = {}
    for (_, word), h in zip(got, found.hash.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    bounds = w.rows(found, len(texts))
    assert bounds[-1] == len(expected) and (np.diff(bounds) >= 0).all()


def test_slices_keep_all_rows():
    batch = pa.record_batch({"text": pa.array(["ab" * n for n in range(50)] + [None, "x" * 5000, ""])})
    parts = list(w.slices([batch], "text", 300))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert len(parts) > 5


def test_grams_depend_on_order_and_length():
    found = w.words(w.text_bytes(pa.array(["a b c", "b a c", "a b"])), w.NOT_SPACE)
    pairs = w.grams(found.hash, 2)[w.within(found, 2)]
    assert len(pairs) == 5 and pairs[0] == pairs[4] and pairs[0] != pairs[2]
    assert not set(w.grams(found.hash, 1)) & set(pairs)
