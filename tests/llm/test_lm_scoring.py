"""Scores against plain counting of word tuples."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from editpulse.llm import lm_scoring as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, order):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for _, t in rows]
    grams = lambda x: Counter(tuple(x[i : i + n]) for n in range(1, order + 1) for i in range(len(x) - n + 1))
    every = sum((grams(x) for x in texts), Counter())
    corpus = sum(map(len, texts))
    out = []
    for (d, _), x in zip(rows, texts, strict=True):
        own, total = grams(x), 0.0
        for i in range(len(x)):
            highest = min(order, i + 1)
            value = 0.4**highest / max(1, corpus - len(x))
            for n in range(highest, 0, -1):
                gram = tuple(x[i - n + 1 : i + 1])
                if every[gram] > own[gram]:
                    context = every[gram[:-1]] - own[gram[:-1]] if n > 1 else max(1, corpus - len(x))
                    value = 0.4 ** (highest - n) * (every[gram] - own[gram]) / context
                    break
            total += math.log(value)
        out.append((d, len(x), total))
    return sorted(out, key=str)


@pytest.mark.parametrize(("order", "ways"), [(1, {}), (2, {"block_bytes": 900, "bucket_bytes": 10_000}), (3, {"block_bytes": 300, "bucket_bytes": 700})])
def test_scores_equal_counting(spark, order, ways):
    random.seed(order)
    vocabulary = ["a", "B", "b", "c", "é", "d#", "e"] + [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(random.choice(vocabulary[: random.choice([4, 37])]) for _ in range(random.randint(0, 60)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "onlyhere"), (None, "a b c"), (None, "a b c"), rows[0], (93, "a b a b a b " * 400)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, block int, n int").repartition(3)
    got = sorted(((r.row.doc_id, r.n_words, r.log_score) for r in lm.score_texts(frame, order=order, **ways).collect()), key=str)
    expected = brute(rows, order)
    assert [x[:2] for x in sorted(got, key=str)] == [x[:2] for x in expected]
    key = lambda x: (str(x[0]), x[1], round(x[2], 6))
    assert np.allclose([x[2] for x in sorted(got, key=key)], [x[2] for x in sorted(expected, key=key)], rtol=1e-9)


def test_one_row_and_none(spark):
    frame = spark.createDataFrame([(1, "alone here")], "doc_id long, text string")
    assert [round(r.log_score, 9) for r in lm.score_texts(frame).collect()] == [round(math.log(0.4) + math.log(0.16), 9)]
    assert lm.score_texts(frame.limit(0)).collect() == []


def test_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm.unpack_sorted(lm.pack_sorted(keys)) == keys).all() and len(lm.unpack_sorted(lm.pack_sorted(keys[:0]))) == 0
    bounds = lm._bucket_bounds(keys, 7)
    assert bounds[0] == 0 and bounds[-1] == len(keys) and (np.diff(bounds) > 80).all()
