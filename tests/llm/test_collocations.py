"""Automata and collocations against counting in plain dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from editpulse.llm import collocations as co
from editpulse.llm import words as w


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_counts(rows):
    found = {}
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            spoken = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                for i in range(len(spoken) - n + 1):
                    key = ("und" if lang is None else lang, *spoken[i : i + n])
                    found[key] = found.get(key, 0) + 1
    return found


def plain_collocations(rows, top, least, covered):
    f = plain_counts(rows)
    n = Counter()
    for key, c in f.items():
        if len(key) == 2:
            n[key[0]] += c
    chosen = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = {}
    for (lang, *p), a in chosen.items():
        longer = [c for (other, *q), c in chosen.items() if other == lang and len(q) > len(p) and (q[: len(p)] == p or q[-len(p) :] == p)]
        if any(100 * c >= covered * a for c in longer):
            continue
        cuts = [(f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p))]
        s, _, x, y = min((1_000_000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), x, y))
    return sorted(
        (lang, k, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for k, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)
    )


def corpus(seed=3, size=120):
    rng = random.Random(seed)
    vocabulary = ["the", "New", "york", "York", "times", "é", "ße", "a", "b", "#", "x\x00y", "long" * 9]
    rows = []
    for _ in range(size):
        words = rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randrange(40))
        rows.append((rng.choice(["en", "de", None, ""]), "".join(x + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "!", "\xa0"]) for x in words)))
    return rows + [("en", None), ("en", ""), ("fr", " . "), ("de", "new york times " * 30)]


def spelt(counts):
    words, languages = [x.decode() for x in counts.words.to_pylist()], counts.languages.to_pylist()
    one = [(languages[a], words[b]) for a, b, _ in counts.one.tolist()]
    two = [(*one[a], words[b]) for a, b, _ in counts.two.tolist()]
    three = [(*two[a], words[b]) for a, b, _ in counts.three.tolist()]
    weights = np.concatenate([counts.one[:, 2], counts.two[:, 2], counts.three[:, 2]]).tolist()
    assert all(x == sorted(x, key=lambda k: [y.encode() for y in k]) for x in (one, two, three))
    return {k: c for k, c in zip(one + two + three, weights, strict=True) if c}


def counted(rows):
    return co.count(w.text_bytes(pa.array([t for _, t in rows], pa.string())), pa.array(["und" if x is None else x for x, _ in rows], pa.string()))


def test_transducers_keep_and_unite_counts():
    rows = corpus()
    parts = [counted(rows[k : k + 31]) for k in range(0, len(rows), 31)]
    again = [co.thaw(dict(zip(co._FIELDS, co.freeze(p), strict=True))) for p in parts]
    for k, p in enumerate(again):
        assert spelt(p) == plain_counts(rows[31 * k : 31 * k + 31])
    whole = co.unite(again)
    assert spelt(whole) == plain_counts(rows)
    divided = {}
    for _, p in co._divided(whole, 7):
        here = spelt(p)
        assert not set(here) & set(divided)
        divided |= here
    assert divided == plain_counts(rows)


def test_equal_states_are_shared():
    counts = counted([("en", "a x q, b x q, c x q, d x r")])
    target, bounds, arcs = co._freeze(counts.three[:, 0], counts.three[:, 1:], len(counts.two))
    assert len(bounds) - 1 == 3  # without arcs, to q, to r
    assert len(arcs) == 2


@pytest.mark.parametrize("ways", [{}, {"shard_bytes": 300, "range_bytes": 400, "width": 64}, {"shard_bytes": 300, "range_bytes": 200, "width": 3}])
def test_collocations_against_plain_program(spark, ways):
    rows = corpus()
    docs = spark.createDataFrame([(k, x, t, 1) for k, (x, t) in enumerate(rows)], "doc_id long, lang string, text string, score int").repartition(3)
    for least, covered, top in ((2, 50, 2000), (4, 80, 5)):
        got = sorted(tuple(r) for r in co.mine_collocations(docs, top, least, covered, **ways).collect())
        assert got == plain_collocations(rows, top, least, covered)


def test_products_beyond_64_bits():
    one = np.array([[0, 0, 4 * 10**12], [0, 1, 5 * 10**12]])
    counts = co.Counts(pa.array(["en"]), pa.array([b"a", b"b"]), one, np.array([[0, 1, 3 * 10**12]]), np.empty((0, 3), np.int64))
    answers = pa.table({"lang": ["en", "en"], "part": ["a", "b"], "weight": [4 * 10**12, 5 * 10**12], "longest": [None, None]})
    assert co._scored(counts, answers, 50) == [["en", "a b", 3 * 10**12, 4 * 10**12, 5 * 10**12, 450000]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert co.mine_collocations(docs).collect() == []
    assert co.mine_collocations(spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string")).collect() == []
