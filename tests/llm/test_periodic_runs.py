"""Lyndon arrays and runs against plain programs."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from editpulse.llm import periodic_runs as pr
from editpulse.llm import queries
from editpulse.llm import words as w


def plain_lyndon(x):
    """The longest Lyndon word at i ends before the next smaller suffix."""
    n = len(x)
    return [next((j - i for j in range(i + 1, n) if x[j:] < x[i:]), n - i) for i in range(n)]


def plain_runs(x, least=pr.MIN_WORDS):
    n, found = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and (i, length) not in found:
                found[i, length] = q
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(x for k, x in enumerate(words) if k not in gone)


def samples():
    rng = random.Random(5)
    for size in range(1, 40):
        for letters in (1, 2, 3, 6):
            yield [rng.randrange(letters) for _ in range(size)]
    a, b = [0], [0, 1]
    for _ in range(8):
        a, b = b, b + a
    yield b  # Fibonacci word
    yield [bin(k).count("1") % 2 for k in range(128)]
    yield list(range(60)) * 3 + [1] * 30 + list(range(60, 0, -1)) * 2


def test_lyndon_lengths_under_both_orders():
    for x in samples():
        assert pr.lyndon_lengths(np.array(x)) == plain_lyndon(x)
        other = [9999 - v for v in x]
        assert pr.lyndon_lengths(np.array(other)) == plain_lyndon(other)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_texts(least):
    lists = list(samples())
    words = [[f"é{v}" if v % 2 else f"w{v}" for v in x] for x in lists]
    found, runs = pr.word_runs(w.text_bytes(pa.array([" ".join(x) for x in words])), least)
    first = w.rows(found, len(lists))
    got = [(int(found.text[s]), int(s - first[found.text[s]]), int(length), int(q)) for s, length, q in runs.tolist()]
    assert got == [(t, *r) for t, x in enumerate(words) for r in plain_runs(x, least)]


def test_long_text_with_many_equal_words():
    text = "a " * 60_000 + " ".join(str(k % 4999) for k in range(20_000))
    _, runs = pr.word_runs(w.text_bytes(pa.array([text])))
    assert runs.tolist() == [[0, 60_000, 1], [60_000, 20_000, 4999]]


def test_odd_rows(spark):
    rows = [(1, None, 7), (None, "", 7), (3, " \n\t", 7), (3, " \n\t", 7), (4, "x  y\n" * 8 + "x", 7), (4, "q\xa0r " * 12, 7), (None, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((r.row.doc_id or 0, r.row.runs or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in pr.collapse_runs(docs).collect())
    assert got == sorted(
        [
            (1, 7, 0, [], ""), (0, 7, 0, [], ""), (3, 7, 0, [], ""), (3, 7, 0, [], ""), (4, 7, 17, [(0, 17, 2)], "x y"),
            (4, 7, 12, [(0, 12, 1)], "q\xa0r"), (0, 0, 2, [], "one two"),
        ]
    )
    assert pr.collapse_runs(docs.limit(0)).collect() == []


def test_query_against_plain_program(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert len(rows) == len(texts)
    seen = 0
    for r in rows:
        words = [x.decode() for x in (texts[r.doc_id] or "").encode().split()]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 1500:
            continue  # the plain program is quadratic
        runs = plain_runs(words)
        seen += len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert seen > 10


def test_names_tell_factors_apart():
    letters = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 2, 2], np.int64)
    for k, names in enumerate(pr._names(letters)):
        parts = [tuple(letters[i : i + (1 << k)]) for i in range(len(names))]
        assert len({(a, b) for a, b in zip(parts, names.tolist(), strict=True)}) == len(set(parts)) == len(set(names.tolist()))
