"""Components against all pairs of real shingle sets."""

import random
import re

import pytest

from editpulse.llm.graph import components
from editpulse.llm.near_dups import near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def brute(rows, size=4):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 100 * len(a & b) >= 80 * len(a | b) and a and b:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [random.choice(vocabulary) for _ in range(90)]
    rows = []
    for length in (3, 5, 9, 20, 64, 66, 80, 120, 400):
        base = [random.choice(vocabulary) for _ in range(length)]
        for copy in range(12):
            words = list(base)
            for _ in range(random.randint(0, max(1, length // 18))):
                words[random.randrange(length)] = random.choice(vocabulary) + "X" * (copy % 2)
            rows.append(" ".join(words))
    for i in range(150):  # dominated by one passage: many share most of a text and few are similar
        rows.append(" ".join(passage + [f"u{i}_{j}" for j in range(random.randint(4, 60))]))
    rows += [" ".join(random.choice(vocabulary) for _ in range(150)) for _ in range(40)]
    rows += [None, "", " \n", "one", "One", "one two", "É x y z", "é x y z"] + [rows[30]] * 7
    random.shuffle(rows)
    return list(enumerate(rows, 5))


def test_equals_all_pairs(spark):
    rows = corpus()
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, rep string, value int").repartition(5)
    assert sorted(map(tuple, near_duplicates(frame).collect())) == brute(rows)


def test_empty_and_missing_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    frame = spark.createDataFrame([(None, "a b c d e"), (None, "q"), (4, "A b c d e"), (4, "A b c d e"), (5, None)], "doc_id long, text string")
    got = sorted((tuple(x) for x in near_duplicates(frame).collect()), key=str)
    expected = [(None, 2, 4, False), (None, 1, None, True), (4, 2, 4, True), (4, 2, 4, True), (5, 0, 5, True)]
    assert got == sorted(expected, key=str)


@pytest.mark.parametrize("n", [1, 40])
def test_components_of_a_path(spark, n):
    random.seed(n)
    nodes = random.sample(range(1000), n + 1)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)) + [(7777, 7777), (None, 3)], "u long, v long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(x, min(nodes)) for x in nodes}
