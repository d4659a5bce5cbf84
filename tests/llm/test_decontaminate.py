"""Leaks against a direct search of every window at every position."""

import random
import re

from editpulse.llm.decontaminate import find_leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(documents, benchmark):
    def words(t):
        return WORD.findall((t or "").translate(LOWER))

    out = []
    for d, text in documents:
        found, hit, names = words(text), set(), set()
        for i, item in benchmark:
            iw = words(item)
            n = min(10, len(iw))
            windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for k in range(len(found) - n + 1):
                if tuple(found[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names.add("null" if i is None else str(i))
        out.append((d, len(found), len(hit), sorted(names)))
    return sorted(out, key=str)


def test_equals_direct_search(spark):
    random.seed(5)
    vocabulary = [f"v{i}" for i in range(30)] + ["Ünï", "x9"]

    def some(n):
        return [random.choice(vocabulary) for _ in range(n)]

    benchmark = [(i, " ".join(some(random.choice([1, 3, 6, 9, 10, 11, 25, 60])))) for i in range(20)]
    benchmark += [(100, None), (101, ""), (102, benchmark[4][1]), (4, benchmark[4][1]), (None, " ".join(some(14)))]
    documents = []
    for d in range(120):
        words = some(random.choice([0, 4, 30, 200]))
        for _ in range(random.randint(0, 3)):
            item = (random.choice(benchmark)[1] or "").split()
            a = random.randint(0, len(item))
            part = item[a : a + random.randint(5, 30)]
            at = random.randint(0, len(words))
            words[at:at] = [x.upper() for x in part]
        documents.append((d, random.choice([" ", ", ", "\n"]).join(words)))
    documents += [(500, None), (501, ""), (None, " ".join(some(300))), (7, documents[7][1])]
    docs = spark.createDataFrame([(d, t, 1, "m") for d, t in documents], "doc_id long, text string, items int, mark string").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in benchmark], "item_id long, text string, key int")
    got = [(r.row.doc_id, r.n_words, r.n_hit, r["items"]) for r in find_leaks(docs, bench).collect()]
    assert sorted(got, key=str) == brute(documents, benchmark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = [(r.row.doc_id, r.n_words, r.n_hit, r["items"]) for r in find_leaks(docs, bench, ["doc_id"]).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(again, key=str) == sorted(got, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.row.doc_id, r.n_hit, r["items"]) for r in find_leaks(docs, none).collect()] == [(1, 0, [])]
    assert find_leaks(docs.limit(0), docs.select(docs.doc_id.alias("item_id"), "text")).collect() == []
